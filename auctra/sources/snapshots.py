"""Directory snapshots as one table: a partition a month, buckets by address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lets a join on (address, ..) use the buckets of the address, as (key, value) of the session.
CO_PARTITION = ("spark.sql.requireAllClusterKeysForCoPartition", "false")


def attach(spark: SparkSession, name: str, folder: str, schema: str | T.StructType, buckets: int = 16, label: str = "snapshot_label", by: str = "address_canon") -> None:
    """Declares the table over its folder; what the folder already holds is found again."""
    fields = schema.fields if isinstance(schema, T.StructType) else T._parse_datatype_string(schema).fields
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({label}) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{folder}'")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    spark.sql(f"MSCK REPAIR TABLE {name}")


def put(rows: DataFrame, name: str) -> None:
    """Writes whole months: a month that is there is replaced, others are not touched."""
    spark = rows.sparkSession
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        rows.select(*spark.table(name).columns).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(key, before)


def months(spark: SparkSession, name: str) -> list[str]:
    """Labels of the months that are there, from the catalog."""
    return sorted(r[0].partition("=")[2] for r in spark.sql(f"SHOW PARTITIONS {name}").collect())


def newcomers(spark: SparkSession, name: str, label: str) -> DataFrame:
    """Organisations of a month that the month before does not have, by address and lower-cased name; none in the first month.

    Both months are read by partition, bucket with bucket, so the table is not shuffled (with ``CO_PARTITION``).
    """
    before = [m for m in months(spark, name) if m < label]
    now = spark.table(name).where(F.col("snapshot_label") == label)
    if not before:
        return now.limit(0)
    old = spark.table(name).where(F.col("snapshot_label") == before[-1]).select(F.col("address_canon").alias("b_address"), F.lower("org_name").alias("b_name"))
    return now.join(old, (F.col("address_canon") == F.col("b_address")) & F.lower("org_name").eqNullSafe(F.col("b_name")), "left_anti")
