"""Readers with declared schemas, and sinks with a fixed column order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctra.functions import columns as C
from auctra.operators.lots import match_class

TENDERS = (
    "id long, startPrice double, pagePrice double, objectArea double, pricePerSquare double, address string, regionName string, districtName string, floors int, tradeForm string, requestEndDate string, "
    "platformLink string, coords array<double>, coordsText string, ignoreCoords boolean, subwayStations array<struct<subwayStationName:string,walkingTime:int>>, "
    "additionalParams array<struct<name:string,value:string>>, functionalityPurposes array<string>, entranceTypeCodes array<string>"
)
PROTOCOL = "struct<participants_count:int,winner_price_num:double,second_price_num:double,start_price:string,auction_duration:string,error:string>"
HOUSE_UNITS = ["fias", "area_total", "area_living", "unit_type", "unit_no", "address"]


def _text_columns(names: list[str]) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def read_csv(spark: SparkSession, path, names: list[str], sep: str = ",") -> DataFrame:
    """All columns as text by name; casts are a second projection. A byte-order mark is dropped by the reader."""
    return spark.read.option("sep", sep).option("header", True).option("enforceSchema", False).schema(_text_columns(names)).csv(path)


def read_by_header(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """All columns as text under the file's own header names (alternative headers)."""
    return spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)


def headers(spark: SparkSession, path) -> list[tuple[str, list[str]]]:
    """(first line, files that begin with it) of text files."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).where("start = 0")
    first = lines.groupBy("file").agg(F.min_by("value", "line").alias("header"))
    return [(r["header"].lstrip("\ufeff"), sorted(r["files"])) for r in first.groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").collect()]


def read_declared(spark: SparkSession, path, schema: str | T.StructType, sep: str = ",", names: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of delimited files under a declared schema, whatever the order of their columns.

    A record is one line. ``names``: other headers of a column. Columns that a file lacks are null, further ones are left out. A record with another number
    of fields than its header, or with a text that is no value of its column's type, is rejected: (source_file, record, reason).
    """
    fields = schema.fields if isinstance(schema, T.StructType) else T._parse_datatype_string(schema).fields
    good = bad = None
    for header, files in headers(spark, path):
        given = [x.strip().strip('"') for x in header.split(sep)]
        cut = lambda n, *more: ", ".join([f"c{i} string" for i in range(n)] + list(more))
        lines = spark.read.text(files).select(F.regexp_replace("value", "^\ufeff", "").alias("record"), F.col("_metadata.file_name").alias("source_file"))
        lines = lines.where((F.col("record") != header) & (F.trim("record") != ""))
        options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record"}
        # Fewer fields than the header are told by the reader, more by one column too many.
        rows = lines.select("source_file", "record", F.from_csv("record", cut(len(given), "_record string"), options).alias("p"), F.from_csv("record", cut(len(given) + 1), {"sep": sep})[f"c{len(given)}"].alias("beyond"))
        rows = rows.select("source_file", "record", "p.*", "beyond")
        place = {f.name: next((i for x in [f.name, *(names or {}).get(f.name, [])] if x in given for i in [given.index(x)]), None) for f in fields}
        own = {f.name: F.lit(None).cast("string") if place[f.name] is None else C.blank_to_null(f"c{place[f.name]}") for f in fields}
        wrong = [F.when(own[f.name].isNotNull() & own[f.name].try_cast(f.dataType).isNull(), F.lit(f.name)) for f in fields]
        reason = F.when(F.col("_record").isNotNull() | F.col("beyond").isNotNull(), "fields").otherwise(C.blank_to_null(F.concat_ws(",", *wrong)))
        rows = rows.select("source_file", "record", reason.alias("reason"), *[own[f.name].try_cast(f.dataType).alias(f"v_{f.name}") for f in fields])
        right = rows.where("reason IS NULL").select(*[F.col(f"v_{f.name}").alias(f.name) for f in fields], "source_file")
        left = rows.where("reason IS NOT NULL").select("source_file", "record", "reason")
        good, bad = (right, left) if good is None else (good.unionByName(right), bad.unionByName(left))
    if good is None:
        none = T.StructType([*fields, T.StructField("source_file", T.StringType())])
        return spark.createDataFrame([], none), spark.createDataFrame([], "source_file string, record string, reason string")
    return good, bad


#: Declared schemas of the two listings of SURVEY 1.4 that come as delimited text, and other headers of their columns.
LOTS = "lot_id string, url string, area_m2 double, start_price double, final_price double, deposit double, bid_step double, address string, cadastral_no string, floor string, floors_total int, purpose string, entrance string, trade_form string, trade_year int, lat double, lon double"
LISTINGS = "url string, title string, price double, params string, date date, lat double, lng double, source string, address string"


def with_provenance(df: DataFrame, label: str | None = None) -> DataFrame:
    """Source file, snapshot label (from the path unless given), its date (last day) and the format."""
    name = F.col("_metadata.file_name")
    found = F.lit(label) if label else F.regexp_extract(F.col("_metadata.file_path"), r"(20\d\d-\d\d)", 1)
    return df.select("*", name.alias("source_file"), found.alias("snapshot_label"), F.lower(F.regexp_extract(name, r"\.(\w+)$", 1)).alias("source_format")).withColumn("snapshot_date", C.snapshot_date("snapshot_label"))


def read_snapshot(spark: SparkSession, path, label: str | None = None, sep: str = ";") -> DataFrame:
    return with_provenance(read_by_header(spark, path, sep), label)


def read_snapshots(spark: SparkSession, paths: list[str], sep: str = ";") -> DataFrame:
    """Many files or folders of districts and months as one table."""
    return read_snapshot(spark, paths, None, sep)


def read_lots(spark: SparkSession, path) -> DataFrame:
    return read_by_header(spark, path)


def read_listings(spark: SparkSession, path) -> DataFrame:
    return read_by_header(spark, path, ";")


def read_house_units(spark: SparkSession, path, names: list[str] = HOUSE_UNITS) -> DataFrame:
    """Register files, pipe-separated; only the needed columns."""
    return read_by_header(spark, path, "|").select(*names)


def read_buildings(spark: SparkSession, path, cols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def write_buildings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_tenders(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("multiLine", True).schema(TENDERS).json(path)


def read_protocols(spark: SparkSession, path) -> DataFrame:
    """A JSON object by lot id, as rows; records with an error are left out."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", f"map<string,{PROTOCOL}>")).alias("lot_id", "p")).select("lot_id", "p.*")
    return rows.where(C.blank_to_null("error").isNull()).drop("error")


def read_progress(spark: SparkSession, path, schema: str = "url string, entrance string, status string, ts string") -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_ids(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("lot_id")).where("lot_id != ''")


def ids_from_files(spark: SparkSession, path, pattern: str = r"(\d+)") -> DataFrame:
    """Ids in file names; the files themselves are not read."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1).alias("lot_id")).where("lot_id != ''").distinct()


def sniff_doc_type(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("doc_type", C.sniff_doc_type(content))


def read_opendata_csv(spark: SparkSession, path, numeric: list[str], sep: str = ";") -> DataFrame:
    """CSV whose second line is a translated header: rows whose numeric column is no number are dropped."""
    df = read_by_header(spark, path, sep)
    for c in numeric:
        df = df.withColumn(c, C.to_double(c))
    return df.where(F.col(numeric[0]).isNotNull())


def write_table(df: DataFrame, path: str, cols: list[str], fmt: str = "parquet") -> None:
    w = df.select(*cols).write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


def export_by_match_class(df: DataFrame, path: str) -> None:
    """One folder per class: new_business, existing_tenant, not_found."""
    df.withColumn("match_class", match_class()).write.mode("overwrite").partitionBy("match_class").parquet(path)


def export_filtered(df: DataFrame, path: str, **criteria) -> None:
    from auctra.operators.lots import filter_lots

    filter_lots(df, **criteria).write.mode("overwrite").option("header", True).csv(path)
