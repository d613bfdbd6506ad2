"""The canonical tables played on the given tables, once for Spark and once as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(k: str) -> Column:
    return F.lit(55.50) + (F.col(k).cast("long") * 7919 % 10007).cast("double") / F.lit(10007).cast("double") * 0.30


def lon(k: str) -> Column:
    return F.lit(37.30) + (F.col(k).cast("long") * 104729 % 10009).cast("double") / F.lit(10009).cast("double") * 0.60


def sql_lat(k: str) -> str:
    return f"(55.50::DOUBLE + (({k})::BIGINT * 7919 % 10007)::DOUBLE / 10007::DOUBLE * 0.30::DOUBLE)"


def sql_lon(k: str) -> str:
    return f"(37.30::DOUBLE + (({k})::BIGINT * 104729 % 10009)::DOUBLE / 10009::DOUBLE * 0.60::DOUBLE)"


def sql_metres(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"


def lots(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lots around 275 addresses; the final price and the number of bidders come from their lines; prices are missing without lines and for every ninth lot."""
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("lot_id")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("final_price"), F.count("*").alias("bidders"))
    nation = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("district"))
    o = table(spark, d, "orders").join(nation, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    o = o.withColumn("a", key % 275)
    o = o.select(
        key.alias("lot_id"), F.col("o_orderdate").cast("date").alias("sale_date"), F.col("o_totalprice").alias("start_price"), F.col("o_orderpriority").alias("trade_form"), "district",
        F.when(key % 7 == 0, 500000.0).otherwise(F.col("o_totalprice") * ((key % 4) * 5 + 5) / 100).alias("deposit"),
        (lat("a") + (key % 37 - 18).cast("double") * 0.0001).alias("lat"), (lon("a") + (key % 31 - 15).cast("double") * 0.0002).alias("lon"), F.concat(F.lit("addr "), F.col("a").cast("string")).alias("address_canon"), ((key % 180) + 10).cast("double").alias("area"),
    )
    o = o.join(line, "lot_id", "left").withColumn("final_price", F.when(F.col("lot_id") % 9 != 0, F.col("final_price")))
    return o.withColumn("excess", (F.col("final_price") - F.col("start_price")) / F.col("start_price") * 100)


LOTS = f"""li AS (SELECT l_orderkey AS lot_id, sum(l_extendedprice * (1 - l_discount)) AS final_price, count(*) AS bidders FROM lineitem GROUP BY 1),
lots AS (SELECT o_orderkey AS lot_id, o_orderdate::DATE AS sale_date, o_totalprice AS start_price, o_orderpriority AS trade_form, n_name AS district,
  CASE WHEN o_orderkey % 7 = 0 THEN 500000.0::DOUBLE ELSE o_totalprice * ((o_orderkey % 4) * 5 + 5) / 100 END AS deposit,
  {sql_lat("o_orderkey % 275")} + (o_orderkey % 37 - 18)::DOUBLE * 0.0001::DOUBLE AS lat, {sql_lon("o_orderkey % 275")} + (o_orderkey % 31 - 15)::DOUBLE * 0.0002::DOUBLE AS lon, 'addr ' || (o_orderkey % 275) AS address_canon, ((o_orderkey % 180) + 10)::DOUBLE AS area,
  CASE WHEN o_orderkey % 9 != 0 THEN li.final_price END AS final_price, li.bidders, CASE WHEN o_orderkey % 9 != 0 THEN (li.final_price - o_totalprice) / o_totalprice * 100 END AS excess
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN li ON li.lot_id = o_orderkey)"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Small lines by quarter as directory snapshots of suppliers, each with three branches at 250 addresses.

    Names come in two spellings, as a brand with a tail, or as a device that is no tenant; one rubric is that of parcel services.
    """
    x = table(spark, d, "lineitem").where("l_quantity <= 5")
    quarter = F.date_trunc("quarter", "l_shipdate")
    org, a = F.col("org_id"), ((F.col("l_suppkey") * 3 + F.col("l_partkey") % 3) % 250).alias("a")
    rows = x.select(F.date_format(quarter, "yyyy-MM").alias("snapshot_label"), F.last_day(quarter.cast("date")).alias("snapshot_date"), F.col("l_suppkey").alias("org_id"), a).distinct()
    text = org.cast("string")
    spelling = F.when((org % 10 == 3) & F.col("snapshot_label").endswith("-04"), "ORG ").when(org % 10 == 4, "OZON, пункт ").when(org % 10 == 5, "Банкомат ").otherwise("Org ")
    rubric = F.when(org % 7 == 6, "Грузоперевозки / Транспортные услуги, Склады").when(org % 7 == 5, "Аптеки").otherwise(F.concat(F.lit("Rubric "), (org % 7).cast("string")))
    address = F.concat(F.lit("addr "), F.col("a").cast("string"))
    return rows.select("snapshot_label", "snapshot_date", "org_id", F.concat(spelling, text).alias("org_name"), address.alias("address_norm"), address.alias("address_canon"), rubric.alias("rubric"),
                       F.lit(None).cast("string").alias("subrubric"), lat("a").alias("lat"), lon("a").alias("lon"))


SNAPSHOTS = f"""snaps0 AS (SELECT DISTINCT strftime(date_trunc('quarter', l_shipdate), '%Y-%m') AS snapshot_label, last_day(date_trunc('quarter', l_shipdate)::DATE) AS snapshot_date, l_suppkey AS org_id, (l_suppkey * 3 + l_partkey % 3) % 250 AS a FROM lineitem WHERE l_quantity <= 5),
snaps AS (SELECT snapshot_label, snapshot_date, org_id, CASE WHEN org_id % 10 = 3 AND snapshot_label LIKE '%-04' THEN 'ORG ' WHEN org_id % 10 = 4 THEN 'OZON, пункт ' WHEN org_id % 10 = 5 THEN 'Банкомат ' ELSE 'Org ' END || org_id AS org_name,
  'addr ' || a AS address_canon, CASE WHEN org_id % 7 = 6 THEN 'Грузоперевозки / Транспортные услуги, Склады' WHEN org_id % 7 = 5 THEN 'Аптеки' ELSE 'Rubric ' || (org_id % 7) END AS rubric, {sql_lat("a")} AS lat, {sql_lon("a")} AS lon FROM snaps0)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Customers as lots on the map."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("lot_id"), lat("c_custkey").alias("lat"), lon("c_custkey").alias("lon"), ((k % 50) * 5 + 10).cast("double").alias("area"), (k % 4).cast("string").alias("floor"), (k % 3).cast("string").alias("entrance"))


POINTS = f"points AS (SELECT c_custkey AS lot_id, {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS lon, ((c_custkey % 50) * 5 + 10)::DOUBLE AS area, (c_custkey % 4)::VARCHAR AS floor, (c_custkey % 3)::VARCHAR AS entrance FROM customer)"


def listings(spark: SparkSession, d: str, prefix: str = "l_") -> DataFrame:
    """Parts as listings on the map."""
    k = F.col("p_partkey")
    cols = {"area": (F.col("p_size") * 5).cast("double"), "price": F.col("p_retailprice") * 100, "type": F.col("p_type"), "floor": (k % 4).cast("string"), "entrance": (k % 3).cast("string"), "lat": lat("p_partkey"), "lon": lon("p_partkey")}
    return table(spark, d, "part").select(k.alias("url"), *[c.alias(prefix + n) for n, c in cols.items()])


LISTINGS = f"listings AS (SELECT p_partkey AS url, (p_size * 5)::DOUBLE AS l_area, p_retailprice * 100 AS l_price, p_type AS l_type, (p_partkey % 4)::VARCHAR AS l_floor, (p_partkey % 3)::VARCHAR AS l_entrance, {sql_lat('p_partkey')} AS l_lat, {sql_lon('p_partkey')} AS l_lon FROM part)"
PAIRS = f"pairs AS (SELECT *, {sql_metres('lat', 'lon', 'l_lat', 'l_lon')} AS distance_m FROM points, listings)"
