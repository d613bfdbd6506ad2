"""Registered queries over the given tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auctra.functions import columns as C
from auctra.functions import vocab as V
from auctra.functions.geo import distance_to
from auctra.operators import lots as L
from auctra.operators import matching as M
from auctra.operators import reach as Q
from auctra.operators import spatial as S
from auctra.operators import stats as A
from auctra.plans.given import LISTINGS, LOTS, PAIRS, POINTS, SNAPSHOTS, listings, lots, points, snapshots, sql_lat, sql_lon, sql_metres, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def r(c: Column | str, n: int = 4) -> Column:
    return F.round(c, n)


# Auction statistics


@query(f"""WITH {LOTS} SELECT district, date_trunc('month', sale_date)::DATE AS month, count(*) AS n, count(final_price) AS sold, round(avg(excess), 4) AS mean_excess,
round(count(final_price) * 100.0::DOUBLE / count(*), 4) AS success_pct FROM lots GROUP BY 1, 2""")
def district_month_excess(spark, d):
    out = lots(spark, d).groupBy("district", F.trunc("sale_date", "month").alias("month"))
    return out.agg(F.count("*").alias("n"), F.count("final_price").alias("sold"), r(F.avg("excess")).alias("mean_excess"), r(F.count("final_price") / F.count("*") * 100).alias("success_pct"))


@query(f"""WITH {LOTS} SELECT count(*) AS n, count(final_price) AS sold, round(avg(start_price), 4) AS mean_start, round(avg(final_price), 4) AS mean_final, round(avg(excess), 4) AS mean_excess, round(median(excess), 4) AS median_excess, round(avg(bidders), 4) AS mean_bidders FROM lots""")
def auction_overview(spark, d):
    return A.segment_stats(lots(spark, d), [], {"sold": F.count("final_price"), "mean_start": r(F.avg("start_price")), "mean_final": r(F.avg("final_price")), "mean_excess": r(F.avg("excess")), "median_excess": r(F.median("excess")), "mean_bidders": r(F.avg("bidders"))})


@query(f"WITH {LOTS} SELECT bidders, count(*) AS n, round(avg(excess), 4) AS mean_excess, round(median(excess), 4) AS median_excess, round(max(excess), 4) AS max_excess FROM lots GROUP BY 1")
def excess_by_bidders(spark, d):
    return A.segment_stats(lots(spark, d), ["bidders"], {"mean_excess": r(F.avg("excess")), "median_excess": r(F.median("excess")), "max_excess": r(F.max("excess"))})


@query(f"""WITH {LOTS} SELECT CASE WHEN bidders IS NULL THEN 'no protocol' WHEN bidders <= 1 THEN '1' WHEN bidders <= 3 THEN '2-3' WHEN bidders <= 5 THEN '4-5' ELSE '6+' END AS bidder_range, count(*) AS n, round(avg(excess), 4) AS mean_excess FROM lots GROUP BY 1""")
def excess_by_bidder_range(spark, d):
    label = F.coalesce(C.bucket("bidders", [1, 3, 5], ["1", "2-3", "4-5", "6+"]), F.lit("no protocol"))
    return A.segment_stats(lots(spark, d), [label.alias("bidder_range")], {"mean_excess": r(F.avg("excess"))})


@query(f"WITH {LOTS} SELECT district, count(*) AS n, round(avg(final_price), 4) AS mean_final, round(avg(bidders), 4) AS mean_bidders, round(count(final_price) * 100.0::DOUBLE / count(*), 4) AS success_pct, round(quantile_cont(excess, 0.25), 4) AS p25, round(quantile_cont(excess, 0.75), 4) AS p75 FROM lots GROUP BY 1 HAVING count(*) >= 5")
def district_stats(spark, d):
    return A.segment_stats(lots(spark, d), ["district"], {"mean_final": r(F.avg("final_price")), "mean_bidders": r(F.avg("bidders")), "success_pct": r(F.count("final_price") / F.count("*") * 100), "p25": r(F.percentile("excess", 0.25)), "p75": r(F.percentile("excess", 0.75))}, min_n=5)


@query(f"WITH {LOTS}, g AS (SELECT district, avg(excess) AS m FROM lots GROUP BY 1) SELECT arg_max(district, m) AS best, arg_min(district, m) AS worst, round(max(m), 4) AS best_excess, round(min(m), 4) AS worst_excess FROM g")
def extreme_districts(spark, d):
    g = lots(spark, d).groupBy("district").agg(F.avg("excess").alias("m"))
    return g.agg(F.max_by("district", "m").alias("best"), F.min_by("district", "m").alias("worst"), r(F.max("m")).alias("best_excess"), r(F.min("m")).alias("worst_excess"))


@query(f"WITH {LOTS} SELECT CASE WHEN grouping(trade_form) = 1 THEN 'all' ELSE trade_form END AS trade_form, count(*) AS n, count(final_price) AS sold, round(avg(excess), 4) AS mean_excess FROM lots GROUP BY ROLLUP (trade_form)")
def form_totals(spark, d):
    return A.form_totals(lots(spark, d), "trade_form", {"sold": F.count("final_price"), "mean_excess": r(F.avg("excess"))})


@query(f"WITH {LOTS} SELECT year(sale_date)::INTEGER AS year, " + ", ".join(f"count(*) FILTER (trade_form = '{x}') AS \"{x}\"" for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM lots GROUP BY 1")
def form_year_pivot(spark, d):
    forms = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return lots(spark, d).groupBy(F.year("sale_date").alias("year")).pivot("trade_form", forms).agg(F.count(F.lit(1))).fillna(0, forms)


_DEPOSIT = "CASE WHEN deposit IS NULL THEN 'none' WHEN abs(deposit - 500000) < 1 THEN 'fixed 500k' WHEN pct IS NULL THEN 'unknown percent' WHEN pct < 5 THEN '1-5%' WHEN pct < 10 THEN '5-10%' WHEN abs(pct - 10) < 0.5 THEN '10%' WHEN pct < 20 THEN '10-20%' ELSE '20%+' END"
_EVASION = f"{LOTS}, ev AS (SELECT *, round_even(deposit / start_price * 100, 1) AS pct, bidders >= 2 AND final_price IS NULL AS evaded FROM lots), ty AS (SELECT *, {_DEPOSIT} AS deposit_type FROM ev)"


def _evasion(spark, d):
    return L.evasion_flags(lots(spark, d)).withColumn("deposit_type", C.deposit_type("deposit", "start_price")).withColumnRenamed("evasion", "evaded")


@query(f"WITH {_EVASION} SELECT deposit_type, count(*) AS n, count(*) FILTER (evaded) AS evaded_n, round(count(*) FILTER (evaded) * 100.0::DOUBLE / count(*), 4) AS evasion_pct, round(avg(bidders), 4) AS mean_bidders FROM ty GROUP BY 1")
def evasion_by_deposit(spark, d):
    return A.segment_stats(_evasion(spark, d), ["deposit_type"], {"evaded_n": F.count_if("evaded"), "evasion_pct": r(A.share(F.col("evaded"))), "mean_bidders": r(F.avg("bidders"))})


@query(f"WITH {_EVASION} SELECT deposit_type, " + ", ".join(f"CASE WHEN count(*) FILTER (bidders = {i}) >= 3 THEN round(count(*) FILTER (bidders = {i} AND evaded) * 100.0::DOUBLE / count(*) FILTER (bidders = {i}), 4) END AS \"{i}\"" for i in range(1, 7)) + " FROM ty GROUP BY 1")
def evasion_pivot(spark, d):
    return A.evasion_pivot(_evasion(spark, d), "deposit_type", "bidders", list(range(1, 7)), r(A.share(F.col("evaded"))))


_BINS = [("< 50k", 0.0, 50e3), ("50k-100k", 50e3, 100e3), ("100k+", 100e3, 1e12), ("fixed", 499999.0, 500001.0)]


@query(f"WITH {LOTS}, b(label, lo, hi) AS (VALUES {', '.join(f'({x[0]!r}, {x[1]}::DOUBLE, {x[2]}::DOUBLE)' for x in _BINS)}) SELECT label, count(*) AS n, round(avg(deposit), 4) AS mean_deposit, min(deposit) AS min_deposit, max(deposit) AS max_deposit FROM lots JOIN b ON deposit >= lo AND deposit < hi GROUP BY 1")
def deposit_bins(spark, d):
    bins = spark.createDataFrame(_BINS, "label string, lo double, hi double")
    return A.bin_join(lots(spark, d), bins, "deposit").groupBy("label").agg(F.count("*").alias("n"), r(F.avg("deposit")).alias("mean_deposit"), F.min("deposit").alias("min_deposit"), F.max("deposit").alias("max_deposit"))


_CORR = [("bidders", "excess"), ("bidders", "start_price"), ("bidders", "area"), ("excess", "start_price"), ("excess", "area"), ("start_price", "area")]


@query(f"WITH {LOTS} " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 4) AS r FROM lots" for a, b in _CORR))
def correlations(spark, d):
    return A.correlations(lots(spark, d), ["bidders", "excess", "start_price", "area"]).withColumn("r", r("r"))


@query(f"WITH {LOTS} SELECT year(sale_date)::INTEGER AS year, count(*) AS n, round(median(start_price), 4) AS median_start, count(*) FILTER (excess > 0) AS above, count(*) FILTER (excess < 0) AS below, count(*) FILTER (excess > 50) AS above50, count(*) FILTER (excess > 100) AS above100 FROM lots GROUP BY 1")
def yearly_stats(spark, d):
    x = F.col("excess")
    return A.segment_stats(lots(spark, d), [F.year("sale_date").alias("year")], {"median_start": r(F.median("start_price")), "above": F.count_if(x > 0), "below": F.count_if(x < 0), "above50": F.count_if(x > 50), "above100": F.count_if(x > 100)})


@query(f"WITH {LOTS} SELECT trade_form, count(*) AS n, count(*) FILTER (excess < 0) AS below, round(count(*) FILTER (excess < 0) * 100.0::DOUBLE / count(*), 4) AS below_pct, round(avg(excess) FILTER (excess < 0), 4) AS mean_below FROM lots GROUP BY 1")
def negative_excess(spark, d):
    low = F.col("excess") < 0
    return A.segment_stats(lots(spark, d), ["trade_form"], {"below": F.count_if(low), "below_pct": r(A.share(low)), "mean_below": r(F.avg(F.when(low, F.col("excess"))))})


@query(f"WITH {LOTS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_n, round(min({c})::DOUBLE, 4) AS min, round(median({c})::DOUBLE, 4) AS median, round(max({c})::DOUBLE, 4) AS max, round(corr({c}, excess), 4) AS r FROM lots" for c in ("area", "bidders", "start_price")))
def column_profile(spark, d):
    p = A.profile(lots(spark, d), ["area", "bidders", "start_price"], "excess")
    return p.select("feature", "nulls", "distinct_n", *[r(c).alias(c) for c in ("min", "median", "max", "r")])


@query(f"WITH {LOTS} SELECT district, count(*) AS n, round(quantile_cont(excess, 0.25), 4) AS p25, round(median(excess), 4) AS p50, round(quantile_cont(excess, 0.75), 4) AS p75 FROM lots GROUP BY 1 ORDER BY n DESC, district LIMIT 10")
def category_spread(spark, d):
    return A.category_spread(lots(spark, d), "district", "excess").select("district", "n", *[r(c).alias(c) for c in ("p25", "p50", "p75")])


@query(f"WITH {LOTS} SELECT (floor(greatest(least(excess, 150.0), -100.0) / 10) * 10)::DOUBLE AS bin, count(*) AS n FROM lots WHERE excess IS NOT NULL GROUP BY 1")
def excess_histogram(spark, d):
    return A.histogram(lots(spark, d), "excess", 10, -100.0, 150.0)


@query(f"WITH {LOTS} SELECT coalesce(bidders::VARCHAR, 'missing') AS value, count(*) AS n FROM lots GROUP BY 1")
def value_counts(spark, d):
    return A.value_counts(lots(spark, d), "bidders")


@query("WITH n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT count(*) AS groups, count(*) FILTER (n > 1) AS repeated, median(n)::DOUBLE AS median_n, max(n) AS max_n FROM n")
def group_sizes(spark, d):
    return A.group_sizes(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query(f"WITH {LOTS} SELECT lot_id, district, round(excess, 4) AS excess FROM lots WHERE excess IS NOT NULL ORDER BY lots.excess DESC, lot_id LIMIT 15")
def top_lots(spark, d):
    return A.top_n(lots(spark, d).where("excess IS NOT NULL"), [F.desc("excess"), "lot_id"], 15).select("lot_id", "district", r("excess").alias("excess"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 10")
def top_categories(spark, d):
    return A.top_n(table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), [F.desc("n"), "p_brand", "p_type"], 10)


@query("SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500")
def stable_sample(spark, d):
    return A.stable_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("WITH g AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT p_type, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 4) AS share FROM g")
def share_of_total(spark, d):
    return A.share_of_total(table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")), "n").withColumn("share", r("share"))


@query(f"WITH {LOTS} SELECT lot_id, count(*) OVER (PARTITION BY address_canon, sale_date) > 1 AS multilot FROM lots")
def multilot_flag(spark, d):
    x = lots(spark, d).select("lot_id", F.concat_ws("|", "address_canon", "sale_date").alias("k"))
    return A.multilot_flag(x, "k").drop("k")


@query(f"WITH {SNAPSHOTS}, l AS (SELECT DISTINCT snapshot_label FROM snaps) SELECT snapshot_label, lag(snapshot_label) OVER (ORDER BY snapshot_label) AS previous_label FROM l")
def previous_snapshots(spark, d):
    return A.previous_snapshot(snapshots(spark, d))


@query("""WITH w AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS c, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS t FROM lineitem)
SELECT l_suppkey, min(v) AS weighted_median FROM w WHERE c >= t / 2 GROUP BY 1""")
def weighted_median(spark, d):
    return A.weighted_median(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")


_UNITS = f"""u AS (SELECT l_orderkey * 100 + l_linenumber AS url, l_quantity * 5 AS area, l_linenumber AS floor, l_shipdate AS date, {sql_lat('l_partkey % 500')} AS lat, {sql_lon('l_partkey % 500')} AS lon, l_partkey, l_suppkey FROM lineitem)"""


@query(f"""WITH {_UNITS}, k AS (SELECT *, round_even(lat * 2000, 0)::BIGINT || '_' || round_even(lon * 2000, 0)::BIGINT AS place, CASE WHEN area < 15 THEN round_even(area, 0) ELSE round_even(area / 5, 0) * 5 END AS size FROM u),
x AS (SELECT *, row_number() OVER (PARTITION BY place, floor, size ORDER BY date DESC, url, l_partkey, l_suppkey) AS rn FROM k) SELECT url, area, floor, date FROM x WHERE rn = 1""")
def dedup_listings(spark, d):
    from auctra.plans.given import lat, lon

    x = table(spark, d, "lineitem").withColumn("k", F.col("l_partkey") % 500)
    x = x.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("url"), (F.col("l_quantity") * 5).alias("area"), F.col("l_linenumber").alias("floor"), F.col("l_shipdate").alias("date"), lat("k").alias("lat"), lon("k").alias("lon"))
    return A.dedup_listings(x).select("url", "area", "floor", "date")


@query("""WITH a AS (SELECT unnest(range(0, 21)) / 20.0::DOUBLE AS alpha), m AS (SELECT alpha, avg(abs((alpha * l_extendedprice + (1 - alpha) * l_quantity * 1000 - l_quantity * 1500) / (l_quantity * 1500) * 100)) AS mape FROM lineitem, a GROUP BY 1)
SELECT alpha, round(mape, 4) AS mape FROM m ORDER BY m.mape, alpha LIMIT 1""")
def best_blend(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1000).alias("b"), (F.col("l_quantity") * 1500).alias("t"))
    return A.best_blend(x, "a", "b", "t").withColumn("mape", r("mape"))


# Spatial joins


@query(f"WITH {POINTS}, {LISTINGS}, {PAIRS} SELECT lot_id, url, round(distance_m, 3) AS distance_m FROM pairs WHERE distance_m <= 1500")
def radius_pairs(spark, d):
    return S.radius_join(points(spark, d), listings(spark, d), 1500, right_at=("l_lat", "l_lon")).select("lot_id", "url", r("distance_m", 3).alias("distance_m"))


@query(f"WITH {POINTS}, s AS (SELECT s_suppkey, {sql_lat('s_suppkey')} AS r_lat, {sql_lon('s_suppkey')} AS r_lon FROM supplier), x AS (SELECT lot_id, s_suppkey, {sql_metres('lat', 'lon', 'r_lat', 'r_lon')} AS distance_m FROM points, s), y AS (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY distance_m, s_suppkey)::INTEGER AS rank FROM x) SELECT lot_id, rank, s_suppkey, round(distance_m, 3) AS distance_m FROM y WHERE rank <= 3")
def nearest_stations(spark, d):
    from auctra.plans.given import lat, lon

    s = table(spark, d, "supplier").select("s_suppkey", lat("s_suppkey").alias("r_lat"), lon("s_suppkey").alias("r_lon"))
    return S.nearest(points(spark, d), s, "lot_id", "s_suppkey", k=3).select("lot_id", "rank", "s_suppkey", r("distance_m", 3).alias("distance_m"))


@query(f"WITH {POINTS}, s AS (SELECT s_suppkey, s_name, {sql_lat('s_suppkey')} AS r_lat, {sql_lon('s_suppkey')} AS r_lon FROM supplier), x AS (SELECT lot_id, s_suppkey, s_name, {sql_metres('lat', 'lon', 'r_lat', 'r_lon')} AS m FROM points, s), y AS (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY m, s_suppkey) AS rn FROM x WHERE m <= 1500) SELECT p.lot_id, coalesce(y.m <= 500, false) AS near, round(y.m, 3) AS near_m, y.s_name AS near_name FROM points p LEFT JOIN y ON y.lot_id = p.lot_id AND y.rn = 1")
def near_schools(spark, d):
    from auctra.plans.given import lat, lon

    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_id"), F.col("s_name").alias("p_name"), lat("s_suppkey").alias("p_lat"), lon("s_suppkey").alias("p_lon"))
    return S.flag_near(points(spark, d), s, 500, 1500).select("lot_id", "near", r("near_m", 3).alias("near_m"), "near_name")


@query(f"WITH {POINTS}, {LISTINGS}, {PAIRS} SELECT p.lot_id, coalesce(sum(x.l_area) FILTER (x.distance_m <= 800), 0)::DOUBLE AS sum_800, coalesce(sum(x.l_area) FILTER (x.distance_m <= 1600), 0)::DOUBLE AS sum_1600 FROM points p LEFT JOIN pairs x ON x.lot_id = p.lot_id AND x.distance_m <= 1600 GROUP BY 1")
def radius_residents(spark, d):
    return S.radius_sum(points(spark, d), listings(spark, d), "lot_id", "l_area", [800, 1600], right_at=("l_lat", "l_lon")).select("lot_id", "sum_800", "sum_1600")


@query(f"""WITH {POINTS}, {LISTINGS}, {PAIRS}, m AS (SELECT lot_id, count(*) FILTER (distance_m <= 1000) AS n_1000, count(*) AS n_2000, median(l_price) FILTER (distance_m <= 1000) AS m1, median(l_price) AS m2,
count(*) FILTER (l_floor = floor) AS s2, median(l_price) FILTER (l_floor = floor) AS ms2, count(*) FILTER (l_floor = floor AND distance_m <= 1000) AS s1, median(l_price) FILTER (l_floor = floor AND distance_m <= 1000) AS ms1 FROM pairs WHERE distance_m <= 2000 GROUP BY 1)
SELECT p.lot_id, coalesce(n_1000, 0) AS n_1000, coalesce(n_2000, 0) AS n_2000, round(CASE WHEN n_1000 >= 2 THEN m1 END, 4) AS median_1000, round(CASE WHEN n_2000 >= 2 THEN m2 END, 4) AS median_2000,
round(coalesce(CASE WHEN s1 >= 2 THEN ms1 END, CASE WHEN n_1000 >= 2 THEN m1 END), 4) AS median_same_1000, round(coalesce(CASE WHEN s2 >= 2 THEN ms2 END, CASE WHEN n_2000 >= 2 THEN m2 END), 4) AS median_same_2000 FROM points p LEFT JOIN m ON m.lot_id = p.lot_id""")
def radius_medians(spark, d):
    out = S.radius_median(points(spark, d), listings(spark, d), "lot_id", "l_price", [1000, 2000], same=("floor", "l_floor"), right_at=("l_lat", "l_lon"))
    return out.select("lot_id", "n_1000", "n_2000", *[r(c).alias(c) for c in ("median_1000", "median_2000", "median_same_1000", "median_same_2000")])


@query(f"WITH {POINTS}, q AS (SELECT lot_id AS o, lat AS r_lat, lon AS r_lon FROM points) SELECT p.lot_id, count(*) - 1 AS neighbours FROM points p, q WHERE {sql_metres('lat', 'lon', 'r_lat', 'r_lon')} <= 1500 GROUP BY 1")
def radius_neighbours(spark, d):
    return S.radius_count(points(spark, d), "lot_id", 1500).select("lot_id", "neighbours")


@query(f"WITH {POINTS} SELECT lot_id, round({sql_metres('lat', 'lon', '55.7558::DOUBLE', '37.6173::DOUBLE')}, 3) AS centre_m FROM points")
def distance_to_centre(spark, d):
    return points(spark, d).select("lot_id", r(distance_to("lat", "lon", (55.7558, 37.6173)), 3).alias("centre_m"))


@query(f"WITH {POINTS}, {LISTINGS}, {PAIRS}, x AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY distance_m, lot_id) AS rn FROM pairs WHERE distance_m <= 2000 AND l_area BETWEEN area * 0.5 AND area * 1.5) SELECT url, lot_id, round(distance_m, 3) AS distance_m FROM x WHERE rn = 1")
def lookalike_listings(spark, d):
    return S.lookalikes(points(spark, d), listings(spark, d), 2000).select("url", "lot_id", r("distance_m", 3).alias("distance_m"))


def _territorial(hard: str, soft: str) -> str:
    return f"""WITH {POINTS}, {LISTINGS}, {PAIRS}, x AS (SELECT * FROM pairs WHERE distance_m <= 3000 AND l_area BETWEEN area * 0.5 AND area * 1.5 AND {hard}),
m AS (SELECT lot_id, count(*) AS n, median(l_price) AS a, count(*) FILTER ({soft}) AS k, median(l_price) FILTER ({soft}) AS b FROM x GROUP BY 1)
SELECT p.lot_id, round(CASE WHEN k >= 2 THEN b WHEN n >= 2 THEN a END, 4) AS territorial, coalesce(CASE WHEN k >= 2 THEN k ELSE n END, 0) AS territorial_n FROM points p LEFT JOIN m ON m.lot_id = p.lot_id"""


@query(_territorial("l_floor = floor", "l_entrance = entrance"))
def territorial_price(spark, d):
    return S.territorial_median(points(spark, d), listings(spark, d), 3000).select("lot_id", r("territorial").alias("territorial"), "territorial_n")


@query(_territorial("true", "l_floor = floor"))
def territorial_rent(spark, d):
    return S.territorial_median(points(spark, d), listings(spark, d), 3000, hard=(), soft=("floor",)).select("lot_id", r("territorial").alias("territorial"), "territorial_n")


_LOO = f"{LISTINGS}, o AS (SELECT url AS r_url, l_area AS r_area, l_price AS r_price, l_floor AS r_floor, l_type AS r_type, l_lat AS r_lat, l_lon AS r_lon FROM listings), z AS (SELECT *, {sql_metres('l_lat', 'l_lon', 'r_lat', 'r_lon')} AS m FROM listings, o)"


@query(f"WITH {_LOO}, e AS (SELECT url, count(*) AS n, median(r_price) AS estimate FROM z WHERE m > 100 AND m <= 2500 AND l_floor = r_floor AND r_area BETWEEN l_area * 0.5 AND l_area * 1.5 GROUP BY 1 HAVING count(*) >= 2) SELECT l.url, coalesce(e.n, 0) AS n, round(e.estimate, 4) AS estimate, round((e.estimate - l.l_price) / l.l_price * 100, 4) AS error_pct FROM listings l LEFT JOIN e ON e.url = l.url")
def loo_errors(spark, d):
    return S.loo_errors(listings(spark, d, "").withColumnRenamed("entrance", "e"), 2500).select("url", "n", r("estimate").alias("estimate"), r("error_pct").alias("error_pct"))


@query(f"""WITH {_LOO}, e AS (SELECT url, l_floor, (median(r_price) - any_value(l_price)) / any_value(l_price) * 100 AS err FROM z WHERE m > 100 AND m <= 2500 AND l_floor = r_floor AND r_area BETWEEN l_area * 0.5 AND l_area * 1.5 GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT l.l_floor AS floor, count(*) AS n, count(err) AS covered, round(avg(abs(err)), 4) AS mape, round(median(err), 4) AS median_error, round(quantile_cont(err, 0.25), 4) AS p25, round(quantile_cont(err, 0.75), 4) AS p75 FROM listings l LEFT JOIN e ON e.url = l.url GROUP BY 1""")
def loo_report(spark, d):
    rep = A.error_report(S.loo_errors(listings(spark, d, "").withColumnRenamed("entrance", "e"), 2500), by=["floor"])
    return rep.select("floor", "n", "covered", *[r(c).alias(c) for c in ("mape", "median_error", "p25", "p75")])


@query(f"""WITH {_LOO}, rr(radius) AS (VALUES (1000.0::DOUBLE), (2000.0::DOUBLE), (3000.0::DOUBLE)), e AS (SELECT radius, url, (median(r_price) - any_value(l_price)) / any_value(l_price) * 100 AS err FROM z JOIN rr ON m <= radius WHERE m > 100 AND l_floor = r_floor AND r_area BETWEEN l_area * 0.5 AND l_area * 1.5 GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT radius, count(*) AS covered, round(avg(abs(err)), 4) AS mape, round(median(err), 4) AS median_error FROM e GROUP BY 1""")
def loo_radius_sweep(spark, d):
    return S.loo_sweep(listings(spark, d, "").withColumnRenamed("entrance", "e"), [1000, 2000, 3000]).select("radius", "covered", r("mape").alias("mape"), r("median_error").alias("median_error"))


@query()
def loo_filter_sweep(spark, d):
    return S.loo_filters(listings(spark, d, "").withColumnRenamed("entrance", "e"), 2000).withColumn("mape", r("mape", 2))


# Snapshots and matching


_NEW = f"{SNAPSHOTS}, lab AS (SELECT snapshot_label, lag(snapshot_label) OVER (ORDER BY snapshot_label) AS previous_label FROM (SELECT DISTINCT snapshot_label FROM snaps)), fresh AS (SELECT s.*, l.previous_label FROM snaps s JOIN lab l USING (snapshot_label) WHERE l.previous_label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snaps p WHERE p.snapshot_label = l.previous_label AND p.address_canon = s.address_canon AND lower(p.org_name) = lower(s.org_name)))"


@query(f"WITH {_NEW} SELECT snapshot_label, previous_label, org_id, address_canon FROM fresh")
def new_organisations(spark, d):
    return M.new_orgs(snapshots(spark, d)).select("snapshot_label", "previous_label", "org_id", "address_canon")


@query(f"WITH {SNAPSHOTS}, s AS (SELECT *, org_id || '@' || address_canon AS branch FROM snaps), lab AS (SELECT snapshot_label, lag(snapshot_label) OVER (ORDER BY snapshot_label) AS previous_label FROM (SELECT DISTINCT snapshot_label FROM snaps)), fresh AS (SELECT s.* FROM s JOIN lab l USING (snapshot_label) WHERE l.previous_label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s p WHERE p.snapshot_label = l.previous_label AND p.branch = s.branch)) SELECT snapshot_label, rubric, count(*) AS n FROM fresh GROUP BY 1, 2")
def new_organisation_stats(spark, d):
    """New branches by snapshot and rubric; a branch has an id of its own."""
    branches = snapshots(spark, d).withColumn("org_id", F.concat_ws("@", F.col("org_id").cast("string"), "address_canon"))
    return M.new_orgs(branches, key="id").groupBy("snapshot_label", "rubric").agg(F.count("*").alias("n"))


_CAND = f"{LOTS}, {_NEW}, cand0 AS (SELECT l.lot_id, l.sale_date, o.snapshot_label, o.org_id, CASE WHEN o.org_id % 10 = 4 THEN 'Ozon' ELSE o.org_name END AS company, o.rubric AS usage, o.snapshot_date - l.sale_date AS after_days, {sql_metres('l.lat', 'l.lon', 'o.lat', 'o.lon')} AS distance_m FROM lots l JOIN fresh o USING (address_canon) WHERE o.snapshot_date - l.sale_date BETWEEN 0 AND 365 AND o.org_id % 10 != 5), cand AS (SELECT * FROM cand0 WHERE distance_m <= 250)"


def _candidates(spark, d):
    return M.match_candidates(M.eligible_lots(lots(spark, d)), M.new_orgs(snapshots(spark, d)))


def _best(spark, d, previews=5):
    return Q.best_in_reach(M.eligible_lots(lots(spark, d)), M.new_orgs(snapshots(spark, d)), previews=previews)


@query(f"WITH {_CAND} SELECT lot_id, snapshot_label, org_id, company, usage, after_days::INTEGER AS after_days, round(distance_m, 3) AS distance_m FROM cand")
def match_candidates(spark, d):
    return _candidates(spark, d).select("lot_id", "snapshot_label", "org_id", "company", "usage", "after_days", r("distance_m", 3).alias("distance_m"))


_BEST = f"""{_CAND}, rk AS (SELECT *, row_number() OVER (PARTITION BY lot_id, snapshot_label ORDER BY distance_m, company, org_id) AS r, CASE WHEN distance_m <= 30 THEN '0-30m' WHEN distance_m <= 100 THEN '30-100m' WHEN distance_m <= 250 THEN '100-250m' ELSE '250m+' END AS band FROM cand),
vc AS (SELECT lot_id, snapshot_label, company AS v, min(r) AS r FROM rk GROUP BY 1, 2, 3), vu AS (SELECT lot_id, snapshot_label, usage AS v, min(r) AS r FROM rk GROUP BY 1, 2, 3),
nc AS (SELECT *, row_number() OVER (PARTITION BY lot_id, snapshot_label ORDER BY r) AS i FROM vc), nu AS (SELECT *, row_number() OVER (PARTITION BY lot_id, snapshot_label ORDER BY r) AS i FROM vu),
pc AS (SELECT lot_id, snapshot_label, string_agg(v, ' | ' ORDER BY r) AS company_preview FROM nc WHERE i <= 5 GROUP BY 1, 2), pu AS (SELECT lot_id, snapshot_label, string_agg(v, ' | ' ORDER BY r) AS usage_preview FROM nu WHERE i <= 5 GROUP BY 1, 2),
best AS (SELECT lot_id, snapshot_label, count(*) AS n, max(company) FILTER (r = 1) AS company, max(usage) FILTER (r = 1) AS usage, max(after_days) FILTER (r = 1) AS after_days, max(band) FILTER (r = 1) AS band, max(org_id) FILTER (r = 1) AS org_id FROM rk GROUP BY 1, 2),
conf AS (SELECT *, CASE WHEN n = 1 AND band = '0-30m' THEN 'high' WHEN n <= 3 AND band IN ('0-30m', '30-100m') THEN 'medium' ELSE 'low' END AS confidence FROM best JOIN pc USING (lot_id, snapshot_label) JOIN pu USING (lot_id, snapshot_label)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY after_days, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, snapshot_label) AS q FROM conf) WHERE q = 1)"""


@query(f"WITH {_BEST} SELECT lot_id, snapshot_label, n, company, usage, after_days::INTEGER AS after_days, confidence, company_preview, usage_preview FROM one")
def best_match_per_lot(spark, d):
    return M.best_per_lot(_best(spark, d)).select("lot_id", "snapshot_label", "n", "company", "usage", "after_days", "confidence", "company_preview", "usage_preview")


@query(f"WITH {_BEST} SELECT lot_id, snapshot_label, count(*) OVER (PARTITION BY address_canon, snapshot_label, org_id) > 1 AS multilot FROM conf JOIN (SELECT lot_id, address_canon FROM lots) USING (lot_id)")
def shared_best_candidates(spark, d):
    return M.shared_best(_best(spark, d), lots(spark, d)).select("lot_id", "snapshot_label", "multilot")


@query(f"WITH {_BEST}, s AS (SELECT *, count(*) OVER (PARTITION BY address_canon, snapshot_label, org_id) > 1 AS many FROM conf JOIN (SELECT lot_id, address_canon FROM lots) USING (lot_id)) SELECT CASE WHEN many THEN 'low' ELSE confidence END AS confidence, count(*) AS n FROM s GROUP BY 1")
def shared_best_downgrades(spark, d):
    return M.shared_best(_best(spark, d), lots(spark, d), policy="downgrade", key="id").groupBy("confidence").agg(F.count("*").alias("n"))


@query(f"WITH {SNAPSHOTS} SELECT org_id, min(snapshot_date) AS first_seen FROM snaps GROUP BY 1")
def first_seen_organisations(spark, d):
    return M.first_seen(snapshots(spark, d))


_BUYOUT = f"""{LOTS}, {SNAPSHOTS}, hit AS (SELECT l.lot_id, l.sale_date, lower(s.org_name) AS key, s.org_name, s.rubric, s.snapshot_label, s.snapshot_date, {sql_metres('l.lat', 'l.lon', 's.lat', 's.lon')} AS m FROM lots l JOIN snaps s ON abs(s.lat - l.lat) < 0.002 AND abs(s.lon - l.lon) < 0.004 WHERE s.org_id % 10 != 5),
buy AS (SELECT lot_id, arg_min(org_name, (m, org_name)) AS name, arg_min(rubric, (m, org_name)) AS usage, min(m) AS distance_m, count(DISTINCT snapshot_label) FILTER (snapshot_date <= sale_date) AS n_before, count(DISTINCT snapshot_label) FILTER (snapshot_date > sale_date) AS n_after, min(snapshot_date) AS first_seen, max(snapshot_date) AS last_seen,
  string_agg(DISTINCT snapshot_label, ' | ' ORDER BY snapshot_label) FILTER (snapshot_date <= sale_date) AS before_labels, string_agg(DISTINCT snapshot_label, ' | ' ORDER BY snapshot_label) FILTER (snapshot_date > sale_date) AS after_labels FROM hit WHERE m <= 50 GROUP BY lot_id, key HAVING n_before >= 3 AND n_after >= 1)"""


@query(f"WITH {_BUYOUT} SELECT lot_id, name, usage, round(distance_m, 3) AS distance_m, n_before::INTEGER AS n_before, n_after::INTEGER AS n_after, first_seen, last_seen, before_labels, after_labels FROM buy")
def tenant_buyouts(spark, d):
    out = Q.lot_buyouts(lots(spark, d), snapshots(spark, d))
    return out.withColumns({"distance_m": r("distance_m", 3), "before_labels": C.join_pipe("before_labels"), "after_labels": C.join_pipe("after_labels")})


_HISTORY = f"""{LOTS}, {SNAPSHOTS}, e AS (SELECT address_canon, snapshot_label, lat, lon, CASE WHEN org_id % 10 = 4 THEN 'ozon' ELSE lower(org_name) END AS key, CASE WHEN org_id % 10 = 4 THEN 'Ozon' ELSE org_name || ' (' || split_part(rubric, ',', 1) || ')' END AS entry FROM snaps WHERE org_id % 10 != 5),
h AS (SELECT l.lot_id, e.key, min((e.snapshot_label, e.entry)) AS f, max((e.snapshot_label, e.entry)) AS t, max(e.snapshot_label) AS last_seen FROM lots l JOIN e USING (address_canon) WHERE {sql_metres('l.lat', 'l.lon', 'e.lat', 'e.lon')} <= 250 GROUP BY 1, 2),
hist AS (SELECT lot_id, key, f[2] AS entry, t[2] AS now_entry, last_seen = (SELECT max(snapshot_label) FROM snaps) AS current FROM h)"""


@query(f"""WITH {_HISTORY} SELECT lot_id, coalesce(string_agg(entry, ' | ' ORDER BY entry), '') AS "all", coalesce(string_agg(now_entry, ' | ' ORDER BY now_entry) FILTER (current), '') AS now, coalesce(string_agg(entry, ' | ' ORDER BY entry) FILTER (NOT current), '') AS gone, count(*) AS n_all, count(*) FILTER (current) AS n_now FROM hist GROUP BY 1""")
def business_histories(spark, d):
    return Q.lot_histories(*Q.class_history(lots(spark, d).select("lot_id", "address_canon", "lat", "lon"), snapshots(spark, d)))


@query(f"WITH {LOTS}, {SNAPSHOTS} SELECT lot_id, address_canon FROM lots l WHERE NOT EXISTS (SELECT 1 FROM snaps s WHERE s.address_canon = l.address_canon)")
def uncovered_addresses(spark, d):
    return M.uncovered_addresses(lots(spark, d), snapshots(spark, d)).select("lot_id", "address_canon")


_CHAINS = "ch AS (SELECT p_brand AS chain, CASE WHEN p_type LIKE 'PROMO%' THEN 'Алкомаркеты' ELSE p_type END AS category, right(p_brand, 1)::INTEGER % 5 AS b, min(p_size) * 5.0::DOUBLE AS area_min_m2, max(p_size) * 4.0::DOUBLE AS area_max_m2 FROM part GROUP BY 1, 2, 3)"


def _chains(spark, d):
    category = F.when(F.col("p_type").startswith("PROMO"), V.ALCOHOL_CATEGORY).otherwise(F.col("p_type"))
    x = table(spark, d, "part").groupBy(F.col("p_brand").alias("name"), category.alias("category")).agg((F.min("p_size") * 5.0).alias("area_min_m2"), (F.max("p_size") * 4.0).alias("area_max_m2"))
    b = F.right("name", F.lit(1)).cast("int") % 5
    return x.withColumn("floor", F.array(*[F.lit(f) for f in ("цоколь", "первый этаж; подвал", "-1", "", "1")])[b]).withColumn("separate_entrance", b == 2)


@query(f"""WITH {POINTS}, {_CHAINS}, p AS (SELECT lot_id, area, lot_id % 4 AS f, lot_id % 2 = 0 AS sep, lot_id % 3 = 0 AS school FROM points),
m AS (SELECT lot_id, category, chain FROM p JOIN ch ON area >= area_min_m2 AND area <= area_max_m2 WHERE (b = 3 OR (f = 0 AND b IN (1, 4)) OR (f = 1 AND b IN (1, 2)) OR (f = 2 AND b = 0)) AND (b != 2 OR sep) AND NOT (category = 'Алкомаркеты' AND school)),
g AS (SELECT lot_id, category, count(*) AS c FROM m GROUP BY 1, 2), t AS (SELECT lot_id, arg_max(category, (c, category)) AS top_category FROM g GROUP BY 1)
SELECT lot_id, count(*) AS chains_n, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories, array_to_string(list_sort(list(chain))[1:8], '; ') AS top_chains, any_value(top_category) AS top_category FROM m JOIN t USING (lot_id) GROUP BY 1""")
def chain_matches(spark, d):
    k = F.col("lot_id")
    label = F.array(*[F.lit(x) for x in ("1 этаж", "Подвал", "Цоколь", "2 этаж")])[(k % 4).cast("int")]
    p = points(spark, d).select("lot_id", "area", label.alias("floor_label"), (k % 2 == 0).alias("separate"), (k % 3 == 0).alias("near_school"))
    return M.chain_summary(M.match_chains(p, _chains(spark, d))).select("lot_id", "chains_n", "categories", "top_chains", "top_category")


@query(f"WITH {_CHAINS} SELECT category, min(area_min_m2) * 0.25::DOUBLE AS area_lo, round(quantile_cont(area_max_m2, 0.75) * 4, 4) AS area_hi FROM ch GROUP BY 1")
def area_limits(spark, d):
    return M.area_limits(_chains(spark, d)).withColumn("area_hi", r("area_hi"))


@query(f"""WITH {LOTS}, g AS (SELECT lot_id, CASE lot_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS c, (lot_id % 300)::INTEGER AS a, CASE WHEN lot_id % 4 = 3 THEN NULL WHEN lot_id % 5 = 0 THEN 'gap_snapshot_x' ELSE 'first_after_snapshot_x' END AS w FROM lots),
n AS (SELECT lot_id, CASE lot_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS c, (lot_id % 200)::INTEGER AS a FROM lots WHERE lot_id % 6 != 0),
x AS (SELECT g.lot_id, CASE WHEN w LIKE 'gap%' THEN NULL ELSE g.c END AS c, CASE WHEN w LIKE 'gap%' THEN NULL ELSE g.a END AS a, CASE WHEN w LIKE 'gap%' THEN NULL ELSE w END AS w, n.c AS nc, n.a AS na FROM g LEFT JOIN n ON n.lot_id = g.lot_id AND n.c != 'low'),
y AS (SELECT *, CASE WHEN nc IS NULL THEN 'none' WHEN c IS NULL THEN 'added' WHEN na < a OR (na = a AND CASE nc WHEN 'high' THEN 0 ELSE 1 END <= CASE c WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) THEN 'upgraded' ELSE 'kept' END AS action FROM x)
SELECT lot_id, CASE WHEN action IN ('added', 'upgraded') THEN nc ELSE c END AS confidence, CASE WHEN action IN ('added', 'upgraded') THEN na ELSE a END AS after_days, CASE WHEN action IN ('added', 'upgraded') THEN 'new ' || lot_id WHEN w IS NOT NULL THEN 'old ' || lot_id END AS company FROM y""")
def merge_gap_matches(spark, d):
    k = F.col("lot_id")
    ids = lots(spark, d).select("lot_id")
    none = F.lit(None).cast("string")
    window = F.when(k % 4 == 3, none).when(k % 5 == 0, "gap_snapshot_x").otherwise("first_after_snapshot_x")
    name = lambda p: F.concat(F.lit(p + " "), k.cast("string"))
    old = ids.select("lot_id", F.when(k % 4 != 3, name("old")).alias("company"), none.alias("usage"), F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").when(k % 4 == 2, "low").alias("confidence"), (k % 300).cast("int").alias("after_days"), window.alias("time_window"))
    gap = ids.where(k % 6 != 0).select("lot_id", name("new").alias("company"), none.alias("usage"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("confidence"), (k % 200).cast("int").alias("after_days"), F.lit("2024-01").alias("snapshot_label"))
    return M.merge_gap(old, gap)[0].select("lot_id", "confidence", "after_days", "company")


# Lots, houses, valuation, sets


@query(f"WITH {LOTS} SELECT lot_id, CASE WHEN EXISTS (SELECT 1 FROM labels WHERE doc_id = lot_id AND toxic = 1) THEN 'refused' WHEN bidders > 0 AND final_price IS NULL THEN 'hidden_failure' WHEN final_price IS NULL THEN 'failed' ELSE 'held' END AS status FROM lots")
def lot_statuses(spark, d):
    refused = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("lot_id"))
    return L.lot_status(lots(spark, d), refused).select("lot_id", "status")


@query("SELECT l_partkey AS fias, count(*) AS apt_total, count(*) FILTER (l_returnflag = 'A') AS apt_living, round_even(count(*) FILTER (l_returnflag = 'A') * 2.4, 0)::DOUBLE AS residents_est FROM lineitem GROUP BY 1")
def houses(spark, d):
    u = table(spark, d, "lineitem").select(F.col("l_partkey").alias("fias"), F.col("l_linenumber").cast("string").alias("unit_no"), F.when(F.col("l_returnflag") == "A", "жилое").otherwise("иное").alias("unit_type"), F.lit("1").alias("area_total"), F.lit("1").alias("area_living"))
    return L.build_houses(u).select("fias", "apt_total", "apt_living", "residents_est")


@query("WITH t AS (SELECT l_suppkey AS station, sum(CASE WHEN year(l_shipdate) = 1998 THEN l_quantity * 2 END) AS t FROM lineitem GROUP BY 1) SELECT station, coalesce(t, (SELECT median(t) FROM t))::DOUBLE AS traffic FROM t")
def station_traffic(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("station"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("incoming"), F.col("l_quantity").alias("outgoing"))
    return L.station_traffic(x, 1998)


@query(_territorial("l_floor = floor", "l_entrance = entrance").replace("SELECT p.lot_id, round(", "SELECT p.lot_id, p.area, (").replace("END, 4) AS territorial,", "END) AS territorial,").join(["WITH t AS (", ") SELECT lot_id, round(f * area, 2) AS market_price, round(f * area * (1 - 0.284::DOUBLE), 2) AS pessimistic_price, round(f * area - area * 50000, 2) AS upside, round((f * area - area * 50000) / (area * 50000) * 100, 4) AS upside_pct FROM (SELECT *, coalesce(0.3::DOUBLE * territorial + 0.7::DOUBLE * m, territorial, m) AS f FROM (SELECT *, CASE WHEN lot_id % 3 != 0 THEN (90000 + lot_id % 50 * 1000)::DOUBLE END AS m FROM t))"]))
def lot_valuations(spark, d):
    t = S.territorial_median(points(spark, d), listings(spark, d), 3000).withColumn("auction_price", F.col("area") * 50000).withColumn("model_m2", F.when(F.col("lot_id") % 3 != 0, (90000 + F.col("lot_id") % 50 * 1000).cast("double")))
    return L.value_lots(t, alpha=0.3).select("lot_id", r("market_price", 2).alias("market_price"), r("pessimistic_price", 2).alias("pessimistic_price"), r("upside", 2).alias("upside"), r("upside_pct").alias("upside_pct"))


@query(f"WITH {POINTS} SELECT lot_id, round((area * 100000 + area * 300000) / ((800 + lot_id % 900) * 12 * area), 4) AS payback_years, round((area * 100000 + area * 300000) / ((800 + lot_id % 900) * 12 * area * (1 - 0.311::DOUBLE)), 4) AS pessimistic_payback, round((800 + lot_id % 900) * 12 / 100000.0::DOUBLE * 100, 4) AS cap_rate_auction, round((800 + lot_id % 900) * 12 / 150000.0::DOUBLE * 100, 4) AS cap_rate_market, round((area * 150000 + area * 300000) / ((800 + lot_id % 900) * 12 * area), 4) AS market_payback FROM points")
def paybacks(spark, d):
    p = points(spark, d).withColumn("auction_price", F.col("area") * 100000).withColumn("rent_m2", (800 + F.col("lot_id") % 900).cast("double")).withColumn("final_m2", F.lit(150000.0))
    return L.payback(p).select("lot_id", *[r(c).alias(c) for c in ("payback_years", "pessimistic_payback", "cap_rate_auction", "cap_rate_market", "market_payback")])


@query("SELECT doc_id, (quality IS NULL) AS holdout FROM documents LEFT JOIN labels USING (doc_id)")
def holdout_split(spark, d):
    from auctra.operators.ml import split_holdout

    docs = table(spark, d, "documents").select("doc_id")
    left, held = split_holdout(docs, A.remaining(docs, table(spark, d, "labels"), "doc_id"), "doc_id")
    return left.withColumn("holdout", F.lit(False)).unionByName(held.withColumn("holdout", F.lit(True)))


@query("SELECT o_orderkey AS lot_id FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def lots_without_lines(spark, d):
    return A.remaining(table(spark, d, "orders").select(F.col("o_orderkey").alias("lot_id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("lot_id")), "lot_id")


# Text rules over generated addresses and floors


_FLOORS = ["подвал", "1", "1, 2", "подвал, 0", "1, 1", "2 этаж и выше", "антресоль", "7", "-1", ""]


@query("WITH f AS (SELECT p_partkey, ['Подвал', '1 этаж', 'Многоуровневый', 'Подвал', '1 этаж', 'Многоуровневый', 'Антресоль', '5+ этаж', 'Подвал', 'Не указано'][p_partkey % 10 + 1] AS floor_label FROM part) SELECT floor_label, count(*) AS n FROM f GROUP BY 1")
def floor_labels(spark, d):
    raw = F.array(*[F.lit(x) for x in _FLOORS])[(F.col("p_partkey") % 10).cast("int")]
    return table(spark, d, "part").groupBy(C.floor_label(raw).alias("floor_label")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, 'тверская ' || s_suppkey || ' корп ' || (s_suppkey % 9 + 1) AS address FROM supplier")
def match_addresses(spark, d):
    k = F.col("s_suppkey").cast("string")
    raw = F.concat(F.lit("Российская Федерация, город Москва, улица Тверская, д. "), k, F.lit(", корпус "), (F.col("s_suppkey") % 9 + 1).cast("string"), F.lit(", этаж 1"))
    return table(spark, d, "supplier").select("s_suppkey", C.canonical_address(C.normalize_address(raw)).alias("address"))


@query(f"WITH {LOTS} SELECT lot_id, CASE WHEN trade_form = '1-URGENT' AND final_price >= start_price THEN round_even(excess, 1) + 0.0::DOUBLE END AS strict, round_even(excess, 1) + 0.0::DOUBLE AS filled FROM lots")
def excess_policies(spark, d):
    x = lots(spark, d).withColumn("f", F.when(F.col("trade_form") == "1-URGENT", V.AUCTION).otherwise(V.PUBLIC_OFFER))
    return x.select("lot_id", C.price_excess("start_price", "final_price", "f").alias("strict"), C.price_excess("start_price", "final_price", "f", policy="fill").alias("filled"))


# Events as feeds (batch twins of the streaming jobs)


@query("SELECT date_trunc('day', ts) AS start, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def daily_feed(spark, d):
    from auctra.streaming.feeds import windowed_counts

    return windowed_counts(table(spark, d, "events")).withColumn("mean", r("mean"))


@query("""WITH x AS (SELECT user_id AS object_id, ts, floor(value / 20) AS value, lag(floor(value / 20)) OVER (PARTITION BY user_id ORDER BY ts, floor(value / 20)) AS last FROM events)
SELECT CASE WHEN last IS NULL THEN 'appeared' ELSE 'changed' END AS change, count(*) AS n FROM x WHERE last IS DISTINCT FROM value GROUP BY 1""")
def object_changes(spark, d):
    from auctra.streaming.feeds import object_changes as changes

    x = table(spark, d, "events").select(F.col("user_id").alias("object_id"), "ts", F.floor(F.col("value") / 20).cast("double").alias("value"))
    return changes(x).groupBy("change").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT user_id AS url, arg_max(event_type, ts) AS entrance, arg_max(CASE WHEN event_type = 'click' THEN 'ok' ELSE 'none' END, ts) AS status FROM events WHERE event_type IN ('click', 'view') GROUP BY 1) SELECT * FROM f""")
def progress_states(spark, d):
    from auctra.streaming.feeds import merge_progress

    status = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "view", "none").otherwise("error")
    return merge_progress(table(spark, d, "events").select(F.col("user_id").alias("url"), F.col("event_type").alias("entrance"), status.alias("status"), "ts"))


# Models and neighbours


@query("""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS b, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2)))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, b)::INTEGER AS rank FROM p) SELECT q AS query_id, rank, b AS neighbour_id FROM k WHERE rank <= 5""")
def nearest_embeddings(spark, d):
    from auctra.operators.ml import knn

    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return knn(e, e, "vec_id", "vec_id", "v").select("query_id", "rank", "neighbour_id")


_LIKE = ["area", "start_price", "lat", "lon"]


@query(f"""WITH {LOTS}, past AS (SELECT * FROM lots WHERE excess IS NOT NULL), s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in _LIKE)} FROM past),
q AS (SELECT lot_id AS q, {', '.join(f'(lots.{c} - m_{c}) / s_{c} AS q_{c}' for c in _LIKE)} FROM lots, s WHERE excess IS NULL), b AS (SELECT lot_id AS b, excess, {', '.join(f'(past.{c} - m_{c}) / s_{c} AS b_{c}' for c in _LIKE)} FROM past, s),
k AS (SELECT q, excess, row_number() OVER (PARTITION BY q ORDER BY {' + '.join(f'(q_{c} - b_{c}) * (q_{c} - b_{c})' for c in _LIKE)}, b) AS r FROM q, b)
SELECT q AS query_id, count(excess) AS n, round(avg(excess), 4) AS mean FROM k WHERE r <= 5 GROUP BY 1""")
def lookalike_excess(spark, d):
    """Mean price excess of the five most alike sold lots, for lots without a price."""
    from auctra.operators.ml import lookalike_mean

    x = lots(spark, d)
    return lookalike_mean(x.where("excess IS NULL"), x.where("excess IS NOT NULL"), _LIKE, "excess").withColumn("mean", r("mean"))


@query(f"WITH RECURSIVE {LISTINGS}, e AS (SELECT a.url AS u, b.url AS v FROM listings a JOIN listings b ON a.url != b.url AND abs(a.l_lat - b.l_lat) < 0.003 AND {sql_metres('a.l_lat', 'a.l_lon', 'b.l_lat', 'b.l_lon')} <= 300), c AS (SELECT DISTINCT u AS a, u AS b FROM e UNION SELECT c.a, e.v FROM c JOIN e ON e.u = c.b) SELECT a AS node, min(b) AS component FROM c GROUP BY 1")
def location_clusters(spark, d):
    """Connected components of listings within 300 m."""
    return S.clusters(listings(spark, d).select("url", F.col("l_lat").alias("lat"), F.col("l_lon").alias("lon")), "url", 300)


@query()
def hedonic_cross_validation(spark, d):
    """Grouped out-of-fold error of the price model."""
    from auctra.operators import ml

    x = listings(spark, d, "").withColumnRenamed("entrance", "e")
    x, features = ml.listing_features(x, floors=["0", "1", "2", "3"], types=["ECONOMY", "STANDARD", "PROMO"], numeric=["area", "lat", "lon"])
    x = ml.assign_folds(x, F.concat_ws("_", "floor", F.rint(F.col("lat") * 2000), F.rint(F.col("lon") * 2000)))
    p = ml.cross_predict(x, features, "price")
    return A.error_report(p.withColumn("error_pct", (F.col("prediction") - F.col("price")) / F.col("price") * 100))


@query()
def similar_names(spark, d):
    """Pairs of similar part names within a brand and type."""
    from auctra.operators.similarity import similar_pairs

    n = table(spark, d, "part").select("p_brand", "p_type", F.col("p_name").alias("name")).distinct().withColumn("id", F.col("name"))
    o = n.select("p_brand", "p_type", F.col("name").alias("r_name"), F.col("id").alias("r_id"))
    found = similar_pairs(n, o, 0.6, ["p_brand", "p_type"]).where("name < r_name")
    return found.select("p_brand", "p_type", F.col("name").alias("p_name"), F.col("r_name").alias("other"), r("similarity").alias("similarity"))


# Reports

_MATCHED = f"""{LOTS}, mt AS (SELECT *, CASE lot_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'existing_tenant' WHEN 3 THEN 'cleared' END AS confidence, CASE WHEN lot_id % 41 = 0 THEN '' ELSE 'Org ' || (lot_id % 40) END AS company, (lot_id % 400)::INTEGER AS after_days, CASE WHEN lot_id % 3 = 0 THEN 'Грузоперевозки / Транспортные услуги, Склады -> Доставка' ELSE 'Rubric ' || (lot_id % 4) END AS usage, CASE lot_id % 6 WHEN 0 THEN '1 этаж' WHEN 1 THEN 'Подвал' WHEN 2 THEN '2 этаж' END AS floor_label FROM lots),
mk AS (SELECT *, CASE WHEN confidence = 'existing_tenant' THEN 'existing_tenant' WHEN confidence IN ('high', 'medium', 'low') THEN 'new_business' ELSE 'not_found' END AS match_class FROM mt)"""


def _matched(spark, d):
    k = F.col("lot_id")
    c = F.when(k % 5 == 0, "high").when(k % 5 == 1, "medium").when(k % 5 == 2, "existing_tenant").when(k % 5 == 3, "cleared")
    return lots(spark, d).withColumn("confidence", c).withColumns({
        "company": F.when(k % 41 == 0, "").otherwise(F.concat(F.lit("Org "), (k % 40).cast("string"))), "after_days": (k % 400).cast("int"),
        "usage": F.when(k % 3 == 0, "Грузоперевозки / Транспортные услуги, Склады -> Доставка").otherwise(F.concat(F.lit("Rubric "), (k % 4).cast("string"))),
        "floor_label": F.when(k % 6 == 0, "1 этаж").when(k % 6 == 1, "Подвал").when(k % 6 == 2, "2 этаж"),
    })


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""WITH {_MATCHED}, o AS (SELECT *, row_number() OVER (PARTITION BY company, address_canon ORDER BY after_days, lot_id) AS rn FROM mk WHERE match_class != 'not_found' AND company != ''),
u AS (SELECT count(*) AS tenants, round(count(*) FILTER (usage LIKE 'Грузо%') * 100.0::DOUBLE / count(*), 4) AS marketplace_pct FROM o WHERE rn = 1),
x AS (SELECT floor_label, CASE WHEN confidence != 'existing_tenant' AND after_days BETWEEN 1 AND 365 THEN after_days END AS days FROM mk WHERE match_class != 'not_found')
SELECT any_value(tenants) AS tenants, any_value(marketplace_pct) AS marketplace_pct, round(median(days), 4) AS median_days, round(count(*) FILTER (days < 90) * 100.0::DOUBLE / count(days), 4) AS under_90_pct, round(count(*) FILTER (days < 180) * 100.0::DOUBLE / count(days), 4) AS under_180_pct,
round(count(*) FILTER (floor_label = '1 этаж') * 100.0::DOUBLE / count(*), 4) AS first_floor_pct, round(count(*) FILTER (floor_label = 'Подвал') * 100.0::DOUBLE / count(*), 4) AS basement_pct FROM x, u""")
def tenant_kpis(spark, d):
    from auctra.operators import reports

    return _rounded(reports.tenant_kpis(_matched(spark, d)))


@query(f"WITH {LOTS} SELECT trade_form, count(final_price / start_price) AS n, round(median(final_price / start_price), 4) AS median_ratio FROM lots GROUP BY 1")
def form_discount(spark, d):
    from auctra.operators import reports

    return _rounded(reports.form_discount(lots(spark, d)))


@query(f"WITH {_MATCHED} SELECT match_class, count(*) AS lots, round(avg(bidders), 4) AS mean_bidders, round(median(final_price), 4) AS median_final FROM mk GROUP BY 1")
def tenant_shares(spark, d):
    from auctra.operators import reports

    return _rounded(reports.tenant_shares(_matched(spark, d)))


@query(f"WITH {_MATCHED} SELECT year(sale_date)::INTEGER AS year, count(*) AS lots, count(*) FILTER (match_class != 'not_found') AS matched, round(count(*) FILTER (match_class != 'not_found') * 100.0::DOUBLE / count(*), 4) AS matched_pct FROM mk GROUP BY 1")
def matches_by_year(spark, d):
    from auctra.operators import reports

    return _rounded(reports.matches_by_year(_matched(spark, d)))


@query(f"WITH {_MATCHED} SELECT trade_form, match_class, count(*) AS n, median(area) AS median_area, round(median(excess), 4) AS median_excess, median(bidders) AS median_bidders, round(count(*) FILTER (final_price < start_price) * 100.0::DOUBLE / count(*), 4) AS below_pct FROM mk GROUP BY 1, 2")
def form_by_class(spark, d):
    from auctra.operators import reports

    return _rounded(reports.form_by_class(_matched(spark, d)))


@query(f"WITH {LOTS} SELECT trade_form, count(deposit / start_price) AS n, round(avg(deposit / start_price * 100), 4) AS mean_pct, round(min(deposit / start_price * 100), 4) AS min_pct, round(max(deposit / start_price * 100), 4) AS max_pct FROM lots GROUP BY 1")
def deposit_distribution(spark, d):
    from auctra.operators import reports

    return _rounded(reports.deposit_distribution(lots(spark, d), ["trade_form"]))


@query(f"""WITH {LISTINGS}, s AS (SELECT l_entrance AS entrance, count(*) AS n, avg(l_price) AS mean, median(l_price) AS median, median(l_price) FILTER (l_floor = '1') AS floor_median FROM listings GROUP BY 1)
SELECT entrance, n, round(mean, 4) AS mean, round(median, 4) AS median, round(floor_median, 4) AS floor_median, round((floor_median / max(floor_median) OVER () - 1) * 100, 4) AS discount_pct FROM s""")
def entrance_discount(spark, d):
    from auctra.operators import reports

    return _rounded(reports.entrance_discount(listings(spark, d, "")))


@query(f"WITH {LOTS}, p AS (SELECT lot_id, CASE WHEN lot_id % 3 = 0 THEN final_price WHEN lot_id % 3 = 1 THEN final_price + 1 END AS w FROM lots) SELECT count(*) AS lots, count(final_price) AS priced, count(*) FILTER (final_price IS NOT NULL AND w = final_price) AS confirmed, count(*) FILTER (final_price IS NOT NULL AND w IS NULL) AS unconfirmed, count(*) FILTER (w != final_price) AS differing FROM lots JOIN p USING (lot_id)")
def price_reconciliation(spark, d):
    from auctra.operators import reports

    x = lots(spark, d)
    p = x.select("lot_id", F.when(F.col("lot_id") % 3 == 0, F.col("final_price")).when(F.col("lot_id") % 3 == 1, F.col("final_price") + 1).alias("winner_price_num"))
    return reports.reconcile_prices(x, p)


@query(f"WITH s AS (SELECT c_custkey // 2 AS k, CASE WHEN c_custkey // 2 % 3 = 0 THEN c_custkey // 2 ELSE c_custkey END AS a FROM customer), x AS (SELECT k, {sql_lat('a')} AS lat, {sql_lon('a')} AS lon FROM s) SELECT k, any_value(lat) AS lat FROM x GROUP BY 1 HAVING count(DISTINCT (lat, lon)) = 1")
def unique_locations(spark, d):
    from auctra.operators import reports
    from auctra.plans.given import lat, lon

    k = F.floor(F.col("c_custkey") / 2)
    x = table(spark, d, "customer").select(k.alias("k"), F.when(k % 3 == 0, k).otherwise(F.col("c_custkey")).alias("a")).select("k", lat("a").alias("lat"), lon("a").alias("lon"))
    return reports.unique_locations(x, "k").select("k", "lat")


from auctra.plans import coverage, further, rules  # noqa: E402, F401  register further queries

_ORACLES["loo_filter_sweep"] = further.LOO_FILTERS
