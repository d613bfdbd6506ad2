"""Registered queries over the newest snapshot, floors and clusters, paybacks, periods, profiles, tables and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auctra.functions import columns as C
from auctra.functions.geo import cell
from auctra.operators import lots as L
from auctra.operators import matching as M
from auctra.operators import ml, sketches
from auctra.operators import reach as Q
from auctra.operators import reports as R
from auctra.operators import stats as A
from auctra.plans.given import LISTINGS, LOTS, PAIRS, POINTS, SNAPSHOTS, lat, listings, lon, lots, points, snapshots, sql_lat, sql_lon, sql_metres, table
from auctra.plans.queries import _BUYOUT, _LOO, _NEW, _rounded, query, r
from auctra.sources import files
from auctra.sources import snapshots as T
from auctra.tables import materialise, new_folder


def _branches(spark, d):
    """Snapshots whose organisations have an id for each branch."""
    return snapshots(spark, d).withColumn("org_id", F.concat_ws("@", F.col("org_id").cast("string"), "address_canon"))


@query(f"""WITH {LOTS}, {SNAPSHOTS}, l2 AS (SELECT DISTINCT snapshot_label FROM snaps ORDER BY 1 DESC LIMIT 2), s AS (SELECT *, org_id || '@' || address_canon AS branch FROM snaps WHERE snapshot_label IN (SELECT snapshot_label FROM l2)),
f AS (SELECT * FROM s WHERE snapshot_label = (SELECT max(snapshot_label) FROM l2) AND branch NOT IN (SELECT branch FROM s WHERE snapshot_label = (SELECT min(snapshot_label) FROM l2))),
c AS (SELECT l.lot_id, l.address_canon, o.snapshot_label, o.branch, CASE WHEN o.org_id % 10 = 4 THEN 'Ozon' ELSE o.org_name END AS company, o.snapshot_date - l.sale_date AS days, {sql_metres('l.lat', 'l.lon', 'o.lat', 'o.lon')} AS m FROM lots l JOIN f o USING (address_canon) WHERE o.snapshot_date - l.sale_date BETWEEN 0 AND 180 AND o.org_id % 10 != 5),
k AS (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY m, company, branch) AS r, count(*) OVER (PARTITION BY lot_id) AS n FROM c WHERE m <= 250),
b AS (SELECT *, count(*) OVER (PARTITION BY address_canon, branch) > 1 AS several FROM k WHERE r = 1)
SELECT lot_id, snapshot_label, company, n, days::INTEGER AS after_days, CASE WHEN several THEN 'low' WHEN n = 1 AND m <= 30 THEN 'high' WHEN n <= 3 AND m <= 100 THEN 'medium' ELSE 'low' END AS confidence FROM b""")
def recent_snapshot_matches(spark, d):
    """Matches from the newest snapshot: 0 to 180 days, by new id, shared candidates downgraded."""
    x = lots(spark, d).withColumn("address_norm", F.col("address_canon"))
    return M.recent_matches(x, _branches(spark, d)).select("lot_id", "snapshot_label", "company", "n", "after_days", "confidence")


_FLOOR = "CASE lot_id % 9 WHEN 0 THEN 'подвал' WHEN 1 THEN 'цокольный этаж' WHEN 2 THEN '1' WHEN 3 THEN '2 этаж' WHEN 4 THEN '3' WHEN 5 THEN '5' WHEN 6 THEN '12 и выше' WHEN 7 THEN '' END"
_GROUP = "CASE lot_id % 9 WHEN 0 THEN 'подвал' WHEN 1 THEN 'цоколь' WHEN 2 THEN '1 этаж' WHEN 3 THEN '2 этаж' WHEN 4 THEN '3 этаж' WHEN 5 THEN '4-5 этажи' WHEN 6 THEN '6+ этажи' ELSE 'unknown' END"


def _priced(spark, d):
    return lots(spark, d).withColumns({"floor": F.expr(_FLOOR), "price_m2": F.col("start_price") / F.col("area")})


@query(f"""WITH {LOTS}, x AS (SELECT *, {_GROUP} AS floor_group, start_price / area AS price_m2 FROM lots)
SELECT floor_group, count(*) AS n, round(avg(price_m2), 4) AS mean_price, round(avg(area), 4) AS mean_area, round(avg(excess) FILTER (excess >= 0), 4) AS mean_excess, round(count(*) FILTER (excess >= 0) * 100.0::DOUBLE / count(*), 4) AS sold_pct,
round(quantile_cont(price_m2, 0.25), 4) AS p25, round(quantile_cont(price_m2, 0.5), 4) AS p50, round(quantile_cont(price_m2, 0.75), 4) AS p75, round(count(*) FILTER (price_m2 >= 2000) * 100.0::DOUBLE / count(*), 4) AS dear_pct,
round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS share_pct FROM x GROUP BY 1""")
def price_by_floor(spark, d):
    return _rounded(R.price_by_floor(_priced(spark, d), 2000))


@query(f"""WITH {LOTS}, x AS (SELECT *, start_price / area AS price_m2 FROM lots) SELECT CASE WHEN price_m2 >= 2000 THEN 'dear' ELSE 'cheap' END AS cluster, count(*) AS n, round(avg(price_m2), 4) AS mean_price, round(avg(area), 4) AS mean_area,
round(count(*) FILTER (excess >= 0) * 100.0::DOUBLE / count(*), 4) AS sold_pct, round(avg(excess) FILTER (excess >= 0), 4) AS mean_excess, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS share_pct FROM x WHERE price_m2 IS NOT NULL GROUP BY 1""")
def price_clusters(spark, d):
    return _rounded(R.price_clusters(_priced(spark, d), 2000))


@query(f"WITH {_BUYOUT} SELECT count(*) AS businesses, count(DISTINCT lot_id) AS lots FROM buy WHERE n_before >= 5 AND n_after >= 2")
def strong_signals(spark, d):
    return Q.strong_signal(*Q.class_buyouts(lots(spark, d).select("lot_id", "sale_date", "lat", "lon"), snapshots(spark, d)))


@query(f"""WITH {POINTS}, {LISTINGS}, {PAIRS}, m AS (SELECT lot_id, l_type AS "use", median(l_price / l_area) AS rent_m2 FROM pairs WHERE distance_m <= 2000 GROUP BY 1, 2), y AS (SELECT p.lot_id, m."use", p.area * 150000 / (rent_m2 * p.area * 12) AS payback_years FROM points p JOIN m USING (lot_id) WHERE rent_m2 > 0)
SELECT lot_id, "use", round(payback_years, 4) AS payback_years, row_number() OVER (PARTITION BY lot_id ORDER BY y.payback_years, "use")::INTEGER AS rank FROM y""")
def payback_by_use(spark, d):
    """Payback of every use that is let near a lot, the soonest first."""
    x = points(spark, d).withColumn("auction_price", F.col("area") * 150000)
    return L.payback_in_reach(x, listings(spark, d), 2000).select("lot_id", "use", r("payback_years").alias("payback_years"), "rank")


@query(f"WITH {LOTS} SELECT CASE WHEN year(sale_date) < 1998 THEN 'early' ELSE 'late' END AS period, count(*) AS n, count(final_price) AS sold FROM lots GROUP BY 1")
def lots_by_period(spark, d):
    x = lots(spark, d)
    return A.union_periods({"early": x.where("year(sale_date) < 1998"), "late": x.where("year(sale_date) >= 1998").drop("deposit")}).groupBy("period").agg(F.count("*").alias("n"), F.count("final_price").alias("sold"))


@query("SELECT user_id, arg_min(event_type, (event_id % 3, event_id)) AS event_type, min((event_id % 3, event_id))[2]::BIGINT AS event_id FROM events GROUP BY 1")
def first_pulls(spark, d):
    """Events as three pulls of objects; the first pull that has an object counts."""
    x = table(spark, d, "events").select("user_id", "event_type", "event_id", (F.col("event_id") % 3).alias("pull"))
    return A.first_seen_rows(x, "user_id", ["pull", "event_id"]).select("user_id", "event_type", "event_id")


@query(f"WITH {LISTINGS} SELECT floor(l_lat / 0.002::DOUBLE)::BIGINT AS y, floor(l_lon / 0.002::DOUBLE)::BIGINT AS x, count(*) AS n FROM listings GROUP BY 1, 2")
def grid_cells(spark, d):
    return listings(spark, d).groupBy(cell("l_lat", "l_lon", 0.002).alias("c")).agg(F.count("*").alias("n")).select("c.y", "c.x", "n")


def _units(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "жилое").otherwise("иное")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("fias"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("unit_no"), kind.alias("unit_type"), F.col("l_quantity").cast("string").alias("area_total"), F.lit("1,5").alias("area_living"))


def _house_coords(spark, d):
    return table(spark, d, "part").where("p_partkey % 3 != 0").select(F.col("p_partkey").alias("fias"), F.when(F.col("p_partkey") % 5 != 0, lat("p_partkey")).alias("lat"), lon("p_partkey").alias("lng"))


@query(f"""WITH u AS (SELECT l_partkey AS fias, count(*) AS apt_total, arg_min(l_quantity, concat_ws('-', l_orderkey, l_linenumber, l_suppkey))::DOUBLE AS area_total FROM lineitem GROUP BY 1)
SELECT fias, apt_total, area_total, 1.5::DOUBLE AS area_living, round({sql_lat('fias')}, 6) AS lat, round({sql_lon('fias')}, 6) AS lng FROM u WHERE fias % 3 != 0 AND fias % 5 != 0 AND fias IN (SELECT p_partkey FROM part)""")
def located_houses(spark, d):
    x = L.build_houses(_units(spark, d), _house_coords(spark, d))
    return x.select("fias", "apt_total", "area_total", "area_living", r("lat", 6).alias("lat"), r("lng", 6).alias("lng"))


@query("WITH h AS (SELECT DISTINCT l_partkey AS k FROM lineitem) SELECT count(*) AS houses, count(*) FILTER (k % 3 != 0 AND k % 5 != 0 AND k IN (SELECT p_partkey FROM part)) AS located, round(count(*) FILTER (k % 3 != 0 AND k % 5 != 0 AND k IN (SELECT p_partkey FROM part)) * 100.0::DOUBLE / count(*), 4) AS located_pct FROM h")
def house_coverage(spark, d):
    return _rounded(R.coordinate_coverage(L.build_houses(_units(spark, d)), _house_coords(spark, d)))


_PROFILED = ["start_price", "final_price", "area"]


@query(f"WITH {LOTS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, round(min({c}), 4) AS least, round(max({c}), 4) AS most, true AS distinct_near, true AS median_near FROM lots" for c in _PROFILED))
def sketched_profile(spark, d):
    """A profile merged from sketches by year; whether its estimates are within their bounds of the exact figures."""
    x = materialise(lots(spark, d).select(F.year("sale_date").alias("year"), *_PROFILED), "profiled")
    got = sketches.estimates(sketches.merged(sketches.column_sketches(x, ["year"], _PROFILED)), {"p50": 0.5})
    # The exact figures come from the distinct values with their counts; no task holds a column.
    values = x.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in _PROFILED]))).where("v IS NOT NULL").groupBy("feature", "v").agg(F.count("*").alias("times"))
    values = materialise(values, "values").join(F.broadcast(got.select("feature", "p50")), "feature")  # a row a column
    ranks = values.groupBy("feature").agg(F.count("*").alias("exact_n"), (F.sum(F.when(F.col("v") <= F.col("p50"), F.col("times")).otherwise(0)) / F.sum("times")).alias("rank"))
    got = got.join(ranks, "feature")
    return got.select("feature", "n", "nulls", r("least").alias("least"), r("most").alias("most"), (F.abs(F.col("distinct_n") - F.col("exact_n")) <= 0.08 * F.col("exact_n")).alias("distinct_near"), (F.abs(F.col("rank") - 0.5) < 0.03).alias("median_near"))


@query(f"WITH {_NEW} SELECT org_id, org_name, address_canon FROM fresh WHERE snapshot_label = (SELECT max(snapshot_label) FROM snaps)")
def newcomers_by_table(spark, d):
    """New organisations of the newest month from the partitioned, bucketed table of snapshots."""
    schema = "org_id long, org_name string, address_canon string, snapshot_label string"
    name = f"snapshots_{uuid.uuid4().hex}"
    T.attach(spark, name, new_folder(spark, "snapshots"), schema)
    T.put(snapshots(spark, d), name)
    return T.newcomers(spark, name, T.months(spark, name)[-1]).select("org_id", "org_name", "address_canon")


@query(f"""WITH {LOTS} SELECT count(*) AS n, count(*) FILTER (lot_id % 10 != 0 AND lot_id % 10 != 3) AS good, count(*) FILTER (lot_id % 10 = 0) AS bad_price, count(*) FILTER (lot_id % 10 = 3) AS bad_fields FROM lots""")
def declared_lots(spark, d):
    """Lots written as text, some with a price that is none or a field too few, read back under a declared schema."""
    k = F.col("lot_id")
    x = lots(spark, d).select(F.concat_ws(",", k.cast("string"), F.when(k % 10 == 0, "dear").otherwise(F.col("start_price").cast("string")), *[F.lit("5")], F.when(k % 10 != 3, F.lit("x"))).alias("value"))
    folder = new_folder(spark, "text")
    x.select(F.col("value").alias("lot_id,start_price,floors_total,address")).write.option("header", True).option("quote", "").option("escape", "").csv(folder)
    good, bad = files.read_declared(spark, folder, files.LOTS)
    return good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason")).agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "good").alias("good"), F.count_if(F.col("reason") == "start_price").alias("bad_price"), F.count_if(F.col("reason") == "fields").alias("bad_fields"))


@query("SELECT count(DISTINCT l_partkey) AS groups, count(*) AS n, 5::BIGINT AS folds, true AS whole, true AS even FROM lineitem")
def balanced_folds(spark, d):
    """Whether folds by part keep groups whole and differ by no more than the largest group."""
    x = ml.balanced_folds(table(spark, d, "lineitem").select("l_partkey"), F.col("l_partkey"), 5)
    by = x.groupBy("l_partkey", "fold").agg(F.count("*").alias("n"))
    folds = by.groupBy("fold").agg(F.sum("n").alias("load"), F.max("n").alias("most"), F.count("*").alias("parts"))
    out = folds.agg(F.sum("parts").alias("parts"), F.sum("load").alias("n"), F.count("*").alias("folds"), (F.max("load") - F.min("load") <= F.max("most")).alias("even"))
    groups = by.agg(F.count_distinct("l_partkey").alias("groups"))
    return out.join(F.broadcast(groups), F.lit(True)).select("groups", "n", "folds", (F.col("parts") == F.col("groups")).alias("whole"), "even")  # one row each


@query()
def excess_holdout(spark, d):
    """Error of the price-excess model on every tenth lot."""
    x = lots(spark, d).where("excess IS NOT NULL").select("lot_id", "excess", "area", "start_price", "bidders", "lat", "lon", "trade_form")
    train, held = ml.split_holdout(x, x.where("lot_id % 10 = 0").select("lot_id"))
    model = ml.train_excess(train, ["area", "start_price", "bidders", "lat", "lon"], "excess", ["trade_form"])
    return ml.holdout_report(model.transform(held).withColumnRenamed("raw", "prediction"), "excess")


@query()
def price_importances(spark, d):
    """Weights of the features in the price model."""
    x, features = ml.listing_features(listings(spark, d, "").withColumnRenamed("entrance", "e"), ["0", "1", "2", "3"], ["ECONOMY", "STANDARD", "PROMO"], ["area", "lat", "lon"])
    return ml.importances(ml.train_hedonic(x, features, "price", iterations=10), features)


@query()
def lot_prices(spark, d):
    """Prices of lots by a model of listings that is fitted, written, read again and applied to lots in listing words."""
    from auctra.operators import hedonic as H

    own = listings(spark, d, "").select(F.col("url").alias("id"), "lat", "lon", "area", "floor", F.element_at(F.array(*map(F.lit, H.TYPES)), (F.col("url") % 3 + 1).cast("int")).alias("type"), F.lit("общий").alias("entrance"), F.lit(9).alias("floors_total"), (F.col("price") / F.col("area")).alias("price_m2"))
    other = own.where("id % 2 = 0").withColumn("price_m2", F.col("price_m2") / 100)
    houses = table(spark, d, "customer").select(F.lit(40).alias("flats"), lat("c_custkey").alias("lat"), lon("c_custkey").alias("lon"))
    k = F.col("s_suppkey")
    stations = table(spark, d, "supplier").select(k.alias("station"), F.col("s_acctbal").alias("passengers"), (k % 3).cast("double").alias("vestibule"), lat("s_suppkey").alias("lat"), lon("s_suppkey").alias("lon"))
    x = points(spark, d).where("lot_id % 10 = 1").withColumns({"floor": F.element_at(F.array(*map(F.lit, ["подвал", "1", "2 этаж", "7"])), (F.col("lot_id") % 4 + 1).cast("int")), "purpose": F.lit("торговое"), "floors_total": F.lit(5)})
    path = f"{new_folder(spark, 'model')}/sale"
    H.write_model(H.fit_prices(H.surroundings(own, own, other, houses, stations), iterations=10), path)
    priced = H.price_places(H.read_model(path), H.surroundings(H.lots_as_places(x), own, other, houses, stations, listed=False))
    return priced.select(F.col("id").alias("lot_id"), *[r(c).alias(c) for c in ("metro_km", "flats_800", "other_median_1500")], "own_count_700", r("prediction").alias("prediction"))


_COMBOS = "(i & 1) = 1 AS by_floor, (i >> 1 & 1) = 1 AS by_area, (i >> 2 & 1) = 1 AS by_type, (i >> 3 & 1) = 1 AS weighted"
LOO_FILTERS = f"""WITH {_LOO}, f AS (SELECT {_COMBOS} FROM (SELECT unnest(range(16)) AS i)), p AS (SELECT * FROM z WHERE m > 100 AND m <= 2000),
x AS (SELECT p.*, f.*, CASE WHEN weighted THEN 1 / greatest(m, 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS w FROM p, f WHERE (NOT by_floor OR l_floor = r_floor) AND (NOT by_area OR r_area BETWEEN l_area * 0.5 AND l_area * 1.5) AND (NOT by_type OR l_type = r_type)),
e AS (SELECT url, any_value(l_price) AS l_price, by_floor, by_area, by_type, weighted, count(*) AS n, median(r_price) AS mid FROM x GROUP BY url, by_floor, by_area, by_type, weighted HAVING count(*) >= 2),
c AS (SELECT url, by_floor, by_area, by_type, r_price, sum(w) OVER (PARTITION BY url, by_floor, by_area, by_type ORDER BY r_price) AS c, sum(w) OVER (PARTITION BY url, by_floor, by_area, by_type) AS t FROM x WHERE weighted),
h AS (SELECT url, by_floor, by_area, by_type, min(r_price) AS heavy FROM c WHERE c >= t / 2 GROUP BY 1, 2, 3, 4)
SELECT by_floor, by_area, by_type, weighted, count(*) AS covered, round(avg(abs((CASE WHEN weighted THEN heavy ELSE mid END - l_price) / l_price * 100)), 2) AS mape FROM e LEFT JOIN h USING (url, by_floor, by_area, by_type) GROUP BY 1, 2, 3, 4"""
