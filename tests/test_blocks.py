"""Sums, medians and nearest rows around a row without its pairs, against brute force."""

from __future__ import annotations

import random
import statistics

import pytest

from auctra.operators import blocks, spatial
from tests.test_nearest import metres


@pytest.fixture(scope="module", params=[(55.7, 37.6, 0.03), (-70.0, 179.99, 0.08)])
def tables(request):
    """Lots (id, lat, lon, area, floor, entrance) and listings (id, lat, lon, area, price, floor, entrance), some equal or with nulls."""
    y, x, w = request.param
    rng = random.Random(3)
    turn = lambda lon: lon - 360 if lon > 180 else lon
    spot = lambda: (y + rng.uniform(-w, w), turn(x + rng.uniform(-w, w)))
    maybe = lambda v: None if rng.random() < 0.1 else v
    lots = [(i, *spot(), maybe(float(rng.choice([0, 20, 50, 80]))), maybe(rng.choice("ab")), maybe(rng.choice("pq"))) for i in range(60)] + [(90, None, 1.0, 5.0, "a", "p")]
    here = [spot() for _ in range(150)] + [(a, b) for _, a, b, *_ in lots[:20]] * 2
    listings = [(500 + i, *p, maybe(float(rng.choice([10, 30, 60, 90]))), maybe(float(rng.randint(1, 9))), maybe(rng.choice("ab")), maybe(rng.choice("pq"))) for i, p in enumerate(here)] + [(999, 1.0, None, 5.0, 1.0, "a", "p")]
    return lots, listings


def frames(spark, tables):
    return spark.createDataFrame(tables[0], "lot_id long, lat double, lon double, area double, floor string, entrance string"), spark.createDataFrame(tables[1], "url long, l_lat double, l_lon double, l_area double, l_price double, l_floor string, l_entrance string")


def fits(own, other):
    return other is not None and own * 0.5 <= other <= own * 1.5 if own is not None and other is not None else own is None or own <= 0


def near(lot, listing, radius, inner=-1.0):
    return None not in (*lot[1:3], *listing[1:3]) and inner < metres(lot[1], lot[2], listing[1], listing[2]) <= radius


def plan(df):
    return df._jdf.queryExecution().toString()


def test_medians_and_sums(spark, tables, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 500)  # several parts a cell
    lots, listings = frames(spark, tables)
    got = spatial.territorial_median(lots, listings, 1500)
    assert "FlatMapCoGroupsInArrow" in plan(got)  # pairs were rows before
    want = {}
    for lot in tables[0]:
        hits = [r for r in tables[1] if near(lot, r, 1500) and r[4] is not None and fits(lot[3], r[3]) and lot[4] in (None, r[5])]
        tight = [r[4] for r in hits if lot[5] in (None, r[6])]
        shown = tight if len(tight) >= 2 else [r[4] for r in hits]
        want[lot[0]] = (statistics.median(shown) if len(shown) >= 2 else None, len(shown))
    assert {r.lot_id: (r.territorial, r.territorial_n) for r in got.collect()} == want and any(t for t, _ in want.values())
    around = spatial.radius_median(lots, listings, "lot_id", "l_price", [900, 1500], same=("floor", "l_floor"), right_at=("l_lat", "l_lon")).collect()
    sums = {r.lot_id: (r.sum_900, r.sum_1500) for r in spatial.radius_sum(lots, listings, "lot_id", "l_area", [900, 1500], right_at=("l_lat", "l_lon")).collect()}
    for r, lot in ((r, next(x for x in tables[0] if x[0] == r.lot_id)) for r in around):
        prices = [x[4] for x in tables[1] if near(lot, x, 900) and x[4] is not None]
        same = [x[4] for x in tables[1] if near(lot, x, 900) and x[4] is not None and lot[4] is not None and x[5] == lot[4]]
        mid = statistics.median(prices) if len(prices) >= 2 else None
        assert (r.n_900, r.median_900, r.median_same_900) == (len(prices), mid, statistics.median(same) if len(same) >= 2 else mid)
        assert sums[lot[0]] == tuple(sum(x[3] or 0 for x in tables[1] if near(lot, x, m)) for m in (900, 1500))


def test_nearest_lot_and_place(spark, tables, monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 50)
    lots, listings = frames(spark, tables)
    want = {}
    for r in tables[1]:
        hits = [(metres(a[1], a[2], r[1], r[2]), a[0]) for a in tables[0] if near(a, r, 1500) and (None in (a[3], r[3]) or a[3] * 0.5 <= r[3] <= a[3] * 1.5)]
        if hits:
            want[r[0]] = min(hits)[1]
    assert {r.url: r.lot_id for r in spatial.lookalikes(lots, listings, 1500).collect()} == want and want
    places = listings.selectExpr("url AS p_id", "concat('n', url) AS p_name", "l_lat AS p_lat", "l_lon AS p_lon")
    for r in spatial.flag_near(lots, places, 100, 900).collect():
        lot = next(x for x in tables[0] if x[0] == r.lot_id)
        best = min(((metres(lot[1], lot[2], x[1], x[2]), x[0]) for x in tables[1] if near(lot, x, 900)), default=None)
        assert (r.near_name, r.near) == ((f"n{best[1]}", best[0] <= 100) if best else (None, False))


def test_filters_equal_brute_force(spark, tables):
    rows = [(r[0], *r[1:3], r[3], r[4], r[5], r[6]) for r in tables[1] if r[4] is not None]
    df = spark.createDataFrame(rows, "url long, lat double, lon double, area double, price double, floor string, type string")
    want = {}
    for i in range(16):
        by_floor, by_area, by_type, weighted = (bool(i >> b & 1) for b in range(4))
        errors = []
        for a in rows:
            hits = [r for r in rows if near(a, r, 1500, 100.0) and (not by_floor or (a[5] is not None and a[5] == r[5])) and (not by_area or fits(a[3], r[3])) and (not by_type or (a[6] is not None and a[6] == r[6]))]
            if len(hits) >= 2:
                weights = {}
                for r in hits:
                    weights[r[4]] = weights.get(r[4], 0) + (1 / max(1.0, metres(a[1], a[2], r[1], r[2])) if weighted else 1)
                run, half = 0.0, sum(weights.values()) / 2
                for price in sorted(weights):
                    run += weights[price]
                    if run >= half * (1 - 1e-9):
                        break
                errors.append(abs((price if weighted else statistics.median(r[4] for r in hits)) - a[4]) / a[4] * 100)
        want[(by_floor, by_area, by_type, weighted)] = (len(errors), sum(errors) / len(errors))
    got = {(r.by_floor, r.by_area, r.by_type, r.weighted): (r.covered, r.mape) for r in spatial.loo_filters(df, 1500).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def _around(spark):
    lots = [(i, 55 + i % 7 * 0.004, 37 + i % 5 * 0.006, None if i == 3 else 10.0 * (i % 6), 100.0 * i) for i in range(40)] + [(99, None, 37.0, 20.0, 5.0), (98, 60.0, 37.0, 20.0, 5.0)]
    past = [(k, 55 + k % 11 * 0.003, 37 + k % 13 * 0.003, None if k == 4 else 7.0 * (k % 9), None if k % 5 == 0 else float(k % 4), None if k % 7 == 0 else k * 1.5, None if k % 6 == 0 else f"u{k % 3}", None if k == 8 else 90.0 + k) for k in range(120)]
    lots = spark.createDataFrame(lots, "lot_id long, lat double, lon double, area double, auction_price double")
    return lots, spark.createDataFrame(past, "past_id long, l_lat double, l_lon double, l_area double, bidders double, excess_pct double, l_type string, l_price double")


def _rows(df):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df.collect())


def test_competition_equals_its_pairs_without_joining_them(spark):
    from auctra.operators import lots as L
    from auctra.plans import queries as core

    lots, past = _around(spark)
    pairs = spatial.radius_join(lots, past, 1000, right_at=("l_lat", "l_lon")).where("l_area BETWEEN area * 0.7 AND area * 1.3")
    want = _rows(L.competition_index(pairs))
    assert len(want) > 20 and _rows(L.competition(lots, past)) == want
    assert "asin" not in core.queries()["competition"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()  # a distance for each joined pair


def test_payback_in_reach_equals_the_pairs_without_joining_them(spark):
    from pyspark.sql import functions as F

    from auctra.operators import lots as L
    from auctra.plans import queries as core

    lots, past = _around(spark)
    past = past.where("coalesce(l_area, 0) > 0")
    near = spatial.radius_join(lots.select("lot_id", "lat", "lon"), past, 1000, right_at=("l_lat", "l_lon"))
    rents = near.groupBy("lot_id", F.col("l_type").alias("use")).agg(F.median(F.col("l_price") / F.col("l_area")).alias("rent_m2"))
    columns = ["lot_id", "use", "payback_years", "rank"]
    want = _rows(L.payback_by_use(lots, rents).select(columns))
    assert len(want) > 60 and _rows(L.payback_in_reach(lots, past, 1000).select(columns)) == want
    assert "asin" not in core.queries()["payback_by_use"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()


def test_clusters_equal_components_of_all_pairs_by_few_links(spark):
    from pyspark.sql import functions as F

    from auctra.operators import components
    from auctra.plans import queries as core

    rng = random.Random(4)
    rows = [(i, 55 + rng.randrange(60) * 0.002 + rng.random() * 0.001, 37 + rng.random() * 0.08) for i in range(400)] + [(i, 56.0, 37.0) for i in range(500, 700)] + [(900, 10.0, 179.9999), (901, 10.0, -179.9999), (902, -70.0, 3.0), (903, None, 3.0), (17, 57.0, 37.0), (904, 57.001, 37.0), (17, 58.0, 37.0), (905, 59.0, 37.0), (905, 59.0, 37.0)]
    df = spark.createDataFrame(rows, "k long, lat double, lon double")
    pairs = spatial.radius_join(df, spatial._mirror(df), 300).where("k < r_k").select(F.col("k").alias("u"), F.col("r_k").alias("v"))
    want = sorted(map(tuple, components.connected_components(pairs).collect()))
    assert len({c for _, c in want}) > 5 and sorted(map(tuple, spatial.clusters(df, "k", 300).collect())) == want
    seen, whole = [], spatial.connected_components
    spatial.connected_components = lambda e: seen.append(e.count()) or whole(e)
    try:
        core.queries()["location_clusters"](spark, "/root/testdata/sf0.01").count()
        spatial.clusters(df.where("k BETWEEN 500 AND 699"), "k", 300)
    finally:
        spatial.connected_components = whole
    assert len(seen) == 2 and seen[1] == 0  # 200 rows at one place: no link, 19900 pairs
