"""Merges and flags on rows that tell the rules apart."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from auctra.functions import columns as C
from auctra.operators import matching as M
from auctra.operators import reports as R
from auctra.operators.similarity import similarity
from tests.test_nearest import metres

DAY = datetime.date(2024, 1, 1)


def rules(spark):
    return spark.createDataFrame([], "category string, area_lo double, area_hi double"), spark.createDataFrame([("магнит",)], "chain string")


def candidates(spark, rows):
    """(lot_id, org_id, org_name, o_address, distance_m, after_days)"""
    df = spark.createDataFrame(rows, "lot_id long, org_id long, org_name string, o_address string, distance_m double, after_days int")
    return df.withColumns({"snapshot_label": F.lit("2024-01"), "company": C.company_name("org_name"), "usage": F.when(F.col("org_name") == "Банкомат", "Постаматы").otherwise("Rubric"), "band": C.distance_band("distance_m")})


def test_branches_of_a_brand_are_not_one(spark):
    best = M.best_matches(candidates(spark, [(1, 10, "Ozon, пункт 1", "addr", 5.0, 200), (2, 11, "OZON, пункт 2", "addr", 5.0, 200), (3, 12, "Хлеб", "addr", 5.0, 200), (4, 12, "ХЛЕБ ", "addr", 6.0, 200)]))
    lots = spark.createDataFrame([(i, "addr") for i in range(1, 5)], "lot_id long, address_canon string")
    for key in ("name", "id"):
        assert {r.lot_id: r.multilot for r in M.shared_best(best, lots, key=key).collect()} == {1: False, 2: False, 3: True, 4: True}
    assert {r.lot_id: r.confidence for r in M.shared_best(best, lots, "downgrade", "id").collect()} == {1: "high", 2: "high", 3: "low", 4: "low"}


def test_recovery_ignores_floors_and_keeps_the_best_rows_confidence(spark):
    c = candidates(spark, [(1, 1, "Магнит", "a", 10.0, 400), (2, 2, "Хлеб", "a", 120.0, 200), (3, 3, "Банкомат", "a", 10.0, 200), (3, 4, "Цветы", "a", 20.0, 200), (4, 5, "Цветы", "a", 300.0, 200), (5, 6, "Хлеб", "a", 10.0, 200)])
    lots = spark.createDataFrame([(i, 50.0, "подвал") for i in range(1, 6)], "lot_id long, area double, floor string")
    taken = spark.createDataFrame([(5, "high")], "lot_id long, confidence string")
    got = {r.lot_id: (r.company, r.confidence) for r in M.recover_matches(c, taken, lots, *rules(spark)).collect()}
    assert got == {1: ("Магнит", "medium"), 2: ("Хлеб", "low"), 3: ("Цветы", "medium")}


def test_tenants_need_a_history_at_the_own_address(spark):
    names = [f"T{i}" for i in range(12)]
    buyout = spark.createDataFrame([(lot, n, f"use {i % 2}", float(i)) for lot in (1, 2) for i, n in enumerate(["t0", *names])], "lot_id long, name string, usage string, distance_m double")
    matches = spark.createDataFrame([(1, None, None, None, None, None, "old"), (2, None, None, None, None, None, "old"), (3, "x", "y", "high", 5, "w", "p")], "lot_id long, company string, usage string, confidence string, after_days int, time_window string, company_preview string")
    lots = spark.createDataFrame([(i, 50.0, "1") for i in (1, 2, 3)], "lot_id long, area double, floor string")
    history = spark.createDataFrame([(1,)], "lot_id long")
    got = {r.lot_id: r for r in M.merge_tenants(matches, buyout, history, lots, *rules(spark)).collect()}
    ten = " | ".join(["t0", *names[1:10]])
    assert (got[1].company, got[1].usage, got[1].company_preview, got[1].confidence) == (ten, "use 0 | use 1", ten, "existing_tenant")
    assert got[2].confidence is None and got[2].company_preview == "old" and got[3].company == "x"


def test_evasion_bound_is_on_one_decimal(spark):
    lots = spark.createDataFrame([(d, 100.0, d == 30.0) for d in (30.0, 30.3) for _ in range(5)], "deposit double, start_price double, evasion boolean")
    assert [(r.deposit_pct, r.n, r.evaded_n) for r in R.evasion_by_percent(lots).collect()] == [(30, 5, 5)]


def test_kinds_of_streets_are_levelled(spark):
    one = "пр. тихий|д:5|к:|стр:"
    rows = [("Москва, проезд Тихий, дом 5",), ("пр. Тихий, д. 5",)]
    assert [r.k for r in spark.createDataFrame(rows, "x string").select(C.building_key("x").alias("k")).collect()] == [one, one]


def test_baseline_equals_brute_force(spark):
    """Days window, ids and names seen before the sale, counts and bands, the best snapshot of each lot."""
    rng = random.Random(21)
    stems = ["кофейня ромашка", "аптека здоровье", "хлеб и соль", "цветы мира"]
    spelled = lambda: "".join(c for c in rng.choice(stems) if rng.random() > 0.05)
    place = lambda: (55.75 + rng.uniform(0, 0.004), 37.6 + rng.uniform(0, 0.006))
    sold = {lot: DAY + datetime.timedelta(rng.randint(300, 500)) for lot in range(14)}
    rows = []
    for _ in range(260):
        lot, days, name = rng.randrange(14), rng.choice([100, 180, 200, 200, 365, 366]), spelled()
        rows.append((lot, f"s{days}", rng.randrange(60), name, name, "Rubric", sold[lot], days, float(rng.choice([10, 20, 50, 99, 120, 240, 260])), *place()))
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    snaps = [(rng.randrange(60), spelled(), DAY + datetime.timedelta(rng.randint(250, 1000)), *place()) for _ in range(90)]
    c = spark.createDataFrame(rows, "lot_id long, snapshot_label string, org_id long, org_name string, company string, usage string, sale_date date, after_days int, distance_m double, o_lat double, o_lon double")
    c = c.withColumns({"band": C.distance_band("distance_m"), "o_address": F.lit("a")})
    s = spark.createDataFrame(snaps, "org_id long, org_name string, snapshot_date date, lat double, lon double")
    tokens = {r.n: r.t for r in c.select("org_name").unionByName(s.select("org_name")).select(F.col("org_name").alias("n"), C.name_tokens("org_name").alias("t")).collect()}
    first = {}
    for org, _, seen, _, _ in snaps:
        first[org] = min(seen, first.get(org, seen))
    groups = {}
    for r in rows:
        lot, label, org, name, company, _, when, days, m, y, x = r
        before = any(seen < when and metres(y, x, v, u) <= 100 and similarity(tokens[name], tokens[other]) >= 0.8 for _, other, seen, v, u in snaps)
        if 180 <= days <= 365 and org in first and first[org] >= when and not before:
            groups.setdefault((lot, label, days), []).append((m, company, org))
    best = {}
    for (lot, label, days), g in groups.items():
        m, company, _ = min(g)
        near = "high" if len(g) == 1 and m <= 30 else "medium" if len(g) <= 3 and m <= 100 else "low"
        conf = near if m <= 100 else "low" if m <= 250 else None
        if conf:
            best[lot] = min(best.get(lot, (9999,)), (days, ["high", "medium", "low"].index(conf), label, company, conf, len(g)))
    got = {r.lot_id: (r.snapshot_label, r.company, r.confidence, r.n) for r in M.baseline_matches(c, s).collect()}
    assert got == {lot: (b[2], b[3], b[4], b[5]) for lot, b in best.items()} and len(got) > 5


def test_long_lists_of_chains_are_looked_up(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "Магнит у дома", "подвал"), (2, "Хлеб & соль", "подвал"), (3, "Магнит", "1"), (4, None, "подвал"), (5, "Цветы", "подвал")], "lot_id long, company string, floor string").withColumns({"usage": F.lit("Rubric"), "area": F.lit(50.0)})
    limits = spark.createDataFrame([], "category string, area_lo double, area_hi double")
    chains = spark.createDataFrame([("магнит",), ("хлеб и соль",), ("аб",), ("",)], "chain string")
    for most in (5_000, 2):
        monkeypatch.setattr(M, "LISTED_CHAINS", most)
        assert {r.lot_id: r.reason for r in M.invalid_reason(rows, limits, chains).collect()} == {1: "floor", 2: "floor", 3: None, 4: None, 5: None}
    assert M.invalid_reason(rows, limits, chains.limit(0)).where("reason IS NOT NULL").count() == 0
