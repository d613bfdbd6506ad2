"""Nearest places through the pyramid against brute force, and candidates that a similar name preceded."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from auctra.operators import matching, spatial
from auctra.operators.similarity import similarity


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def places():
    rng = random.Random(6)
    out = [(55 + rng.gauss(0, 0.02), 37 + rng.gauss(0, 0.02)) for _ in range(250)] + [(48.8 + rng.gauss(0, 0.001), 2.3 + rng.gauss(0, 0.001)) for _ in range(120)]
    out += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(20)] + [(10.0, 179.99), (10.0, -179.99), (89.9, 10.0), (-89.9, -170.0), (90.0, 0.0), (55.0, 37.0)]
    return [(i, *p) for i, p in enumerate(out)] + [(1000 + i, 55.01, 37.01) for i in range(30)]  # a point with many rows


@pytest.mark.parametrize(("k", "cell_rows"), [(1, 8), (3, 8), (40, 8), (3, 1000)])
def test_nearest_equals_brute_force(spark, k, cell_rows):
    rng = random.Random(k)
    rows = places()
    asked = [(i, *rng.choice(rows)[1:]) for i in range(25)] + [(100 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(25)] + [(200, 90.0, 50.0), (201, -90.0, 0.0), (202, 10.0, 180.0), (203, 55.3, 37.4)]
    left = spark.createDataFrame([*asked, (300, None, 1.0)], "a long, lat double, lon double")
    right = spark.createDataFrame([*rows, (2000, 1.0, None)], "b long, r_lat double, r_lon double")
    got = sorted((r.a, r.rank, r.b) for r in spatial.nearest(left, right, "a", "b", k, cell_rows=cell_rows).collect())
    want = [(a, i + 1, b) for a, lat, lon in asked for i, (_, b) in enumerate(sorted((metres(lat, lon, y, x), b) for b, y, x in rows)[:k])]
    differing = set(got) ^ set(want)
    by = {b: (y, x) for b, y, x in rows}
    at = {a: (y, x) for a, y, x in asked}
    # Equal up to ties within rounding.
    assert len(got) == len(want) and all(any(abs(metres(*at[a], *by[b]) - metres(*at[a], *by[c])) < 1e-6 for x, j, c in want if (x, j) == (a, i)) for a, i, b in differing)


def test_leaves_are_small_and_few(spark):
    rows = places()
    right = spark.createDataFrame(rows, "b long, r_lat double, r_lon double")
    nodes, _ = spatial.pyramid(right, ("r_lat", "r_lon"), 8)
    leaves = nodes.where("leaf").collect()
    assert sum(x.n for x in leaves) == len(rows) and max(x.n for x in leaves if x.lat_lo < x.lat_hi) <= 8
    left = spark.createDataFrame([(i, y, x) for i, y, x in rows], "a long, lat double, lon double")
    met = spatial.nearest_leaves(left, nodes, "a", 1, ("lat", "lon")).agg(F.sum("n")).first()[0]
    assert met < 0.1 * len(rows) ** 2
    assert spatial.nearest(left, right.limit(0), "a", "b").count() == 0 == spatial.nearest(left.limit(0), right, "a", "b").count()


def test_preexisting_equals_brute_force(spark):
    rng = random.Random(11)
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    stems = ["кофейня ромашка", "аптека здоровье", "хлеб и соль", "цветы мира", "ремонт обуви", "coffee point"]
    spelled = lambda: "".join(c for c in rng.choice(stems) if rng.random() > 0.06) + rng.choice(["", " 24", " плюс"])
    place = lambda: (55.75 + rng.uniform(0, 0.002), 37.6 + rng.uniform(0, 0.003))
    cand = [(i % 30, i, day(rng.randint(0, 400)), spelled(), *place()) for i in range(90)] + [(1, 500, day(9), "", 55.75, 37.6), (1, 501, day(9), "хлеб и соль", None, None)]
    snap = [(day(rng.randint(0, 400)), spelled(), *place()) for _ in range(150)] + [(day(1), None, 55.75, 37.6), (day(1), "хлеб", None, 37.6)]
    c = spark.createDataFrame(cand, "lot_id long, org_id long, sale_date date, org_name string, o_lat double, o_lon double")
    s = spark.createDataFrame(snap, "snapshot_date date, org_name string, lat double, lon double")
    tokens = {r.n: r.t for r in c.select("org_name").unionByName(s.select("org_name")).select(F.col("org_name").alias("n"), matching.C.name_tokens("org_name").alias("t")).collect()}
    want = {
        (lot, org) for lot, org, sold, name, y, x in cand for seen, other, v, u in snap
        if None not in (y, x, v, u) and seen < sold and metres(y, x, v, u) <= 100 and similarity(tokens[name], tokens[other]) >= 0.8
    }
    got = [(r.lot_id, r.org_id) for r in matching.preexisting(c, s).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < len(cand)


def test_flat_vectors_are_dealt_into_boxes(spark, monkeypatch):
    import random

    from auctra.operators import neighbours

    rng = random.Random(8)
    monkeypatch.setattr(neighbours, "BOX_ROWS", 16)
    monkeypatch.setattr(neighbours, "BOX_QUERIES", 10)
    monkeypatch.setattr(neighbours, "_summary", None)  # pivots, as before
    base = [(i, [float(rng.randrange(12)), rng.random(), -3.0]) for i in range(300)] + [(i, [5.0, 0.5, -3.0]) for i in range(300, 340)] + [(400, [1e200, 0.0, 0.0]), (401, [9e9, 1.0, 1.0]), (402, None)]
    ask = [r for r in base if r[0] % 3 == 0] + [(500, [60.0, 0.1, 7.0]), (501, [5.0, 0.5, -3.0])]
    import math

    def nearest(i, v):
        d = sorted((math.sqrt(s), b) for b, y in base if y and b != i for s in [sum((p - o) * (p - o) for p, o in zip(y, v))] if s < math.inf)
        return [(i, r, b) for r, (_, b) in enumerate(d[:5], 1)]

    schema = "id long, v array<double>"
    found = neighbours.knn(spark.createDataFrame(ask, schema), spark.createDataFrame(base, schema), "id", "id", "v")
    assert sorted((r.query_id, r.rank, r.neighbour_id) for r in found.collect()) == sorted(x for i, v in ask if v for x in nearest(i, v))
