"""Nearest neighbours by metric pruning against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from auctra.operators import ml, neighbours


def brute(queries, base, k):
    out = []
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(y)) ** 2).sum())), b) for b, y in base if b != q)
        out += [(q, i + 1, b) for i, (_, b) in enumerate(d[:k])]
    return sorted(out)


def test_knn_equals_brute_force_and_opens_few(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 6)) * 10
    points = np.concatenate([centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 6)) * 0.3, rng.normal(size=(4, 6)) * 400])
    rows = [(i, v.tolist()) for i, v in enumerate(points)] + [(5000 + i, points[7].tolist()) for i in range(40)]  # repeated points: ties by id
    bad = [(9000, None), (9001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9002, [float("nan")] * 6)]
    df = spark.createDataFrame(rows + bad, "id long, v array<double>")
    asked = df.where(F.col("id") % 9 == 0)
    opened = []
    got = sorted((r.query_id, r.rank, r.neighbour_id) for r in neighbours.knn(asked, df, "id", "id", "v", 5, block=50, opened=opened).collect())
    queries = [x for x in rows if x[0] % 9 == 0]
    assert got == brute(queries, rows, 5)
    pairs = sum(t.agg(F.sum("n")).first()[0] or 0 for t in opened)
    assert pairs < 0.25 * len(queries) * len(rows)


@pytest.mark.parametrize("k", [1, 7, 50])
def test_knn_with_few_rows_and_large_k(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    far = spark.createDataFrame([(100, [1e6, 0.0, 0.0])], "id long, v array<double>")
    assert sorted((r.query_id, r.rank, r.neighbour_id) for r in neighbours.knn(df.unionByName(far), df, "id", "id", "v", k).collect()) == brute([*rows, (100, [1e6, 0, 0])], rows, k)
    assert neighbours.knn(df, df.limit(0), "id", "id", "v", k).count() == 0 == neighbours.knn(df.limit(0), df, "id", "id", "v", k).count()


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, pivots = rng.normal(size=(300, 4)), rng.normal(size=(5, 4))
    d = neighbours.distances(x, pivots)
    cells = neighbours.Cells(np.arange(3), np.full(3, 100), np.stack([d[k::3].min(0) for k in range(3)]), np.stack([d[k::3].max(0) for k in range(3)]))
    q = rng.normal(size=(40, 4)) * 2
    least, most = cells.bounds(neighbours.distances(q, pivots))
    for k in range(3):
        real = np.sqrt(((q[:, None] - x[k::3][None]) ** 2).sum(2))
        assert (least[:, k] <= real.min(1)).all() and (most[:, k] >= real.max(1)).all()


def test_lookalike_mean_standardises(spark):
    past = spark.createDataFrame([(i, float(i), i * 1e6, float(i % 5), 10.0 * i) for i in range(40)], "lot_id long, a double, b double, c double, y double")
    lots = spark.createDataFrame([(100, 20.2, 20.2e6, 0.0), (101, None, 3e6, 3.0)], "lot_id long, a double, b double, c double")
    got = {r.query_id: (r.n, r["mean"]) for r in ml.lookalike_mean(lots, past, ["a", "b", "c"], "y", k=3).collect()}
    x = np.array([[i, i * 1e6, i % 5] for i in range(40)], float)
    q = np.array([[20.2, 20.2e6, 0], [np.median(x[:, 0]), 3e6, 3]], float)
    z = lambda v: (v - x.mean(0)) / x.std(0, ddof=1)
    want = [10.0 * np.argsort(((z(x) - z(p)) ** 2).sum(1), kind="stable")[:3].mean() for p in q]
    assert got[100] == (3, pytest.approx(want[0])) and got[101][0] == 3


@pytest.mark.parametrize("kind", ["plain", "offset", "huge", "tiny", "outlier", "alike"])
def test_block_nearest_equals_brute_force(kind, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 64)
    monkeypatch.setattr(neighbours, "TILE_QUERIES", 32)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 24)) * {"huge": 1e150, "tiny": 1e-25}.get(kind, 1.0)
    if kind == "offset":
        x = 1e9 + x * 1e-3
    if kind == "outlier":
        x[3] = 1e12
    if kind == "alike":
        x[100:300] = x[7]
        x[300:] = x[7] * (1 + 1e-15)
    ids = np.concatenate([rng.permutation(390), np.full(10, 389)])  # an id with many rows
    q, b, d = neighbours.block_nearest(ids, x, ids, x, 5)
    got = sorted(zip(ids[q].tolist(), ids[b].tolist(), d.tolist()))
    want = []
    for i, v in zip(ids.tolist(), x):
        near = sorted((float(np.sqrt(((v - y) ** 2).sum())), j) for j, y in zip(ids.tolist(), x) if j != i)[:5]
        want += [(i, j, e) for e, j in near]
    assert got == sorted(want)


@pytest.mark.parametrize("dim", [3, 48])
def test_knn_compares_all_pairs_where_bounds_say_little(spark, dim, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", (100, 300))
    used, all_pairs = [], neighbours.all_pairs
    monkeypatch.setattr(neighbours, "all_pairs", lambda *a: used.append(1) or all_pairs(*a))
    rng = np.random.default_rng(dim)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(700, dim)).tolist())]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties by id
    df = spark.createDataFrame([*rows, (9000, None)], "id long, v array<double>")
    asked = df.where(F.col("id") % 3 == 1)
    got = sorted((r.query_id, r.rank, r.neighbour_id) for r in neighbours.knn(asked, df, "id", "id", "v", 5).collect())
    assert got == brute([x for x in rows if x[0] % 3 == 1], rows, 5) and bool(used) == (dim == 48)
