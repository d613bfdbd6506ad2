"""Sketched profiles, the snapshot table, balanced folds, and declared schemas with rejects."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from auctra.operators import ml, sketches
from auctra.sources import files, snapshots


def test_sketches_merge_within_their_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("part"), F.when(F.col("id") % 10 != 0, F.pmod(F.xxhash64("id"), F.lit(9000)).cast("double")).alias("a"), (F.col("id") * 1.5).alias("b"), F.lit(None).cast("double").alias("c"))
    known = sketches.column_sketches(df.where("part < 5"), ["part"], ["a", "b", "c"])
    whole = sketches.added(known, df.where("part >= 4"), ["part"], ["a", "b", "c"])
    assert whole.count() == 21
    got = {r.feature: r for r in sketches.estimates(sketches.merged(whole), {"p25": 0.25, "p50": 0.5, "p99": 0.99}).collect()}
    for c in ("a", "b"):
        values = sorted(r[0] for r in df.where(f"{c} IS NOT NULL").select(c).collect())
        assert (got[c].n, got[c].nulls, got[c].least, got[c].most) == (60_000, 60_000 - len(values), values[0], values[-1])
        assert abs(got[c].distinct_n - len(set(values))) < 0.06 * len(set(values))
        for name, q in (("p25", 0.25), ("p50", 0.5), ("p99", 0.99)):
            assert abs(sum(v <= got[c][name] for v in values) / len(values) - q) < 0.03
    assert got["c"].nulls == 60_000 and got["c"].p50 is None and got["c"].distinct_n == 0
    parts = sketches.estimates(whole, {"p50": 0.5}).where("feature = 'b'").collect()
    assert len(parts) == 7 and sum(r.n for r in parts) == 60_000


def test_snapshot_table_replaces_one_month_and_joins_without_exchange(spark, tmp_path):
    schema = "org_id long, org_name string, address_canon string, snapshot_label string"
    rows = [(i, f"Org {i % 40}", f"addr {i % 30}", f"2024-0{m}") for m in (1, 2, 3) for i in range(0, 200, m)]
    df = spark.createDataFrame(rows, schema)
    spark.sql("DROP TABLE IF EXISTS snaps")
    snapshots.attach(spark, "snaps", str(tmp_path / "snaps"), schema, buckets=4)
    snapshots.put(df, "snaps")
    stamp = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "snaps").rglob("*.parquet")}
    late = spark.createDataFrame([(1000, "Org x", "addr 1", "2024-02"), (0, "Org 0", "addr 0", "2024-02")], schema)
    snapshots.put(late, "snaps")
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "snaps").rglob("*.parquet")}
    kept = {n for n in stamp if n in after}
    assert kept == {p.name for m in ("1", "3") for p in (tmp_path / "snaps" / f"snapshot_label=2024-0{m}").rglob("*.parquet")} and all(after[n] == stamp[n] for n in kept)
    spark.sql("DROP TABLE snaps")
    snapshots.attach(spark, "snaps", str(tmp_path / "snaps"), schema, buckets=4)
    assert snapshots.months(spark, "snaps") == ["2024-01", "2024-02", "2024-03"] and spark.table("snaps").where("snapshot_label = '2024-02'").count() == 2
    before = spark.conf.get(snapshots.CO_PARTITION[0]), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(*snapshots.CO_PARTITION)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = snapshots.newcomers(spark, "snaps", "2024-03")
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("PartitionFilters: [isnotnull") == 2 and "snapshot_label" in plan
        had = {(r.address_canon, r.org_name.lower()) for r in late.collect()}
        assert sorted(r.org_id for r in new.collect()) == sorted(i for i, n, a, m in rows if m == "2024-03" and (a, n.lower()) not in had)
        assert snapshots.newcomers(spark, "snaps", "2024-01").count() == 0
    finally:
        spark.conf.set(snapshots.CO_PARTITION[0], before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
        spark.sql("DROP TABLE snaps")


@pytest.mark.parametrize("sizes", [[1] * 500, [300, 5, 5, 5, 3, 2, 2, 1, 1, 1], [40] * 7 + [1] * 60 + [13] * 9, [9]])
def test_folds_are_even_and_groups_whole(spark, sizes):
    rows = [(g,) for g, n in enumerate(sizes) for _ in range(n)]
    df = ml.balanced_folds(spark.createDataFrame(rows, "grp long"), F.col("grp"), 5, bucket_groups=40)
    by = df.groupBy("grp").agg(F.count_distinct("fold").alias("k"), F.first("fold").alias("f"), F.count("*").alias("n")).collect()
    loads = [sum(r.n for r in by if r.f == f) for f in range(5)]
    assert all(r.k == 1 for r in by) and sum(loads) == len(rows) and max(loads) - min(loads) <= max(sizes)
    hist = {s: 10**9 * sizes.count(s) for s in set(sizes)}  # the same in bulk
    made = ml.spread(hist, 5)
    totals = [sum(s * (hi - lo) for s, f, lo, hi in made if f == k) for k in range(5)]
    assert max(totals) - min(totals) <= max(sizes) and sum(totals) == sum(s * c for s, c in hist.items())


def test_declared_schemas_reject_and_report(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿lot_id,area_m2,floors_total,address\n1,94.3,5,\"ул. Ясная, 5\"\n2,,,\n3,big,7,x\n4,1.0\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("floors_total,address,note,id\n3,y,n,5\n2.5,z,n,6\n1,q,n,7,more\n", encoding="utf-8")
    good, bad = files.read_declared(spark, str(tmp_path), "lot_id string, area_m2 double, floors_total int, address string", names={"lot_id": ["id"]})
    assert sorted(map(tuple, good.collect()), key=str) == sorted([("1", 94.3, 5, "ул. Ясная, 5", "a.csv"), ("2", None, None, None, "a.csv"), ("5", None, 3, "y", "b.csv")], key=str)
    assert sorted((r.source_file, r.reason) for r in bad.collect()) == [("a.csv", "area_m2"), ("a.csv", "fields"), ("b.csv", "fields"), ("b.csv", "floors_total")]
    rng = random.Random(1)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.csv").write_text("lot_id,area_m2\n" + "".join(f"{i},{rng.random()}\n" for i in range(5000)))
    assert files.read_declared(spark, str(tmp_path / "c"), files.LOTS)[0].count() == 5000


def test_shuffle_files_go_with_the_table_that_is_written(spark):
    import time
    from pathlib import Path

    from auctra.tables import materialise

    folders = [d.getPath() for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in folders for p in Path(d).rglob("shuffle_*.data")}
    before = files()
    table = materialise(spark.range(10_000).repartition(3, "id").groupBy("id").count(), "swept")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert table.count() == 10_000
