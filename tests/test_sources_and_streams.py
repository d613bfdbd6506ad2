from __future__ import annotations

import datetime
import random

import pytest

import json

from pyspark.sql import functions as F

from auctra.sources import files as S
from auctra.streaming import feeds


def test_snapshots(spark, tmp_path):
    for label in ("2024-01", "2024-02"):
        p = tmp_path / label
        p.mkdir()
        (p / "north.csv").write_text("﻿Название;Адрес\nПекарня;ул. Ясная, 5\n", encoding="utf-8")
    got = S.read_snapshots(spark, [str(tmp_path / "2024-01"), str(tmp_path / "2024-02")])
    assert sorted((r["Название"], r.snapshot_label, str(r.snapshot_date), r.source_file) for r in got.collect()) == [("Пекарня", "2024-01", "2024-01-31", "north.csv"), ("Пекарня", "2024-02", "2024-02-29", "north.csv")]


def test_json_and_ids(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"5": {"participants_count": 2, "winner_price_num": 10.5}, "6": {"error": "none"}}))
    assert [(r.lot_id, r.participants_count) for r in S.read_protocols(spark, str(tmp_path / "p.json")).collect()] == [("5", 2)]
    (tmp_path / "ids.txt").write_text("1\n\n 2 \n")
    assert sorted(r.lot_id for r in S.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["1", "2"]
    (tmp_path / "t.json").write_text(json.dumps([{"id": 1, "subwayStations": [], "coords": [55.0, 37.0]}]))
    assert S.read_tenders(spark, str(tmp_path / "t.json")).select("id").collect()[0].id == 1
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "protocol_77.pdf").write_bytes(b"%PDF-1.4")
    (docs / "protocol_78.docx").write_bytes(b"PK\x03\x04rest")
    assert sorted(r.lot_id for r in S.ids_from_files(spark, str(docs)).collect()) == ["77", "78"]
    got = S.sniff_doc_type(spark.read.format("binaryFile").load(str(docs))).select("doc_type").collect()
    assert sorted(r.doc_type for r in got) == ["pdf", "zip"]


def test_opendata_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_text("station;machines\nСтанция;Автоматы\nЯсная;3\n", encoding="utf-8")
    df = S.read_opendata_csv(spark, str(tmp_path / "m.csv"), ["machines"])
    assert [tuple(r) for r in df.collect()] == [("Ясная", 3.0)]
    S.write_table(df, str(tmp_path / "out"), ["machines", "station"], "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["machines", "station"]
    m = spark.createDataFrame([(1, "high"), (2, "existing_tenant"), (3, None), (4, "cleared_school")], "lot_id long, confidence string")
    S.export_by_match_class(m, str(tmp_path / "classes"))
    back = spark.read.parquet(str(tmp_path / "classes"))
    assert {r.lot_id: r.match_class for r in back.collect()} == {1: "new_business", 2: "existing_tenant", 3: "not_found", 4: "not_found"}


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams_match_their_batch_twins(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 5.0), (1, "2024-01-02 00:00:00", 5.0), (1, "2024-01-03 00:00:00", 6.0), (2, "2024-01-01 12:00:00", 1.0), (1, "2024-01-04 00:00:00", None)]
    df = spark.createDataFrame(rows, "object_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "feed"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed"))
    got = sorted(tuple(r) for r in feeds.object_changes(df).select("object_id", "change").collect())
    assert got == [(1, "appeared"), (1, "changed"), (1, "disappeared"), (2, "appeared")]
    _run(feeds.windowed_counts(stream(), value="value"), "counts", "complete")
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, feeds.windowed_counts(df).collect()))
    _run(feeds.dedup_stream(stream(), key="object_id"), "firsts")
    assert spark.table("firsts").count() == 2


def test_tracker_equals_its_batch_twin_with_gaps(spark, tmp_path):
    """Rows out of order, twice at one time, beyond the gap, and objects that no longer appear; the last batch moves the watermark."""
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = [(o, start + datetime.timedelta(hours=t), rng.choice([None, 1.0, 1.0, 2.0])) for o in range(12) for t in sorted(rng.sample(range(1400), 14))]
    arrive = lambda t: int((t - start).total_seconds() // 3600 + rng.randint(0, 15)) // 120
    rows = [(*r, arrive(r[1])) for r in rows] + [(99, start + datetime.timedelta(days=90), 1.0, 13)]
    df = spark.createDataFrame(rows, "object_id long, ts timestamp, value double, batch int")
    feeds.write_arrivals(df, "batch", str(tmp_path / "feed"))
    spark.conf.set(*feeds.ROCKSDB)
    stream = feeds.track_objects(feeds.replayed(spark, str(tmp_path / "feed"), df.drop("batch").schema))
    got, counts = feeds.run_once(stream, "append", str(tmp_path / "out"), str(tmp_path / "ck"))
    want = feeds.object_history(df.drop("batch"), start + datetime.timedelta(days=89))
    show = lambda x: sorted(map(str, x.select("object_id", "ts", "change", "value").collect()))
    assert counts == {"read": len(rows), "dropped": 0} and show(got) == show(want)
    assert {r.change for r in want.collect()} == {"appeared", "changed", "disappeared", "gone"}


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=i), float(i % 7), i // 100 if i % 13 else 3) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, value double, batch int")
    feeds.write_arrivals(df, "batch", str(tmp_path / "feed"))
    out, counts = feeds.run_once(feeds.windowed_counts(feeds.replayed(spark, str(tmp_path / "feed"), df.drop("batch").schema)), "update", str(tmp_path / "out"), str(tmp_path / "ck"))
    marked = feeds.on_time(df, "batch", F.window("ts", "1 day").end)
    final = feeds.latest(out, ["start"])
    assert counts["read"] - final.agg(F.sum("n")).first()[0] == marked.where("late").count() > 0 < counts["dropped"]
    assert sorted(map(str, final.collect())) == sorted(map(str, feeds.windowed_counts(marked.where("NOT late")).collect()))


def test_merges_are_exactly_once(spark, tmp_path):
    """A batch that comes again after a crash before or after its commit changes nothing, and of two writers one wins."""
    table = feeds.VersionedTable(spark, f"file://{tmp_path}/matches")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    add = lambda new: lambda current: new if current is None else current.unionByName(new)
    ids = lambda: sorted(r.id for r in table.read().collect())
    assert table.read() is None
    table.merge("s", 0, add(rows(1, 2)))
    table.write(add(rows(3))(table.read()))  # a crash between write and commit
    assert ids() == [1, 2]
    for _ in range(2):  # the replay, and another one after the commit
        table.merge("s", 1, add(rows(3)))
        assert ids() == [1, 2, 3] and table.versions() == [0, 1]
    table.merge("other", 0, add(rows(9)))
    with pytest.raises(Exception, match="exists"):
        table.commit(2, {"data": "x", "batches": {}})
    assert ids() == [1, 2, 3, 9] and table.drop_old(1) == 3 and ids() == [1, 2, 3, 9]
    with pytest.raises(ZeroDivisionError):
        table.merge("s", 2, lambda _: 1 / 0)
    assert ids() == [1, 2, 3, 9]


def test_progress_and_upsert(spark, tmp_path):
    log = spark.createDataFrame([("a", None, "error", "1"), ("a", "x", "ok", "2"), ("b", None, "error", "1"), ("c", None, "none", "1")], "url string, entrance string, status string, ts string")
    assert {r.url: r.status for r in feeds.merge_progress(log).collect()} == {"a": "ok", "c": "none"}
    assert [r.url for r in feeds.open_keys(log).collect()] == ["b"]
    log.write.parquet(str(tmp_path / "in"))
    table = feeds.VersionedTable(spark, str(tmp_path / "table"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    for again in ("ck", "other"):  # a lost checkpoint replays the batch
        feeds.upsert_matches(stream, table, lambda current, batch: batch if current is None else current.unionByName(batch), str(tmp_path / again)).awaitTermination(120)
    assert table.read().count() == 4 and table.versions() == [0]
