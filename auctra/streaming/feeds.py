"""Structured Streaming jobs; each has a batch twin with the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.window import Window as W


def dedup_stream(stream: DataFrame, key: str = "lot_id", ts: str = "ts", delay: str = "30 days") -> DataFrame:
    """First row of each key; state is dropped after the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, ts: str = "ts", value: str = "value", width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Tumbling counts and means; the same expression for a stream and for a batch."""
    rows = rows.withWatermark(ts, delay) if rows.isStreaming else rows
    return rows.groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def merge_progress(log: DataFrame, key: str = "url", ts: str = "ts") -> DataFrame:
    """Last final state of each key: success, or checked with nothing found; errors stay open for a retry."""
    final = log.where(F.col("status").isin("ok", "none"))
    return final.groupBy(key).agg(F.max_by("entrance", ts).alias("entrance"), F.max_by("status", ts).alias("status"))


def open_keys(log: DataFrame, key: str = "url") -> DataFrame:
    return log.select(key).distinct().join(merge_progress(log, key).select(key), key, "left_anti")


CHANGES = "object_id long, ts timestamp, change string, value double"


class ObjectTracker(StatefulProcessor):
    """Changes of one object in the order of event time.

    Rows wait in a list state until the watermark has passed them, so late arrival within the delay changes nothing. The last value and
    the time when it was seen are value states; a timer ends the object when it has not been seen for ``gap_s`` seconds, and its state with it.
    """

    def __init__(self, gap_s: int):
        self.gap_ms = gap_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value double, seen_ms long")
        self.waiting = handle.getListState("waiting", "ms long, value double")

    def _timer(self, ms: int) -> None:
        if ms not in set(self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(int(pd.Timestamp(t).value // 1_000_000), None if pd.isna(v) else float(v)) for pdf in rows for t, v in zip(pdf["ts"], pdf["value"])]
        self.waiting.appendList(new)
        for ms in {ms for ms, _ in new}:
            self._timer(ms)
        yield pd.DataFrame([], columns=["object_id", "ts", "change", "value"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = sorted(self.waiting.get(), key=lambda x: (x[0], x[1] is not None, x[1] or 0.0))
        due, later = [x for x in rows if x[0] <= now], [x for x in rows if x[0] > now]
        value, seen = self.last.get() if self.last.exists() else (None, None)
        out = []
        for ms, new in due:
            if value is not None and ms > seen + self.gap_ms:
                out.append((seen + self.gap_ms, "gone", None))
                value = None
            if new != value:
                out.append((ms, "appeared" if value is None else "disappeared" if new is None else "changed", new))
            value, seen = new, ms
        if value is not None and now >= seen + self.gap_ms:
            out.append((seen + self.gap_ms, "gone", None))
            value = None
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if value is None:
            self.last.clear()
        else:
            self.last.update((value, seen))
            self._timer(seen + self.gap_ms)
        yield pd.DataFrame([(key[0], pd.Timestamp(ms, unit="ms"), change, v) for ms, change, v in out], columns=["object_id", "ts", "change", "value"])

    def close(self) -> None:
        pass


def track_objects(stream: DataFrame, gap_s: int = 7 * 86_400, delay: str = "1 day") -> DataFrame:
    """Changes of an object's value (object_id, ts, value): appeared, changed, disappeared (null value), gone (not seen for ``gap_s``).

    The session needs the RocksDB state store (``ROCKSDB``).
    """
    return stream.withWatermark("ts", delay).groupBy("object_id").transformWithStateInPandas(ObjectTracker(gap_s), CHANGES, "append", "EventTime")


#: State store that ``track_objects`` asks for, as (key, value) of the session.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def object_history(rows: DataFrame, until, gap_s: int = 7 * 86_400) -> DataFrame:
    """Batch twin of ``track_objects`` for rows up to the watermark ``until``."""
    w = W.partitionBy("object_id").orderBy("ts", F.col("value").isNotNull(), "value")
    until = F.lit(until).cast("timestamp")
    rows = rows.where(F.col("ts") <= until).withColumns({"last": F.lag("value").over(w), "last_ts": F.lag("ts").over(w), "next_ts": F.lead("ts").over(w)})
    late = lambda a, b: F.unix_millis(b) > F.unix_millis(a) + gap_s * 1000
    before = F.when(~F.coalesce(late(F.col("last_ts"), F.col("ts")), F.lit(False)), F.col("last"))
    change = F.when(before.isNull() & F.col("value").isNotNull(), "appeared").when(before.isNotNull() & F.col("value").isNull(), "disappeared").when(before != F.col("value"), "changed")
    end = F.timestamp_millis(F.unix_millis("ts") + gap_s * 1000)
    gone = F.col("value").isNotNull() & F.when(F.col("next_ts").isNull(), end <= until).otherwise(late(F.col("ts"), F.col("next_ts")))
    seen = rows.withColumn("change", change).where("change IS NOT NULL").select("object_id", "ts", "change", "value")
    return seen.unionByName(rows.where(gone).select("object_id", end.alias("ts"), F.lit("gone").alias("change"), F.lit(None).cast("double").alias("value")))


def object_changes(rows: DataFrame) -> DataFrame:
    """Changes of an object's value in a table, without an end by time."""
    w = W.partitionBy("object_id").orderBy("ts", "value")
    rows = rows.withColumn("last", F.lag("value").over(w))
    change = F.when(F.col("last").isNull() & F.col("value").isNotNull(), "appeared").when(F.col("last").isNotNull() & F.col("value").isNull(), "disappeared").when(F.col("last") != F.col("value"), "changed")
    return rows.withColumn("change", change).where("change IS NOT NULL").select("object_id", "ts", "change", "value")


def write_arrivals(rows: DataFrame, batch: str, folder: str) -> int:
    """Writes a table as the files of a stream, one batch (column ``batch``: 0, 1, ..) after the other; returns their number."""
    n = (rows.agg(F.max(batch)).first()[0] or 0) + 1
    for i in range(n):
        rows.where(F.col(batch) == i).drop(batch).repartition(1).sortWithinPartitions(*rows.drop(batch).columns[:1]).write.mode("append").parquet(folder)
    return n


def replayed(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of ``write_arrivals`` as a stream: a file a micro-batch, in the order of writing."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_once(result: DataFrame, mode: str, folder: str, checkpoint: str) -> tuple[DataFrame, dict[str, int]]:
    """Runs a stream over what is there; every batch's rows go to ``folder/batch_id=n``, overwritten if the batch comes again.

    Returns the written rows with ``batch_id``, and counts over the last 100 batches: ``read`` rows, and ``dropped`` as late by the
    stateful operators, which see rows after partial aggregation.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    spark = result.sparkSession
    query = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    counts = {"read": sum(p["numInputRows"] for p in progress), "dropped": sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])}
    fields = T.StructType([*result.schema.fields, T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(fields).parquet(folder), counts


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key, of rows in update mode."""
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


def on_time(rows: DataFrame, batch: str, end: Column, ts: str = "ts", delay: str = "2 days") -> DataFrame:
    """Batch twin of dropping late rows: ``late`` is true where ``end`` is not after the watermark that late rows of the row's batch are held
    against, which is the watermark of the batch before: the largest time of the batches before that one, less the delay."""
    tops = rows.groupBy(batch).agg(F.max(ts).alias("top"))
    before = W.orderBy(batch).rowsBetween(W.unboundedPreceding, -2)  # one row a batch
    marks = tops.select(batch, (F.max("top").over(before) - F.expr(f"INTERVAL {delay}")).alias("watermark"))
    return rows.join(F.broadcast(marks), batch).withColumn("late", F.coalesce(end <= F.col("watermark"), F.lit(False))).drop("watermark")


class VersionedTable:
    """A table of whole versions, with a ledger of the batches that are in it.

    A version's rows are written under a name of their own; the commit is a small file, renamed to the version's number, and a rename never
    replaces one, so of two writers one wins. It names the rows and the last batch of every stream. A batch that the newest commit knows
    changes nothing; rows without a commit are never read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.fs.Path("/".join((self.folder, *parts)))

    def versions(self) -> list[int]:
        ledger = self._path("commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(ledger)) if self._fs.exists(ledger) else []

    def _commit_of(self, version: int) -> dict:
        source = self._fs.open(self._path("commits", f"{version:012d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def newest(self) -> tuple[int, dict]:
        """(version, commit), version -1 before the first."""
        done = self.versions()
        return (done[-1], self._commit_of(done[-1])) if done else (-1, {"data": None, "batches": {}})

    def read(self) -> DataFrame | None:
        """The newest version, or None."""
        data = self.newest()[1]["data"]
        return self.spark.read.parquet(f"{self.folder}/data/{data}") if data else None

    def write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        return name

    def commit(self, version: int, commit: dict) -> None:
        """Makes a version; fails if there is one of that number."""
        for part in ("commits", "tmp"):
            self._fs.mkdirs(self._path(part))
        made = self._path("tmp", uuid.uuid4().hex)
        sink = self._fs.create(made)
        sink.write(bytearray(json.dumps(commit).encode()))
        sink.close()
        files = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 1)
        none[0] = self._hadoop.fs.Options.Rename.NONE
        files.rename(made, self._path("commits", f"{version:012d}"), none)

    def merge(self, stream: str, batch_id: int, change: Callable[[DataFrame | None], DataFrame]) -> DataFrame | None:
        """``change(current or None)`` becomes the next version, once for each batch; batches of a stream come in order."""
        version, last = self.newest()
        if batch_id > last["batches"].get(stream, -1):
            data = self.write(change(self.read()))
            self.commit(version + 1, {"data": data, "batches": last["batches"] | {stream: batch_id}})
        return self.read()

    def drop_old(self, keep: int = 2) -> int:
        """Deletes the rows of all but the newest versions, and rows without a commit; call it when nothing is being written."""
        alive = {self._commit_of(v)["data"] for v in self.versions()[-keep:]}
        folder = self._path("data")
        gone = [s.getPath() for s in self._fs.listStatus(folder) if s.getPath().getName() not in alive] if self._fs.exists(folder) else []
        return sum(self._fs.delete(p, True) for p in gone)


def upsert_matches(stream: DataFrame, table: VersionedTable, merge, checkpoint: str, name: str = "upsert"):
    """Merges every micro-batch into a versioned table, exactly once: ``merge(current or None, batch)`` makes the next version."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.merge(name, batch_id, lambda current: merge(current, batch))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
