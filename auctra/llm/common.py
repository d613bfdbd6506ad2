"""Helpers that the corpus operators share: written intermediates and skew-safe lookups."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctra.tables import materialise, shared_dir

__all__ = ["BROADCAST_ROWS", "WORD_PATTERN", "batches_of", "give_back", "lookup", "materialise", "shared_dir"]

#: Words of the contracts: maximal runs without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows a lookup table may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 20_000

#: Parts into which a key of a lookup is dealt when the lookup is joined by shuffle.
SALTS = 64


def lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "left") -> DataFrame:
    """Join a lookup table (one row per key, already written) to a large, skewed table.

    Up to ``BROADCAST_ROWS`` counted rows it is broadcast. Beyond, every key is dealt into
    ``SALTS`` parts by the hash of column ``spread`` of the left side, so that a key with a third
    of all rows spreads over many tasks. Keys must not be null.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return left.join(salted, [*keys, "__salt"], how).drop("__salt")


@contextmanager
def batches_of(spark: SparkSession, size: str):
    """Texts are long rows: Arrow batches of few bytes keep the memory of a worker small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Returns the memory of earlier Arrow batches to the system: Python workers live on beside the JVM of their executor."""
    pa.default_memory_pool().release_unused()
