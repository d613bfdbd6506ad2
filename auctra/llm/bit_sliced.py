"""Operator 4, exact top-k search by a bit-sliced index.

Vectors of whole numbers are indexed in blocks: in a block each component less its smallest value is cut into
bits, and each bit of a component is a bitmap over the block's rows. The inner product of a query with all
rows of a block is a sum of weighted bitmaps, carried out by carry-save adders on whole bitmaps; a negative query
component takes the complement bitmaps. The best k rows are then selected from the most
significant bitmap of the sum downward; the rows that tie at the boundary are resolved by id, exactly.

Blocks of rows and blocks of queries are paired and spread over tasks; each pair reports k rows a
query at most, and a final ranking per query merges them.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without
an id. Only vectors of one length are compared. Queries are the distinct ids divisible by
``every``; of several rows with a query's id the smallest vector is the query, and none of them is
its candidate. Repeated rows are candidates each. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from auctra.llm.common import materialise

BLOCK_ROWS, BLOCK_QUERIES = 8_192, 4_096
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, dim, v): floor(scale * component) of every usable vector."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.where(F.col(ident).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(ident).cast("long").alias("id"), F.size(vector).alias("dim"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _bitmap(bits: np.ndarray) -> np.ndarray:
    """(n, rows) booleans to (n, words) of 64 bits."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


class Slices:
    """The bit slices of one block of rows."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], v[order]
        self.low = self.v.min(0)
        self.high = [max(-a, b) for a, b in zip(self.low.tolist(), self.v.max(0).tolist())]
        above = (self.v - self.low).T
        self.bits = [int(x).bit_length() for x in above.max(1)]
        self.slices = [_bitmap(np.array([(a >> b) & 1 for b in range(n)], bool).reshape(n, len(ids))) for a, n in zip(above, self.bits)]
        self.valid = _bitmap(np.ones((1, len(ids)), bool))[0]

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Bitmaps, least significant first, of a number that differs from the inner product by a constant."""
        bags: dict[int, list[np.ndarray]] = {}
        for x, n, own in zip(q.tolist(), self.bits, self.slices):
            if n and x:
                own = own if x > 0 else ~own
                w, x = 0, abs(x)
                while x:
                    if x & 1:
                        for b in range(n):
                            bags.setdefault(w + b, []).append(own[b : b + 1])
                    x >>= 1
                    w += 1
        out, w = [], 0
        while bags:
            parts = bags.pop(w, None)
            if parts is None:
                out.append(np.zeros_like(self.valid))
            else:
                bag, carries = np.concatenate(parts), bags.setdefault(w + 1, [])
                while len(bag) > 2:
                    m = len(bag) // 3
                    a, b, c = bag[:m], bag[m : 2 * m], bag[2 * m : 3 * m]
                    ab = a ^ b
                    carries.append((a & b) | (c & ab))
                    bag = np.concatenate([ab ^ c, bag[3 * m :]])
                if len(bag) == 2:
                    carries.append(bag[:1] & bag[1:])
                    bag = bag[:1] ^ bag[1:]
                out.append(bag[0])
                if not carries:
                    del bags[w + 1]
            w += 1
        return out

    def top(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (id, score), the smaller ids where scores tie at the boundary."""
        if sum(abs(x) * y for x, y in zip(q.tolist(), self.high)) >= 2**63:
            raise OverflowError("inner products beyond 64 bits")
        tied = self.valid.copy()
        for i in range(*np.searchsorted(self.ids, [own, own + 1]).tolist()):
            tied[i // 64] &= ~np.uint64(1 << (i % 64))
        sure = np.zeros_like(tied)
        for s in reversed(self.sums(q)):
            high = tied & s
            n = int(np.bitwise_count(sure | high).sum())
            if n > k:
                tied = high
            else:
                sure |= high
                tied &= ~s
                if n == k:
                    tied[:] = 0
                    break
        rows = self._rows(sure)
        if len(rows) < k and tied.any():  # rows are sorted by id: the first ones are the smallest
            words = np.flatnonzero(tied)
            need, enough = k - len(rows), int(np.searchsorted(np.cumsum(np.bitwise_count(tied[words])), k)) + 1
            part = np.zeros_like(tied)
            part[words[:enough]] = tied[words[:enough]]
            rows = np.concatenate([rows, self._rows(part)[:need]])
        score = self.v[rows] @ q
        return list(zip(self.ids[rows].tolist(), score.tolist()))

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))[:]


def _search(k: int):
    def run(_, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(queries):
            index = Slices(rows["id"].to_numpy(np.int64), np.array(rows["v"].tolist(), np.int64))
            for qid, q in zip(queries["id"], queries["v"]):
                found += [(qid, i, s) for i, s in index.top(np.asarray(q, np.int64), int(qid), k)]
        return pd.DataFrame(found, columns=["query_id", "id", "score"], dtype="int64")

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, **columns) -> DataFrame:
    """query_id, rank, vec_id, score for the queries among ``vectors`` against all rows."""
    rows = materialise(quantised(vectors, **columns), "bits-rows")
    n = rows.count()
    blocks, query_blocks = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(n / every / BLOCK_QUERIES))
    deal = lambda c, m, seed: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(m)).cast("int")
    queries = rows.where(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min("v").alias("v"))
    queries = queries.withColumn("qb", deal(["id"], query_blocks, 1)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Rows are dealt by id and a row number of their file, so that a repeated row does not fill one block.
    base = rows.withColumn("rb", deal(["id", F.monotonically_increasing_id()], blocks, 2)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    keys = ["dim", "rb", "qb"]
    found = base.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search(k), "query_id long, id long, score long")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


#: DuckDB form of the query over embeddings (unique vec_ids).
SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]))::BIGINT AS score
      FROM e q JOIN e c ON c.vec_id != q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5
"""
