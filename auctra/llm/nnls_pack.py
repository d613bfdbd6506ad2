"""Operator 9, packing: pattern counts by non-negative least squares.

Every document's token ids, ended by ``eos``, are cut into whole windows, one body (a multiple of
``unit`` tokens) and one tail (less than ``unit``). Combinations of few body lengths that fill a window
exactly are enumerated; non-negative least squares finds how often to repeat each, so that they use
up the histogram of body lengths. The counts are rounded down, and what is left, tails included, is
packed greedily, longest first. All this works on the histogram (at most window / unit + unit
lengths), whatever the number of documents. Pieces get their place by their rank among the pieces of
their length, which is computed from counts per (length, bucket) and a rank within the bucket.

Defined results: a null or empty text has the one token ``eos``. Repeated rows are packed each on their
own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from auctra.llm.common import batches_of, give_back, materialise

WINDOW, UNIT, EOS = 4096, 64, 2
#: Most different lengths of a combination; each may repeat.
DEPTH = 2
#: Mean rows of a (length, bucket) in ranking.
BUCKET_ROWS = 50_000
#: Words in a worker's memory of token ids, by generation.
CACHED_WORDS = 250_000
#: Texts whose new words are encoded together.
TEXTS = 256

#: A Latin letter or digit, then ASCII signs but the apostrophe, up to the end.
_ENDED = re.compile(rb"(.*(?:[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-&(-/:-@\[-`{-~]+)", re.S)

_memory: dict[str, tuple] = {}


class WordTokens:
    """Token ids of texts for lower-casing tokenizers that never join across white space, word by word.

    Ids are little-endian unsigned 32-bit. Two generations of words are remembered, so memory is
    bounded and frequent words stay. Signs after a letter or digit at the end of a word are a piece of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.new, self.old = Tokenizer.from_file(path), {}, {}
        spelled = self.tokenizer.get_vocab()
        #: By id: whether the token ends a word.
        self.ends = np.zeros(max(spelled.values()) + 1, bool)
        self.ends[[i for w, i in spelled.items() if w.endswith("</w>")]] = True

    def _encode(self, words: list[str]) -> list[bytes]:
        """Words of Latin letters only are one word to the tokenizer too, so many are encoded as one text and cut where a word ends."""
        alone, plain = [], []
        for i, w in enumerate(words):
            (plain if w.isalpha() and (w.isascii() or max(w) <= "ÿ") else alone).append(i)
        texts = [" ".join([words[i] for i in plain[k : k + 256]]) for k in range(0, len(plain), 256)]
        made = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in alone] + texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(made[len(alone) :]), "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(plain):  # a vocabulary without word ends
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        out, data, ends = [b""] * len(words), ids.tobytes(), ends.tolist()
        for i, x in zip(alone, made):
            out[i] = np.array(x, "<u4").tobytes()
        for i, a, b in zip(plain, [0, *ends], ends):
            out[i] = data[a:b]
        return out

    def _learn(self, words: set[bytes]) -> None:
        new, old = self.new, self.old
        ended, whole = {}, set()
        for w in words:
            if w in old:
                new[w] = old[w]
            elif b"<|" not in w and (m := _ENDED.fullmatch(w)):
                ended[w] = m.groups()
                whole.update(x for x in ended[w] if x not in new)
            else:
                whole.add(w)
        for w in [w for w in whole if w in old]:
            new[w] = old[w]
            whole.discard(w)
        order = list(whole)
        new.update(zip(order, self._encode([w.decode("utf-8", "surrogatepass") for w in order])))
        for w, (stem, marks) in ended.items():
            new[w] = new[stem] + new[marks]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of several texts; the words that are new in them are encoded together."""
        split = []
        for text in texts:
            data = text.encode("utf-8", "surrogatepass") if text else b""
            # Special tokens are spelled with "<|" and count in lower case only.
            split.append((data if b"<|" in data else data.lower()).split())
        if missing := set().union(*split).difference(self.new):
            self._learn(missing)
        out = [b"".join(map(self.new.__getitem__, words)) for words in split]
        if len(self.new) > CACHED_WORDS:
            self.new, self.old = {}, self.new
        return out


def _tokens(path: str) -> WordTokens:
    if path not in _memory:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for one task
        _memory[path] = WordTokens(path)
    return _memory[path]


def cuts(n: int, window: int, unit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with n ids."""
    whole, rest = divmod(n, window)
    out = [(i * window, window) for i in range(whole)]
    body = rest // unit * unit
    if body:
        out.append((whole * window, body))
    if rest - body:
        out.append((whole * window + body, rest - body))
    return out


def _pieces_udf(path: str, window: int, unit: int, eos: int, with_ids: bool):
    fields = [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = np.array([eos], "<u4").tobytes()

    @F.pandas_udf(T.ArrayType(T.StructType(fields)))
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = _tokens(path)
        for batch in texts:
            rows = []
            for ids in chain.from_iterable(tokens.encode_all(batch.iloc[at : at + TEXTS].tolist()) for at in range(0, len(batch), TEXTS)):
                ids += end
                own = []
                for start, length in cuts(len(ids) // 4, window, unit):
                    part = ids[4 * start : 4 * (start + length)]
                    own.append((start, length, zlib.crc32(part)) + ((part,) if with_ids else ()))
                rows.append([dict(zip([f.name for f in fields], x)) for x in own])
            yield pd.Series(rows)
            give_back()

    return pieces


def combinations(units: int, depth: int = DEPTH) -> list[Counter]:
    """Multisets of at most ``depth`` different lengths (in units, below a window) that fill a window,
    and of three single lengths."""
    out = [Counter({i: units // i}) for i in range(1, units) if units % i == 0]
    if depth > 1:
        for i in range(1, units):
            for j in range(i + 1, units):
                out += [Counter({i: (units - b * j) // i, j: b}) for b in range(1, units // j + 1) if (units - b * j) % i == 0 and units > b * j]
        out += [Counter((i, j, units - i - j)) for i in range(1, units // 3 + 1) for j in range(i + 1, (units - i + 1) // 2) if units - i - j > j]
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        used[k] = True
        while True:
            z = np.zeros_like(x)
            z[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            bad = used & (z <= 1e-12)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            used &= x > 1e-12
            x[~used] = 0
        x = z
    return x


def plan(hist: dict[int, int], window: int = WINDOW, unit: int = UNIT) -> list[tuple[dict[int, int], int]]:
    """(pieces per length, number of sequences) of every pattern; together they use up the histogram."""
    left = {k: v for k, v in hist.items() if v}
    patterns: list[tuple[dict[int, int], int]] = []

    def take(per: dict[int, int], most: int | None = None) -> None:
        times = min(left.get(k, 0) // c for k, c in per.items())
        times = times if most is None else min(times, most)
        if times > 0:
            patterns.append((per, times))
            for k, c in per.items():
                left[k] -= c * times
                if not left[k]:
                    del left[k]

    if window in left:
        take({window: 1})
    units = window // unit
    ways = combinations(units)
    a, b = np.zeros((units, len(ways))), np.zeros(units)
    for j, way in enumerate(ways):
        for i, c in way.items():
            a[i, j] = c
    for k, v in left.items():
        if k % unit == 0:
            b[k // unit] = v
    if b.any():
        x = nnls(a, b / b.sum()) * b.sum()
        for j in np.argsort(-x, kind="stable"):
            if x[j] >= 1:
                take({i * unit: c for i, c in ways[j].items()}, math.floor(x[j] + 1e-9))
    while left:
        room, per = window, {}
        for k in sorted(left, reverse=True):
            c = min(left[k], room // k)
            if c:
                per[k], room = c, room - c * k
        take(per)
    return patterns


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, unit: int = UNIT, eos: int = EOS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, row_id, start, length, ids_crc32 (and ids), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file, present on every executor.
    """
    spark = docs.sparkSession
    made = docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), _pieces_udf(tokenizer, window, unit, eos, with_ids)(F.col("text")).alias("p"))
    made = made.withColumn("doc_tokens", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]))
    with batches_of(spark, "2m"):
        made = materialise(made.select("doc_id", "row_id", "doc_tokens", F.explode("p").alias("p")).select("doc_id", "row_id", "doc_tokens", "p.*"), "pack-pieces")

    hist = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # window / unit + unit lengths at most
    rows, first = [], 0
    used: Counter = Counter()
    for per, times in plan(hist, window, unit):
        at = 0
        for k, c in sorted(per.items(), reverse=True):
            rows.append((k, used[k], used[k] + c * times, first, c, at))
            used[k] += c * times
            at += c * k
        first += times
    # An Arrow table: rows would start further Python workers.
    columns = ["length", "lo", "hi", "first", "per", "at"]
    slots = spark.createDataFrame(pa.table({c: pa.array([x[i] for x in rows], pa.int64()) for i, c in enumerate(columns)}))

    buckets = max(1, math.ceil(sum(hist.values()) / BUCKET_ROWS))
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("row_id", "start"), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("row_id", "start")) - 1)
    ranked = ranked.join(materialise(offsets, "pack-offsets"), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= lo AND rank < hi")
    q = F.col("rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(q / F.col("per"))).withColumn("offset", F.col("at") + q % F.col("per") * F.col("length"))
    return placed.select("doc_id", "row_id", "start", "length", "ids_crc32", *["ids"] * with_ids, "doc_tokens", "sequence_id", "offset")
