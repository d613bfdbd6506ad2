"""Operator 13, spelling variants: search schemes with one error on bidirectional FM-indexes.

Two words are near if one code point inserted, deleted or replaced turns one into the other. A word is
cut in the middle; with one error one half stays as it is. So the words are indexed in two ways: by the start
that every near word with the same first half shares, and by the end that every near word with the same second
half shares. Starts (ends) are dealt to buckets by hash; a start with more words than a bucket holds is cut into parts, its
queries into as many, and every part meets every part of the queries, so no task holds more than a few buckets' words.

A bucket is a bidirectional FM-index over its delimited words (``WordIndex``): the suffix ranks of the text and of the
reversed text. A query matches one half exactly from the middle outwards up to the delimiter, then extends across the other
half with one error up to the other delimiter; all queries of a bucket step together. A pair with a common first half comes from the
first search only, so every pair is found once and no pair crosses a shuffle: each bucket returns the count and the best near word of a query.

Defined results: a null text has no runs; a null doc_id counts as the empty text. Repeated rows count each on their own. Ties of n go to the smallest
word in code-point order. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctra.llm.common import batches_of, give_back, lookup, materialise
from auctra.tables import discard

#: A run is deleted from where this divides its hash.
SLIP = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Words of a bucket on average.
BUCKET_WORDS = 4096
#: From this length on words are compared one by one under a common start or end of half this length: an index takes memory by its letters.
LONG = 256
#: Different words in a worker's counts before they are given out.
HELD_WORDS = 300_000

#: Latin-1 bytes: letters of [A-Za-zÀ-ÿ] with A-Z lowered, blanks for all else.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> Counter:
    """Lower-cased runs as Latin-1 bytes, one byte a code point, with their counts."""
    return Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())


def slipped(run: bytes, seed: int) -> bytes:
    """The run without one code point, if ``SLIP`` divides its hash. ``seed``: the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    return run if h % SLIP else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all texts, with at least ``min_length`` code points and ``min_count`` occurrences."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}
        out = lambda: pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"]):
                seed = zlib.crc32(f"{key}:".encode())
                for run, n in runs_of(text).items():
                    word = slipped(run, seed)
                    if len(word) >= min_length:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield out()
                    held = {}
            del pdf
            give_back()
        if held:
            yield out()

    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class WordIndex:
    """Bidirectional FM-index over distinct words, each between delimiters.

    ``below[d][i, c]``: how many of the first i characters of the transform are less than c; d = 0 for the text, 1 for the
    reversed text. A state is the first rank in either order and the number of ranks.
    """

    END, MARK = 0, 1  # codes of the end of the text and of the delimiter; letters follow

    def __init__(self, words: list[str]):
        self.words = words
        text = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), "<u4")
        self.letters = np.unique(text)[1:]  # "\n" is the least
        codes = np.append(np.where(text == 10, self.MARK, np.searchsorted(self.letters, text) + 2), self.END).astype(np.int64)
        self.size, self.sigma = len(codes), len(self.letters) + 2
        backward = np.append(codes[-2::-1], self.END)
        order = self._order(codes)
        self.below = [self._below(codes, order), self._below(backward, self._order(backward))]
        self.first = self.below[0][-1]  # characters of the text less than c
        marks = np.flatnonzero(codes == self.MARK)
        word_at = np.full(self.size, -1)
        word_at[marks[:-1]] = np.arange(len(words))
        self.word_of = word_at[order]  # by rank of a suffix that starts with the delimiter of a word

    def _order(self, codes: np.ndarray) -> np.ndarray:
        """Suffix array: nine characters at once, then by doubling."""
        n, span = len(codes), 9
        key = np.zeros(n, np.int64)
        for i in range(span):
            key[: n - i] += codes[i:] << (7 * (span - 1 - i))
        while True:
            order = np.argsort(key, kind="stable")
            rank = np.zeros(n, np.int64)
            rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
            if rank[order[-1]] == n - 1:
                return order
            key = rank * (n + 1)
            key[: n - span] += rank[span:] + 1
            span *= 2

    def _below(self, codes: np.ndarray, order: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes) + 1, self.sigma + 1), np.int32)
        out[np.arange(1, len(codes) + 1), codes[order - 1] + 1] = 1
        np.cumsum(out, 0, out=out)
        return np.cumsum(out, 1, out=out)

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words, a row each, ended by -1, and their lengths; letters that the index lacks are -2."""
        lengths = np.array([len(w) for w in words], np.int64)
        out = np.full((len(words), int(lengths.max(initial=0)) + 1), -1, np.int64)
        text = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.letters, text), len(self.letters) - 1)
        out[np.arange(out.shape[1]) < lengths[:, None]] = np.where(self.letters[at] == text, at + 2, -2)
        return out, lengths

    def start(self, n: int) -> np.ndarray:
        """States (rank, rank in the reversed text, size) of the empty pattern."""
        return np.tile(np.array([0, 0, self.size], np.int64), (n, 1))

    def step(self, states: np.ndarray, codes: np.ndarray, right: bool) -> np.ndarray:
        """States after one more character on the left or on the right; size 0 if it does not occur there."""
        below, own, other = self.below[right], int(right), int(not right)
        c = np.maximum(codes, 0)
        lo, hi = states[:, own], states[:, own] + states[:, 2]
        under, upto = below[lo, c], below[lo, c + 1]
        under_hi, upto_hi = below[hi, c], below[hi, c + 1]
        out = np.empty_like(states)
        out[:, own] = self.first[c] + upto - under
        out[:, other] = states[:, other] + under_hi - under
        out[:, 2] = np.where(codes < 0, 0, (upto_hi - under_hi) - (upto - under))
        return out

    def letters_beside(self, states: np.ndarray, not_code: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row of states, code) of every letter but ``not_code`` that occurs next to a state's pattern."""
        below, own = self.below[right], int(right)
        lo, hi = states[:, own], states[:, own] + states[:, 2]
        there = np.diff(below[hi, 2:] - below[lo, 2:]) > 0
        rows = np.flatnonzero(not_code >= 2)
        there[rows, not_code[rows] - 2] = False
        return np.nonzero(there)

    def near(self, queries: list[str], suffix: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word), as positions, one error apart, where the query's first (``suffix``: second) half is the word's."""
        codes, lengths = self.coded(queries)
        half = lengths // 2
        alive, states, done = np.arange(len(queries)), self.start(len(queries)), []
        # One half exactly, from the middle outwards, then its delimiter.
        same = lengths - half if suffix else half
        for t in range(int(same.max(initial=0)) + 1):
            ends = same[alive] == t
            c = np.where(ends, self.MARK, codes[alive, np.where(ends, 0, half[alive] + t if suffix else half[alive] - 1 - t)])
            states = self.step(states, c, right=suffix)
            done.append((alive[ends], states[ends]))
            keep = ~ends & (states[:, 2] > 0)
            alive, states = alive[keep], states[keep]
        alive, states = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        keep = states[:, 2] > 0
        q, w = self._across(codes, half, lengths, alive[keep], states[keep], suffix)
        if suffix:  # a common first half is the other search's
            keep = np.array([not self.words[j].startswith(queries[i][: half[i]]) for i, j in zip(q.tolist(), w.tolist())], bool)
            q, w = q[keep], w[keep]
        return q, w

    def _across(self, codes: np.ndarray, half: np.ndarray, lengths: np.ndarray, alive: np.ndarray, states: np.ndarray, suffix: bool) -> tuple[np.ndarray, np.ndarray]:
        """Extends over the other half with one error: replaced, inserted (before another letter) or deleted (last of equals)."""
        rest = half if suffix else lengths - half
        right = not suffix

        def code(q: np.ndarray, t: int) -> np.ndarray:
            """The t-th character of the other half, counted from the middle; the delimiter behind the last."""
            at = half[q] - 1 - t if suffix else half[q] + t
            return np.where(t >= rest[q], self.MARK, codes[q, np.clip(at, 0, codes.shape[1] - 1)])

        found, with_error, states_e = [], alive[:0], states[:0]
        for t in range(int(rest.max(initial=0)) + 1):
            c = code(alive, t)
            row, letter = self.letters_beside(states, c, right)
            other, other_states = alive[row], self.step(states[row], letter + 2, right)
            # An inserted letter stands before character t.
            q, s = np.concatenate([with_error, other]), np.concatenate([states_e, other_states])
            ends = rest[q] == t
            s = self.step(s, code(q, t), right)
            hit = ends & (s[:, 2] > 0)
            found.append((q[hit], self.word_of[s[hit, 0]]))
            go = ~ends & (s[:, 2] > 0)
            replaced = rest[other] > t
            skipped = (rest[alive] > t) & (c != code(alive, t + 1))
            with_error = np.concatenate([q[go], other[replaced], alive[skipped]])
            states_e = np.concatenate([s[go], other_states[replaced], states[skipped]])
            states = self.step(states, c, right)
            keep = (rest[alive] > t) & (states[:, 2] > 0)
            alive, states = alive[keep], states[keep]
        q, w = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return q, w


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def one_error(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and len(b) - len(a) < 2 and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _near_long(words: list[str], queries: list[str], suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """As ``WordIndex.near`` for queries of ``LONG`` code points or more: by their common start or end, then one by one."""
    shown, by = (lambda w: w[-(LONG // 2) + 1 :] if suffix else w[: LONG // 2 - 1]), {}
    for j, w in enumerate(words):
        if len(w) >= LONG - 1:
            by.setdefault(shown(w), []).append(j)
    pairs = []
    for i, a in enumerate(queries):
        for j in by.get(shown(a), ()) if len(a) >= LONG else ():
            if one_error(a, words[j]) and words[j].startswith(a[: len(a) // 2]) != suffix:
                pairs.append((i, j))
    return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)


def _near_best(words: list[str], n: np.ndarray, queries: list[str], suffix: bool, chunk: int = 8192) -> pa.Table:
    """(word, n_near, best_n, best) of the queries that have near words here."""
    if not words or not queries:
        return _FOUND.empty_table()
    place = np.empty(len(words), np.int64)
    place[np.argsort(np.array(words, object))] = np.arange(len(words))
    short = np.array([j for j, w in enumerate(words) if len(w) <= LONG], np.int64)
    index, out = WordIndex([words[j] for j in short]) if len(short) else None, []
    asked = [a for a in queries if len(a) < LONG] if index else []
    parts = [(asked[lo : lo + chunk], False) for lo in range(0, len(asked), chunk)] + [([a for a in queries if len(a) >= LONG], True)]
    for part, long in parts:
        q, w = _near_long(words, part, suffix) if long else index.near(part, suffix)
        w = w if long else short[w]
        order = np.lexsort((place[w], -n[w], q))
        q, w = q[order], w[order]
        at = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q
        counts = np.diff(np.append(at, len(q)))
        out += zip([part[i] for i in q[at]], counts.tolist(), n[w[at]].tolist(), [words[i] for i in w[at]])
    return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)


def _keys(suffix: bool, lengths: list[Column]) -> Column:
    """Keys of the starts (ends) of a word that words of these lengths are indexed by."""
    size = lambda m: F.floor(m / 2 if suffix else (m - 1) / 2).cast("int")
    part = lambda k: F.right("word", k) if suffix else F.substring(F.col("word"), F.lit(1), k)
    return F.array_distinct(F.array(*[F.struct(size(m).alias("k"), part(size(m)).alias("half")) for m in lengths]))


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words`` (word, n; written, distinct) that has a near one."""
    buckets = max(1, math.ceil(words.count() / bucket_words))
    length = F.length("word")
    sides = [(F.lit(int(s)).alias("side"), s) for s in (False, True)]
    both = lambda keys: [words.select("word", "n", side, F.explode(keys(s)).alias("key")) for side, s in sides]
    index = DataFrame.unionByName(*both(lambda s: _keys(s, [length])))
    asked = DataFrame.unionByName(*both(lambda s: _keys(s, [F.greatest(length - 1, F.lit(min_length)), length, length + 1])))
    keyed = lambda df: df.select(F.col("word").alias("word"), F.col("n").alias("n"), "side", F.xxhash64("side", "key").alias("key"))
    index, asked = keyed(index), keyed(asked)
    hot = materialise(index.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > bucket_words).select("key", F.ceil(F.col("c") / bucket_words).alias("parts")), "variant-hot")

    def dealt(df: DataFrame, own: str, others: str) -> DataFrame:
        """Buckets of rows; the rows of a hot key have one of its parts and meet all parts of the other table."""
        df = lookup(df, hot, ["key"], "word")
        df = df.withColumn("bucket", F.when(F.col("parts").isNull(), F.pmod("key", F.lit(buckets))).otherwise(F.col("key"))).fillna(1, ["parts"])
        df = df.withColumn(own, F.pmod(F.xxhash64("word"), F.col("parts")))
        return df.withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("side", "bucket", "part", "chunk", "word", "n")

    def search(_, left: pa.Table, right: pa.Table) -> pa.Table:
        suffix = bool(left.num_rows and left["side"][0].as_py())
        return _near_best(left["word"].to_pylist(), left["n"].to_numpy(), right["word"].unique().to_pylist(), suffix)

    keys = ["side", "bucket", "part", "chunk"]
    found = dealt(index, "part", "chunk").groupBy(*keys).cogroup(dealt(asked, "chunk", "part").groupBy(*keys)).applyInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus_n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus_n")).alias("best_n"), F.col("b.best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed by doubling the steps; n at least doubles with each, so there is no cycle."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = materialise(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        discard(now)
        if not then.where("moved").limit(1).count():
            return then.drop("moved")
        now = then.drop("moved")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text)."""
    with batches_of(docs.sparkSession, "2m"):
        words = materialise(word_counts(docs, min_length, min_count), "variant-words")
    near = near_words(words, min_length, bucket_words)
    takes = F.col("best_n") >= 2 * F.col("n")
    known = materialise(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")), "variant-forms")
    roots = last_forms(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
