"""Operator 2, language identification: a linear-chain conditional random field over words.

Words (runs of letters, lower-cased) are labelled with languages by forward-backward over the whole text.
Features of a word are its prefixes and suffixes, its character n-grams and, if it is in the lexicon, the
word itself; weights and label transitions are learned. Training sequences are spliced from pieces of
documents of different languages, so that switches have a learned cost. A document's language is the
one with the largest expected number of words, its score that share.

The field is fitted on a bounded sample: at most ``SAMPLE_DOCS`` documents of each language, chosen by
hash, and of their pieces of ``PIECE_WORDS`` words at most ``SAMPLE_PIECES``. Everything else covers whole
texts. Long texts are cut into segments only for computing: the transfer matrices of the segments
are chained, which gives the same marginals as one pass over the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Documents with a null language or
a null doc_id are predicted but not learned from. Without any labelled document every text is ``und``. Of equal
expected counts the alphabetically first language counts. Repeated rows are predicted alike. Extra
columns are passed through. More than ``MAX_LABELS`` languages are an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from auctra.llm.common import materialise

UND = "und"
SAMPLE_DOCS, SAMPLE_PIECES, PIECE_WORDS = 400, 600, 48
MAX_LABELS = 512
MIN_FEATURE, STEPS, RATE, L2 = 3, 30, 0.25, 1e-4
SEQUENCE, SEGMENT = 64, 32
#: Words computed at once, and words remembered by a worker.
CHUNK_WORDS, CACHED_WORDS = 200_000, 400_000

_word = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters; signs that the pattern takes beside letters (circled or Roman numerals, fractions) part words."""
    found = _word.findall(text.lower()) if text else []
    if text and not text.isascii() and not all(map(str.isalpha, found)):
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


def features_of(word: str) -> list[str]:
    s = f"<{word}>"
    n = len(s)
    out = [f"={word}"]
    out += [f"p{s[1 : 1 + k]}" for k in (1, 2, 3) if k < n - 1]
    out += [f"s{s[n - 1 - k : n - 1]}" for k in (1, 2, 3, 4) if k < n - 1]
    out += [s[i : i + k] for k in (1, 2, 3) for i in range(n - k + 1)]
    return out


class Field:
    """Learned labels, feature weights (feature to row of ``weights``) and transitions."""

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.index, self.weights, self.moves = labels, index, weights, moves
        self._clear()

    def __getstate__(self):
        return self.labels, self.index, self.weights, self.moves

    def __setstate__(self, state):
        self.__init__(*state)

    def _clear(self):
        self.known: dict[str, int] = {}
        self.scores = np.ones((1024, len(self.labels)))

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp(score) of each word and label, scaled to a largest of 1."""
        if len(self.known) > CACHED_WORDS:
            self._clear()
        known, get = self.known, self.index.get
        new = [w for w in set(words) if w not in known]
        if new:
            rows, ends = [], []
            for w in new:
                rows += [x for f in features_of(w) if (x := get(f)) is not None]
                ends.append(len(rows))
            sums = np.concatenate([np.zeros((1, len(self.labels))), np.cumsum(self.weights[rows], axis=0)])
            e = np.diff(sums[np.array([0, *ends])], axis=0)
            e = np.exp(e - e.max(1, keepdims=True))
            first = len(known)
            while first + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.ones_like(self.scores)])
            self.scores[first : first + len(new)] = e
            known.update(zip(new, range(first, first + len(new))))
        return np.maximum(self.scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))], 1e-30)

    def marginals(self, lists: list[list[str]]) -> list[np.ndarray]:
        """(words, labels) probabilities of every text, by forward-backward."""
        sizes = np.array([len(x) for x in lists])
        flat = self.emissions([w for x in lists for w in x])
        k, move = len(self.labels), np.exp(self.moves)
        count = -(-sizes // SEGMENT)  # segments of each text
        text = np.repeat(np.arange(len(lists)), count)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = (np.cumsum(sizes) - sizes)[text] + rank * SEGMENT
        length = np.minimum(SEGMENT, sizes[text] - rank * SEGMENT)
        at = start[:, None] + np.minimum(np.arange(SEGMENT), length[:, None] - 1)
        e = flat[at]
        inside = np.arange(SEGMENT) < length[:, None]
        # Transfer matrix of every segment; the first word of a text has no transition.
        through = np.where((rank == 0)[:, None, None], np.eye(k), move)
        step = through * e[:, 0, None, :]
        for t in range(1, SEGMENT):
            nxt = (step @ move) * e[:, t, None, :]
            nxt /= nxt.max((1, 2), keepdims=True)
            step = np.where(inside[:, t, None, None], nxt, step)
        # Chain the segments of each text, all texts at once.
        enter, leave = np.ones((len(text), k)), np.ones((len(text), k))
        first = np.cumsum(count) - count
        for r in range(1, int(count.max(initial=0))):
            s = first[count > r] + r
            v = (enter[s - 1, None, :] @ step[s - 1])[:, 0]
            enter[s] = v / v.sum(1, keepdims=True)
            s = first[count > r] + count[count > r] - 1 - r
            v = (step[s + 1] @ leave[s + 1, :, None])[:, :, 0]
            leave[s] = v / v.sum(1, keepdims=True)
        ahead = np.empty_like(e)
        a = (enter[:, None, :] @ through)[:, 0] * e[:, 0]
        ahead[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, SEGMENT):
            a = (ahead[:, t - 1] @ move) * e[:, t]
            ahead[:, t] = a / a.sum(1, keepdims=True)
        b = leave
        for t in range(SEGMENT - 1, -1, -1):
            p = ahead[:, t] * b
            ahead[:, t] = p / p.sum(1, keepdims=True)
            nxt = (e[:, t] * b) @ move.T
            nxt /= nxt.sum(1, keepdims=True)
            b = np.where(inside[:, t, None], nxt, b)
        return np.split(ahead[inside], np.cumsum(sizes)[:-1])


def train(pieces: list[tuple[str, list[str]]]) -> Field | None:
    """Fits the field to (language, words) pieces by gradient ascent on the log-likelihood."""
    labels = sorted({x for x, w in pieces if w})
    if not labels:
        return None
    k, rng = len(labels), np.random.default_rng(7)
    number = {x: i for i, x in enumerate(labels)}
    stream = [(w, number[x]) for j in rng.permutation(len(pieces)) for x, w in [pieces[j]]]
    words = [w for x, _ in stream for w in x]
    truth = np.repeat([y for _, y in stream], [len(x) for x, _ in stream])
    counts = Counter(f for w in words for f in features_of(w))
    index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= MIN_FEATURE))}
    vocab = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rows = [[index[f] for f in features_of(w) if f in index] for w in vocab]
    lens = np.array([len(r) for r in rows])
    feat, owner = np.array([x for r in rows for x in r], np.int64), np.repeat(np.arange(len(rows)), lens)

    n = -(-len(words) // SEQUENCE) * SEQUENCE
    pad = lambda x, v: np.concatenate([x, np.full(n - len(x), v)]).reshape(-1, SEQUENCE)
    seq = pad(np.array([vocab[w] for w in words]), 0)
    true, real = pad(truth, 0), pad(np.ones(len(words), bool), False)
    onehot = np.eye(k)[true] * real[..., None]
    follow = real[:, 1:] & real[:, :-1]
    seen = np.zeros((k, k))
    np.add.at(seen, (true[:, :-1][follow], true[:, 1:][follow]), 1)

    weights, moves = np.zeros((len(index), k)), np.zeros((k, k))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, moves)]
    for it in range(1, STEPS + 1):
        score = np.stack([np.bincount(owner, weights[feat, y], len(rows)) for y in range(k)], 1)
        e, move = np.exp(score - score.max(1, keepdims=True))[seq], np.exp(moves)
        e = np.where(real[..., None], np.maximum(e, 1e-30), 1.0)
        ahead, norm = np.empty_like(e), np.ones(e.shape[:2])
        a = e[:, 0]
        for t in range(SEQUENCE):
            a = e[:, 0] if t == 0 else np.where(real[:, t, None], (a @ move) * e[:, t], a)
            norm[:, t] = a.sum(1)
            a = a / norm[:, t, None]
            ahead[:, t] = a
        b, both = np.ones((len(e), k)), np.zeros((k, k))
        expected = np.zeros_like(e)
        for t in range(SEQUENCE - 1, -1, -1):
            p = ahead[:, t] * b
            expected[:, t] = p / p.sum(1, keepdims=True)
            if t:
                eb = np.where(real[:, t, None], e[:, t] * b / norm[:, t, None], 0)
                both += move * (ahead[:, t - 1].T @ eb)
                b = np.where(real[:, t, None], eb @ move.T, b)
        gap = (onehot - expected * real[..., None]).reshape(-1, k)
        per_word = np.stack([np.bincount(seq.ravel(), gap[:, y], len(rows)) for y in range(k)], 1)
        grad = np.stack([np.bincount(feat, per_word[owner, y], len(index)) for y in range(k)], 1)
        for x, g, (m, v) in zip((weights, moves), (grad / len(words) - L2 * weights, (seen - both) / len(words) - L2 * moves), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-9)
    return Field(labels, index, weights, moves)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame) -> list[tuple[str, list[str]]]:
    """The bounded training sample, from text and language of documents that are not held out. A document repeated in many rows counts once."""
    labelled = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_key")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id", "text_key"))
    chosen = materialise(labelled.select("doc_id", "lang", "text_key").distinct().withColumn("r", first).where(F.col("r") <= SAMPLE_DOCS), "crf-chosen")
    langs = chosen.select("lang").distinct().limit(MAX_LABELS + 1).collect()
    if len(langs) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages")
    texts = labelled.join(F.broadcast(chosen.drop("r")), ["doc_id", "lang", "text_key"], "left_semi").dropDuplicates(["doc_id", "lang", "text_key"])  # MAX_LABELS * SAMPLE_DOCS ids at most

    def cut(batches):
        for pdf in batches:
            rows = [(d, x, k, i, w[i : i + PIECE_WORDS]) for d, x, k, t in zip(pdf["doc_id"], pdf["lang"], pdf["text_key"], pdf["text"]) for w in [words_of(t)] for i in range(0, len(w), PIECE_WORDS)]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "text_key", "at", "words"])

    pieces = texts.mapInPandas(cut, "doc_id long, lang string, text_key long, at long, words array<string>")
    order = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64(F.lit(2), "doc_id", "at"), "doc_id", "at", "text_key"))
    pieces = pieces.withColumn("r", order).where(F.col("r") <= SAMPLE_PIECES)
    return [(r["lang"], list(r["words"])) for r in sorted(pieces.collect(), key=lambda r: (r["lang"], r["r"]))]


_LABEL = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def predictor(spark, field: Field | None):
    """A pandas UDF from texts to ``lang_pred`` and ``score``."""
    shared = spark.sparkContext.broadcast(field)

    @F.pandas_udf(_LABEL)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        field = shared.value
        for batch in texts:
            label, score = np.full(len(batch), UND, dtype=object), np.zeros(len(batch))
            values = batch.tolist()
            at = 0
            while field is not None and at < len(values):
                # Texts are tokenised until a chunk is full, so that memory is bounded.
                lists, where, n = [], [], 0
                while at < len(values) and n < CHUNK_WORDS:
                    if x := words_of(values[at]):
                        lists.append(x)
                        where.append(at)
                        n += len(x)
                    at += 1
                if lists:
                    for i, p in zip(where, field.marginals(lists)):
                        share = p.mean(0)
                        best = int(np.argmax(share))
                        label[i], score[i] = field.labels[best], min(1.0, float(share[best]))
            yield pd.DataFrame({"lang_pred": label, "score": score})

    return predict


def span_labeller(spark, field: Field):
    """A pandas UDF from texts to spans (start, end in characters of the lower-cased text) of one language each."""
    shared = spark.sparkContext.broadcast(field)

    @F.pandas_udf(_SPANS)
    def label(texts: pd.Series) -> pd.Series:
        field, out = shared.value, []
        for text in texts:
            found = list(_word.finditer(text.lower())) if text else []
            spans: list[dict] = []
            if found:
                for m, y in zip(found, field.marginals([[m[0] for m in found]])[0].argmax(1)):
                    if spans and spans[-1]["lang"] == field.labels[y]:
                        spans[-1]["end"] = m.end()
                    else:
                        spans.append({"start": m.start(), "end": m.end(), "lang": field.labels[y]})
            out.append(spans)
        return pd.Series(out, dtype=object)

    return label


def identify(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Struct ``doc`` with the columns that came in, ``held_out``, ``lang_pred``, ``score``."""
    field = field or train(sample(docs))
    rows = docs.select(F.struct("*").alias("doc"), held_out(F.col("doc_id")).alias("held_out"), predictor(docs.sparkSession, field)(F.col("text")).alias("p"))
    return rows.select("doc", "held_out", "p.*")
