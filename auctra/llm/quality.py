"""Operator 6, quality rules: robust multivariate outliers by minimum covariance determinant.

Every text gets counts, then a vector of four transformed statistics. Per language and source the
minimum-covariance-determinant estimate of centre and scatter is searched from three deterministic starts
(quartiles, moments, spatial signs): concentration steps, Spark aggregations over all rows, go on from each as long as its
determinant falls, and the end with the smallest determinant counts. A document is rejected if its squared Mahalanobis
distance exceeds a chi-square quantile.

Defined results: a null or empty text has no words and fails the base rules. Null languages and
sources form groups of their own. A group with fewer than ``min_rows`` documents that pass the base
rules is judged by the estimate of its whole language, and a language with fewer by the estimate of
the whole table; if that is smaller still, only the base rules judge. Equal rows get equal verdicts. An empty table gives an
empty result. Extra columns are passed through untouched.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from auctra.llm.common import WORD_PATTERN, batches_of, give_back, lookup, materialise

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIM = 4
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]

#: Statistics are held as whole numbers of this fraction, so that sums over rows are exact and
#: the same in any order.
UNIT = 256

#: Standard deviations added to the scatter in each direction (in natural-log units): mean word
#: length, symbols per 1000 characters, repeated lines and repeated words per 100 words. They keep
#: the estimate regular where most documents have no symbol or repeat at all, and are small enough
#: that with TAIL each statistic rejects alone: beside documents without any, from about 3.3 symbols,
#: 1.6 repeated lines or 20 repeated words on (the base rule starts at 50).
FLOORS = (0.04, 0.3, 0.2, 0.6)

#: Share of a group in the concentrated half.
ALPHA = 0.75
#: Concentration steps at most; a search ends when its determinant no longer falls, after some 5 to 10.
STEPS = 50
MIN_ROWS = 100
#: Probability that a clean, normal document is rejected.
TAIL = 1e-4

_word = re.compile(WORD_PATTERN)


def _counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = _word.findall(text)
    lines = [x for x in text.split("\n") if _word.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times: dict[tuple, int] = {}
        for x in windows:
            times[x] = times.get(x, 0) + 1
        end = 0
        for i, x in enumerate(windows):
            if times[x] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(texts: pd.Series) -> pd.DataFrame:
    give_back()
    return pd.DataFrame([_counts_of(x) for x in texts], columns=COUNTS, dtype="int64")


def base_failed(counts: Column, min_words: int = 50, max_repeat_pct: int = 50) -> Column:
    n = counts["n_words"]
    return (n < min_words) | (100 * counts["n_repeat_words"] > max_repeat_pct * n)


def _vector(counts: Column) -> Column:
    """Array of DIM whole numbers; only for texts with words."""
    n, chars = counts["n_words"].cast("double"), counts["word_chars"].cast("double")
    parts = (
        F.log(chars / n),
        F.log1p(1000 * counts["n_symbols"] / chars),
        F.log1p(100 * counts["n_dup_lines"] / n),
        F.log1p(100 * counts["n_repeat_words"] / n),
    )
    return F.array(*[F.round(UNIT * x).cast("long") for x in parts])


def chi2_cdf(x: float, even: int) -> float:
    """Chi-square distribution with an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(even // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p_above: float, even: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - chi2_cdf(mid, even) > p_above else (lo, mid)
    return hi


def _distance(v: Column) -> Column:
    """Squared Mahalanobis distance of vector ``v`` from the row's ``centre`` by its ``inverse``."""
    d = [v[i].cast("double") - F.col("centre")[i] for i in range(DIM)]
    return sum(((1 if i == j else 2) * F.col("inverse")[k] * d[i] * d[j] for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


_RIDGE = np.diag([(UNIT * x) ** 2 for x in FLOORS])


def _square(values) -> np.ndarray:
    m = np.zeros((DIM, DIM))
    for (i, j), x in zip(PAIRS, values):
        m[i, j] = m[j, i] = x
    return m


def _upper(m: np.ndarray) -> list[float]:
    return [float(m[i, j]) for i, j in PAIRS]


def _estimates(fix: float):
    """From sums over rows: centre, inverse of the corrected scatter, logarithm of its determinant."""

    def run(batches):
        for pdf in batches:
            rows = []
            for w, s, ss in zip(pdf["w"], pdf["s"], pdf["ss"]):
                m = np.asarray(s, float) / w
                cov = fix * (_square(np.asarray(ss, float) / w) - np.outer(m, m)) + _RIDGE
                rows.append((m.tolist(), _upper(np.linalg.inv(cov)), float(np.linalg.slogdet(cov)[1])))
            yield pdf[["g_lang", "g_source", "start", "n"]].assign(**dict(zip(("centre", "inverse", "logdet"), map(list, zip(*rows)))) if rows else {"centre": [], "inverse": [], "logdet": []})

    return run


def _from_signs(batches):
    """From sums over directions (whole numbers of 1/UNIT): the scatter of the signs in the units of the quartile start."""
    for pdf in batches:
        inverses = []
        for w, ss, inverse in zip(pdf["w"], pdf["ss"], pdf["inverse"]):
            sd = 1 / np.sqrt(np.diag(_square(inverse)))
            signs = DIM * _square(np.asarray(ss, float) / w) / UNIT**2
            inverses.append(_upper(np.linalg.inv(signs * np.outer(sd, sd) + _RIDGE)))
        yield pdf[["g_lang", "g_source", "start", "n", "centre"]].assign(inverse=inverses, logdet=float("inf"))


_PARAMS = "g_lang string, g_source string, start int, n long, centre array<double>, inverse array<double>, logdet double"


def _sums() -> list[Column]:
    v, w = F.col("v"), F.col("w")
    return [
        F.sum("w").alias("w"),
        F.array(*[F.sum(w * v[i]) for i in range(DIM)]).alias("s"),
        F.array(*[F.sum(w * v[i] * v[j]) for i, j in PAIRS]).alias("ss"),
    ]


def _group_keys(df: DataFrame, lang: str, source: str) -> DataFrame:
    """Adds q_lang and q_source, with a marker in place of null (JSON quotes never clash with it)."""
    return df.withColumn("q_lang", F.coalesce(F.to_json(F.struct(F.col(lang).cast("string").alias("k"))), F.lit("null"))).withColumn(
        "q_source", F.coalesce(F.to_json(F.struct(F.col(source).cast("string").alias("k"))), F.lit("null"))
    )


def fit(counted: DataFrame, min_rows: int = MIN_ROWS, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """Estimates from a table with ``lang``, ``source`` and the struct ``counts``.

    Returns two written tables: groups (q_lang, q_source to g_lang, g_source) and
    parameters by (g_lang, g_source). Groups are pre-aggregated to distinct vectors, and each
    step is one aggregation by (group, distance bucket): no group meets in one task.
    """
    rows = _group_keys(counted, "lang", "source").where(~base_failed(F.col("counts")))
    cells = materialise(rows.groupBy("q_lang", "q_source", _vector(F.col("counts")).alias("v")).agg(F.count("*").alias("w")), "mcd-cells")
    levels = F.array(
        F.struct(F.col("q_lang").alias("g_lang"), F.col("q_source").alias("g_source")),
        F.struct(F.col("q_lang").alias("g_lang"), F.lit("*").alias("g_source")),
        F.struct(F.lit("*").alias("g_lang"), F.lit("*").alias("g_source")),
    )
    cells = materialise(cells.withColumn("g", F.explode(levels)).groupBy("q_lang", "q_source", "g.g_lang", "g.g_source", "v").agg(F.sum("w").alias("w")), "mcd-cells")
    total = materialise(cells.groupBy("g_lang", "g_source").agg(F.sum("w").alias("n")).where(F.col("n") >= min_rows), "mcd-sizes")
    fine = F.when(F.col("g_source") != "*", 0).when(F.col("g_lang") != "*", 1).otherwise(2)
    groups = cells.select("q_lang", "q_source", "g_lang", "g_source").distinct().join(total, ["g_lang", "g_source"])
    groups = materialise(groups.groupBy("q_lang", "q_source").agg(F.min_by(F.struct("g_lang", "g_source"), fine).alias("g")).select("q_lang", "q_source", "g.*"), "mcd-groups")
    cells = materialise(cells.groupBy("g_lang", "g_source", "v").agg(F.sum("w").alias("w")), "mcd-cells")

    params = _starts(cells, total)
    while True:
        step = materialise(_concentrated(cells, params.where("fell")).mapInPandas(_estimates(ALPHA / chi2_cdf(chi2_quantile(1 - ALPHA, DIM), DIM + 2)), _PARAMS), "mcd-step")
        new = step.select(*_SEARCH, F.struct("centre", "inverse", "logdet").alias("new"))
        falls = F.coalesce(F.col("new.logdet") < F.col("logdet") - 1e-9, F.lit(False))
        better = lambda c: F.when(falls, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
        params = params.join(new, _SEARCH, "left").select(*_SEARCH, "n", better("centre"), better("inverse"), better("logdet"), falls.alias("fell"))
        params = materialise(params, "mcd-params")
        steps -= 1
        if not steps or not params.where("fell").limit(1).count():
            break
    least = F.min_by(F.struct("n", "centre", "inverse"), F.struct("logdet", "start"))
    return groups, materialise(params.groupBy("g_lang", "g_source").agg(least.alias("p")).select("g_lang", "g_source", "p.*"), "mcd-best")


_SEARCH = ["g_lang", "g_source", "start"]


def _starts(cells: DataFrame, total: DataFrame) -> DataFrame:
    """The three starts of every group."""
    # Medians and scaled quartile ranges of each statistic.
    values = cells.select("g_lang", "g_source", "w", F.posexplode("v").alias("k", "x")).groupBy("g_lang", "g_source", "k", "x").agg(F.sum("w").alias("w"))
    below = W.partitionBy("g_lang", "g_source", "k").orderBy("x")
    whole = W.partitionBy("g_lang", "g_source", "k")
    values = values.withColumn("c", F.sum("w").over(below)).withColumn("n", F.sum("w").over(whole))
    at = lambda q: F.min(F.when(F.col("c") >= q * F.col("n"), F.col("x"))).cast("double")
    start = values.groupBy("g_lang", "g_source", "k").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("sd"))
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    flat = lambda k: 1 / (pick("sd", k) * pick("sd", k) + (UNIT * FLOORS[k]) ** 2)
    quartiles = (
        start.groupBy("g_lang", "g_source")
        .agg(F.array(*[pick("mid", k) for k in range(DIM)]).alias("centre"), F.array(*[flat(i) if i == j else F.lit(0.0) for i, j in PAIRS]).alias("inverse"))
        .join(total, ["g_lang", "g_source"])
        .select("g_lang", "g_source", F.lit(0).alias("start"), "n", "centre", "inverse", F.lit(float("inf")).alias("logdet"))
    )
    quartiles = materialise(quartiles, "mcd-start")
    # Mean and covariance of all rows.
    moments = cells.groupBy("g_lang", "g_source").agg(*_sums()).join(total, ["g_lang", "g_source"]).withColumn("start", F.lit(1))
    moments = moments.mapInPandas(_estimates(1.0), _PARAMS).withColumn("logdet", F.lit(float("inf")))
    # Directions from the median, in units of the quartile ranges.
    near = lookup(cells.withColumn("spread", F.xxhash64("v")), quartiles, ["g_lang", "g_source"], "spread", "inner")
    z = F.array(*[(F.col("v")[i] - F.col("centre")[i]) * F.sqrt(F.col("inverse")[PAIRS.index((i, i))]) for i in range(DIM)])
    length = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))
    near = near.withColumn("z", z).withColumn("length", length)
    near = near.withColumn("v", F.transform("z", lambda x: F.coalesce(F.round(UNIT * F.try_divide(x, F.col("length"))), F.lit(0.0)).cast("long")))
    signs = near.groupBy("g_lang", "g_source").agg(*_sums()).join(quartiles, ["g_lang", "g_source"]).withColumn("start", F.lit(2)).mapInPandas(_from_signs, _PARAMS)
    return materialise(quartiles.unionByName(moments).unionByName(signs).withColumn("fell", F.lit(True)), "mcd-params")


def _concentrated(cells: DataFrame, params: DataFrame) -> DataFrame:
    """Sums over the rows nearest to each estimate.

    Buckets of distance (1/128 of a doubling) stand for its exact order; the last bucket
    that the half reaches into is taken whole.
    """
    near = lookup(cells.withColumn("spread", F.xxhash64("v")), params, ["g_lang", "g_source"], "spread", "inner")
    near = near.groupBy(*_SEARCH, "n", F.floor(128 * F.log2(1 + _distance(F.col("v")))).alias("b")).agg(*_sums())
    cum = W.partitionBy(*_SEARCH).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    near = near.withColumn("before", F.coalesce(F.sum("w").over(cum), F.lit(0))).where(F.col("before") < F.ceil(ALPHA * F.col("n")))
    return near.groupBy(*_SEARCH, "n").agg(
        F.sum("w").alias("w"), F.array(*[F.sum(F.col("s")[i]) for i in range(DIM)]).alias("s"), F.array(*[F.sum(F.col("ss")[k]) for k in range(len(PAIRS))]).alias("ss")
    )


def score(counted: DataFrame, groups: DataFrame, params: DataFrame, tail: float = TAIL) -> DataFrame:
    """Adds ``base_failed``, ``distance2`` (null without an estimate) and ``kept`` to rows with ``counts``."""
    lookup_table = materialise(groups.join(params, ["g_lang", "g_source"], "left").select("q_lang", "q_source", "centre", "inverse"), "mcd-lookup")
    rows = _group_keys(counted, "lang", "source").withColumn("__spread", F.xxhash64("counts", F.monotonically_increasing_id()))
    rows = lookup(rows, lookup_table, ["q_lang", "q_source"], "__spread").drop("__spread", "q_lang", "q_source")
    failed = base_failed(F.col("counts"))
    rows = rows.withColumn("base_failed", failed).withColumn("distance2", F.when(~failed & F.col("centre").isNotNull(), _distance(_vector(F.col("counts")))))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("distance2").isNull() | (F.col("distance2") <= chi2_quantile(tail, DIM)))).drop("centre", "inverse")


def _counted(docs: DataFrame, *columns) -> DataFrame:
    """A written table of the columns and the counts of each text."""
    with batches_of(docs.sparkSession, "2m"):
        return materialise(docs.select(*columns, "lang", "source", text_counts(F.col("text")).alias("counts")), "counts")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source, counts, base_failed, distance2, kept."""
    counted = _counted(docs, "doc_id")
    return score(counted, *fit(counted))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Texts are counted once; the rejected rows are written as keys of 128 bits and taken out."""
    k1, k2 = (F.xxhash64(F.lit(i), "doc_id", "lang", "source", "text").alias(f"k{i}") for i in (1, 2))
    counted = _counted(docs, k1, k2)
    bad = materialise(score(counted, *fit(counted.drop("k1", "k2"))).where("NOT kept").select("k1", "k2").distinct(), "quality-bad")
    # Merged at every size: the rejected keys grow with the documents.
    return docs.select(F.struct("*").alias("doc"), k1, k2).join(bad.hint("merge"), ["k1", "k2"], "left_anti").select("doc.*")
