"""Operator 5, mixing sources to target weights: Poisson replication.

A source with n documents, target weight w (of a total W) and N documents in all has the mean
repetition rate w / W * N / n. Each document gets a Poisson count by inverting the distribution at a
uniform number hashed from seed and document; it is exploded by its count, and the copies are
sorted globally by a second hash. Only DataFrame functions are used.

Defined results: a null source is a source of its own. The document's hash is that of its doc_id,
or of its text where doc_id is null; repeated rows get equal counts, each row its own copies.
Sources of weight 0 get no copies. An empty table stays empty. Extra columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctra.llm.common import lookup, materialise

#: Means above this are split into a sum of equal Poisson parts, so that exp(-mean) keeps its digits.
PART = 32.0


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / float(2**52)


def rates(docs: DataFrame, weights: dict[str, float], default: float = 1.0, size: float = 1.0) -> DataFrame:
    """Per source marker ``m_source``: mean ``rate``, number of ``parts`` and the ``cdf`` of one part.

    ``size`` is the expected size of the mixture, as a multiple of the input.
    """
    weight = F.lit(float(default))
    for k, v in weights.items():
        weight = F.when(F.col("source") == k, float(v)).otherwise(weight)
    n = materialise(docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("w", weight), "mix-sizes")
    n_all, w_all = n.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    n = n.where("w > 0").withColumn("rate", F.col("w") / w_all * (n_all * float(size)) / F.col("n"))
    n = n.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 24).cast("int")  # beyond it lies less than 2**-53
    p0 = F.exp(-F.col("mean"))
    step = lambda a, k: F.struct((a["p"] * F.col("mean") / k).alias("p"), (a["c"] + a["p"] * F.col("mean") / k).alias("c"), F.concat(a["all"], F.array(a["c"] + a["p"] * F.col("mean") / k)).alias("all"))
    cdf = F.aggregate(F.sequence(F.lit(1), last), F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("all")), step)["all"]
    return materialise(n.select(_marker(F.col("source")).alias("m_source"), "rate", "parts", cdf.alias("cdf")), "mix-rates")


def _marker(source: Column) -> Column:
    return F.coalesce(F.to_json(F.struct(source.cast("string").alias("k"))), F.lit("null"))


def mix(docs: DataFrame, weights: dict[str, float], default: float = 1.0, size: float = 1.0, seed: int = 1) -> DataFrame:
    """Sorted copies: struct ``doc`` with the columns that came in, ``copy_no`` from 1, ``shuffle_key``."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), key.alias("m_key"), _marker(F.col("source")).alias("m_source"))
    rows = lookup(rows, rates(docs, weights, default, size), ["m_source"], "m_key", "inner")
    draw = lambda i: F.size(F.filter("cdf", lambda c: c <= _uniform(F.lit(f"count{seed}"), F.col("m_key"), i.cast("string"))))
    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), draw), F.lit(0), lambda a, x: a + x)
    rows = rows.select("doc", "m_key", count.alias("m_count")).where("m_count > 0")
    rows = rows.select("doc", "m_key", F.explode(F.sequence(F.lit(1), F.col("m_count"))).alias("copy_no"))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.col("m_key"), F.col("copy_no").cast("string"))))
    return rows.orderBy("shuffle_key").select("doc", "copy_no", "shuffle_key")


def sql(weights: dict[str, float], default: float = 1.0, seed: int = 1) -> str:
    """DuckDB form of ``mix`` over documents, for rates up to PART."""
    cases = "".join(f" WHEN source = '{k}' THEN {v!r}::DOUBLE" for k, v in weights.items())
    return f"""
WITH n AS (SELECT source, count(*) AS n, CASE{cases} ELSE {default!r}::DOUBLE END AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
k AS (SELECT source, rate, unnest(range(0, 120)) AS k FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k WHERE k <= 60),
u AS (SELECT doc_id, text, source, ('0x' || substr(md5('count{seed}|' || doc_id || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
m AS (SELECT u.doc_id, count(*) AS m FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u GROUP BY 1),
x AS (SELECT doc_id, unnest(range(1, m + 1)) AS copy_no FROM m)
SELECT d.doc_id, d.source, d.text, x.copy_no::INTEGER AS copy_no, md5('order{seed}|' || d.doc_id || '|' || x.copy_no) AS shuffle_key
FROM x JOIN documents d USING (doc_id)
"""
