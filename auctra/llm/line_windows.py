"""Operator 7, line dedup: overlapping three-line windows.

Every run of three consecutive lines is hashed (128 bits). A window that occurs more than once in
the corpus is kept at its first place, by (doc_id, position); the lines that later occurrences cover
are merged and removed. Only DataFrame functions are used.

Defined results: a null text stays null and an empty text stays empty (one empty line). A text
with fewer than three lines has no window. Windows without a word (blank lines only) do not count.
Null doc_ids sort last. Rows with equal doc_id and text are one document: each gets the same cleaned
text, and they do not count as each other's copies. Of equal doc_ids with different texts, the text
with the smaller hash comes first. If occurrences overlap within one document, every line under a
later one goes. A document whose every line goes has an empty text. Extra columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctra.llm.common import materialise

_LAST = 2**63 - 1


def _keys() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("k_id"), F.xxhash64("text").alias("k_text")]


def _windows(docs: DataFrame, span: int) -> DataFrame:
    """k_id, k_text, pos, window for each distinct document."""
    lines = F.split("text", "\n", -1)
    at = F.transform(F.sequence(F.lit(1), F.size("lines") - (span - 1)), lambda i: F.array_join(F.slice("lines", i, span), "\n"))
    rows = docs.where(F.col("text").isNotNull()).select(*_keys(), lines.alias("lines")).where(F.size("lines") >= span)
    rows = rows.select("k_id", "k_text", F.posexplode(at).alias("pos", "w")).where(F.col("w").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select("k_id", "k_text", "pos", F.unhex(F.md5("w")).alias("window"))


def removed_lines(docs: DataFrame, span: int = 3) -> DataFrame:
    """One row per document that loses lines: k_id, k_text and the merged positions ``gone``."""
    windows = materialise(_windows(docs.select("doc_id", "text"), span), "line-windows")
    place = F.struct("k_id", "k_text", "pos")
    # Firsts are pre-aggregated before their shuffle, then written: both sides of the join are plain
    # exchanges, which adaptive execution can split at a window that is everywhere.
    firsts = windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last"))
    firsts = materialise(firsts.select("window", "first"), "line-firsts")
    later = windows.join(firsts, "window").where(place != F.col("first"))
    covered = F.flatten(F.collect_set(F.sequence("pos", F.col("pos") + (span - 1))))
    return later.groupBy("k_id", "k_text").agg(F.array_distinct(covered).alias("gone"))


def dedup_lines(docs: DataFrame, span: int = 3) -> DataFrame:
    """The documents with their cleaned ``text``, plus ``n_lines`` and ``n_removed`` in struct ``line_dedup``.

    Struct ``doc`` holds the columns that came in, so that no name can clash.
    """
    # What goes is written first: the windows are not needed any more, and texts are split above the join, so they cross its shuffle once.
    gone = materialise(removed_lines(docs, span), "line-gone")
    # Merged at every size: ``gone`` grows with the documents, so it is not sent to all tasks where it happens to be small.
    rows = docs.select(F.struct("*").alias("doc"), *_keys()).join(gone.hint("merge"), ["k_id", "k_text"], "left").withColumn("lines", F.split("doc.text", "\n", -1))
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("gone", F.array().cast("array<int>")))
    clean = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n"))
    known = F.when(F.col("doc.text").isNull(), 0)
    return rows.select(
        "doc",
        clean.alias("text"),
        F.struct(known.otherwise(n).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")).alias("line_dedup"),
    )


#: DuckDB form of the query over documents (unique doc_ids).
SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w0 AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS w FROM w0),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS rn
      FROM w WHERE regexp_matches(w, '[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM r WHERE rn > 1),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d),
kept AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.p) AS t
         FROM lines x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p WHERE g.p IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY 1)
SELECT d.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, coalesce(n.c, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.t, '')) END AS text_md5
FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
