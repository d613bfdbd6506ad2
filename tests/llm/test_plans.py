"""Tables that grow with the documents are not sent to all tasks."""

from __future__ import annotations

from auctra.llm import line_windows, quality


def test_texts_are_merged_at_every_size(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for out in (line_windows.dedup_lines(docs), quality.keep_good(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan  # a broadcast where the keys were few
        assert out.count() > 0
