"""What a task holds does not grow with a table."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from auctra.operators import ml
from auctra.plans import queries as core


def test_fits_deal_rows_evenly(spark, monkeypatch):
    monkeypatch.setattr(ml, "FIT_ROWS", 100, raising=False)
    fit, parts = Pipeline.fit, []

    def seen(self, df):
        parts.append([r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])
        return fit(self, df)

    monkeypatch.setattr(Pipeline, "fit", seen)
    rows = spark.range(1000).select("id", (F.col("id") % 17).cast("double").alias("a"), F.when(F.col("id") != 5, F.col("id") + 1.0).otherwise(0.0).alias("price"), (F.col("id") % 3).alias("fold")).coalesce(1)
    ml.train_hedonic(rows, ["a"], "price", iterations=1)
    assert sum(parts[0]) == 999 and max(parts[0]) <= 150  # one part before
    scored = ml.cross_predict(rows, ["a"], "price", 3, iterations=1)
    assert sum(map(sum, parts[1:])) == 2 * 999  # each row in two of three fits
    assert sorted(r.id for r in scored.select("id").collect()) == list(range(1000))


def test_a_profile_holds_no_column_in_one_task(spark):
    plan = core.queries()["sketched_profile"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "median" not in plan.replace("median_near", "") and "Expand" not in plan
