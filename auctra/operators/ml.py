"""Features, training and scoring on Spark ML, and nearest neighbours by features."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window as W

from auctra.operators.neighbours import knn, neighbour_mean
from auctra.tables import materialise

#: Rows of one task of a fit.
FIT_ROWS = 50_000

def listing_features(df: DataFrame, floors: list[str] = ("цоколь", "1", "2", "3+"), types: list[str] = (), numeric: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Fixed dummies for floor and type, and numeric columns with 0 for null: one function for training and scoring."""
    cols: dict[str, Column] = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}
    cols |= {f"floor_{i}": F.coalesce((F.col("floor") == x).cast("double"), F.lit(0.0)) for i, x in enumerate(floors)}
    cols |= {f"type_{i}": F.coalesce((F.col("type") == x).cast("double"), F.lit(0.0)) for i, x in enumerate(types)}
    return df.withColumns(cols), list(cols)


def assign_folds(df: DataFrame, group: Column, n: int = 5) -> DataFrame:
    """Fold by hash of a group, so that a group is never split."""
    return df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(n)).cast("int"))


def spread(hist: dict[int, int], n: int) -> list[tuple[int, int, int, int]]:
    """(size, fold, lo, hi): groups of a size with ranks from lo to hi go to a fold, so that folds differ by no more than the largest group.

    The largest groups go first, each to the smallest fold; groups of one size fill up the smallest folds together.
    """
    loads, out = [0] * n, []
    for size in sorted(hist, reverse=True):
        left, at = hist[size], 0
        while left:
            order = sorted(range(n), key=lambda f: (loads[f], f))
            low = [f for f in order if loads[f] < loads[order[0]] + size]
            gap = min((loads[f] for f in order if f not in low), default=loads[order[0]] + size * left)
            each = max(1, min(left // len(low), (gap - loads[order[0]]) // size))
            for f in low:
                take = min(each, left)
                if take:
                    out.append((size, f, at, at + take))
                    loads[f] += size * take
                    at, left = at + take, left - take
    return out


def balanced_folds(df: DataFrame, group: Column, n: int = 5, bucket_groups: int = 50_000) -> DataFrame:
    """Fold of each row, groups whole and folds even to within the largest group; which group goes where depends on hashes only.

    The histogram of group sizes is all that the driver sees (sizes differ, so it has at most sqrt(2 * rows) entries).
    """
    sizes = materialise(df.groupBy(F.xxhash64(group).alias("g")).agg(F.count("*").alias("size")), "fold-sizes")
    hist = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, sum(hist.values()) // bucket_groups)
    dealt = sizes.withColumn("bucket", F.pmod("g", F.lit(buckets)))
    before = W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("size", "bucket").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("size", "bucket").orderBy("g")) - 1).join(offsets, ["size", "bucket"])
    slots = df.sparkSession.createDataFrame(spread(hist, n) or [(0, 0, 0, 0)], "size long, fold int, lo long, hi long")
    folds = ranked.join(slots, "size").where("rank + before >= lo AND rank + before < hi").select("g", "fold")
    return df.withColumn("g", F.xxhash64(group)).join(folds, "g").drop("g")


def split_holdout(features: DataFrame, ids: DataFrame, key: str = "lot_id") -> tuple[DataFrame, DataFrame]:
    ids = ids.select(key).distinct()
    return features.join(ids, key, "left_anti"), features.join(ids, key, "left_semi").dropDuplicates([key])


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` in even parts of some ``FIT_ROWS`` rows, in their order: what a task of a fit holds and reads does not grow with the table, however its files are cut."""
    rows = rows.select(*columns)
    return rows.repartition(max(1, math.ceil(rows.count() / FIT_ROWS))).sortWithinPartitions(*columns)


def train_hedonic(df: DataFrame, features: list[str], target: str, log: bool = True, iterations: int = 60) -> PipelineModel:
    """Boosted trees on the (log) target; the label column is added by the caller's ``with_label``."""
    gbt = GBTRegressor(featuresCol="x", labelCol="label", predictionCol="raw", maxDepth=5, stepSize=0.05, subsamplingRate=0.8, maxIter=iterations, seed=42)
    rows = df.where(F.col(target) > 0).withColumn("label", F.log(target) if log else F.col(target).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep"), gbt]).fit(dealt(rows, *features, "label"))


def score(model: PipelineModel, df: DataFrame, log: bool = True) -> DataFrame:
    return model.transform(df).withColumn("prediction", F.exp("raw") if log else F.col("raw")).drop("x", "raw")


def cross_predict(df: DataFrame, features: list[str], target: str, n: int = 5, **kw) -> DataFrame:
    """Out-of-fold predictions over column ``fold``; the models are fitted side by side, as a fit is many short jobs."""
    fit = inheritable_thread_target(df.sparkSession)(lambda k: train_hedonic(df.where(F.col("fold") != k), features, target, **kw))
    with ThreadPool(n) as pool:
        models = pool.map(fit, range(n))
    out = None
    for k, model in enumerate(models):
        part = score(model, df.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def train_excess(df: DataFrame, numeric: list[str], target: str, categorical: list[str] = (), iterations: int = 40) -> PipelineModel:
    """Boosted trees with absolute loss over imputed numbers and one-hot categories."""
    filled = [f"{c}_i" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled)]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_n", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_n"], outputCols=[f"{c}_v"], handleInvalid="keep")]
    stages += [VectorAssembler(inputCols=[*filled, *[f"{c}_v" for c in categorical]], outputCol="x"), GBTRegressor(featuresCol="x", labelCol=target, predictionCol="raw", lossType="absolute", maxDepth=5, maxIter=iterations, seed=42)]
    return Pipeline(stages=stages).fit(df.where(F.col(target).isNotNull()))


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.getActiveSession().createDataFrame(list(zip(features, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def holdout_report(pred: DataFrame, truth: str, prediction: str = "prediction") -> DataFrame:
    e = F.col(prediction) - F.col(truth)
    return pred.agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.median(F.abs(e)).alias("median_abs_error"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(prediction, truth).alias("corr"),
        (1 - F.sum(e * e) / (F.var_pop(truth) * F.count("*"))).alias("r2"),
    )


def fit_standardiser(df: DataFrame, features: list[str]) -> PipelineModel:
    """Medians for nulls, then zero mean and unit deviation; fitted on the base, applied to queries too."""
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=[f"{c}_i" for c in features]), VectorAssembler(inputCols=[f"{c}_i" for c in features], outputCol="v0"), StandardScaler(inputCol="v0", outputCol="v", withMean=True)]
    return Pipeline(stages=stages).fit(df)


def standardised(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``v``: its standardised features as array<double>."""
    return model.transform(df).withColumn("v", vector_to_array("v")).select(*df.columns, "v")


def lookalike_mean(lots: DataFrame, past: DataFrame, features: list[str], value: str, key: str = "lot_id", k: int = 5) -> DataFrame:
    """(query_id, n, mean): mean ``value`` of the k past lots with the most alike standardised features."""
    model = fit_standardiser(past, features)
    base = standardised(model, past.where(F.col(value).isNotNull()))
    return neighbour_mean(knn(standardised(model, lots), base, key, key, "v", k), base, key, value)
