"""Column profiles as mergeable sketches: kept by part of a table (a snapshot, a day), merged without reading rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the distinct sketch (2^12 registers, some 2 % off) and of the quantile sketch (ranks some 1.5 % off).
LG_K, K = 12, 200


def column_sketches(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per part and column: feature, n, nulls, least, most, distinct and quantile sketch of the column as numbers."""
    made = []
    for c in columns:
        x = F.col(c).cast("double")
        made.append(F.struct(
            F.lit(c).alias("feature"), F.count("*").alias("n"), F.count_if(x.isNull()).alias("nulls"), F.min(x).alias("least"), F.max(x).alias("most"),
            F.hll_sketch_agg(x.cast("string"), LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double(x, K).alias("quantile_sketch"),
        ))
    return df.groupBy(*by).agg(F.array(*made).alias("s")).select(*by, F.inline("s"))


def merged(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sketches of coarser parts (of everything without ``by``), from those of parts."""
    return sketches.groupBy(*by, "feature").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def estimates(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The sketches' figures: distinct_n, and the named quantiles (null where there is no value)."""
    some = F.col("n") > F.col("nulls")
    rest = [c for c in sketches.columns if not c.endswith("_sketch")]
    return sketches.select(*rest, F.hll_sketch_estimate("distinct_sketch").alias("distinct_n"), *[F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q))).alias(name) for name, q in quantiles.items()])


def added(known: DataFrame, rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Known sketches and those of new parts; rows of known parts are read no more, a part that comes again takes its place."""
    new = column_sketches(rows, by, columns)
    return known.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)
