"""Grouped statistics, ranks and small aggregates over typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def share(cond: Column) -> Column:
    """Share of rows, in percent, for which a condition holds (null counts as no)."""
    return F.count_if(cond) / F.count(F.lit(1)) * 100


def segment_stats(df: DataFrame, by: list, metrics: dict[str, Column], min_n: int = 0) -> DataFrame:
    """Named aggregates by group, groups with fewer than ``min_n`` rows left out. No keys: one total row."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in metrics.items()])
    return out.where(F.col("n") >= min_n) if min_n else out


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """First n rows of each group in a total order, as ``rank``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def stable_sample(df: DataFrame, key: str, n: int = 500, seed: int = 42) -> DataFrame:
    """The n rows with the smallest hash of their key: the same in every run."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """Adds ``share`` of the total of a small, aggregated table."""
    return df.withColumn("share", F.col(value) / F.sum(value).over(W.partitionBy()) * 100)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Smallest value at which the running weight reaches half of the total, as ``weighted_median``. Equal values of a key are added up first."""
    df = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    run = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = df.withColumn("c", F.sum("w").over(run)).withColumn("t", F.sum("w").over(W.partitionBy(*keys)))
    return cum.where(F.col("c") >= F.col("t") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def multilot_flag(df: DataFrame, key: str) -> DataFrame:
    """Adds ``multilot``: whether another row has the same key (null counts as one). Keys are counted before they meet their rows."""
    many = df.groupBy(F.col(key).alias("m_key")).agg(F.count("*").alias("m_n")).where("m_n > 1")
    return df.join(many, F.col(key).eqNullSafe(F.col("m_key")), "left").withColumn("multilot", F.col("m_n").isNotNull()).drop("m_key", "m_n")


def previous_snapshot(labels: DataFrame, label: str = "snapshot_label") -> DataFrame:
    """Distinct labels with the label before; one row per snapshot."""
    return labels.select(label).distinct().withColumn("previous_label", F.lag(label).over(W.orderBy(label)))


def correlations(df: DataFrame, cols: list[str], lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns; ``lo`` and ``hi`` bound the first column."""
    if lo is not None or hi is not None:
        df = df.where(F.col(cols[0]).between(lo if lo is not None else float("-inf"), hi if hi is not None else float("inf")))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def profile(df: DataFrame, cols: list[str], target: str | None = None, approx: bool = False) -> DataFrame:
    """One row per column: nulls, distinct values, min, median, max and correlation with the target; one pass."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        r = F.corr(x, F.col(target).cast("double")) if target else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("nulls"), distinct(c).alias("distinct_n"), F.min(x).alias("min"), F.median(x).alias("median"), F.max(x).alias("max"), r.alias("r")))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def category_spread(df: DataFrame, feature: str, target: str, k: int = 10) -> DataFrame:
    """Quartiles of the target for the k most frequent categories."""
    stats = df.groupBy(feature).agg(F.count("*").alias("n"), F.percentile(target, 0.25).alias("p25"), F.median(target).alias("p50"), F.percentile(target, 0.75).alias("p75"))
    return stats.orderBy(F.desc("n"), feature).limit(k)


def histogram(df: DataFrame, col: str, step: float, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts per bin of width ``step``; values are clipped to [lo, hi]."""
    x = F.col(col)
    x = x if hi is None else F.least(x, F.lit(hi))
    x = x if lo is None else F.greatest(x, F.lit(lo))
    return df.where(F.col(col).isNotNull()).groupBy((F.floor(x / step) * step).cast("double").alias("bin")).agg(F.count("*").alias("n"))


def error_report(errors: DataFrame, err: str = "error_pct", by: list[str] | None = None) -> DataFrame:
    """Coverage, mean absolute, median and quartile errors."""
    e = F.col(err)
    return errors.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count(e).alias("covered"), F.avg(F.abs(e)).alias("mape"), F.median(e).alias("median_error"), F.percentile(e, 0.25).alias("p25"), F.percentile(e, 0.75).alias("p75")
    )


def best_blend(df: DataFrame, a: str, b: str, truth: str, step: float = 0.05) -> DataFrame:
    """Weight of ``a`` against ``b`` with the least mean absolute percentage error; one pass over the rows."""
    n = round(1 / step)
    mape = lambda w: F.avg(F.abs((w * F.col(a) + (1 - w) * F.col(b) - F.col(truth)) / F.col(truth) * 100))
    row = df.agg(F.array(*[F.struct(F.lit(i / n).alias("alpha"), mape(i / n).alias("mape")) for i in range(n + 1)]).alias("w")).select(F.inline("w"))
    return row.orderBy("mape", "alpha").limit(1)


def form_totals(df: DataFrame, form: str, metrics: dict[str, Column]) -> DataFrame:
    """Per form, and over all forms as ``all``."""
    return df.rollup(form).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in metrics.items()], F.grouping_id().alias("g")).withColumn(form, F.when(F.col("g") == 1, "all").otherwise(F.col(form))).drop("g")


def bin_join(df: DataFrame, bins: DataFrame, value: str) -> DataFrame:
    """Rows to all bins (lo, hi, label) that hold them; overlapping bins repeat rows. Bins are a short, fixed list."""
    return df.join(F.broadcast(bins), (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")))


def evasion_pivot(df: DataFrame, row: str, col: str, values: list, rate: Column, min_n: int = 3) -> DataFrame:
    """Rate by two categories, cells with fewer than ``min_n`` rows empty."""
    return df.groupBy(row).pivot(col, values).agg(F.when(F.count(F.lit(1)) >= min_n, rate))


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of groups, of groups with more than one row, and quartiles of their sizes."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("repeated"), F.median("n").alias("median_n"), F.max("n").alias("max_n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("missing")).alias("value")).agg(F.count("*").alias("n"))


def ordered_preview(value: Column, order: Column, n: int) -> Column:
    """Aggregate: the first n distinct values in an order, joined by `` | ``. Pre-aggregate long groups."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])
    return F.array_join(F.slice(F.array_distinct(items), 1, n), " | ")


def dedup_listings(df: DataFrame, small: float = 15, step: float = 5, per_degree: float = 2000) -> DataFrame:
    """Newest listing of each (50 m cell, floor, area bucket); rows without the key pass. Columns url, lat, lon, floor, area, date."""
    from auctra.functions.geo import cell_rounded

    size = F.when(F.col("area") < small, F.rint("area")).otherwise(F.rint(F.col("area") / step) * step)
    keyed = df.withColumn("place", cell_rounded("lat", "lon", per_degree)).withColumn("size", size)
    whole = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("floor").isNotNull() & F.col("area").isNotNull()
    one = top_per_group(keyed.where(whole), ["place", "floor", "size"], [F.col("date").desc_nulls_last(), "url"]).drop("rank")
    return one.unionByName(keyed.where(~whole)).drop("place", "size")


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def union_periods(periods: dict[str, DataFrame], name: str = "period") -> DataFrame:
    """Tables of several periods as one, each row with the label of its own."""
    return union_all(*[df.withColumn(name, F.lit(label)) for label, df in periods.items()])


def remaining(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return every.join(done.select(key), key, "left_anti")


def first_seen_rows(df: DataFrame, key: str, order: list) -> DataFrame:
    return top_per_group(df, [key], order).drop("rank")


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys that both tables have."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def first_remaining(every: DataFrame, done: DataFrame, key: str, n: int) -> DataFrame:
    """The n smallest keys that are not done yet."""
    return remaining(every.select(key).distinct(), done, key).orderBy(key).limit(n)


def log_histogram(df: DataFrame, col: str, bins: int = 50, top: float = 0.99) -> DataFrame:
    """Counts in equal bins of log10 of the positive values up to a quantile; the last bin includes its end."""
    cap = df.agg(F.percentile(col, top).alias("cap"))
    x = df.join(F.broadcast(cap), F.lit(True)).where((F.col(col) > 0) & (F.col(col) <= F.col("cap"))).select(F.log10(col).alias("v"))  # one row
    ends = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    x = x.join(F.broadcast(ends), F.lit(True))  # one row
    return x.groupBy(F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Type and most frequent value of each column; the smallest of equally frequent ones."""
    types = dict(df.dtypes)
    one = lambda c: df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("c")).orderBy(F.desc("c"), c).limit(1).select(F.lit(c).alias("feature"), F.lit(types[c]).alias("type"), F.col(c).cast("string").alias("mode"))
    return union_all(*[one(c) for c in cols])
