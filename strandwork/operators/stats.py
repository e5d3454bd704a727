"""Aggregates: moments, correlations, stable log sums, burn-in ratios, replicate summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.operators.ordered import ranks, running_total


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Moments, extremes and the exact median; values are counted, and the counts are added up in ranges, so that no task
    holds a group."""
    v = F.col(value)
    moments = df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    return moments.join(medians(df, keys, value), [moments[k].eqNullSafe(F.col(f"__m{i}")) for i, k in enumerate(keys)], "left").select(*keys, "n", "sum", "mean", "sd", "median", "min", "max")


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``__m0, __m1, ...`` (the keys) and ``median``: the mean of the two middle values."""
    named = [F.col(k).alias(f"__m{i}") for i, k in enumerate(keys)]
    names = [f"__m{i}" for i in range(len(keys))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*named, F.col(value).alias("__value")).agg(F.count("*").alias("n"))
    placed = running_total(counts, "__value", ["n"], keys=names)
    total = counts.groupBy(*names).agg(F.sum("n").alias("__total")).toDF(*(f"{c}t" for c in names), "__total")
    both = placed.join(total, [F.col(c).eqNullSafe(F.col(f"{c}t")) for c in names])
    low, high = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    first = F.col("cum_n") - F.col("n")
    hits = F.when((low >= first) & (low < F.col("cum_n")), 1).otherwise(0) + F.when((high >= first) & (high < F.col("cum_n")), 1).otherwise(0)
    return both.withColumn("__hits", hits).where("__hits > 0").groupBy(*names).agg((F.sum(F.col("__value") * F.col("__hits")) / 2).alias("median"))


def weighted_pearson(df: DataFrame, x: str, y: str, w: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """``r`` from sums about the means, so that large values don't cancel."""
    w = w if w is not None else F.lit(1.0)
    rows = df.select(*(keys or []), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.cast("double").alias("w"))
    means = rows.groupBy(*(keys or [])).agg((F.sum(F.expr("w*x")) / F.sum("w")).alias("mx"), (F.sum(F.expr("w*y")) / F.sum("w")).alias("my"))
    both = rows.join(means, keys) if keys else rows.crossJoin(F.broadcast(means))  # one row of means
    sums = both.groupBy(*(keys or [])).agg(F.sum(F.expr("w*(x-mx)*(y-my)")).alias("xy"), F.sum(F.expr("w*(x-mx)*(x-mx)")).alias("xx"), F.sum(F.expr("w*(y-my)*(y-my)")).alias("yy"))
    return sums.select(*(keys or []), (F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("r"))


def spearman(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Correlation of dense ranks, both ranked without a single-task order."""
    a = ranks(df.select(tie, x, y), x, tie).select(tie, y, F.col("contiguous").alias("rx"))
    b = ranks(a, y, tie).select("rx", F.col("contiguous").alias("ry"))
    return weighted_pearson(b, "rx", "ry")


def log_sum_exp(df: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """``lse`` by group (and ``more`` aggregates); the largest value is taken out first."""
    top = df.groupBy(*keys).agg(F.max(value).alias("top"))
    sums = df.join(top, keys).groupBy(*keys, "top").agg(F.sum(F.when(F.col("top") == -math.inf, 0.0).otherwise(F.exp(F.col(value) - F.col("top")))).alias("s"), *more)
    return sums.withColumn("lse", F.when(F.col("top") == -math.inf, F.col("top")).otherwise(F.col("top") + F.log("s"))).drop("top", "s")


def z_scores(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``z`` by group: means and deviations are aggregated first and joined, so no group is held by one task."""
    m = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(m, keys).withColumn("z", F.when(F.col("__s") == 0, 0.0).otherwise((F.col(value) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def mean_and_error(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))).alias("se"))


def replicates(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean, relative difference and coefficient of variation of two replicates; zeros where the mean is zero."""
    mean = (F.col(a) + F.col(b)) / 2
    return df.withColumn("mean", mean).withColumn("rel_diff", F.when(mean == 0, 0.0).otherwise(F.abs(F.col(a) - F.col(b)) / mean)).withColumn("cv", F.when(mean == 0, 0.0).otherwise(F.abs(F.col(a) - F.col(b)) / 2 / mean))


def cumulative_share(df: DataFrame, value: str) -> DataFrame:
    """``value, n, share``: histogram and distribution function; distinct values are few or summed by range."""
    n = df.groupBy(value).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 1
    return running_total(n, value, ["n"]).select(value, "n", (F.col("cum_n") / total).alias("share"))


def variance_ratio(df: DataFrame, chain: str, value: str) -> DataFrame:
    """Gelman-Rubin potential scale reduction over chains of one length."""
    per = df.groupBy(chain).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    return per.agg(F.avg("v").alias("within"), F.var_samp("m").alias("between"), F.avg("n").alias("n")).select(F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between")) / F.col("within")).alias("ratio"))


def attributes_wide(df: DataFrame, keys: list[str], attributes: str, names: list[str] | None = None) -> DataFrame:
    """A map column as one column a key. Without ``names`` all keys are looked up first."""
    cells = df.select(*keys, F.explode(attributes).alias("k", "v"))
    return cells.groupBy(*keys).pivot("k", names).agg(F.first("v"))


def standing(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``number``: zero-based place within the group."""
    return df.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
