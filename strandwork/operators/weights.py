"""Weights made of values or ranks, and weights of windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.operators.kmers import kmers
from strandwork.operators.ordered import percentile_ceil, ranks, running_total

MODES = ("linear", "range", "log_range", "rank_log", "rank_outlier", "rank_outlier_repeated", "sigmoid", "rank_sigmoid", "percentile_logistic", "step")
_TINY = 1e-10
_SPREAD = math.log(_TINY) - math.log1p(-_TINY)


def at_index(df: DataFrame, value: str, index: list[int]) -> list[float]:
    """The values at some zero-based places of the ascending order; nothing is sorted in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    placed = running_total(counts, value, ["n"])
    first = F.col("cum_n") - F.col("n")
    hit = placed.where(F.exists(F.lit(index), lambda i: (i >= first) & (i < F.col("cum_n")))).select(value, first.alias("a"), "cum_n").collect()  # one row to a place at most
    return [next(r[0] for r in hit if r[1] <= i < r[2]) for i in index]


def _outlier_share(df: DataFrame, value: str, n: int, repeat: bool) -> float:
    """Share of values beyond the upper quartile by one and a half times the quartiles' distance, on what is left of the
    values until no more go if ``repeat``."""
    upto, share = n, None
    while True:
        low, high = at_index(df, value, [int(0.25 * upto), int(0.75 * upto)])
        limit = high + 1.5 * (high - low)
        below, equal = df.agg(F.count_if(F.col(value) < limit), F.count_if(F.col(value) == limit)).first()
        edge = below if equal else below + 2
        share = 1 - edge / n
        if not repeat or edge >= upto:
            return share
        upto = edge


def interpolate(df: DataFrame, value: str, mode: str, prior: float = 0.1, tie: str = "id", out: str = "weight") -> DataFrame:
    """``df`` with a weight in [0, 1] for each value. ``prior`` is the share of rows that should weigh more than a half.

    ``linear`` (half at the threshold that leaves the share above), ``range`` (0 at the least, 1 at the largest),
    ``log_range`` (logarithms, from the prior to one less the prior), ``rank_log``, ``rank_outlier`` and
    ``rank_outlier_repeated`` (as ``rank_log``, the share that of outliers), ``sigmoid``, ``rank_sigmoid``,
    ``percentile_logistic`` (0.1 and 0.9 at those percentiles), ``step``.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    x = F.col(value)
    n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return df.withColumn(out, F.lit(None).cast("double"))

    def threshold() -> float:
        return at_index(df, value, [min(n - 1, math.ceil((1 - prior) * n))])[0]

    if mode == "range":
        return df.withColumn(out, (x - low) / (high - low))
    if mode == "log_range":
        return df.withColumn(out, prior + (1 - 2 * prior) * (F.log(x) - math.log(low)) / (math.log(high) - math.log(low)))
    if mode == "linear":
        t = threshold()
        return df.withColumn(out, F.when(x >= t, 0.5 + 0.5 * F.try_divide(x - t, F.lit(high - t))).otherwise(0.5 - 0.5 * F.try_divide(t - x, F.lit(t - low))))
    if mode == "step":
        return df.withColumn(out, (x >= threshold()).cast("double"))
    if mode == "percentile_logistic":
        a, b = (percentile_ceil(df, [], value, p).first()[0] for p in (0.1, 0.9))
        slope = (math.log(0.1 / 0.9) - math.log(0.9 / 0.1)) / (a - b)
        return df.withColumn(out, 1 / (1 + F.exp(-(slope * x + math.log(0.1 / 0.9) - slope * a))))
    if mode == "sigmoid":
        t = threshold()
        b = _SPREAD / (1 - high / t)
        return df.withColumn(out, 1 / (1 + F.exp(-(b / t) * x + b)))
    placed = ranks(df, value, tie)
    if mode == "rank_sigmoid":
        last = placed.agg(F.max("in_order")).first()[0]
        t, low = -math.floor(prior * n), -last
        b = -_SPREAD / (1 - low / t)
        out_df = placed.withColumn(out, 1 / (1 + F.exp((b / t) * F.col("in_order") + b)))
    else:
        share = prior if mode == "rank_log" else _outlier_share(df, value, n, mode.endswith("repeated"))
        last = placed.agg(F.max("sports")).first()[0]
        h = F.col("sports") / last
        weight = 1 / (1 + F.try_divide(h, 1 - h) * (1 - share) / share) if share > 0 else F.lit(0.0)
        out_df = placed.withColumn(out, F.when(h == 1, 0.0).otherwise(weight))
    return out_df.drop("in_order", "sports", "pessimistic", "contiguous")


def window_weights(df: DataFrame, seq: str, k: int, weight: str) -> DataFrame:
    """``kmer, weight``: every window carries its sequence's weight; equal windows are one."""
    return kmers(df, seq, k).groupBy("kmer").agg(F.sum(weight).alias("weight"))


def elements_of_length(df: DataFrame, seq: str, length: int, weight: str | None = None) -> DataFrame:
    """``n, weight``: how many windows of a length there are, and how much they weigh."""
    n = F.greatest(F.lit(0), F.length(seq) - length + 1).cast("bigint")
    return df.agg(F.sum(n).alias("n"), F.sum(n * (F.col(weight) if weight else F.lit(1.0))).alias("weight"))


def shifted(scores: list[Column], class_weights: list[float]) -> list[Column]:
    """Scores of classes with log class weights added."""
    return [s + (math.log(w) if w > 0 else -math.inf) for s, w in zip(scores, class_weights)]


def threshold_weights(t: float) -> tuple[float, float]:
    """Log class weights of two classes so that class 0 is chosen where the score difference is ``t`` or more."""
    first = -math.log1p(math.exp(t))
    return first, t + first
