"""Numbers about distributions: normalisation, divergences, information, criteria, chains and integrals.

What says something about rows is a column expression or an aggregation; what concerns one small model (a transition
matrix, a function of one number) is numpy on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.scalar import let, log_sum
from strandwork.operators.kmers import all_words


def softmax(logs: Column, offset: float = 0.0) -> Column:
    """Struct of the probabilities that log scores stand for and of the logarithm of their sum."""
    return let(logs, lambda x: let(log_sum(x), lambda total: F.struct(F.transform(x, lambda v: F.exp(v - total)).alias("p"), (total + offset).alias("log_sum"))))


def normalised(values: Column) -> Column:
    """Values divided by their sum; uniform if the sum is 0."""

    def share(x):
        total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
        return let(total, lambda t: F.transform(x, lambda v: F.when(t == 0, 1.0 / F.size(x)).otherwise(v / t)))

    return let(F.transform(values, lambda v: v.cast("double")), share)


def array_summary(values: Column) -> Column:
    """Struct of ``most``, ``least``, ``total``, and the first places (zero-based) of the extremes."""

    def of(x):
        low, high = F.array_min(x), F.array_max(x)
        return F.struct(high.alias("most"), low.alias("least"), F.aggregate(x, F.lit(0.0), lambda s, v: s + v).alias("total"), (F.array_position(x, high) - 1).alias("argmax"), (F.array_position(x, low) - 1).alias("argmin"))

    return let(F.transform(values, lambda v: v.cast("double")), of)


def transpose(rows: Column) -> Column:
    """An array of equally long arrays, the other way round."""
    return F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))


def entropy(p: Column, bits: bool = False) -> Column:
    base = math.log(2) if bits else 1.0
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log(x) / base).otherwise(0.0))


def information(p: Column) -> Column:
    """Information content scaled to [0, 1]: 0 for uniform probabilities, 1 for a certain symbol."""
    top = F.log2(F.size(p).cast("double"))
    return (top - entropy(p, True)) / top


def divergence(cells: DataFrame, p: str, q: str, epsilon: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """``divergence`` of two distributions over the same cells (power family; epsilon 1: twice Kullback-Leibler)."""
    if epsilon <= 0:
        raise ValueError("epsilon has to be positive")
    x, y = F.col(p), F.col(q)
    if epsilon == 1:
        total = 2 * F.sum(F.when(x != 0, x * F.log(x / y)).otherwise(0.0))
    else:
        total = (F.sum(x * F.pow(x / y, F.lit(epsilon - 1))) - 1) / (epsilon * (epsilon - 1) / 2)
    return cells.groupBy(*(keys or [])).agg(total.alias("divergence"))


def divergence_from_independence(cells: DataFrame, row: str, column: str, p: str, epsilon: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """``divergence`` of a joint distribution from the product of its margins (epsilon 1: twice the mutual information)."""
    keys = keys or []
    rows = cells.groupBy(*keys, row).agg(F.sum(p).alias("__r"))
    columns = cells.groupBy(*keys, column).agg(F.sum(p).alias("__c"))
    both = cells.join(rows, [*keys, row]).join(columns, [*keys, column]).withColumn("__q", F.col("__r") * F.col("__c"))
    return divergence(both, p, "__q", epsilon, keys)


def compare_models(spark, alphabet: str, length: int, a: Callable[[Column], Column], b: Callable[[Column], Column]) -> DataFrame:
    """One row over all words of a length: ``kl`` and ``symmetric_kl`` of two models' scores, ``entropy`` (nats) and ``total``
    of the first, and the ``largest`` and ``summed`` deviation of probabilities."""
    words = all_words(spark, alphabet, length).select(a(F.col("kmer")).alias("x"), b(F.col("kmer")).alias("y"))
    p, q = F.exp("x"), F.exp("y")

    def times(weight, value):
        return F.sum(F.when(weight == 0, 0.0).otherwise(weight * value))

    far = F.abs(p - q)
    return words.agg(times(p, F.col("x") - F.col("y")).alias("kl"), F.sum((p - q) * (F.col("x") - F.col("y"))).alias("symmetric_kl"), (-times(p, F.col("x"))).alias("entropy"), F.sum(p).alias("total"), F.max(far).alias("largest"), F.sum(far).alias("summed"))


def marginal(spark, alphabet: str, length: int, score: Callable[[Column], Column], start: int, width: int) -> DataFrame:
    """``part, prob``: the distribution of a model's symbols at some places, by enumeration."""
    words = all_words(spark, alphabet, length)
    return words.groupBy(F.substring("kmer", start + 1, width).alias("part")).agg(F.sum(F.exp(score(F.col("kmer")))).alias("prob"))


def most_probable(spark, alphabet: str, length: int, score: Callable[[Column], Column]) -> DataFrame:
    """``kmer, score`` of the best word (of equals the first)."""
    words = all_words(spark, alphabet, length).withColumn("score", score(F.col("kmer")))
    best = words.agg(F.max(F.struct("score", (-F.col("number")).alias("minus"), "kmer")).alias("x"))
    return best.select("x.kmer", "x.score")


def criteria(df: DataFrame, score: Column, parameters: int, weight: Column | None = None) -> DataFrame:
    """``log_likelihood, aic, bic`` (larger is better) of scored rows, weighted if asked for."""
    w = weight if weight is not None else F.lit(1.0)
    sums = df.agg(F.sum(score * w).alias("log_likelihood"), F.count("*").alias("n"))
    ll = F.col("log_likelihood")
    return sums.select(ll, (2 * ll - 2 * parameters).alias("aic"), (2 * ll - parameters * F.log(F.col("n").cast("double"))).alias("bic"))


def stationary(move: np.ndarray) -> np.ndarray:
    """The distribution that a chain keeps (rows of ``move`` are where a state leads)."""
    n = len(move)
    system = np.vstack([np.asarray(move, float).T - np.eye(n), np.ones(n)])
    return np.linalg.lstsq(system, np.append(np.zeros(n), 1.0), rcond=None)[0]


def normal_cdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Distribution function of the normal, in Arrow batches (the JVM has no error function)."""

    @F.pandas_udf("double")
    def cdf(values):
        return values.map(lambda v: 0.5 * math.erfc(-(v - mean) / (sd * math.sqrt(2))), na_action="ignore").astype("float64")

    return cdf(x.cast("double"))


def integrate(f: Callable[[np.ndarray], np.ndarray], low: float, high: float, steps: int = 1000, rule: str = "simpson") -> float:
    """Integral by the trapezoid or Simpson's rule."""
    if rule == "simpson":
        steps += steps % 2
    x = np.linspace(low, high, steps + 1)
    y = np.asarray(f(x), float)
    h = (high - low) / steps
    if rule == "trapezoid":
        return float(h * (y.sum() - (y[0] + y[-1]) / 2))
    return float(h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


def nice_ticks(low: float, high: float, most: int = 10) -> tuple[float, float, float]:
    """First and last tick and their distance: 1, 2 or 5 times a power of ten, ``most`` steps or fewer."""
    span = (high - low) or abs(high) or 1.0
    size = 10 ** math.floor(math.log10(span / most))
    step = next(size * k for k in (1, 2, 5, 10) if span / (size * k) <= most)
    return math.floor(low / step) * step, math.ceil(high / step) * step, step


def _up_to(limit: Column):
    return lambda x: x <= limit


def sample_words(spark, logs: list[list[float]], alphabet: str, n: int, seed: int = 0) -> DataFrame:
    """``id, seq``: ``n`` sequences drawn from a position matrix of log probabilities; the same again for the same seed."""
    symbols = []
    for place, row in enumerate(logs):
        edges = np.cumsum(np.exp(row))
        draw = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(place)), F.lit(1 << 40)) / float(1 << 40) * float(edges[-1])
        pick = F.size(F.filter(F.lit([float(e) for e in edges[:-1]]), _up_to(draw))) if len(alphabet) > 1 else F.lit(0)
        symbols.append(F.substring(F.lit(alphabet), pick + 1, F.lit(1)))
    return spark.range(n).select("id", F.concat(*symbols).alias("seq"))
