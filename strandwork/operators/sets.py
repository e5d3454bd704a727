"""Bag operations, equi-joins of sets, splits and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_distinct(df: DataFrame, key: str, weight: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(weight).alias("weight"))


def bag_union(*bags: DataFrame, take: list[bool] | None = None) -> DataFrame:
    """All rows of the bags that ``take`` has (all by default)."""
    chosen = [b for b, t in zip(bags, take or [True] * len(bags)) if t]
    return reduce(DataFrame.unionByName, chosen)


def bag_intersection(*bags: DataFrame) -> DataFrame:
    """Each row as often as in the bag that has it least."""
    return reduce(DataFrame.intersectAll, bags)


def bag_difference(data: DataFrame, *others: DataFrame) -> DataFrame:
    """One copy goes for each copy in the others."""
    return reduce(DataFrame.exceptAll, others, data)


def presence_matrix(df: DataFrame, row: str, column: str, names: list | None = None) -> DataFrame:
    wide = df.groupBy(row).pivot(column, names).agg(F.count(F.lit(1)))
    return wide.select(row, *((F.coalesce(F.col(f"`{c}`"), F.lit(0)) > 0).alias(c) for c in wide.columns if c != row))


def reciprocal_best(df: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Pairs that are each other's best (ties count for all), by grouping and joining."""
    best_a = df.groupBy(F.col(a).alias("__a")).agg(F.max(score).alias("__sa"))
    best_b = df.groupBy(F.col(b).alias("__b")).agg(F.max(score).alias("__sb"))
    out = df.join(best_a, (F.col(a) == F.col("__a")) & (F.col(score) == F.col("__sa")))
    return out.join(best_b, (F.col(b) == F.col("__b")) & (F.col(score) == F.col("__sb"))).select(a, b, score)


def shares_of(ids: Column, seed: int = 0) -> Column:
    """A number in [0, 1) made of an id: the same on every machine and in every retry."""
    return F.pmod(F.xxhash64(ids, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def folds(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """``fold`` by the digest of seed and id: no shuffle, and the same after a lost executor and in other engines."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % k).cast("int"))


def shared(bags: list[DataFrame]) -> DataFrame:
    """Distinct rows that all bags have."""
    return reduce(DataFrame.intersect, bags)


def merged_sets(pairs: DataFrame, a: str, b: str) -> dict:
    """Union-find over a bounded number of pairs (sets, clusters, strains): member -> smallest member of its set."""
    root: dict = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for x, y in pairs.select(a, b).distinct().collect():
        low, high = sorted((find(x), find(y)))
        root[high] = low
    return {i: find(i) for i in root}


def split(df: DataFrame, id_col: str, percentages: list[float], seed: int = 0) -> DataFrame:
    """``part``: which of the given percentages (of 100) a row falls to."""
    edges, total = [], 0.0
    for p in percentages[:-1]:
        total += p / 100
        edges.append(total)
    return df.withColumn("part", F.size(F.filter(F.lit(edges) if edges else F.array().cast("array<double>"), lambda e: shares_of(F.col(id_col), seed) >= e)))


def split_by_quota(df: DataFrame, keys: list[str], order: list[str], measure: str, share: float) -> DataFrame:
    """``first_part``: rows in the given order within their class until the quota of ``measure`` is reached."""
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(measure).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("first_part", before < share * F.sum(measure).over(w))


def subsample(df: DataFrame, fraction: float, seed: int, with_replacement: bool = True) -> DataFrame:
    return df.sample(with_replacement, fraction, seed)


def hold_outs(df: DataFrame, id_col: str, percentage: float, repeats: int):
    """Train and test frames of repeated hold-outs."""
    for r in range(repeats):
        kept = shares_of(F.col(id_col), r) < percentage / 100
        yield df.where(kept), df.where(~kept)


def sampled_pairs(df: DataFrame, fraction: float, repeats: int, seed: int = 0):
    """Train and test frames drawn apart from each other, with replacement, so they may share rows."""
    for r in range(repeats):
        yield df.sample(True, fraction, seed + 2 * r), df.sample(True, fraction, seed + 2 * r + 1)


def sampled_hold_outs(df: DataFrame, id_col: str, class_col: str, reference: int, percentage: float, repeats: int):
    """Hold-outs of a reference class; of each other class about as many rows as the reference class has on either side."""
    n = {r[0]: r[1] for r in df.groupBy(class_col).agg(F.count("*")).collect()}
    for r in range(repeats):
        share = F.lit(1.0)
        for c, k in n.items():
            share = F.when(F.col(class_col) == c, min(1.0, n.get(reference, 0) / k)).otherwise(share)
        drawn = df.where(shares_of(F.col(id_col), 2 * r + 1) < share)
        kept = shares_of(F.col(id_col), 2 * r) < percentage / 100
        yield drawn.where(kept), drawn.where(~kept)


def filtered(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which an SQL expression over their columns (or a map's ``attrs['name']``) holds."""
    return df.where(F.expr(expression))
