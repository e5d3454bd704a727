"""Interval algebra: sweeps, overlap joins, islands, nearest features. Intervals are half-open unless said otherwise.

Overlap joins deal intervals to bins and compare within bins, so they are equi-joins on (chrom, level, bin) which adaptive
execution can split where one is hot; a pair that shares several bins counts in the first of them only. Sweeps cut each
chromosome in ranges and carry sums and extremes over from the ranges before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.operators.ordered import SEGMENT_ROWS, carried, in_ranges, own_rows, running_total, whole_groups, with_halo
from strandwork.operators.stats import log_sum_exp


def coverage(df: DataFrame, keys: list[str], start: str, end: str, value: str) -> DataFrame:
    """Sum of ``value`` over all intervals at every place, as runs of equal sums (zero runs left out)."""
    ends = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.col(value).alias("d")), F.struct(F.col(end).alias("at"), (-F.col(value)).alias("d")))).alias("e"))
    if parts := whole_groups(df, keys, 2):
        # one shuffle and one sort; sums by place are taken after them, where they need no table of places
        w = Window.partitionBy(*keys).orderBy("at")
        later = F.lead(F.struct("at")).over(w)
        each = ends.select(*keys, "e.at", "e.d").repartition(parts, *keys).withColumn("d", F.sum("d").over(Window.partitionBy(*keys, "at"))).withColumn("__later", later)
        deltas = each.where(F.col("__later").isNull() | ~F.col("__later.at").eqNullSafe(F.col("at"))).where("d <> 0")
        runs = deltas.withColumn("cov", F.sum("d").over(w)).withColumn("stop", F.lead("at").over(w))
        return runs.where("cov <> 0 and stop is not null").select(*keys, F.col("at").alias("start"), F.col("stop").alias("end"), "cov")
    deltas = ends.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    w = Window.partitionBy(*keys, "__range").orderBy("at")
    placed = carried(in_ranges(deltas, "at"), keys, __b=(F.sum("d"), F.sum, "before"), __next=(F.min("at"), F.min, "after"))
    runs = placed.withColumn("cov", F.sum("d").over(w) + F.coalesce("__b", F.lit(0))).withColumn("stop", F.coalesce(F.lead("at").over(w), "__next"))
    return runs.where("cov <> 0 and stop is not null").select(*keys, F.col("at").alias("start"), F.col("stop").alias("end"), "cov")


def run_lengths(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Per-place values as runs of equal values at neighbouring places."""
    w = Window.partitionBy(*keys, "__range").orderBy(pos)
    last = F.max(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    placed = carried(in_ranges(df, pos), keys, __last=(last, F.max, "before"))
    before, where = F.coalesce(F.lag(value).over(w), F.col("__last.v")), F.coalesce(F.lag(pos).over(w), F.col("__last.p"))
    fresh = F.when((before == F.col(value)) & (where + 1 == F.col(pos)), 0).otherwise(1)
    island = running_total(placed.withColumn("__new", fresh).drop("__range", "__last"), pos, ["__new"], keys=keys)
    return island.groupBy(*keys, "cum___new").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.first(value).alias("value")).drop("cum___new")


def islands(df: DataFrame, keys: list[str], start: str, end: str, reach: Column | int = 0, dealt: bool = False) -> DataFrame:
    """``df`` with ``island``: numbers from 1 on, intervals that start within ``reach`` of all ends so far stay in one.
    ``dealt``: groups are small and each in one partition already."""
    parts = 0 if dealt else whole_groups(df, keys)
    if dealt or parts:
        w = Window.partitionBy(*keys).orderBy(start, end)
        far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.when(far + (F.lit(reach) if isinstance(reach, int) else reach) >= F.col(start), 0).otherwise(1)
        near = df if dealt else df.repartition(parts, *keys)
        return near.withColumn("__new", fresh).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")
    placed = carried(in_ranges(df, start), keys, __far=(F.max(end), F.max, "before"))
    w = Window.partitionBy(*keys, "__range").orderBy(start, end)
    far = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__far"))
    fresh = F.when(far + (F.lit(reach) if isinstance(reach, int) else reach) >= F.col(start), 0).otherwise(1)
    # of rows with one start only the first can be new, so ties may count together
    flagged = placed.withColumn("__new", fresh).drop("__range", "__far")
    return running_total(flagged, start, ["__new"], keys=keys).withColumnRenamed("cum___new", "island").drop("__new")


def merged(df: DataFrame, keys: list[str], start: str, end: str, reach: int = 0) -> DataFrame:
    return islands(df, keys, start, end, reach).groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("island")


#: An interval is dealt to bins of the width at which it covers few; widths grow by this factor.
GROWTH, LEVELS = 16, 8


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal ``on`` whose [l_start, l_end) and [r_start, r_end) overlap, with ``overlap``.

    ``left`` has columns ``l_*`` and ``right`` ``r_*``, apart from ``on``. Bins have widths ``width``, 16 ``width``, 256
    ``width`` and so on. Each interval has a level, the least at which it spans 17 bins at most; a pair meets in the bins of
    the higher of its two levels, so a long interval makes no more rows than a short one does.
    """

    def sized(df, p):
        length = F.col(f"{p}_end") - F.col(f"{p}_start")
        level = F.least(F.lit(LEVELS), F.ceil(F.log(F.greatest(length, F.lit(1)) / width) / math.log(GROWTH)) - 1)
        return df.where(length > 0).withColumn(f"__{p}level", F.greatest(F.lit(0), level).cast("int"))

    def binned(df, p, level):
        size = F.lit(float(width)) * F.pow(F.lit(float(GROWTH)), level)
        first, last = F.floor(F.col(f"{p}_start") / size), F.floor((F.col(f"{p}_end") - 1) / size)
        return df.withColumn("__bin", F.explode(F.sequence(first, last)))

    sides = {p: sized(df, p) for p, df in (("l", left), ("r", right))}
    seen = {p: {r[0] for r in df.select(f"__{p}level").distinct().collect()} for p, df in sides.items()}  # LEVELS + 1 at most

    def every(p, other):
        # at its own level for partners up to it, and at each higher level that partners have
        own = F.col(f"__{p}level")
        higher = F.filter(F.lit(sorted(seen[other])), lambda k: k > own) if seen[other] else F.array().cast("array<int>")
        return binned(sides[p].withColumn("__level", F.explode(F.concat(F.array(own), higher))), p, F.col("__level"))

    shared = F.greatest("l_start", "r_start")
    both = every("l", "r").join(every("r", "l"), [*on, "__level", "__bin"])
    size = F.lit(float(width)) * F.pow(F.lit(float(GROWTH)), F.col("__level"))
    both = both.where((F.col("__level") == F.greatest("__llevel", "__rlevel")) & (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("__bin") == F.floor(shared / size)))
    out = both.withColumn("overlap", F.least("l_end", "r_end") - shared).drop("__bin", "__level", "__llevel", "__rlevel")
    if how == "inner":
        return out
    missing = left.join(out.select("l_id").distinct(), "l_id", "left_anti")
    return out.unionByName(missing, allowMissingColumns=True)


def best_match(left: DataFrame, right: DataFrame, on: list[str], width: int) -> DataFrame:
    """For each left interval the right one with the highest F1 of covered places (ties: the smallest id)."""
    f1 = 2 * F.col("overlap") / ((F.col("l_end") - F.col("l_start")) + (F.col("r_end") - F.col("r_start")))
    pairs = overlap_join(left, right, on, width).withColumn("f1", f1)
    best = pairs.groupBy("l_id").agg(F.max(F.struct("f1", (-F.col("r_id")).alias("minus"))).alias("x"))
    return best.select("l_id", (-F.col("x.minus")).alias("r_id"), F.col("x.f1").alias("f1"))


def mean_coverage(left: DataFrame, tracks: DataFrame, on: list[str], width: int) -> DataFrame:
    """``l_id, mean_cov`` of ``tracks`` (``r_start, r_end, r_cov``) under each left interval; 0 where there is none."""
    pairs = overlap_join(left, tracks, on, width).groupBy("l_id").agg(F.sum(F.col("overlap") * F.col("r_cov")).alias("mass"))
    return left.join(pairs, "l_id", "left").select("l_id", (F.coalesce("mass", F.lit(0)) / (F.col("l_end") - F.col("l_start"))).alias("mean_cov"))


def nearest(points: DataFrame, features: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """For each point the distance to the nearest feature of its keys on either side (null: there is none). Both
    sides are put in one order and looked up there; nothing is paired."""
    all_ = points.select("id", *keys, F.col(pos).alias("p")).withColumn("f", F.lit(None).cast("bigint")).unionByName(features.select(F.lit(None).cast("bigint").alias("id"), *keys, F.col(pos).alias("p"), F.col(pos).alias("f")))
    placed = carried(in_ranges(all_, "p"), keys, __low=(F.max("f"), F.max, "before"), __high=(F.min("f"), F.min, "after"))
    w = Window.partitionBy(*keys, "__range").orderBy("p")
    back = F.coalesce(F.last("f", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.col("__low"))
    # the same from the other end: a frame up to the group's end is gone through again for each row
    down = Window.partitionBy(*keys, "__range").orderBy(F.col("p").desc())
    ahead = F.coalesce(F.last("f", ignorenulls=True).over(down.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.col("__high"))
    return placed.withColumn("distance", F.least(F.col("p") - back, ahead - F.col("p"))).where("id is not null").select("id", "distance")


def bin_features(df: DataFrame, keys: list[str], pos: str, value: str, width: int, order: list[str]) -> DataFrame:
    """Features of each bin: least, median and mean value, number of changes between neighbours (``changes``), the longest
    run of increases and of decreases (``up``, ``down``: equal values neither count nor end a run), and the least of the bin
    before and after."""
    row = Window.partitionBy(*keys, "bin").orderBy(*order)
    step = F.col(value) - F.lag(value).over(row)
    cells = df.withColumn("bin", F.floor(F.col(pos) / width)).withColumn("__step", F.signum(step))
    upto = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, way in (("up", 1), ("down", -1)):  # runs are told apart by the number of steps the other way
        cells = cells.withColumn(f"__{name}", F.sum(F.when(F.col("__step") == -way, 1).otherwise(0)).over(upto))
        cells = cells.withColumn(f"__{name}", F.sum(F.when(F.col("__step") == way, 1).otherwise(0)).over(Window.partitionBy(*keys, "bin", f"__{name}")))
    changed = F.coalesce((F.col("__step") != 0).cast("bigint"), F.lit(0))
    out = cells.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.min(value).alias("least"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.sum(changed).alias("changes"), F.max("__up").alias("up"), F.max("__down").alias("down"))
    dealt = with_halo(out, "bin", 1, 1, SEGMENT_ROWS)
    w = Window.partitionBy(*keys, "__seg").orderBy("bin")
    return own_rows(dealt.withColumn("least_before", F.min("least").over(w.rangeBetween(-1, -1))).withColumn("least_after", F.min("least").over(w.rangeBetween(1, 1))))


def window_features(df: DataFrame, keys: list[str], pos: str, value: str, width: int, broad: int) -> DataFrame:
    """Features of each bin over values that may be missing: ``least, mean, most`` of those that are there (0 if none is),
    ``mean0`` with the missing ones as 0, and mean and most within ``broad`` ahead of the bin's start and behind it."""
    there = F.when(F.isnan(F.col(value).cast("double")), None).otherwise(F.col(value).cast("double"))
    cells = df.withColumn("bin", F.floor(F.col(pos) / width)).withColumn("__v", there)
    out = cells.groupBy(*keys, "bin").agg(*(F.coalesce(f("__v"), F.lit(0.0)).alias(name) for name, f in (("least", F.min), ("mean", F.avg), ("most", F.max))), F.avg(F.coalesce("__v", F.lit(0.0))).alias("mean0"))
    # rows meet the bins whose start lies within reach of them
    at = F.col(pos)

    def bins(first, last):  # of a sequence that would run backwards, none
        low, high = F.ceil(first / width), F.floor(last / width)
        return cells.where(low <= high).select(*keys, "__v", F.explode(F.sequence(low, high)).alias("bin"))

    ahead, behind = bins(at - broad, at), bins(at, at + broad)
    for name, near in (("after", ahead), ("before", behind)):
        wide = near.groupBy(*keys, "bin").agg(F.avg("__v").alias(f"mean_{name}"), F.max("__v").alias(f"most_{name}"))
        out = out.join(wide, [*keys, "bin"], "left").fillna(0.0, [f"mean_{name}", f"most_{name}"])
    return out


def bin_scores(df: DataFrame, bins: DataFrame, keys: list[str], pos: str, score: str, width: int) -> DataFrame:
    """``keys, bin, most, log_sum`` of the scores in each of ``bins`` (``keys, bin``); null where there is none."""
    cells = df.withColumn("bin", F.floor(F.col(pos) / width))
    found = log_sum_exp(cells, [*keys, "bin"], score, F.max(score).alias("most")).withColumnRenamed("lse", "log_sum")
    return bins.join(found, [*keys, "bin"], "left")


def combine_neighbours(df: DataFrame, keys: list[str], bin_col: str, p: str, reach: int) -> DataFrame:
    """``any``: the probability that at least one of the bins within ``reach`` holds, if bins are independent; ``mean`` of
    the same. Numbers over 1 are no probabilities: ``any`` isn't a number where one is within reach."""
    dealt = with_halo(df, bin_col, reach, reach, max(SEGMENT_ROWS, reach))
    w = Window.partitionBy(*keys, "__seg").orderBy(bin_col).rangeBetween(-reach, reach)
    none = F.sum(F.when(F.col(p) < 1, F.log1p(-F.col(p))).when(F.col(p).isNotNull(), 0.0)).over(w)
    most = F.max(p).over(w)
    some = F.when(most > 1, math.nan).when(most == 1, 1.0).otherwise(-F.expm1(none))
    return own_rows(dealt.withColumn("any", some).withColumn("mean", F.avg(p).over(w)))


def pairs_within(df: DataFrame, keys: list[str], pos: str, id_col: str, least: int, most: int) -> DataFrame:
    """Pairs (a, b) with ``least`` <= pos_b - pos_a <= ``most``: an equi-join on bins of that width."""
    width = most + 1
    left = df.select(*keys, F.col(id_col).alias("a"), F.col(pos).alias("pa")).withColumn("__bin", F.explode(F.array(F.floor(F.col("pa") / width), F.floor(F.col("pa") / width) + 1)))
    right = df.select(*keys, F.col(id_col).alias("b"), F.col(pos).alias("pb")).withColumn("__bin", F.floor(F.col("pb") / width))
    return left.join(right, [*keys, "__bin"]).where((F.col("pb") - F.col("pa")).between(least, most)).select(*keys, "a", "b", (F.col("pb") - F.col("pa")).alias("gap"))
