"""Window operators, and orders over whole groups that don't gather a group in one task.

An order is cut at approximate quantiles (a bounded number of them reaches the driver), each range of each group is one
partition of the window, and what a range needs of the ones before or after it (sums, extremes, the nearest row) is carried
over from one small row to a range (``carried``). Frames of a fixed reach are cut in segments of a fixed width, and each
segment also gets copies of the rows within reach of it (``with_halo``). Results don't depend on the cuts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
#: Rows to a segment of frames that count rows, and reaches to a segment of frames that measure distance.
SEGMENT_ROWS, SEGMENT_REACHES = 1 << 16, 16


def _ranges(df: DataFrame, by: str, ranges: int = RANGES) -> Column:
    """Number of the range of ``by`` (ascending) that a row lies in; nulls come first."""
    cuts = df.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    edges, steps = F.lit(cuts), F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])

    def step(at, width):  # binary search: how many cuts are not above the value
        return F.when((at + width <= len(cuts)) & (F.get(edges, at + width - 1) <= F.col(by)), at + width).otherwise(at)

    return F.when(F.col(by).isNull(), F.lit(-1)).otherwise(F.aggregate(steps, F.lit(0), step))


#: Rows to a group that may be ordered in one task, which sorts on disk; larger groups are cut in ranges.
GROUP_ROWS, TASK_ROWS = 1 << 20, 1 << 19


def whole_groups(df: DataFrame, keys: list[str], times: int = 1) -> int:
    """Partitions of ``TASK_ROWS`` on average (at least one to a core) if each group has few enough rows (``times`` of them to
    a row) to be ordered as it is, else 0. Reads the keys only."""
    most, total = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first() if keys else (None, None)
    if most is None or most * times > GROUP_ROWS:
        return 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-total * times // TASK_ROWS))


def in_ranges(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``__range``, the range of ``by`` that a row lies in."""
    return df.withColumn("__range", _ranges(df, by))


def carried(df: DataFrame, keys: list[str], ascending: bool = True, **columns: tuple[Column, Callable, str]) -> DataFrame:
    """``df`` (from ``in_ranges``) with columns that say something about the group's other ranges.

    Each is (aggregate over a range, how such values combine over a window, "before" or "after"). One row to a group and
    range is windowed; it meets the rows in a join on both.
    """
    per = df.groupBy(*keys, "__range").agg(*(x.alias(f"__v_{name}") for name, (x, _, _) in columns.items()))
    order = Window.partitionBy(*keys).orderBy(F.col("__range") if ascending else F.col("__range").desc())
    frames = {"before": order.rowsBetween(Window.unboundedPreceding, -1), "after": order.rowsBetween(1, Window.unboundedFollowing)}
    names = [*keys, "__range"]
    over = per.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(names)), *(how(F.col(f"__v_{name}")).over(frames[side]).alias(name) for name, (_, how, side) in columns.items()))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return df.join(over if keys else F.broadcast(over), on).drop(*(f"__k{i}" for i in range(len(names))))  # without groups: RANGES + 1 rows


def running_total(df: DataFrame, by: str, values: list[str], ascending: bool = True, keys: list[str] | None = None) -> DataFrame:
    """``df`` with ``cum_<value>``: the sum over all rows of the group up to and including the ties of ``by``."""
    keys = keys or []
    out = carried(in_ranges(df, by), keys, ascending, **{f"__b_{v}": (F.sum(v), F.sum, "before") for v in values})
    key = F.col(by) if ascending else F.col(by).desc()
    within = Window.partitionBy(*keys, "__range").orderBy(key).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for v in values:
        out = out.withColumn(f"cum_{v}", F.sum(v).over(within) + F.coalesce(F.col(f"__b_{v}"), F.lit(0)))
    return out.drop("__range", *(f"__b_{v}" for v in values))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: zero-based places in each group's order (ranges are cut by the first column of ``order``)."""
    placed = carried(in_ranges(df, order[0]), keys, __b=(F.count(F.lit(1)), F.sum, "before"))
    w = Window.partitionBy(*keys, "__range").orderBy(*order)
    return placed.withColumn(out, F.row_number().over(w) - 1 + F.coalesce("__b", F.lit(0))).drop("__range", "__b")


def with_halo(df: DataFrame, pos: str, before: int, after: int, width: int) -> DataFrame:
    """``df`` dealt to segments ``__seg`` of ``width`` in ``pos``, with copies (``__own`` false) of the rows that lie within
    ``before`` ahead of a segment or ``after`` behind it. Null places are a segment of their own."""
    at = F.col(pos)
    every = F.sequence(F.floor((at - after) / width), F.floor((at + before) / width))
    dealt = df.withColumn("__seg", F.explode(F.when(at.isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(every)))
    return dealt.withColumn("__own", at.isNull() | (F.col("__seg") == F.floor(at / width)))


def near_rows(df: DataFrame, keys: list[str], order: str, value: str, reach: int, made: dict[str, tuple[str, int, Callable]]) -> DataFrame:
    """``df`` with columns made of the values near each row: ``made`` has type, distance and function by name; the function
    gets a segment's values in order (without nulls), the row each is of, and the bounds of each row's neighbours among them.

    A segment, with the rows within ``reach`` around it, is one Arrow table; a row costs the same however many neighbours it
    has (Spark's sliding frames go through all of them for each row).
    """
    names = df.columns
    dealt = with_halo(df, order, reach, reach, max(SEGMENT_REACHES * reach, 1))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), *(f"`{c}` {kind}" for c, (kind, _, _) in made.items())])

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.sort_by(order)
        own = table.column("__own").to_numpy()
        values = table.column(value)
        there = values.is_valid().to_numpy()
        before = np.concatenate([[0], np.cumsum(there)])
        known = values.filter(pc.is_valid(values)).to_numpy()
        which = np.flatnonzero(there)
        columns = [table.column(c).filter(pa.array(own)) for c in names]
        for _, distance, f in made.values():
            if table.column(order).null_count:  # null places are near each other
                low, high = np.zeros(len(own), np.int64), np.full(len(own), len(own))
            else:
                at = table.column(order).to_numpy()
                low, high = np.searchsorted(at, at - distance, "left"), np.searchsorted(at, at + distance, "right")
            columns.append(f(known, which, before[low], before[high]).filter(pa.array(own)))
        return pa.table(columns, names=[*names, *made])

    return dealt.groupBy(*keys, "__seg").applyInArrow(run, schema)


def _means(known, which, low, high):
    """Means of ranges of values, from sums of what comes before (of the differences from the mean, in long doubles)."""
    import pyarrow as pa

    known = known.astype(float)
    odd = ~np.isfinite(known)
    plain = np.where(odd, 0.0, known)
    centre = plain.mean() if len(plain) else 0.0
    sums = np.concatenate([[0], np.cumsum((plain - centre).astype(np.longdouble))])
    n = high - low
    out = (sums[high] - sums[low]).astype(float) / np.maximum(n, 1) + centre
    if odd.any():
        up, down, none = ((c := np.concatenate([[0], np.cumsum(x)]))[high] > c[low] for x in (known == np.inf, known == -np.inf, np.isnan(known)))
        out = np.where(none | (up & down), np.nan, np.where(up, np.inf, np.where(down, -np.inf, out)))
    return pa.array(out, mask=n == 0)


def _tops(known, which, low, high):
    """Whether a row's value is the largest of its range: maxima of spans of powers of two, two to a range."""
    import pyarrow as pa

    level = np.unique(known, return_inverse=True)[1].reshape(-1)
    span = np.frexp(np.maximum(high - low, 1))[1] - 1
    best, table, wide = np.full(len(low), -1), level, 1
    for j in range(int(span.max(initial=0)) + 1):
        at = np.flatnonzero((span == j) & (high > low))
        if len(at):
            best[at] = np.maximum(table[low[at]], table[high[at] - wide])
        table = np.maximum(table[:-wide], table[wide:])
        wide *= 2
    own = np.full(len(low), -2)
    own[which] = level
    return pa.array(own == best)


def _above_percentile(p: float):
    def f(known, which, low, high):
        """A row's value less that at index ceil(p * (n - 1)) of its sorted range: values' numbers go down by their bits, all
        rows' ranges with them."""
        import pyarrow as pa

        names, level = np.unique(known, return_inverse=True)
        level = level.reshape(-1)
        k = np.ceil(p * (high - low - 1)).astype(np.int64)
        a, b, found = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for bit in reversed(range(max(len(names) - 1, 1).bit_length())):
            zero = (level >> bit & 1) == 0
            upto = np.concatenate([[0], np.cumsum(zero)])
            za, zb = upto[a], upto[b]
            right = k >= zb - za
            k = np.where(right, k - (zb - za), k)
            found |= right.astype(np.int64) << bit
            a, b = np.where(right, upto[-1] + a - za, za), np.where(right, upto[-1] + b - zb, zb)
            level = np.concatenate([level[zero], level[~zero]])
        out, none = np.zeros(len(low), known.dtype), np.ones(len(low), bool)
        out[which], none[which] = known - names[found[which]] if len(names) else known, False
        return pa.array(out, mask=none)

    return f


def by_rows(df: DataFrame, keys: list[str], order: list[str], before: int, after: int):
    """Segments with the ``before`` and ``after`` rows around them, and the window of a segment's order."""
    placed = numbered(df, keys, order, "__n")
    return with_halo(placed, "__n", before, after, max(SEGMENT_ROWS, before, after)), Window.partitionBy(*keys, "__seg").orderBy("__n")


def own_rows(df: DataFrame) -> DataFrame:
    """The rows themselves, without the copies."""
    return df.where("__own").drop("__own", "__seg", "__n")


def ranks(df: DataFrame, by: str, tie: str) -> DataFrame:
    """Zero-based descending ranks under four policies: ``in_order`` (ties by ``tie``), ``sports``, ``pessimistic``,
    ``contiguous``."""
    per = df.groupBy(by).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    per = running_total(per, by, ["n", "one"], ascending=False)
    per = per.select(F.col(by).alias("__v"), (F.col("cum_n") - F.col("n")).alias("sports"), (F.col("cum_n") - 1).alias("pessimistic"), (F.col("cum_one") - 1).alias("contiguous"))
    out = df.join(per, F.col(by).eqNullSafe(F.col("__v"))).drop("__v")
    place = F.row_number().over(Window.partitionBy(by).orderBy(tie)) - 1
    return out.withColumn("in_order", F.col("sports") + place)


def percentile_ceil(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The element at index ceil(p*(n-1)) of each group's sorted values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))  # ties are counted before anything is ordered
    placed = running_total(counts, value, ["n"], keys=keys)
    total = counts.groupBy(*keys).agg(F.ceil(p * (F.sum("n") - 1)).alias("at"))
    on = [placed[k].eqNullSafe(total[k]) for k in keys]
    both = placed.join(total, on) if keys else placed.crossJoin(F.broadcast(total))  # one row
    return both.where((F.col("at") < F.col("cum_n")) & (F.col("at") >= F.col("cum_n") - F.col("n"))).select(*(placed[k] for k in keys), F.col(value).alias("percentile"))


def weight_percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    """The value at which the descending running sum reaches p of the total (N50 for p = 0.5)."""
    per = df.groupBy(value).agg(F.sum(value).alias("mass"))
    total = per.agg(F.sum("mass")).first()[0] or 0
    return running_total(per, value, ["mass"], ascending=False).where(F.col("cum_mass") >= p * total).agg(F.max(value).alias("value"))


def smooth(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Moving mean and median over ``width`` rows from each row on; only full windows."""
    dealt, w = by_rows(df, keys, order, 0, width - 1)
    w = w.rowsBetween(0, width - 1)
    middle = [(width + 1) // 2, width // 2 + 1]
    out = dealt.withColumn("mean", F.avg(value).over(w)).withColumn("__in", F.array_sort(F.collect_list(value).over(w)))
    return own_rows(out.where(F.size("__in") == width)).withColumn("median", sum(F.element_at("__in", i) for i in middle) / 2).drop("__in")


def local_rate(df: DataFrame, keys: list[str], order: str, value: str, reaches: list[int]) -> DataFrame:
    """``rate``: the largest of the group's mean and of the means within each reach (in units of ``order``) around."""
    whole = df.groupBy(*keys).agg(F.avg(value).alias("__whole")).toDF(*(f"__g{i}" for i in range(len(keys))), "__whole")
    near = near_rows(df, keys, order, value, max(reaches), {f"__near{r}": ("double", r, _means) for r in reaches})
    out = near.join(whole, [F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)])
    return out.withColumn("rate", F.greatest("__whole", *(f"__near{r}" for r in reaches))).drop("__whole", *(f"__near{r}" for r in reaches), *(f"__g{i}" for i in range(len(keys))))


def peaks_only(df: DataFrame, keys: list[str], order: str, score: str, reach: int) -> DataFrame:
    """Rows whose score is the largest within ``reach`` around them."""
    return near_rows(df, keys, order, score, reach, {"__top": ("boolean", reach, _tops)}).where("__top").drop("__top")


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: str, before: int, after: int) -> DataFrame:
    """The values of the rows around each row as columns ``m2, m1, p1, ...``."""
    out, w = by_rows(df, keys, order, before, after)
    for k in range(before, 0, -1):
        out = out.withColumn(f"m{k}", F.lag(value, k).over(w))
    for k in range(1, after + 1):
        out = out.withColumn(f"p{k}", F.lead(value, k).over(w))
    return own_rows(out)


def detrended(df: DataFrame, keys: list[str], order: str, value: str, margin: int, p: float) -> DataFrame:
    """``value`` minus the ceil-percentile of the values within ``margin`` around it."""
    kind = df.schema[value].dataType.simpleString()
    return near_rows(df, keys, order, value, margin, {"detrended": (kind, margin, _above_percentile(p))})


def quantile_normalised(df: DataFrame, column: str, value: str, tie: str) -> DataFrame:
    """The k-th smallest value of each column replaced by the mean of all k-th smallest values."""
    placed = numbered(df, [column], [value, tie], "k")
    means = placed.groupBy("k").agg(F.avg(value).alias("normalised"))
    return placed.join(means, "k")


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group: a group limit that Spark applies in every task before rows are shuffled."""
    if not keys:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= k).drop("__place")


def sorted_by(df: DataFrame, *criteria: str) -> DataFrame:
    """Rows in the order of some SQL expressions, each optionally followed by ``asc`` or ``desc``; a range-partitioned sort."""
    orders = []
    for c in criteria:
        text, _, way = c.strip().rpartition(" ")
        orders.append(F.expr(text).desc() if way.lower() == "desc" else F.expr(text).asc() if way.lower() == "asc" else F.expr(c).asc())
    return df.orderBy(*orders)
