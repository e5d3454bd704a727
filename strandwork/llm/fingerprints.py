"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every distinct hash of a text's five-word shingles that lies below a fixed fraction of the hash
space. It grows with its text, so sketches of very unequal documents still estimate how much of one is contained in
the other, and sketches merge by union. A text none of whose hashes lies that low keeps its lowest one instead
(union followed by the same rule merges these as well); a text without words has the empty sketch.

Edge cases: null counts as the empty text; fewer than five words make one shingle; equal texts have equal sketches;
two empty sketches are alike (1.0), an empty and a full one are not (0.0); rows with equal ids follow each other in
the order of their texts; a null id comes before all others; an only row is its own next row; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm._common import SPACE_RE, lower_ascii

FRACTION = 8  # one hash in so many is kept
WORDS = 5
#: Buckets of neighbouring ids, at most: bounds the literal that deals ids out, never the result.
MAX_BUCKETS = 1 << 16
ROWS_IN_BUCKET = 32


def sketch(text: Column, words: int = WORDS, fraction: int = FRACTION) -> Column:
    """The sorted distinct kept hashes of a text, as ``array<bigint>``."""
    limit = -(2**63) + 2**64 // fraction
    parts = F.transform(F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SPACE_RE), lambda w: w != ""), lambda w: F.xxhash64(w))
    # a second array of the same words, so that each lambda reads an array once made
    made = F.transform(
        F.array(parts),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < words, F.array(F.xxhash64(w)))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(words))))),
    )
    kept = F.transform(made, lambda h: F.struct(F.filter(h, lambda x: x < F.lit(limit)).alias("low"), F.array_min(h).alias("least")))
    chosen = F.transform(kept, lambda s: F.when((F.size(s["low"]) == 0) & s["least"].isNotNull(), F.array(s["least"])).otherwise(F.array_distinct(s["low"])))
    return F.sort_array(chosen[0])


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two sketches (Jaccard)."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def containment(a: Column, b: Column) -> Column:
    """The share of ``a``'s text that ``b``'s text has too, as the sketches tell."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """The sketch of the union of two texts' shingles."""
    limit = -(2**63) + 2**64 // fraction
    every = F.array_union(a, b)
    low = F.filter(every, lambda x: x < F.lit(limit))
    return F.sort_array(F.when((F.size(low) == 0) & (F.size(every) > 0), F.array(F.array_min(every))).otherwise(low))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(docs: DataFrame, order_col: str, carried: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with columns ``made`` of each row's own, and ``next``: a struct of ``carried`` from the next row in ascending
    order (the last row's: the first's).

    Rows are dealt out by buckets of neighbouring ids, cut at approximate quantiles, in one shuffle; each bucket
    also gets a copy of the row after it. Only the buckets' bounds and first ids (``MAX_BUCKETS`` at most) reach
    the driver. Every choice of bounds gives the same result.
    """
    spark = docs.sparkSession
    counted = docs.agg(F.count("*")).first()[0]
    buckets = max(1, min(MAX_BUCKETS, counted // ROWS_IN_BUCKET))
    bounds = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(docs.agg(F.percentile_approx(order_col, shares, max(10_000, 2 * buckets))).first()[0] or []))
    if bounds:
        ids = F.lit(bounds)
        # binary search: how many bounds are not above the id
        steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
        tell = F.aggregate(
            F.lit(steps),
            F.lit(0),
            lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(ids, at + step) <= F.col(order_col)), at + step).otherwise(at),
        )
        bucket = F.coalesce(tell, F.lit(0))
    else:
        bucket = F.lit(0)
    dealt = docs.withColumn("__bucket", bucket).withColumn("__copy", F.lit(False))
    firsts = dealt.groupBy("__bucket").agg(F.min(F.struct(F.col(order_col).isNotNull().alias("some"), F.col(order_col).alias("id"))).alias("first")).collect()
    order = sorted(r[0] for r in firsts)
    first_of = {r[0]: r[1]["id"] for r in firsts}
    goes_to = {order[i]: order[i - 1] for i in range(len(order))}  # the first bucket's first row closes the last bucket
    if not order:
        return docs.withColumns(made or {}).withColumn("next", F.struct(*carried))
    guards = spark.createDataFrame([(first_of[b], b, goes_to[b]) for b in order], f"__first {docs.schema[order_col].dataType.simpleString()}, __own int, __to int")
    copies = docs.join(F.broadcast(guards), F.col(order_col).eqNullSafe(F.col("__first")))
    # of rows with the bucket's first id, the one that comes first
    every = [F.col(c) for c in docs.columns]
    copies = copies.groupBy("__to").agg(F.min(F.struct(*every)).alias("row")).select("row.*", F.col("__to").alias("__bucket"), F.lit(True).alias("__copy"))
    w = Window.partitionBy("__bucket").orderBy("__copy", F.col(order_col).asc_nulls_first(), *(c for c in docs.columns if c != order_col))
    # what is made of a row is made once, before rows and copies are dealt out
    out = dealt.unionByName(copies).withColumns(made or {}).withColumn("next", F.lead(F.struct(*carried)).over(w))
    return out.where(~F.col("__copy")).drop("__bucket", "__copy")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, fraction: int = FRACTION) -> DataFrame:
    """Sketches of every text and of its edited text: the last half (rounded down) replaced by as many first code
    points of the next text. ``id, text, edited, sketch, edited_sketch, next_sketch``."""
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paired = with_next(narrow, "id", ["text", "sketch"], {"sketch": sketch(F.col("text"), words, fraction)})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    paired = paired.select("id", "text", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    return paired.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "edited", "sketch", sketch(F.col("edited"), words, fraction).alias("edited_sketch"), "next_sketch")
