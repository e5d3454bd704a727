"""Words of sequences: windows, counts, presence, position-specific counts and what follows from them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.scalar import canonical, windows
from strandwork.operators.words import different, holders, once, row_words


def kmers(df: DataFrame, seq: str, k: int) -> DataFrame:
    """A row for each window of each sequence, with its zero-based ``pos`` and all columns but the sequence."""
    return df.select("*", F.posexplode(windows(F.col(seq), k)).alias("pos", "kmer")).drop(seq)


def kmer_counts(df: DataFrame, seq: str, k: int, both_strands: bool = False, weight: str | None = None) -> DataFrame:
    """``kmer, cnt``; with both strands a k-mer and its reverse complement count as the smaller one. The map-side
    partial sums leave at most one row to a k-mer and task for the shuffle."""
    key = canonical(F.col("kmer")) if both_strands else F.col("kmer")
    total = F.sum(weight) if weight else F.count("*")
    return kmers(df, seq, k).groupBy(key.alias("kmer")).agg(total.alias("cnt"))


def presence(df: DataFrame, seq: str, k: int, id_col: str) -> DataFrame:
    """``kmer, n_seqs``: how many sequences hold each k-mer. A task sends a row for each k-mer at most."""
    return holders(df, seq, k, F.col(id_col)).select("kmer", F.col("n0").alias("n_seqs"))


def conserved(df: DataFrame, seq: str, k: int, id_col: str, least: int) -> DataFrame:
    return presence(df, seq, k, id_col).where(F.col("n_seqs") >= least)


def common(df: DataFrame, seq: str, k: int, id_col: str) -> DataFrame:
    """K-mers of all sequences."""
    n = df.select(id_col).distinct().count()
    return presence(df, seq, k, id_col).where(F.col("n_seqs") == n)


def without_background(df: DataFrame, seq: str, k: int, id_col: str, foreground: Column, fg_weight: float = 1.0, bg_weight: float = 1.0) -> DataFrame:
    """K-mers found in more foreground than background sequences, both weighted."""
    counts = holders(df, seq, k, F.col(id_col), F.when(foreground, 0).when(~foreground, 1), 2).select("kmer", F.col("n0").alias("n_fg"), F.col("n1").alias("n_bg"))
    return counts.where(F.col("n_fg") * fg_weight > F.col("n_bg") * bg_weight)


def window_profile(df: DataFrame, id_col: str, seq: str, k: int, weight: str) -> DataFrame:
    """``id, n_windows, weight, n_distinct``: each sequence's windows, their weight and how many are different. Rows of one
    id are one sequence; windows stay where they are, and only where ids repeat bitmaps of words meet."""
    each = row_words(df, seq, k, [id_col, weight])
    if once(df, F.col(id_col)):
        odd = F.array(F.coalesce("odd", F.array().cast("array<string>")))
        return each.select(id_col, F.col("n").alias("n_windows"), (F.col(weight) * F.col("n")).alias("weight"), different(F.array("words"), odd).alias("n_distinct"))
    every = each.groupBy(id_col).agg(F.sum("n").alias("n_windows"), F.sum(F.col(weight) * F.col("n")).alias("weight"), F.collect_list("words").alias("words"), F.collect_list("odd").alias("odd"))
    return every.select(id_col, "n_windows", "weight", different(F.col("words"), F.col("odd")).alias("n_distinct"))


def neighbourhood(words: DataFrame, column: str, alphabet: str, mismatches: int = 1) -> DataFrame:
    """Pairs of words of one length that differ in ``mismatches`` places at most: each word's variants meet in an equi-join,
    not all pairs.

    A variant has so many places blanked out, so words that agree beyond them share a key.
    """

    def blanked(texts: Column) -> Column:
        # each step blanks one more place, behind the last blank
        def more(t):
            first = F.length(t) - F.length(F.regexp_replace(t, r"^.*_", "")) + 1
            return F.when(first > F.length(t), F.array(t)).otherwise(F.transform(F.sequence(first, F.length(t)), lambda i: F.overlay(t, F.lit("_"), i, F.lit(1))))

        return F.flatten(F.transform(texts, more))

    variants = F.array(F.col(column))
    for _ in range(mismatches):
        variants = blanked(variants)
    keyed = words.select(column, F.explode(F.array_distinct(F.transform(variants, lambda v: F.concat(F.length(v).cast("string"), F.lit(":"), v)))).alias("key"))
    left, right = keyed.select(F.col(column).alias("a"), "key"), keyed.select(F.col(column).alias("b"), "key")
    return left.join(right, "key").where("a < b").select("a", "b").distinct()


def position_counts(df: DataFrame, seq: str, weight: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """``pos, sym, cnt`` (a weighted position frequency matrix in long form), by ``keys`` as well."""
    keys = keys or []
    cells = df.select(*keys, (weight if weight is not None else F.lit(1.0)).alias("w"), F.posexplode(F.split(F.col(seq), "")).alias("pos", "sym"))
    return cells.groupBy(*keys, "pos", "sym").agg(F.sum("w").alias("cnt"))


def probabilities(counts: DataFrame, alphabet: str, keys: list[str], ess: float = 0.0) -> DataFrame:
    """``prob`` of each symbol given ``keys``, over the whole alphabet, ``ess`` spread over it as pseudo-counts;
    uniform where there is nothing."""
    m = len(alphabet)
    grid = counts.select(*keys).distinct().withColumn("sym", F.explode(F.array(*map(F.lit, alphabet))))
    full = grid.join(counts, [*keys, "sym"], "left").fillna(0.0, ["cnt"])
    total = F.sum("cnt").over(Window.partitionBy(*keys))
    return full.withColumn("prob", F.when(total + ess == 0, 1.0 / m).otherwise((F.col("cnt") + ess / m) / (total + ess)))


def conditional_counts(df: DataFrame, seq: str, order: int, weight: str | None = None, period: int | None = None) -> DataFrame:
    """``context, sym, cnt`` for a homogeneous model; with a period also ``phase`` of the symbol's place."""
    w = kmers(df, seq, order + 1)
    keys = [F.substring("kmer", 1, order).alias("context"), F.substring("kmer", order + 1, 1).alias("sym")]
    if period:
        keys.insert(0, F.pmod(F.col("pos") + order, F.lit(period)).alias("phase"))
    return w.groupBy(*keys).agg((F.sum(weight) if weight else F.count("*").cast("double")).alias("cnt"))


def position_kmer_profile(df: DataFrame, seq: str, k: int, window: int) -> DataFrame:
    """``pos, kmer, freq``: counts by place, summed over ``window`` places from each on, over sequences and window."""
    n = df.count()
    counts = kmers(df, seq, k).groupBy("pos", "kmer").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("kmer").orderBy("pos").rangeBetween(0, window - 1)
    return counts.withColumn("freq", F.sum("cnt").over(w) / (n * window))


def pair_counts(df: DataFrame, seq: str) -> DataFrame:
    """``i, j, a, b, n`` for all pairs of places i < j of sequences of one length."""
    cells = df.select(F.split(F.col(seq), "").alias("s"))
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.transform(F.sequence(i + 1, F.size("s") - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), F.get("s", i).alias("a"), F.get("s", j).alias("b")))))
    return cells.where(F.size("s") >= 2).select(F.explode(places).alias("x")).select("x.*").groupBy("i", "j", "a", "b").agg(F.count("*").alias("n"))


def mutual_information(df: DataFrame, seq: str) -> DataFrame:
    """``i, j, mi`` in nats."""
    pairs = pair_counts(df, seq)
    place = Window.partitionBy("i", "j")
    total = F.sum("n").over(place)
    a, b = F.sum("n").over(Window.partitionBy("i", "j", "a")), F.sum("n").over(Window.partitionBy("i", "j", "b"))
    return pairs.select("i", "j", (F.col("n") / total * F.log(F.col("n") * total / (a * b))).alias("t")).groupBy("i", "j").agg(F.sum("t").alias("mi"))


def all_words(spark, alphabet: str, k: int) -> DataFrame:
    """All words of length k, built from their numbers in base m."""
    m = len(alphabet)
    digit = [F.substring(F.lit(alphabet), (F.floor(F.col("id") / m**p) % m + 1).cast("int"), F.lit(1)) for p in reversed(range(k))]
    return spark.range(m**k).select(F.col("id").alias("number"), F.concat(*digit).alias("kmer"))


def de_bruijn(alphabet: str, n: int) -> str:
    """A cyclic sequence that holds each word of length n once: all Lyndon words whose length divides n, in order."""
    out = []
    for word in product(range(len(alphabet)), repeat=n):
        for p in (d for d in range(1, n + 1) if n % d == 0):
            if word == word[:p] * (n // p):
                break
        root = word[:p]
        if all(root <= root[i:] + root[:i] for i in range(p)):
            out.append((root, "".join(alphabet[c] for c in root)))
    return "".join(t for _, t in sorted(set(out)))


def pair_scales(df: DataFrame, id_col: str, seq: str, scales: DataFrame) -> DataFrame:
    """``id, scale, mean, most`` of numbers given to pairs of neighbours (``scale, pair, x``: sixteen rows to a scale). Pairs
    are counted within each sequence first, so a sequence sends sixteen rows at most."""
    counts = kmers(df.select(id_col, seq), seq, 2).groupBy(id_col, "kmer").agg(F.count("*").alias("n"))
    both = counts.join(F.broadcast(scales), F.col("kmer") == F.col("pair"))  # a published table
    return both.groupBy(id_col, "scale").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.max("x").alias("most"))
