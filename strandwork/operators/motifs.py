"""Motifs: matrices as tables, distances, scanning with significance, assessment."""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.scalar import reverse_complement, windows
from strandwork.operators.clustering import agglomerate, cut_tree
from strandwork.operators.kmers import de_bruijn, position_counts, presence
from strandwork.operators.models import PWM
from strandwork.operators.ordered import running_total
from strandwork.operators.words import cores


#: Pairs of words that every task may hold.
FEW = 200_000


def consensus(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, consensus``: the most frequent symbol of each place (of equals the first in the alphabet)."""
    best = counts.groupBy(*keys, "pos").agg(F.min(F.struct((-F.col("cnt")).alias("minus"), "sym")).alias("x"))
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x.sym"))), lambda c: c["sym"]), "").alias("consensus"))


def reverse_matrix(counts: DataFrame, keys: list[str], symbols: str = "ACGT", partners: str = "TGCA") -> DataFrame:
    """The matrix of the other strand."""
    last = counts.groupBy(*keys).agg(F.max("pos").alias("__last"))
    both = counts.join(last, keys) if keys else counts.crossJoin(F.broadcast(last))  # one row
    return both.select(*keys, (F.col("__last") - F.col("pos")).alias("pos"), F.translate("sym", symbols, partners).alias("sym"), "cnt")


def admissible_words(model: PWM, k: int, offset: int, threshold: float) -> list[str]:
    """Words of length k that can stand at ``offset`` of a window scoring above ``threshold``: with the best symbols on
    both sides. At most alphabet size ** k of them."""
    best = [max(row) for row in model.logs]
    room = threshold - sum(best[:offset]) - sum(best[offset + k :])
    words = product(range(len(model.alphabet)), repeat=k)
    return ["".join(model.alphabet[c] for c in w) for w in words if sum(model.logs[offset + j][c] for j, c in enumerate(w)) > room]


def _strands(df: DataFrame, id_col: str, seq: str, n: int, both_strands: bool) -> DataFrame:
    """``id, pos, strand, w``: all windows of a length."""
    each = df.select(F.col(id_col).alias("id"), F.posexplode(windows(F.col(seq), n)).alias("pos", "w"))
    if not both_strands:
        return each.withColumn("strand", F.lit("+"))
    return each.select("id", "pos", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("w").alias("w")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("w")).alias("w")))).alias("x")).select("id", "pos", "x.strand", "x.w")


def scan(df: DataFrame, id_col: str, seq: str, model: PWM, threshold: float, both_strands: bool = True, prefilter: int | None = None, offset: int = 0) -> DataFrame:
    """``id, pos, strand, score`` of the windows that score at least ``threshold``. With ``prefilter`` only windows with an
    admissible word of that length at ``offset`` are scored."""
    each = _strands(df, id_col, seq, len(model.logs), both_strands)
    if prefilter:
        words = admissible_words(model, prefilter, offset, threshold - 1e-12)
        table = df.sparkSession.createDataFrame([(w,) for w in words], "word string")
        each = each.join(F.broadcast(table), F.substring("w", offset + 1, prefilter) == F.col("word"), "left_semi")  # alphabet ** k words
    return each.withColumn("score", model.score(F.col("w"))).where(F.col("score") >= threshold).select("id", "pos", "strand", "score", F.col("w").alias("site"))


def threshold_for(scores: DataFrame, score: str, p: float) -> float | None:
    """The least of the background scores that a share of ``p`` at most reaches or passes; beyond all of them if none is."""
    counts = scores.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"))
    return _border(counts, score, p, counts.agg(F.sum("n")).first()[0] or 0)


def _border(counts: DataFrame, score: str, p: float, total: int) -> float | None:
    """The same of counted scores (``n``)."""
    if not total:
        return None
    border = math.ceil(total * (1 - p))
    placed = running_total(counts, score, ["n"]).withColumn("first", F.col("cum_n") - F.col("n"))
    # ties across the border belong below it
    above, top = placed.agg(F.min(F.when(F.col("first") >= border, F.col(score))), F.max(score)).first()
    return above if above is not None else math.nextafter(top, math.inf)


def occurrences(df: DataFrame, background: DataFrame, id_col: str, seq: str, model: PWM, p: float, both_strands: bool = True) -> DataFrame:
    """``id, pos, strand, score, p``: windows that score as only a share of ``p`` of the background's windows do. The
    background is read once: its equal windows are scored as one, and what is kept is a row for each score."""
    sites = _strands(background, id_col, seq, len(model.logs), both_strands).groupBy("w").agg(F.count("*").alias("n"))
    every = sites.select(model.score(F.col("w")).alias("score"), "n").where("score is not null").groupBy("score").agg(F.sum("n").alias("n")).persist()
    total = every.agg(F.sum("n")).first()[0] or 0
    limit = _border(every, "score", p, total)
    found = scan(df, id_col, seq, model, limit if limit is not None else math.inf, both_strands)
    counts = every.unionByName(found.select("score").distinct().withColumn("n", F.lit(0).cast("bigint")))
    tail = running_total(counts.groupBy("score").agg(F.sum("n").alias("n")), "score", ["n"], ascending=False).select("score", (F.col("cum_n") / max(total, 1)).alias("p"))
    return found.join(tail, "score").select("id", "pos", "strand", "score", "site", "p")


def seeds(df: DataFrame, background: DataFrame, seq: str, id_col: str, k: int, most: int) -> list[str]:
    """The words that more sequences hold than background sequences do, by the log ratio of the shares times the number of
    sequences; ``most`` of them."""
    def share(x, name):
        total = max(x.count(), 1)
        return presence(x, seq, k, id_col).withColumnRenamed("n_seqs", name), total

    (fg, n), (bg, m) = share(df, "f"), share(background, "b")
    both = fg.join(bg, "kmer", "left").withColumn("gain", F.col("f") * F.log((F.col("f") / n) / ((F.coalesce("b", F.lit(0)) + 1) / (m + 1))))
    return [r["kmer"] for r in both.orderBy(F.desc("gain"), "kmer").limit(most).collect()]


def discover(df: DataFrame, seq: str, width: int, seed: str, alphabet: str = "ACGT", share: float = 0.5, steps: int = 10, ess: float = 1.0) -> tuple[PWM, float]:
    """A motif of zero or one occurrence a sequence, all places alike, against uniform symbols: expectation maximisation from
    a seed word. Each step is one aggregation of windows weighted by their posterior; returns the matrix and the share of
    sequences with an occurrence."""
    m = len(alphabet)
    word = (seed + alphabet[0] * width)[:width]
    logs = [[math.log(0.6 if c == word[i] and i < len(seed) else (0.4 / (m - 1) if i < len(seed) else 1 / m)) for c in alphabet] for i in range(width)]
    model = PWM(alphabet, logs)
    rows = df.where(F.length(seq) >= width).select(seq)
    n = max(rows.count(), 1)
    for _ in range(steps):
        scores = model.window_scores(F.col(seq))
        even = width * math.log(m)
        ratio = F.transform(scores, lambda x: F.exp(x + even))  # null where a window has other symbols
        each = rows.select(windows(F.col(seq), width).alias("w"), ratio.alias("r"))
        mass = F.aggregate("r", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) * (share / F.size("r"))
        weighted = each.withColumn("mass", mass).select(F.explode(F.arrays_zip("w", "r")).alias("x"), "mass", F.size("r").alias("c"))
        post = F.col("x.r") * (share / F.col("c")) / (1 - share + F.col("mass"))
        found = weighted.where("x.r is not null").select(F.col("x.w").alias("w"), post.alias("p"))
        # equal windows are one before their symbols are told apart
        sums = found.groupBy("w").agg(F.sum("p").alias("p"))
        cells = {(r["pos"], r["sym"]): r["cnt"] for r in position_counts(sums, "w", F.col("p")).collect()}
        counts = [[cells.get((i, c), 0.0) + ess / m for c in alphabet] for i in range(width)]
        model = PWM(alphabet, [[math.log(x / sum(row)) for x in row] for row in counts])
        share = min(max(sum(cells.get((0, c), 0.0) for c in alphabet) / n, 1e-6), 1 - 1e-6)
    return model, share


def bound(found: DataFrame, df: DataFrame, id_col: str) -> DataFrame:
    """``id, sites, first``: how many sites each sequence has, and the first one's place (null: none)."""
    per = found.groupBy("id").agg(F.count("*").alias("sites"), F.min("pos").alias("first"))
    return df.select(F.col(id_col).alias("id")).join(per, "id", "left").select("id", F.coalesce("sites", F.lit(0)).alias("sites"), "first")


def sites_matrix(found: DataFrame) -> DataFrame:
    """``pos, sym, cnt`` of the sites that were found."""
    return position_counts(found.groupBy("site").agg(F.count("*").cast("double").alias("n")), "site", F.col("n"))  # equal sites as one


def assess(truth: DataFrame, predicted: DataFrame, width: int, most: int) -> DataFrame:
    """One row: sensitivity, positive predictive value, performance coefficient and their mean (``sn, ppv, pc, asp``) by site
    (a predicted start within ``most`` places of a true one) and by symbol (``n_*``). Both: ``id, pos``, one motif."""
    t, q = truth.select("id", F.col("pos").alias("a")).distinct(), predicted.select("id", F.col("pos").alias("b")).distinct()
    near = t.join(q, "id").where(F.abs(F.col("a") - F.col("b")) <= most)
    sites = near.agg(F.count_distinct("id", "a").alias("hit"), F.count_distinct("id", "b").alias("right")).crossJoin(t.agg(F.count("*").alias("n"))).crossJoin(q.agg(F.count("*").alias("m")))  # one row each

    def places(df, c):
        return df.select("id", F.explode(F.sequence(F.col(c), F.col(c) + width - 1)).alias("at")).distinct()

    both = places(t, "a").withColumn("t", F.lit(1)).join(places(q, "b").withColumn("q", F.lit(1)), ["id", "at"], "full")
    cells = both.agg(F.count_if(F.expr("t = 1 and q = 1")).alias("tp"), F.count("t").alias("nt"), F.count("q").alias("nq"))
    out = sites.crossJoin(cells)  # one row each
    sn, ppv = F.try_divide("hit", "n"), F.try_divide("right", "m")
    n_sn, n_ppv = F.try_divide("tp", "nt"), F.try_divide("tp", "nq")
    return out.select(sn.alias("sn"), ppv.alias("ppv"), F.try_divide(F.col("hit"), F.col("n") + F.col("m") - F.col("right")).alias("pc"), ((sn + ppv) / 2).alias("asp"), n_sn.alias("n_sn"), n_ppv.alias("n_ppv"), F.try_divide(F.col("tp"), F.col("nt") + F.col("nq") - F.col("tp")).alias("n_pc"), ((n_sn + n_ppv) / 2).alias("n_asp"))


def containing(df: DataFrame, id_col: str, seq: str, words: DataFrame, k: int, mismatches: int) -> DataFrame:
    """``id, kmer``: sequences and words (``kmer``, all of length k) of which a window differs in so many places at most.

    The different windows and the words meet in an equi-join on the word with some places blanked out, not pair by pair; a
    sequence has a row for each of its windows only.
    """
    places = list(combinations(range(k), mismatches))

    def keys(word: Column) -> Column:
        out = []
        for blank in places:
            parts, at = [], 0
            for b in blank:
                parts += [F.substring(word, at + 1, b - at), F.lit("_")]
                at = b + 1
            parts.append(F.substring(word, at + 1, k - at))
            out.append(F.concat(*parts))
        return F.array_distinct(F.array(*out))

    dealt = df.select(F.col(id_col).alias("id"), F.col(seq).alias("seq")).repartition(cores(df), "id")
    each = dealt.select("id", F.explode(F.array_distinct(windows(F.col("seq"), k))).alias("w"))
    left = each.select("w").distinct().select("w", F.explode(keys(F.col("w"))).alias("key"))
    right = words.select("kmer", F.explode(keys(F.col("kmer"))).alias("key"))
    met = left.join(right, "key").select("w", "kmer").distinct()
    if met.count() < FEW:  # then rows stay with their ids
        met = F.broadcast(met)
    return each.join(met, "w").select("id", "kmer").distinct()


# --- distances of matrices ----------------------------------------------------------------------------


def _columns(p: np.ndarray, q: np.ndarray, kind: str, ess: float) -> np.ndarray:
    """Distance (for ``pearson``: correlation) of each pair of columns, counts in and symbols last."""
    if kind == "kl":
        p, q = (p + ess / p.shape[-1]) / (p.sum(-1, keepdims=True) + ess), (q + ess / q.shape[-1]) / (q.sum(-1, keepdims=True) + ess)
        return ((p - q) * np.log(p / q)).sum(-1) / 2
    p, q = p / p.sum(-1, keepdims=True), q / q.sum(-1, keepdims=True)
    if kind == "euclidean":
        return np.sqrt(((p - q) ** 2).sum(-1)) / math.sqrt(2)
    x, y = p - 1 / p.shape[-1], q - 1 / q.shape[-1]
    below = np.sqrt((x * x).sum(-1) * (y * y).sum(-1))
    return np.divide((x * y).sum(-1), below, out=np.zeros_like(below), where=below > 0)


def matrix_distance(a: np.ndarray, b: np.ndarray, kind: str = "euclidean", least: int = 1, ess: float = 1.0, uniform_border: bool = False) -> tuple[float, int]:
    """Least mean distance of the columns of two matrices (places x symbols) over all offsets with ``least`` overlapping
    places, and that offset (of b's start in a; of equals the smallest). Kinds: ``euclidean``, ``pearson`` (one less the
    correlation), ``kl`` (symmetric). With ``uniform_border`` places beyond a matrix count as uniform columns."""
    best = math.inf, 0
    for offset in range(least - len(b), len(a) - least + 1):
        low, high = max(0, offset), min(len(a), offset + len(b))
        if high - low < least:
            continue
        p, q = a[low:high], b[low - offset : high - offset]
        if uniform_border:
            first, last = min(0, offset), max(len(a), offset + len(b))
            p, q = np.full((last - first, a.shape[1]), a[0].sum() / a.shape[1]), np.full((last - first, b.shape[1]), b[0].sum() / b.shape[1])
            p[-first : len(a) - first], q[offset - first : offset - first + len(b)] = a, b
        each = _columns(p, q, kind, ess).mean()
        best = min(best, (float(1 - each if kind == "pearson" else each), offset))
    return best


def matrix_distances(counts: DataFrame, alphabet: str = "ACGT", kind: str = "euclidean", least: int = 1, ess: float = 1.0, blocks: int = 16) -> DataFrame:
    """``a, b, offset, d`` for all pairs a < b of matrices (``motif, pos, sym, cnt``).

    A matrix is one row; rows are dealt to pairs of blocks, so the pairs are spread over ``blocks`` ** 2 / 2 keys, and each
    is measured in numpy.
    """
    wide = counts.groupBy("motif").agg(F.collect_list(F.struct("pos", "sym", F.col("cnt").cast("double").alias("cnt"))).alias("cells"))
    mine = F.pmod(F.xxhash64("motif"), F.lit(blocks))
    dealt = wide.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keyed = dealt.select("motif", "cells", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    left, right = keyed.select("x", "y", F.col("motif").alias("a"), F.col("cells").alias("ca"), F.col("block").alias("ba")), keyed.select("x", "y", F.col("motif").alias("b"), F.col("cells").alias("cb"), F.col("block").alias("bb"))
    # a pair of one block meets under (block, block) only
    pairs = left.join(right, ["x", "y"]).where("a < b and (ba <> bb or x = y)").select("a", "b", "ca", "cb")
    name = counts.schema["motif"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        place = {s: i for i, s in enumerate(alphabet)}

        def dense(cells):
            out = np.zeros((1 + max(c["pos"] for c in cells), len(alphabet)))
            for c in cells:
                out[c["pos"], place[c["sym"]]] += c["cnt"]
            return out

        for batch in batches:
            found = [matrix_distance(dense(p), dense(q), kind, least, ess) for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o for _, o in found], pa.int32()), pa.array([d for d, _ in found], pa.float64())], ["a", "b", "offset", "d"])

    return pairs.mapInArrow(run, f"a {name}, b {name}, offset int, d double")


def search(database: DataFrame, query: np.ndarray, alphabet: str = "ACGT", kind: str = "euclidean", least: int = 1, ess: float = 1.0) -> DataFrame:
    """``motif, strand, offset, d``: each matrix of a database against one, the nearer strand."""
    wide = database.groupBy("motif").agg(F.collect_list(F.struct("pos", "sym", F.col("cnt").cast("double").alias("cnt"))).alias("cells"))
    name = database.schema["motif"].dataType.simpleString()
    strands = {"+": query, "-": query[::-1, ::-1]}  # complements stand opposite in the alphabet

    def run(batches):
        import pyarrow as pa

        place = {s: i for i, s in enumerate(alphabet)}
        for batch in batches:
            found = []
            for cells in batch.column(1).to_pylist():
                m = np.zeros((1 + max(c["pos"] for c in cells), len(alphabet)))
                for c in cells:
                    m[c["pos"], place[c["sym"]]] += c["cnt"]
                found.append(min((*matrix_distance(m, q, kind, least, ess), s) for s, q in strands.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for _, _, s in found]), pa.array([o for _, o, _ in found], pa.int32()), pa.array([d for d, _, _ in found], pa.float64())], ["motif", "strand", "offset", "d"])

    return wide.mapInArrow(run, f"motif {name}, strand string, offset int, d double")


def profile(model: PWM, text: str) -> np.ndarray:
    """Scores of all windows of a cyclic text."""
    n = len(model.logs)
    codes = np.asarray([model.alphabet.index(c) for c in text + text[: n - 1]])
    logs = np.asarray(model.logs)
    return sum(logs[j][codes[j : j + len(text)]] for j in range(n))


def profile_distance(a: PWM, b: PWM, order: int = 6, shift: int = 4) -> float:
    """One less the best correlation of two models' scores along a De Bruijn sequence, over shifts up to ``shift``."""
    text = de_bruijn(a.alphabet, order)
    x, y = profile(a, text), profile(b, text)
    return 1 - max(float(np.corrcoef(x, np.roll(y, k))[0, 1]) for k in range(-shift, shift + 1))


def clustered(models: dict[str, PWM], limit: float, linkage: str = "average", order: int = 6, shift: int = 4) -> dict[str, int]:
    """Cluster number of each of some motifs, by their profiles (a handful to a few thousand motifs)."""
    names = sorted(models)
    d = np.zeros((len(names), len(names)))
    for i, j in combinations(range(len(names)), 2):
        d[i, j] = d[j, i] = profile_distance(models[names[i]], models[names[j]], order, shift)
    return dict(zip(names, cut_tree(agglomerate(d, linkage), len(names), limit)))


def logo_heights(counts: DataFrame, keys: list[str], symbols: int = 4) -> DataFrame:
    """``keys, pos, sym, height`` in bits: what a sequence logo draws."""
    place = Window.partitionBy(*keys, "pos")
    p = F.col("cnt") / F.sum("cnt").over(place)
    cells = counts.withColumn("__p", p)
    bits = math.log2(symbols) + F.sum(F.when(F.col("__p") > 0, F.col("__p") * F.log2("__p")).otherwise(0.0)).over(place)
    return cells.withColumn("height", F.col("__p") * bits).select(*keys, "pos", "sym", "height")
