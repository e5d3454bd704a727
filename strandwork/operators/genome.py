"""Genomes, peaks, introns and transcripts. Places are zero-based and half-open unless said otherwise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.scalar import DNA, DNA_COMPLEMENT, reverse_complement, translate_codons, windows
from strandwork.operators.intervals import coverage, islands, overlap_join
from strandwork.operators.ordered import numbered, whole_groups
from strandwork.operators.words import arrow_map, once, starts
from strandwork.operators.words import pieces as slices


def pieces(genome: DataFrame, chrom: str, seq: str, size: int, overlap: int) -> DataFrame:
    """``chrom, piece, offset, part``: chromosomes cut in pieces, each with the first ``overlap`` symbols of the next (not
    more than ``size``). One pass over each sequence."""
    if overlap > size:
        raise ValueError("pieces can't overlap by more than their size")
    parts = F.regexp_extract_all(F.col(seq), F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    cut = genome.select(F.col(chrom).alias("chrom"), parts.alias("__parts"))
    each = cut.select("chrom", F.posexplode(F.transform("__parts", lambda x, i: F.concat(x, F.coalesce(F.substring(F.get("__parts", i + 1), 1, overlap), F.lit("")))))).toDF("chrom", "piece", "part")
    return each.withColumn("offset", F.col("piece").cast("bigint") * size).select("chrom", "piece", "offset", "part")


def around(genome: DataFrame, peaks: DataFrame, width: int, top: str = "top", chrom: str = "chrom", seq: str = "seq", symbols: str = "ACGT", size: int = 1 << 16) -> DataFrame:
    """``peaks`` with ``start`` and ``window``: ``width`` symbols around each peak's ``top``. Peaks whose window leaves the
    chromosome or holds other symbols are left out. Peaks meet pieces of chromosomes, never whole ones."""
    size = max(size, width)
    part = pieces(genome, chrom, seq, size, width)
    placed = peaks.withColumn("__start", F.col(top) - width // 2).where("__start >= 0").withColumn("__piece", F.floor(F.col("__start") / size).cast("int"))
    both = placed.join(part.select(F.col("chrom").alias("__chrom"), F.col("piece").alias("__p"), "offset", "part"), (F.col(chrom) == F.col("__chrom")) & (F.col("__piece") == F.col("__p")))
    window = F.substring(F.col("part"), (F.col("__start") - F.col("offset") + 1).cast("int"), F.lit(width))
    out = both.withColumn("window", window).where((F.length("window") == width) & F.col("window").rlike(f"^[{symbols}]*$"))
    return out.withColumn("start", F.col("__start")).drop("__start", "__piece", "__chrom", "__p", "offset", "part")


def lifted(features: DataFrame, regions: DataFrame, on: list[str], width: int) -> DataFrame:
    """``l_id, r_id, from, to``: features (``l_*``) in the coordinates of the regions (``r_*``, ``r_strand``) they overlap,
    clipped, and counted from the region's end on the reverse strand."""
    both = overlap_join(features, regions, on, width)
    low, high = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    back = F.col("r_strand") == "-"
    return both.select("l_id", "r_id", F.when(back, F.col("r_end") - high).otherwise(low - F.col("r_start")).alias("from"), F.when(back, F.col("r_end") - low).otherwise(high - F.col("r_start")).alias("to"))


def order_numbers(genes: DataFrame, chrom: str, start: str, end: str, out: str = "number") -> DataFrame:
    """``genes`` with their place (from 0) on their chromosome, by their middles, then by start and end."""
    return numbered(genes.withColumn("__middle", F.col(start) + F.col(end)), [chrom], ["__middle", start, end], out).drop("__middle")


def synteny(genes: DataFrame, reference: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, number, reference_chrom, reference_number`` of genes that the reference has too (both ``id, chrom, start, end``)."""
    mine = order_numbers(genes, "chrom", "start", "end")
    other = order_numbers(reference, "chrom", "start", "end", "reference_number").select(id_col, F.col("chrom").alias("reference_chrom"), "reference_number")
    return mine.join(other, id_col).select(id_col, "chrom", "number", "reference_chrom", "reference_number")


_PLACE = ["id", "chrom", "start", "end"]


def mean_near(points: DataFrame, runs: DataFrame, context: int, width: int) -> DataFrame:
    """``id, chrom, start, end, left, right``: mean coverage of ``runs`` (``chrom, start, end, cov``) over ``context`` places
    before ``start`` and after ``end``; places without any coverage on both sides are left out."""
    distinct = points.select(*_PLACE).distinct()

    def side(k, start, end):
        return distinct.select("chrom", F.struct(*_PLACE, F.lit(k).alias("side")).alias("l_id"), start.alias("l_start"), end.alias("l_end"))

    near = side(0, F.col("start") - context, F.col("start")).unionByName(side(1, F.col("end"), F.col("end") + context))
    tracks = runs.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("cov").alias("r_cov"))
    mass = F.col("overlap") * F.col("r_cov")
    pairs = overlap_join(near, tracks, ["chrom"], width).groupBy(*(F.col(f"l_id.{c}").alias(c) for c in _PLACE)).agg(*(F.sum(F.when(F.col("l_id.side") == k, mass)).alias(name) for k, name in enumerate(("left", "right"))))
    return pairs.select(*_PLACE, *((F.coalesce(c, F.lit(0)) / context).alias(c) for c in ("left", "right")))


def denoised(introns: DataFrame, runs: DataFrame, context: int, least: float, longest: int, width: int = 256) -> DataFrame:
    """Introns (``id, chrom, start, end, reads``) shorter than ``longest`` whose reads are at least ``least`` times the higher
    mean coverage on either side; without any coverage near, those with reads."""
    near = mean_near(introns, runs, context, width)
    higher = F.greatest(F.coalesce("left", F.lit(0.0)), F.coalesce("right", F.lit(0.0)))
    return introns.join(near, _PLACE, "left").where((F.col("end") - F.col("start") < longest) & F.when(higher == 0, F.col("reads") > 0).otherwise(F.col("reads") / higher >= least)).drop("left", "right")


def evidence(parts: DataFrame, introns: DataFrame, runs: DataFrame, width: int = 256) -> DataFrame:
    """What reads say about transcripts: ``transcript, parts, tie`` (share of introns with reads, null for one part),
    ``min_reads, tpc`` (share of covered places), ``min_cov`` (0 if any place has none), ``avg_cov``.

    ``parts``: ``transcript, chrom, strand, start, end``; ``introns``: ``chrom, strand, start, end, reads``; ``runs``:
    ``chrom, start, end, cov``.
    """
    w = Window.partitionBy("transcript").orderBy("start", "end")  # a transcript has few parts
    gaps = parts.withColumn("__from", F.lag("end").over(w)).where("__from is not null").select("transcript", "chrom", "strand", F.col("__from").alias("start"), F.col("start").alias("end"))
    reads = introns.groupBy("chrom", "strand", "start", "end").agg(F.sum("reads").alias("reads"))
    split = gaps.join(reads, ["chrom", "strand", "start", "end"], "left").groupBy("transcript").agg(F.avg((F.coalesce("reads", F.lit(0)) > 0).cast("double")).alias("tie"), F.min(F.coalesce("reads", F.lit(0))).alias("min_reads"))
    left = parts.select("chrom", F.struct("transcript", "start").alias("l_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    tracks = runs.where("cov > 0").select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("cov").alias("r_cov"))
    under = overlap_join(left, tracks, ["chrom"], width).groupBy(F.col("l_id.transcript").alias("transcript")).agg(F.sum("overlap").alias("covered"), F.sum(F.col("overlap") * F.col("r_cov")).alias("mass"), F.min("r_cov").alias("low"))
    total = parts.groupBy("transcript").agg(F.count("*").alias("parts"), F.sum(F.col("end") - F.col("start")).alias("__length"))
    out = total.join(split, "transcript", "left").join(under, "transcript", "left")
    covered = F.coalesce("covered", F.lit(0))
    return out.select("transcript", "parts", "tie", "min_reads", (covered / F.col("__length")).alias("tpc"), F.when(covered < F.col("__length"), 0).otherwise(F.col("low")).alias("min_cov"), (F.coalesce("mass", F.lit(0)) / F.col("__length")).alias("avg_cov"))


def transcript_matches(mine: DataFrame, other: DataFrame, width: int = 64) -> DataFrame:
    """``transcript, other, f1``: for each transcript the one of the others (both ``transcript, chrom, strand, start, end``: a
    row to a part) with the best F1 of covered places on the same strand; of equals the smallest."""
    def side(x, p):
        return x.select(F.struct("chrom", "strand").alias("where"), F.col("transcript").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))

    def sizes(x, p):
        return x.groupBy(F.col("transcript").alias(f"{p}_id")).agg(F.sum(F.col("end") - F.col("start")).alias(f"{p}_size"))

    shared = overlap_join(side(mine, "l"), side(other, "r"), ["where"], width).groupBy("l_id", "r_id").agg(F.sum("overlap").alias("same"))
    scored = shared.join(sizes(mine, "l"), "l_id").join(sizes(other, "r"), "r_id").withColumn("f1", 2 * F.col("same") / (F.col("l_size") + F.col("r_size")))
    best = scored.groupBy("l_id").agg(F.min(F.struct((-F.col("f1")).alias("minus"), "r_id")).alias("x"))
    return best.select(F.col("l_id").alias("transcript"), F.col("x.r_id").alias("other"), (-F.col("x.minus")).alias("f1"))


def gene_completeness(rows: DataFrame) -> DataFrame:
    """``item, status`` of single-copy checks (``item, status, gene``: a row to a transcript) counted by gene: S (one gene
    complete), D (several), F (fragmented only) or M."""
    genes = rows.groupBy("item").agg(F.count_distinct(F.when(F.col("status").isin("Complete", "Duplicated"), F.col("gene"))).alias("n"), F.max((F.col("status") == "Fragmented").cast("int")).alias("part"))
    return genes.select("item", F.when(F.col("n") > 1, "D").when(F.col("n") == 1, "S").when(F.col("part") == 1, "F").otherwise("M").alias("status"))


def read_depth(reads: DataFrame) -> DataFrame:
    """``chrom, start, end, cov`` of alignments with ``blocks`` (from ``read_sam``)."""
    blocks = reads.select("chrom", F.explode("blocks").alias("b")).select("chrom", "b.start", "b.end", F.lit(1).cast("bigint").alias("one"))
    return coverage(blocks, ["chrom"], "start", "end", "one")


def split_reads(reads: DataFrame) -> DataFrame:
    """``chrom, start, end, reads``: introns that alignments span."""
    return reads.select("chrom", F.explode("introns").alias("i")).groupBy("chrom", "i.start", "i.end").agg(F.count("*").alias("reads"))


def bin_labels(bins: DataFrame, relaxed: DataFrame, sure: DataFrame, width: int, region: int, by_summit: bool = False) -> DataFrame:
    """``chrom, start, label`` of bins (``chrom, start``): S (a sure peak's summit lies in the bin of ``width``), else B (a
    sure peak covers half a bin of the region of ``region`` places from the bin's start, or has its summit there), else A (a
    relaxed peak touches the region), else U. Peaks: ``chrom, start, end, summit`` (the last one's place)."""
    spans = bins.select("chrom", F.col("start").alias("l_id"), F.col("start").alias("l_start"), (F.col("start") + region).alias("l_end"))

    def near(peaks):
        return overlap_join(spans, peaks.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("summit").alias("r_summit")), ["chrom"], max(region, 64))

    def top_within(length):
        return (F.col("l_start") <= F.col("r_summit")) & (F.col("r_summit") <= F.col("l_start") + length)

    hits = near(sure).select("chrom", "l_id", F.when(top_within(width), 3).when(top_within(region) if by_summit else F.col("overlap") >= width // 2, 2).alias("k"))
    hits = hits.unionByName(near(relaxed).select("chrom", "l_id", F.lit(1).alias("k")))
    best = hits.groupBy("chrom", F.col("l_id").alias("start")).agg(F.max("k").alias("k"))
    return bins.select("chrom", "start").join(best, ["chrom", "start"], "left").select("chrom", "start", F.when(F.col("k") == 3, "S").when(F.col("k") == 2, "B").when(F.col("k") == 1, "A").otherwise("U").alias("label"))


def merged_bins(*features: DataFrame) -> DataFrame:
    """Feature tables with the same (``chrom, bin``) side by side; bins that one of them lacks are left out."""
    out = features[0]
    for f in features[1:]:
        out = out.join(f, ["chrom", "bin"])
    return out


def in_all(*targets: DataFrame) -> DataFrame:
    """Targets (``target``) that every set has."""
    every = targets[0].select("target", F.lit(0).alias("k"))
    for k, t in enumerate(targets[1:], 1):
        every = every.unionByName(t.select("target", F.lit(k).alias("k")))
    return every.groupBy("target").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(targets)).select("target")


def inverted_repeats(df: DataFrame, id_col: str, seq: str, k: int, least: int, most: int) -> DataFrame:
    """``id, first, second``: places of words whose reverse complement starts ``least`` to ``most`` places later in the same
    sequence (rows of one id are one sequence's). Where ids don't repeat and the places are few, each row is read where it
    is; otherwise words meet their complements in an equi-join on sequence and word."""
    if most - least < 64 and once(df, F.col(id_col)):
        rows = df.select(F.col(id_col).alias("id"), F.col(seq).alias("seq")).where("seq is not null")
        return arrow_map(rows, lambda batches: _inverted(batches, k, least, most), f"id {rows.schema['id'].dataType.simpleString()}, first int, second int")
    words = df.select(F.col(id_col).alias("id"), F.posexplode(windows(F.col(seq), k)).alias("pos", "w"))
    left, right = words.select("id", F.col("pos").alias("first"), "w"), words.select("id", F.col("pos").alias("second"), reverse_complement(F.col("w")).alias("w"))
    return left.join(right, ["id", "w"]).where((F.col("second") - F.col("first")).between(least, most)).select("id", "first", "second")


def _inverted(batches, k: int, least: int, most: int):
    import pyarrow as pa

    for batch in batches:
        ids, every = batch.column(0), batch.column(1).to_pylist()
        for s in slices(np.fromiter(map(len, every), np.int64, len(every))):
            texts = every[s]
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            partners = points.copy()
            for x, y in zip(DNA, DNA_COMPLEMENT):
                partners[points == ord(x)] = ord(y)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            at = starts(lengths, k)
            row = np.repeat(np.arange(len(texts)), np.maximum(lengths - k + 1, 0))
            begin = (np.cumsum(lengths) - lengths)[row]
            last = begin + lengths[row] - k
            for gap in range(least, most + 1):
                ok = np.flatnonzero((at + gap >= begin) & (at + gap <= last))
                for j in range(k):
                    ok = ok[points[at[ok] + j] == partners[at[ok] + gap + k - 1 - j]]
                if len(ok):
                    first = (at[ok] - begin[ok]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[ok] + s.start)), pa.array(first), pa.array(first + np.int32(gap))], ["id", "first", "second"])


def tandem_repeats(df: DataFrame, id_col: str, seq: str, least_unit: int, most_unit: int, copies: int) -> DataFrame:
    """``id, unit, text``: stretches in which a unit of ``least_unit`` to ``most_unit`` symbols stands ``copies`` times or
    more in a row, leftmost first, the shortest unit."""
    pattern = rf"((.{{{least_unit},{most_unit}}}?)\2{{{copies - 1},}}+)"
    found = F.regexp_extract_all(F.col(seq), F.lit(pattern), F.lit(1))
    unit = F.regexp_extract("text", pattern, 2)
    return df.select(F.col(id_col).alias("id"), F.explode(found).alias("text")).select("id", unit.alias("unit"), "text")


def spliced(genome: DataFrame, parts: DataFrame, chrom: str = "chrom", seq: str = "seq", size: int = 1 << 16, longest: int = 1 << 14) -> DataFrame:
    """``transcript, cds, protein``: coding parts (``transcript, chrom, strand, start, end, phase``) cut out of the genome,
    put together in the order of the strand and translated after the first part's phase. Parts are at most ``longest`` long."""
    part = pieces(genome, chrom, seq, max(size, longest), longest)
    size = max(size, longest)
    placed = parts.withColumn("__piece", F.floor(F.col("start") / size).cast("int"))
    both = placed.join(part.select(F.col("chrom").alias("__chrom"), F.col("piece").alias("__p"), "offset", "part"), (F.col(chrom) == F.col("__chrom")) & (F.col("__piece") == F.col("__p")))
    text = F.substring(F.col("part"), (F.col("start") - F.col("offset") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    back = F.col("strand") == "-"
    cut = both.select("transcript", F.when(back, -F.col("start")).otherwise(F.col("start")).alias("at"), F.when(back, reverse_complement(text)).otherwise(text).alias("text"), "phase")
    ordered = cut.groupBy("transcript").agg(F.array_sort(F.collect_list(F.struct("at", "text", "phase"))).alias("parts"))
    joined = ordered.select("transcript", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("cds"), F.coalesce(F.col("parts")[0]["phase"], F.lit(0)).alias("phase"))
    return joined.select("transcript", "cds", translate_codons(F.expr("substring(cds, phase + 1)")).alias("protein"))


def filter_predictions(df: DataFrame, keep: Column | str, score: Column) -> DataFrame:
    """The best prediction of each cluster: equal ones (``chrom, strand, start, end``) are one, with the highest score and
    all their ``evidence`` counted; those that ``keep`` holds for are clustered where they overlap on a strand; of a cluster
    the highest score stays, of equals the smallest id. ``id, chrom, strand, start, end, score, evidence, members``."""
    parts = whole_groups(df, ["chrom", "strand"])
    near = df.repartition(parts, "chrom", "strand") if parts else df  # what follows needs no other shuffle then
    same = near.withColumn("__s", score).groupBy("chrom", "strand", "start", "end").agg(F.min("id").alias("id"), F.max("__s").alias("score"), F.count("*").alias("evidence"))
    kept = same.where(keep)
    clusters = islands(kept, ["chrom", "strand"], "start", "end", -1, bool(parts))  # touching ones don't overlap
    rank = F.struct("score", (-F.col("id")).alias("minus"), "id", "start", "end", "evidence")
    best = clusters.groupBy("chrom", "strand", "island").agg(F.max(rank).alias("x"), F.count("*").alias("members"))
    return best.select("x.id", "chrom", "strand", "x.start", "x.end", "x.score", "x.evidence", "members")
