"""Readers and writers of sequence and interval files, all on Spark's own text and CSV sources."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions.scalar import infix, let, running_sums

GFF = "seqid string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attributes string"
BEDGRAPH = "chrom string, start bigint, end bigint, cov string"
NARROWPEAK = "chrom string, start bigint, end bigint, name string, score int, strand string, signal double, p double, q double, summit int"
FAI = "chrom string, length bigint, offset bigint, linebases int, linewidth int"
#: The twelve columns of tabular hits, and those of the long form after them.
HITS = "query string, subject string, identity double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"
MORE_HITS = ", subjects string, score bigint, identical int, positive int, gaps int, ppos double, frames string, qseq string, sseq string, qlen bigint, slen bigint, title string"
METHYLATION = "chrom string, start bigint, end bigint, percent double, meth bigint, unmeth bigint"


def read_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """``seq``: a row for each line that is no comment (plain or gzip)."""
    return spark.read.text(path).where(~F.col("value").startswith(comment)).withColumnRenamed("value", "seq")


def read_fasta(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """``header, seq``: records are split at lines that start with '>', so one file is read by many tasks."""
    records = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    body = F.regexp_replace(F.regexp_replace("value", r"^>?[^\n]*\n?", ""), r"\s", "")
    return records.select(F.regexp_extract("value", r"^>?([^\r\n]*)", 1).alias("header"), (F.upper(body) if upper else body).alias("seq"))


def read_dna(spark: SparkSession, path: str) -> DataFrame:
    """FASTA in capitals; anything but A, C, G, T in a sequence raises an error when it is read."""
    return require_alphabet(read_fasta(spark, path, True), "seq", "ACGT")


def require_alphabet(df: DataFrame, seq: str, alphabet: str) -> DataFrame:
    good = F.col(seq).isNull() | F.col(seq).rlike(f"^[{alphabet}]*$")
    return df.withColumn(seq, F.when(good, F.col(seq)).otherwise(F.raise_error(F.concat(F.lit("symbols outside the alphabet: "), F.col(seq)))))


def genome_parts(fasta: DataFrame, least: int, chunk: int | None = None, overlap: int = 0) -> DataFrame:
    """``id, offset, seq``: runs of A, C, G, T of at least ``least`` symbols, cut in overlapping chunks if asked for."""
    seq = F.upper("seq")
    runs = F.regexp_extract_all(seq, F.lit("([ACGT]+)"), F.lit(1))

    def placed(x):
        gaps = F.split(seq, "[ACGT]+")
        each = F.zip_with(F.slice(gaps, F.lit(1), F.size(x)), x, lambda g, r: F.length(g) + F.length(r))
        ends = F.zip_with(running_sums(each), each, lambda s, n: s + n)
        return F.zip_with(ends, x, lambda end, r: F.struct((end - F.length(r)).alias("offset"), r.alias("part")))

    found = let(runs, placed)
    parts = fasta.select(F.substring_index("header", " ", 1).alias("id"), F.explode(found).alias("x")).select("id", "x.offset", F.col("x.part").alias("seq")).where(F.length("seq") >= least)
    if not chunk:
        return parts
    if overlap > chunk:
        raise ValueError("chunks can't overlap by more than their size")
    # one pass: pieces without overlap, then the next piece's first symbols
    pieces = F.regexp_extract_all("seq", F.lit(rf"(?s).{{1,{chunk}}}"), F.lit(0))
    joined = let(pieces, lambda x: F.transform(x, lambda p, i: F.concat(p, F.coalesce(F.substring(F.get(x, i + 1), 1, overlap), F.lit("")))))
    cut = parts.select("id", "offset", F.posexplode(joined).alias("k", "seq")).select("id", (F.col("offset") + F.col("k") * chunk).alias("offset"), "seq", "k")
    # a last piece that the one before it holds already says nothing new
    return cut.where((F.col("k") == 0) | (F.length("seq") > overlap)).drop("k")


def read_infixes(spark: SparkSession, path: str, start: int, length: int, comment: str = "#") -> DataFrame:
    """``seq``: the same slice of each line."""
    return read_lines(spark, path, comment).select(infix(F.col("seq"), start, length).alias("seq"))


def first_records(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def keyed(fasta: DataFrame, pattern: str, group: int = 1, find: str | None = None, put: str = "") -> DataFrame:
    """``key, seq`` of FASTA records: the part of the header that a pattern finds (null: it doesn't), after a replacement."""
    key = F.nullif(F.regexp_extract("header", pattern, group), F.lit(""))
    return fasta.select((F.regexp_replace(key, find, put) if find else key).alias("key"), "seq")


def _as_map(pairs: Column) -> Column:
    """Pairs (k, v) as a map; values of a key that comes several times are joined with commas."""
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(pairs, lambda x: x["k"] == k), lambda x: x["v"]), ",")))


def annotations(header: Column) -> Column:
    """``key: value; key: value`` as a map; values of repeated keys are joined with commas, parts without a colon left out."""
    parts = F.filter(F.split(header, ";"), lambda x: F.contains(x, F.lit(":")))
    return _as_map(F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns and ``attrs``, a map (GFF3 ``k=v`` or GTF ``k "v"``; values of repeated keys are joined with commas);
    comments are left out."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema=GFF, quote="")
    pairs = F.filter(F.split(F.trim("attributes"), r"\s*;\s*"), lambda x: x != "")
    named = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([^= ]+)", 1).alias("k"), F.regexp_extract(x, r'^[^= ]+[= ]"?([^"]*)"?$', 1).alias("v")))
    return raw.withColumn("attrs", _as_map(F.coalesce(named, F.array().cast("array<struct<k:string,v:string>>"))))


def read_introns(spark: SparkSession, path: str, least: int) -> DataFrame:
    """``chrom, start, end, strand, reads`` (zero-based, half-open) of introns with ``least`` reads or more; a score that is
    no number counts as ``least``, and a strand that isn't known as both."""
    gff = read_gff(spark, path)
    reads = F.coalesce(F.expr("try_cast(score as bigint)"), F.lit(least))
    strands = F.when(F.col("strand").isin("+", "-"), F.array("strand")).otherwise(F.array(F.lit("+"), F.lit("-")))
    rows = gff.select(F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("start"), "end", F.explode(strands).alias("strand"), reads.alias("reads"))
    return rows.where(F.col("reads") >= least).groupBy("chrom", "start", "end", "strand").agg(F.sum("reads").alias("reads"))


def with_parents(gff: DataFrame) -> DataFrame:
    """A row for each parent of a feature with several."""
    return gff.withColumn("parent", F.explode_outer(F.split(F.col("attrs")["Parent"], ",")))


def coding_only(gff: DataFrame) -> DataFrame:
    """CDS lines, and a transcript line over the CDS parts of each parent."""
    cds = with_parents(gff.where("type = 'CDS'"))
    spans = cds.groupBy("seqid", "strand", "parent").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts"))
    return cds.select("seqid", "type", "start", "end", "strand", "parent", F.lit(1).cast("bigint").alias("parts")).unionByName(spans.withColumn("type", F.lit("mRNA")))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """Half-open intervals; a track line is skipped and coverage that is no number counts as 1."""
    raw = spark.read.csv(path, sep="\t", schema=BEDGRAPH)
    return raw.where(~F.col("chrom").startswith("track") & F.col("end").isNotNull()).withColumn("cov", F.coalesce(F.expr("try_cast(cov as double)"), F.lit(1.0)))


def read_narrowpeak(spark: SparkSession, path: str) -> DataFrame:
    """Peaks with ``top``, the place of the summit (the middle if there is none)."""
    raw = spark.read.csv(path, sep="\t", schema=NARROWPEAK)
    middle = F.floor((F.col("end") - F.col("start")) / 2)
    return raw.withColumn("top", F.col("start") + F.when(F.col("summit") >= 0, F.col("summit")).otherwise(middle))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=FAI)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular search hits: the twelve standard columns and those of the long form (null if a file doesn't have them)."""
    return spark.read.csv(path, sep="\t", schema=HITS + MORE_HITS, comment="#")


def read_methylation(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", schema=METHYLATION)
    return raw.groupBy("chrom", "start").agg(F.sum("meth").alias("meth"), F.sum("unmeth").alias("unmeth"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """``name, flag, chrom, pos`` (zero-based) ``, cigar, blocks, introns`` of SAM text; blocks and introns are
    half-open intervals of the alignment on its chromosome."""
    raw = spark.read.text(path).where(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    # get() and not an index: conditions may be evaluated in any order
    rows = raw.select(F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(1)).try_cast("int").alias("flag"), F.get(f, F.lit(2)).alias("chrom"), (F.get(f, F.lit(3)).try_cast("bigint") - 1).alias("pos"), F.get(f, F.lit(5)).alias("cigar"))
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    sizes, kinds = (F.regexp_extract_all("cigar", pattern, F.lit(k)) for k in (1, 2))

    def steps(ops):
        moved = F.transform(ops, lambda x: F.when(x["k"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(F.lit(0).cast("bigint")))
        return F.zip_with(running_sums(moved), ops, lambda at, x: F.struct((F.col("pos") + at).alias("start"), (F.col("pos") + at + x["n"]).alias("end"), x["k"].alias("kind")))

    done = rows.withColumn("__steps", let(F.zip_with(sizes, kinds, lambda n, k: F.struct(n.cast("bigint").alias("n"), k.alias("k"))), steps))
    return done.withColumn("blocks", F.filter("__steps", lambda x: x["kind"].isin("M", "=", "X"))).withColumn("introns", F.filter("__steps", lambda x: x["kind"] == "N")).drop("__steps")


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).where("trim(value) <> ''")


def read_pfms(spark: SparkSession, path: str) -> DataFrame:
    """``motif, pos, sym, cnt`` from matrices in the form of a '>' line and one line a symbol (``A [ 1 2 3 ]``), or four
    lines of numbers only, for A, C, G and T."""
    records = _records(spark, path, "\n>").select(F.regexp_extract("value", r"^>?(\S+)", 1).alias("motif"), F.split("value", "\n").alias("lines"))
    lines = records.select("motif", F.posexplode(F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda x: x.rlike("[0-9]"))).alias("k", "line"))
    sym = F.when(F.col("line").rlike(r"^\s*[A-Za-z]"), F.upper(F.regexp_extract("line", r"^\s*([A-Za-z])", 1))).otherwise(F.get(F.array(*map(F.lit, "ACGT")), "k"))
    numbers = F.regexp_extract_all("line", F.lit(r"([0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1))
    return lines.select("motif", sym.alias("sym"), F.posexplode(numbers).alias("pos", "cnt")).withColumn("cnt", F.col("cnt").cast("double"))


def read_position_rows(spark: SparkSession, path: str, name: str = "ID") -> DataFrame:
    """``motif, pos, sym, cnt`` from records that end with ``//``, with a line ``name`` (or ``AC``, ``NA``, ``DE``) and a row to
    a place: ``01 1 2 3 4 [N]``, after a header like ``P0 A C G T``."""
    records = _records(spark, path, "//")
    lines = F.split("value", "\n")
    label = F.regexp_extract("value", rf"(?m)^{name}\s+(\S+)", 1)
    head = F.regexp_extract("value", r"(?m)^P[O0]\s+(.*)$", 1)
    symbols = F.when(head == "", F.array(*map(F.lit, "ACGT"))).otherwise(F.regexp_extract_all(head, F.lit(r"([A-Za-z])"), F.lit(1)))
    rows = records.select(label.alias("motif"), symbols.alias("symbols"), F.posexplode(F.filter(lines, lambda x: x.rlike(r"^\s*\d+\s+[0-9.]"))).alias("pos", "line")).where("motif <> ''")
    values = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x.rlike(r"^[0-9.]+(?:[eE][-+]?[0-9]+)?$"))
    cells = rows.select("motif", "pos", F.explode(F.arrays_zip(F.col("symbols").alias("sym"), F.slice(values, F.lit(2), F.size("symbols")).alias("cnt"))).alias("x"))
    return cells.select("motif", "pos", F.upper("x.sym").alias("sym"), F.col("x.cnt").cast("double").alias("cnt"))


def read_labelled_rows(spark: SparkSession, path: str) -> DataFrame:
    """``motif, pos, sym, cnt`` from files with one matrix each: the first line is the name, then a line a symbol
    (``A: 0.1 0.2``). Files are small, so each is one record."""
    files = spark.read.text(path, wholetext=True)
    lines = F.split("value", "\r?\n")
    rows = files.select(F.trim(lines[0]).alias("motif"), F.explode(F.filter(lines, lambda x: x.rlike(r"^[ACGTacgt]\s*:"))).alias("line"))
    numbers = F.regexp_extract_all(F.regexp_replace("line", "^[^:]*:", ""), F.lit(r"([0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1))
    return rows.select("motif", F.upper(F.substring("line", 1, 1)).alias("sym"), F.posexplode(numbers).alias("pos", "cnt")).withColumn("cnt", F.col("cnt").cast("double"))


def parse_profile(text: str) -> dict:
    """A profile hidden Markov model in its ASCII form (version 3): ``name, alphabet, background, match`` and ``insert`` (nodes x
    symbols) and ``move`` (nodes x seven transitions), all as probabilities. Node 0 is the begin."""
    head, rows, body = {}, [], False
    for line in text.splitlines():
        if line.startswith("//"):
            break
        parts = line.split()
        if not parts:
            continue
        if parts[0] == "HMM" and not body:
            body, alphabet = True, parts[1:]
        elif body:
            rows.append(parts)
        else:
            head[parts[0]] = " ".join(parts[1:])

    def numbers(parts):
        return [0.0 if x == "*" else math.exp(-float(x)) for x in parts]

    m, rows = len(alphabet), rows[1:]  # the first row names the transitions
    background = numbers(rows.pop(0)[1 : m + 1]) if rows and rows[0][0] == "COMPO" else None
    match, insert, move = [[]], [numbers(rows[0][:m])], [numbers(rows[1][:7])]
    for k in range(2, len(rows) - 2, 3):
        match.append(numbers(rows[k][1 : m + 1]))
        insert.append(numbers(rows[k + 1][:m]))
        move.append(numbers(rows[k + 2][:7]))
    return {"name": head.get("NAME", ""), "alphabet": "".join(alphabet), "background": background, "match": match, "insert": insert, "move": move}


def parse_newick(text: str) -> list[tuple[int, int, str, float]]:
    """``node, parent, name, length`` of a tree; the root is 0 and its parent -1."""
    out, stack, node, i = [[0, -1, "", 0.0]], [], 0, 0
    while i < len(text) and text[i] != ";":
        c = text[i]
        if c in "(,":
            if c == "(":
                stack.append(node)
            out.append([len(out), stack[-1], "", 0.0])
            node = len(out) - 1
            i += 1
        elif c == ")":
            node = stack.pop()
            i += 1
        else:
            j = i + 1
            while j < len(text) and text[j] not in "(),:;":
                j += 1
            if c == ":":
                out[node][3] = float(text[i + 1 : j])
            else:
                out[node][2] = text[i:j].strip()
            i = j
    return [tuple(x) for x in out]


def column_of(df: DataFrame, number: int) -> DataFrame:
    """The column with a one-based number."""
    return df.select(df.columns[number - 1])


# --- sinks ------------------------------------------------------------------------------------------


def write_fasta(df: DataFrame, path: str, header: str = "header", seq: str = "seq", width: int | None = None) -> None:
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else F.col(seq)
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), body).alias("value")).write.text(path)


def write_gff(df: DataFrame, path: str) -> None:
    attrs = F.concat_ws(";", F.transform(F.array_sort(F.map_entries("attrs")), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    names = ["seqid", "source", "type", "start", "end", "score", "strand", "phase"]
    df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in names), attrs).alias("value")).write.text(path)


def write_bedgraph(df: DataFrame, path: str) -> None:
    df.select("chrom", "start", "end", "cov").write.csv(path, sep="\t")


def write_split(df: DataFrame, path: str, parts: int, group: Column) -> None:
    """Rows in ``parts`` folders, rows of a group together."""
    df.withColumn("part", F.pmod(F.xxhash64(group), F.lit(parts))).write.partitionBy("part").parquet(path)


def save(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    df.write.format(kind).options(**options).save(path)


def write_annotated(df: DataFrame, path: str, notes: str, seq: str = "seq") -> None:
    """FASTA whose headers are a map's ``key: value; key: value``, in the order of the keys."""
    header = F.array_join(F.transform(F.array_sort(F.map_entries(notes)), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "; ")
    df.select(F.concat(F.lit(">"), header, F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def write_lines(df: DataFrame, path: str, column: str, pattern: str, keep: bool = True) -> None:
    """The lines of a column that a pattern finds, or those that it doesn't."""
    found = F.col(column).rlike(pattern)
    df.where(found if keep else ~found).select(F.col(column).alias("value")).write.text(path)


def graph_text(edges: DataFrame, a: str, b: str, label: str | None = None, name: str = "g") -> str:
    """A directed graph (of a model's states or places: a bounded number) in Graphviz form."""
    rows = edges.select(F.col(a).cast("string"), F.col(b).cast("string"), *([F.col(label).cast("string")] if label else [])).collect()
    lines = [f'  "{r[0]}" -> "{r[1]}"' + (f' [label="{r[2]}"]' if label else "") + ";" for r in sorted(rows)]
    return "\n".join([f"digraph {name} {{", *lines, "}"]) + "\n"


def dump_model(model) -> str:
    """A fitted model (a dataclass of numbers, texts, lists, arrays and models) as JSON."""
    import dataclasses

    import numpy as np

    def plain(x):
        if dataclasses.is_dataclass(x):
            return {"__model": type(x).__name__} | {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
        if isinstance(x, np.ndarray):
            return {"__array": x.tolist()}
        if isinstance(x, tuple):
            return {"__tuple": [plain(v) for v in x]}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x

    return json.dumps(plain(model))


def load_model(text: str):
    """What ``dump_model`` wrote."""
    import numpy as np

    from strandwork.operators import models

    def made(x):
        if isinstance(x, list):
            return [made(v) for v in x]
        if not isinstance(x, dict):
            return x
        if "__array" in x:
            return np.asarray(x["__array"])
        if "__tuple" in x:
            return tuple(made(v) for v in x["__tuple"])
        if "__model" in x:
            return getattr(models, x["__model"])(**{k: made(v) for k, v in x.items() if k != "__model"})
        return {k: made(v) for k, v in x.items()}

    return made(json.loads(text))
