"""Annotations of sequences: arrays of (type, id, start, end) that travel with their row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "array<struct<type:string,id:string,start:bigint,end:bigint>>"


def annotation(kind: Column, identifier: Column, start: Column | None = None, end: Column | None = None) -> Column:
    none = F.lit(None).cast("bigint")
    return F.struct(kind.cast("string").alias("type"), identifier.cast("string").alias("id"), (start if start is not None else none).cast("bigint").alias("start"), (end if end is not None else none).cast("bigint").alias("end"))


def annotate(old: Column, *new: Column, replace: bool = False) -> Column:
    """``old`` annotations (null: none) with more of them, or new ones in their place."""
    more = F.array(*new).cast(KIND) if new else F.array().cast(KIND)
    return more if replace else F.concat(F.coalesce(old, F.array().cast(KIND)), more)


def lookup(annotations: Column, kind: str, identifier: str | None = None) -> Column:
    """The first annotation of a type (and id); null if there is none."""
    return F.get(F.filter(annotations, lambda a: (a["type"] == kind) & (F.lit(True) if identifier is None else a["id"] == identifier)), F.lit(0))


def count_of(annotations: Column, kind: str | None = None) -> Column:
    return F.size(F.filter(F.coalesce(annotations, F.array().cast(KIND)), lambda a: F.lit(True) if kind is None else a["type"] == kind))


def index_matrix(df: DataFrame, annotations: str, rows: str, columns: str, id_col: str, names: list[str] | None = None) -> DataFrame:
    """The smallest id of the sequences for each identifier of one annotation type (rows) and of another (columns)."""
    r, c = lookup(F.col(annotations), rows)["id"], lookup(F.col(annotations), columns)["id"]
    return df.select(r.alias(rows), c.alias("__c"), id_col).where(F.col(rows).isNotNull() & F.col("__c").isNotNull()).groupBy(rows).pivot("__c", names).agg(F.min(id_col))


def motifs_of(header: Column) -> Column:
    """Annotations written as ``Motif:id(pos, length, STRAND)``: array of (id, pos, length, strand)."""
    pattern = r"[Mm]otif:\s*([^\s(,;]+)\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*([A-Za-z+-]+)\s*\)"
    found = [F.regexp_extract_all(header, F.lit(pattern), F.lit(k)) for k in range(1, 5)]
    return F.transform(F.arrays_zip(*(x.alias(n) for x, n in zip(found, ("id", "pos", "length", "strand")))), lambda x: F.struct(x["id"].alias("id"), x["pos"].cast("bigint").alias("pos"), x["length"].cast("bigint").alias("length"), x["strand"].alias("strand")))


def aligned_columns(df: DataFrame, group: list[str], id_col: str, seq: str) -> DataFrame:
    """``group, pos, column``: the symbols of all sequences of a group at a place, in the order of their ids."""
    cells = df.select(*group, id_col, F.posexplode(F.split(seq, "")).alias("pos", "sym"))
    return cells.groupBy(*group, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(id_col, "sym"))), lambda x: x["sym"]), "").alias("column"))
