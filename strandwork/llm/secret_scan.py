"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Three kinds of base spans are found by regular expression: assignments, access keys and long hexadecimal runs. The
method adds *owned* spans: opaque tokens (long, with capitals, small letters and digits) anywhere in a text. For
every candidate value, hashed, the corpus counts the distinct owners and repositories that have it: a value that
many owners share is a copied example, one that few share looks like a live credential of theirs.

A table of documents has no repositories. By default the owner of a text is its ``source`` and its repository what that
source has in one ``lang``: a value's repositories are its distinct pairs of both. Other columns can be named.

Counting is a distinct of (value, owner, repository) and then a count, both combined before the shuffle, so that a
value in a third of all rows arrives as one row a task and pair. Values and rows meet in a sort-merge join of hashes, which
adaptive execution may split; no text is shuffled by the scan itself.

Edge cases: a null or empty text has no spans; a null owner counts as an owner of its own; equal rows have equal
results, and owners count once however many rows they have; an empty table gives an empty result; columns of the
input other than the ones named don't matter to ``scan`` and are kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm._common import materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is taken whole from its first place, so a least length in the pattern gives what a later filter would.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Not a base kind: possessive, hence linear.
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{24,}+(?![A-Za-z0-9+/_-])"
KINDS = ("assign", "access", "hex", "owned")


@dataclass(frozen=True)
class Ownership:
    """A value is live-looking if at most ``max_owners`` owners and ``max_repositories`` repositories have it."""

    max_owners: int = 2
    max_repositories: int = 3


#: Matches that are placed one by one; arrays grow within a block and block by block.
_BLOCK = 64
_SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """``array<struct<start,end,kind,value>>`` of all matches, in code points: what stands between two matches is as
    long as the split's parts are. A text without a match is read once, others twice."""
    none = F.array().cast(_SPANS)

    def placed(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))).alias("out"))

    def block(acc, xs):
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), placed)
        return _let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], i["out"]).alias("out")))

    def place(pairs):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int")), lambda b: F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda acc: acc["out"])

    def found(values):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        pairs = F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
        return F.when(F.size(values) == 0, none).otherwise(_let(pairs, place))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _value(span: Column) -> Column:
    """What is counted over the corpus: the value of an assignment, else the whole match."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def find(docs: DataFrame, text_col: str, out: str = "found") -> DataFrame:
    """``docs`` with all spans of each text, base and candidate, ordered by start and kind, each with its value's
    hash; spans of equal start come as the kinds are listed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(_matches(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    spans = F.concat(assign, _matches(text, ACCESS, "access"), _matches(text, HEX, "hex"), _matches(text, OPAQUE, "owned"))
    rank = F.array(*map(F.lit, KINDS))
    hashed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(rank, s["kind"]).cast("int").alias("rank"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
            F.sha2(_value(s).cast("binary"), 256).alias("hash"),
        ),
    )
    return docs.withColumn(out, F.sort_array(hashed))


def ownership(found: DataFrame, owner_col: str, repository_col: str, spans_col: str = "found") -> DataFrame:
    """``hash, owners, repositories`` for every candidate value of ``found``."""
    each = found.select(
        F.explode(F.array_distinct(F.transform(spans_col, lambda s: s["hash"]))).alias("hash"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("owner"),
        F.coalesce(F.col(repository_col).cast("string"), F.lit("\x00")).alias("repository"),
    )
    pairs = each.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def live_spans(found: DataFrame, owners: DataFrame, key: str, rule: Ownership, spans_col: str = "found") -> DataFrame:
    """``key, live``: the spans of each row whose value is live-looking (rows without any are left out)."""
    each = found.select(key, F.explode(spans_col).alias("span"))
    each = each.withColumn("hash", F.col("span.hash"))
    rare = owners.where((F.col("owners") <= rule.max_owners) & (F.col("repositories") <= rule.max_repositories)).select("hash")
    return each.join(rare, "hash").groupBy(key).agg(F.sort_array(F.collect_list("span")).alias("live"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "lang", rule: Ownership = Ownership()) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``base`` (base spans), ``live`` (spans of live-looking values, base
    or owned) as arrays of ``start, rank, end, kind, hash``."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(owner_col).alias("owner"), F.col(repository_col).alias("repository"))
    found = find(narrow, "text").drop("text").withColumn("row", F.monotonically_increasing_id())
    found = materialize(found, "secrets")  # no texts; row numbers hold from here on
    live = live_spans(found, ownership(found, "owner", "repository"), "row", rule)
    none = F.filter("found", lambda s: F.lit(False))
    joined = found.join(live, "row", "left")
    return joined.select(F.col("id").alias(id_col), F.filter("found", lambda s: s["kind"] != "owned").alias("base"), F.coalesce("live", none).alias("live"))


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repository_col: str = "lang", rule: Ownership = Ownership(), mask: str = "[SECRET]") -> DataFrame:
    """The rows and columns of ``docs`` with every live-looking span of ``text_col`` replaced by ``mask``.

    Copied examples stay. Texts are searched once and written down with what was found; only rows with a live-looking span
    are shuffled.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    body, owner, repository = (f"c{names.index(c)}" for c in (text_col, owner_col, repository_col))
    rows = materialize(find(plain, body).withColumn("row", F.monotonically_increasing_id()), "secrets")
    some = rows.where(F.size("found") > 0)
    live = live_spans(some, ownership(some, owner, repository), "row", rule)
    hit = some.join(live, "row", "left")
    cut = F.aggregate(
        "live",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(F.col(body), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(body), acc["at"] + 1, F.length(body))),
    )
    hit = hit.withColumn(body, F.when(F.col("live").isNull(), F.col(body)).otherwise(cut)).select(plain.columns)
    return hit.unionByName(rows.where(F.size("found") == 0).select(plain.columns)).toDF(*names)
