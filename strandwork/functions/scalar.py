"""Column functions over symbol sequences and numbers; all stay inside the JVM."""

from __future__ import annotations

import math
import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

DNA, DNA_COMPLEMENT = "ACGT", "TGCA"
#: IUPAC ambiguity codes as sets of bases.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: The standard genetic code, amino acids in the order of codons over T, C, A, G.
_STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def genetic_code() -> dict[str, str]:
    return {"".join(c): a for c, a in zip(product("TCAG", repeat=3), _STANDARD)}


def complement(seq: Column, symbols: str = DNA, partners: str = DNA_COMPLEMENT) -> Column:
    return F.translate(seq, symbols, partners)


def reverse_complement(seq: Column, symbols: str = DNA, partners: str = DNA_COMPLEMENT) -> Column:
    return F.reverse(F.translate(seq, symbols, partners))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def symbol_code(symbol: Column, alphabet: str = DNA) -> Column:
    """Place of a symbol in an alphabet, -1 if it isn't in it."""
    return F.instr(F.lit(alphabet), symbol) - 1


def windows(seq: Column, k: int) -> Column:
    """All overlapping windows of length k; none for shorter or null sequences.

    One pass of a pattern that matches before every symbol and captures the next k, so the work grows with the length
    (taking substrings by place would read the sequence from its start for each window).
    """
    found = F.regexp_extract_all(seq, F.lit(rf"(?s)(?!\p{{Cs}})(?=(.{{{k}}}))"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def symbol_codes(seq: Column, alphabet: str) -> Column:
    """The places of a sequence's symbols in an alphabet, as an array; null if one isn't in it."""
    codes = F.transform(F.split(seq, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    known = F.translate(seq, alphabet, "") == ""
    return F.when(F.length(seq) == 0, F.array().cast("array<int>")).when(known, codes)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column, block: int = 64) -> Column:
    """For each number of an array the sum of those before it. Arrays grow within blocks and block by block, so that long
    ones don't cost the square of their length."""
    kind = "array<bigint>"

    def add(acc, x):
        return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def within(acc, xs):
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), add)
        return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], i["out"]).alias("out")))

    def over(xs):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, F.lit(block)))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))
        return F.when(F.size(xs) == 0, F.array().cast(kind)).otherwise(F.aggregate(blocks, start, within, lambda acc: acc["out"]))

    return let(F.transform(values, lambda v: v.cast("bigint")), over)


def infix(seq: Column, start: int, length: int | None = None) -> Column:
    """Zero-based slice."""
    return F.substring(seq, F.lit(start + 1), F.lit(length if length is not None else 2**31 - 1 - start))


def composite(seq: Column, parts: list[tuple[int, int]]) -> Column:
    """Several slices (start, length) joined."""
    return F.concat(*(infix(seq, a, n) for a, n in parts))


def cyclic(seq: Column, length: int) -> Column:
    """The sequence read round and round up to a length."""
    return F.when(F.length(seq) > 0, F.substring(F.repeat(seq, F.ceil(F.lit(length) / F.length(seq)).cast("int")), F.lit(1), F.lit(length)))


def hamming(a: Column, b: Column) -> Column:
    """Number of places that differ; -1 for unequal lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) != F.length(b), F.lit(-1)).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def contains_about(seq: Column, word: str, mismatches: int) -> Column:
    """Whether some window is within so many mismatches of ``word``."""
    return F.exists(windows(seq, len(word)), lambda w: hamming(w, F.lit(word)) <= mismatches)


def code_hash(seq: Column, alphabet: str = DNA) -> Column:
    """31-polynomial hash of a sequence's codes, as a signed 32-bit number."""
    wide = F.aggregate(symbol_codes(seq, alphabet), F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + c, F.lit(2**32)))
    return F.when(wide >= 2**31, wide - 2**32).otherwise(wide)


def to_text(seq: Column, delimiter: str, start: int = 0, length: int | None = None) -> Column:
    """The symbols of a slice with a delimiter between them."""
    part = infix(seq, start, length)
    return F.when(part == "", "").otherwise(F.array_join(F.split(part, ""), delimiter))


def tokens(text: Column, delimiter: str, alphabet: list[str] | None = None) -> Column:
    """Symbols of several characters between delimiters; null if one isn't in the alphabet."""
    parts = F.filter(F.split(text, re.escape(delimiter)), lambda x: x != "")
    return parts if alphabet is None else F.when(F.forall(parts, lambda x: x.isin(alphabet)), parts)


def permuted(seq: Column, seed: int | None = None) -> Column:
    """The symbols in random order."""
    return F.array_join(F.shuffle(F.split(seq, ""), seed), "")


def iupac_within(a: Column, b: Column) -> Column:
    """Whether every base that code ``a`` stands for is one of those of code ``b``."""
    masks = F.create_map(*(F.lit(x) for c, bases in IUPAC.items() for x in (c, sum(1 << DNA.index(s) for s in bases))))
    x, y = F.try_element_at(masks, F.upper(a)), F.try_element_at(masks, F.upper(b))
    return x.bitwiseAND(y) == x


def iupac_pattern(word: str) -> str:
    """A regular expression for an ambiguous word."""
    return "".join(IUPAC[c] if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in word.upper())


def translate_codons(seq: Column, frame: int = 0, code: dict[str, str] | None = None, unknown: str | None = "X") -> Column:
    """Protein of a reading frame; a rest under three symbols is left out. Codons outside the code become ``unknown``, are
    left out if that is "", and make the result null if it is None."""
    table = F.create_map(*(F.lit(x) for pair in (code or genetic_code()).items() for x in pair))
    codons = F.regexp_extract_all(F.substring(seq, F.lit(frame + 1), F.length(seq)), F.lit("(?s)(.{3})"), F.lit(1))
    acids = F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(unknown)))
    joined = F.array_join(acids, "")
    return F.when(F.exists(acids, lambda x: x.isNull()), F.lit(None).cast("string")).otherwise(joined) if unknown is None else joined


def pair_profile(seq: Column, scale: dict[str, float], default: float = 0.0) -> Column:
    """A number for each adjacent pair of symbols."""
    table = F.create_map(*(F.lit(x) for pair in scale.items() for x in pair))
    return F.transform(windows(seq, 2), lambda w: F.coalesce(F.try_element_at(table, w), F.lit(default)))


def log_sum(values: Column) -> Column:
    """log of the sum of exponentials of an array, stable; minus infinity for none."""

    def body(v, top):
        total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return F.when(F.size(v) == 0, F.lit(-math.inf)).when(top == F.lit(-math.inf), top).otherwise(top + F.log(total))

    return let(values, lambda v: let(F.array_max(v), lambda top: body(v, top)))


def p_norm(a: Column, b: Column, p: float = 2.0) -> Column:
    return F.pow(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y), F.lit(p))), F.lit(0.0), lambda s, x: s + x), F.lit(1.0 / p))


def array_pearson(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of one length."""
    n = F.size(a).cast("double")

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    ad, bd = F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double"))
    sa, sb = total(ad), total(bd)
    saa, sbb = total(F.transform(ad, lambda x: x * x)), total(F.transform(bd, lambda x: x * x))
    sab = total(F.zip_with(ad, bd, lambda x, y: x * y))
    return (n * sab - sa * sb) / F.sqrt((n * saa - sa * sa) * (n * sbb - sb * sb))


def gaussian_log_density(x: Column, mean: float, sd: float) -> Column:
    return F.lit(-math.log(sd) - 0.5 * math.log(2 * math.pi)) - (x - mean) * (x - mean) / (2 * sd * sd)


def poisson_log_density(x: Column, rate: float) -> Column:
    return x * math.log(rate) - rate - F.expr("0") - F.log(F.factorial(x.cast("int")).cast("double"))


def exponential_log_density(x: Column, rate: float) -> Column:
    return F.when(x >= 0, F.lit(math.log(rate)) - x * rate).otherwise(F.lit(-math.inf))
