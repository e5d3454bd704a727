"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths (in words) mark every n-gram that occurs twice or more in its own text;
what counts is the share of the text's word characters that lie inside marked n-grams, or on lines that occur
twice or more. A text is rejected when one of these shares passes its limit, or when it fails the base rules
(too few words; too many words inside repeated 8-word windows), or when too many of its characters are symbols.

Edge cases: a null or empty text has no words and is rejected; rows are judged one by one, so repeated rows and
ties get equal answers; an empty table gives an empty result; other columns of the input are ignored by
``measure`` and kept by ``keep_good``. Memory is bounded by the longest single text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm._common import arrow_map, equal_ranges, mix, spans_by_size, text_bytes

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_STEP = 0xD6E8FEB86659FD93
BLOCK_BYTES = 1 << 19


@dataclass(frozen=True)
class Limits:
    """``ngram_share``: n-gram length -> largest share of word characters inside repeated n-grams of that length."""

    min_words: int = 20
    max_repeat_percent: int = 30
    ngram_share: tuple[tuple[int, float], ...] = ((3, 0.60), (5, 0.35), (8, 0.30), (10, 0.28))
    line_share: float = 0.30
    symbol_share: float = 0.05


DEFAULT = Limits()
BASE_WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    np.subtract.at(edge, starts + width, 1)
    return np.cumsum(edge[:-1]) > 0


def measure_block(texts: list[bytes], limits: Limits = DEFAULT) -> dict[str, np.ndarray]:
    """Counts and shares of some texts, all in one buffer."""
    n = len(texts)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, n))
    bounds = np.concatenate([[0], ends])

    def per_text(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    word_byte = ~_IS_SPACE[buf]
    edges = np.flatnonzero(np.diff(word_byte, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    doc = np.searchsorted(ends, starts, side="right")
    chars = np.concatenate([[0], np.cumsum(word_byte & ((buf & 0xC0) != 0x80), dtype=np.int64)])
    width = chars[stops] - chars[starts]
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": np.bincount(doc, width, n).astype(np.int64), "n_symbols": per_text(_IS_SYMBOL[buf])}
    total = np.maximum(out["word_chars"], 1)

    # lines: every text ends with a line feed here, so a line is what stands between two of them
    feeds = np.flatnonzero(buf == 10)
    line_start = np.concatenate([[0], feeds[:-1] + 1])
    line_chars = chars[feeds] - chars[line_start]
    full = line_chars > 0
    line_start, line_end, line_chars = line_start[full], feeds[full], line_chars[full]
    line_doc = np.searchsorted(ends, line_start, side="right")
    key = line_doc * len(buf) + equal_ranges(buf, line_start, line_end)
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    out["line_share"] = np.bincount(line_doc, line_chars * _repeated(key), n) / total

    # n-grams of words; equal words have equal numbers, so only rolling hashes of up to ten of them can collide
    word = mix(equal_ranges(buf, starts, stops).astype(np.uint64) + np.uint64(1))
    salt = mix(doc.astype(np.uint64) + np.uint64(1))
    shares = dict(limits.ngram_share)
    rolling, scale, m = np.zeros(len(word), np.uint64), 1, len(word)
    for k in range(1, max([BASE_WINDOW, *shares]) + 1):
        if m - k + 1 <= 0:
            rolling = rolling[:0]
        else:
            rolling = rolling[: m - k + 1] + word[k - 1 :] * np.uint64(scale)
            scale = scale * _STEP % 2**64
        if k != BASE_WINDOW and k not in shares:
            continue
        inside = np.flatnonzero(doc[: len(rolling)] == doc[k - 1 :][: len(rolling)])
        first = inside[_repeated(mix(rolling[inside]) ^ salt[inside])]
        covered = _covered(m, first, k)
        if k == BASE_WINDOW:
            out["n_repeat_words"] = np.bincount(doc, covered, n).astype(np.int64)
        if k in shares:
            out[f"share_{k}"] = np.bincount(doc, width * covered, n) / total

    out["base_failed"] = (out["n_words"] < limits.min_words) | (100 * out["n_repeat_words"] > limits.max_repeat_percent * out["n_words"])
    good = (out["line_share"] <= limits.line_share) & (out["n_symbols"] <= limits.symbol_share * total)
    for k, most in limits.ngram_share:
        good &= out[f"share_{k}"] <= most
    out["kept"] = good & ~out["base_failed"]
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = DEFAULT) -> DataFrame:
    """One row per row of ``docs``: its id, the counts, the shares, ``base_failed`` and ``kept``. Nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ["line_share", *(f"share_{k}" for k, _ in limits.ngram_share)]
    names = [*COUNTS, *extra, "base_failed", "kept"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in spans_by_size([len(t) for t in texts], BLOCK_BYTES):
                got = measure_block(texts[a:b], limits)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(got[k]) for k in names)], ["id", *names])

    schema = f"id {kind}, " + ", ".join([*(f"{k} bigint" for k in COUNTS), *(f"{k} double" for k in extra), "base_failed boolean", "kept boolean"])
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits = DEFAULT) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns. Nothing is shuffled."""

    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch.column(place))
            kept = [measure_block(texts[a:b], limits)["kept"] for a, b in spans_by_size([len(t) for t in texts], BLOCK_BYTES)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    # columns go by position in there, so that clashing names don't matter
    return arrow_map(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), run, docs.schema)
