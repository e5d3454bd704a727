"""Best-fit packing of token sequences by large-item matching.

How pieces are packed depends on their lengths only, and there are at most ``capacity`` distinct lengths. So the
corpus is reduced to a histogram of lengths (``capacity`` rows at most, whatever the input), the packing is planned
on it, and the plan - a few thousand rows, bounded by the capacity as well - is dealt back to the pieces by their
rank among the pieces of equal length.

The plan: lengths above a third of the capacity go at most two to a bin, each matched greedily, longest first, with
the longest partner that still fits; smaller pieces then go, longest first, where they leave the smallest gap.

Edge cases: a null or empty text is a document of one token (the end token); longer documents than a sequence are
cut in full pieces and a rest; pieces of equal length are interchangeable, so ties and repeated rows need no order
beyond (id, piece); an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm._common import arrow_map, flat_index, lower_bytes, materialize, spans_by_size, text_bytes
from strandwork.llm._spans import SpanTable

BLOCK_BYTES = 1 << 19
#: Bytes by class: 1 letters, 2 digits, 3 other visible characters, 0 what parts chunks, 4 what the pattern below or the
#: library has to see in its chunk.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[0x20, 0x0A]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[ord("'")] = 4
#: Characters for which lower case, composition and classes are plain and the same in every Unicode version.
_UNUSUAL = re.compile(r"[^\x09\x0a\x0d\x20-\x7e\xa1-\u017f]|<\|")
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
_ENCODERS: dict = {}


class ChunkEncoder:
    """``tokenizers`` over the words and runs of signs of a text, each distinct one once.

    For vocabularies that drop white space: there no token depends on what stands beyond a space or line feed, nor, in
    plain ASCII, on what stands beyond the run of letters, the digit or the run of other signs. Chunks between spaces that
    aren't plain are kept whole and cut by pattern, those with unusual characters or special tokens by the library.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.table = SpanTable(self._learn, np.uint32)

    def _library(self, strings: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch(strings, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = [self._learn_some([c.decode("utf-8", "replace") for c in chunks[a:b]]) for a, b in spans_by_size([len(c) for c in chunks], 400_000)]
        return (np.concatenate([x for x, _ in made]), np.concatenate([n for _, n in made])) if made else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn_some(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rare = [i for i, c in enumerate(chunks) if _UNUSUAL.search(c)]
        own = dict(zip(rare, self._library([chunks[i] for i in rare])))
        pieces = [[] if i in own else _PRETOKEN.findall(c.lower()) for i, c in enumerate(chunks)]
        number: dict[str, int] = {}
        of = np.asarray([number.setdefault(p, len(number)) for ps in pieces for p in ps], np.int64)
        fresh = list(number)
        # one call for many words: the last token of each is marked as a word's end
        ids = np.asarray(self.tokenizer.encode(" ".join(fresh), add_special_tokens=False).ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(fresh):  # a vocabulary without such marks
            found = self._library(fresh)
            ids, stops = np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([len(x) for x in found], dtype=np.int64)
        sizes = np.diff(stops, prepend=0)
        values = ids[flat_index((stops - sizes)[of], sizes[of])]
        last = np.cumsum(np.asarray([len(ps) for ps in pieces], np.int64))
        upto = np.concatenate([[0], np.cumsum(sizes[of])])
        counts = np.diff(upto[last], prepend=0)
        if own:
            parts = np.split(values, np.cumsum(counts)[:-1])
            for i, x in own.items():
                parts[i] = x
                counts[i] = len(x)
            values = np.concatenate(parts)
        return values, counts

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        kind = _CLASS[buf]
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        cut = (kind != before) | (kind == 2)
        # chunks that aren't plain are taken whole
        odd = kind == 4
        odd[:-1] |= (buf[:-1] == 0x3C) & (buf[1:] == 0x7C)
        begins, ends = np.flatnonzero((kind > 0) & (before == 0)), np.flatnonzero((kind == 0) & (before > 0))
        whole = np.unique(np.searchsorted(begins, np.flatnonzero(odd), side="right") - 1)
        inside = flat_index(begins[whole], ends[whole] - begins[whole])
        cut[inside] = before[inside] == 0
        # plain chunks in small letters, so that there are fewer strings to learn
        low = np.frombuffer(lower_bytes(buf.tobytes()), np.uint8).copy()
        low[inside] = buf[inside]
        edges = np.flatnonzero(cut)
        stops = np.append(edges[1:], len(buf))
        real = kind[edges] > 0
        starts, stops = edges[real], stops[real]
        ids, counts = self.table.lookup(low, starts, stops)
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        done = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, text_ends)]
        raw = ids.astype("<u4", copy=False).tobytes()
        return [raw[4 * x : 4 * y] for x, y in zip([0, *done[:-1].tolist()], done.tolist())]


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` (and ``ids``) for every piece of every row. Nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.uint32(end_id).tobytes()

    def run(batches):
        import pyarrow as pa

        encode = encoder(path)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in spans_by_size([len(t) for t in texts], BLOCK_BYTES):
                rows, piece, start, length, crc, cut = [], [], [], [], [], []
                for i, ids in enumerate(encode(texts[a:b]), a):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            cut.append(part)
                arrays = [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(cut, pa.binary())] * keep_ids, ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``length, first_rank, end_rank, first_bin, per_bin, offset``.

    The pieces of a length with ranks in [first_rank, end_rank) go to bins from ``first_bin`` on, ``per_bin`` to a
    bin, side by side from ``offset`` on.
    """
    left = dict(histogram)
    groups: list[list] = []  # [bins, gap, [(length, per bin)]]
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        long = large[-1]
        at = bisect.bisect_right(large, capacity - long) - 1
        if at < 0:
            groups.append([left.pop(long), capacity - long, [(long, 1)]])
            large.pop()
            continue
        mate = large[at]
        if mate == long:
            pairs, odd = divmod(left.pop(long), 2)
            large.pop()
            if pairs:
                groups.append([pairs, capacity - 2 * long, [(long, 2)]])
            if odd:  # it may still match a shorter one
                rest = bisect.bisect_right(large, capacity - long) - 1
                if rest < 0:
                    groups.append([1, capacity - long, [(long, 1)]])
                else:
                    short = large[rest]
                    groups.append([1, capacity - long - short, [(long, 1), (short, 1)]])
                    left[short] -= 1
                    if not left[short]:
                        large.pop(rest)
            continue
        bins = min(left[long], left[mate])
        groups.append([bins, capacity - long - mate, [(long, 1), (mate, 1)]])
        for k in (long, mate):
            left[k] -= bins
            if not left[k]:
                large.remove(k)
    by_gap: dict[int, list] = {}
    for g in groups:
        by_gap.setdefault(g[1], []).append(g)
    gaps = sorted(by_gap)

    def put(group):
        if group[1] not in by_gap:
            by_gap[group[1]] = []
            bisect.insort(gaps, group[1])
        by_gap[group[1]].append(group)

    for size in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        todo = left[size]
        while todo:
            at = bisect.bisect_left(gaps, size)
            if at == len(gaps):
                bins, gap, inside = -(-todo // (capacity // size)), capacity, []
            else:
                gap = gaps[at]
                bins, _, inside = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap], gaps[at]
            each = gap // size
            full, rest = divmod(todo, each)
            if full >= bins:
                put([bins, gap - each * size, [*inside, (size, each)]])
                todo -= bins * each
                continue
            if full:
                put([full, gap - each * size, [*inside, (size, each)]])
            if rest:
                put([1, gap - rest * size, [*inside, (size, rest)]])
            if unused := bins - full - (rest > 0):
                put([unused, gap, inside])
            todo = 0
    rows, used, first = [], dict.fromkeys(histogram, 0), 0
    for gap in sorted(by_gap):
        for bins, _, inside in by_gap[gap]:
            if not inside:
                continue
            offset = 0
            for length, each in inside:
                rows.append((length, used[length], used[length] + bins * each, first, each, offset))
                used[length] += bins * each
                offset += each * length
            first += bins
    return rows


def pack(parts: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """``parts`` (from ``pieces``) with ``sequence_id`` (0 to bins - 1) and ``offset``.

    ``parts`` is written to the shared folder first. A common length doesn't gather in one task: ranks are counted
    within (length, salt) and shifted by the sizes of the salts before.
    """
    spark = parts.sparkSession
    parts = materialize(parts, "pieces")
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    parts = parts.withColumn("__salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = parts.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("__n")).collect()}  # capacity rows at most
    rows = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("length").alias("__length"), F.col("__salt").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    ranked = parts.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(id_col, "piece", "ids_crc32")) - 1)
    ranked = ranked.join(shift, (F.col("length") == F.col("__length")) & (F.col("__salt") == F.col("__s"))).withColumn("__rank", F.col("__rank") + F.col("__shift"))
    schema = "__l long, __first long, __end long, __bin long, __each long, __at long"
    # its rows are bounded by the capacity, not by the corpus
    deal = F.broadcast(spark.createDataFrame(rows, schema))
    place = F.col("__rank") - F.col("__first")
    dealt = ranked.join(deal, (F.col("length") == F.col("__l")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__end")))
    return dealt.select(
        *(c for c in parts.columns if c != "__salt"),
        (F.col("__bin") + F.floor(place / F.col("__each"))).alias("sequence_id"),
        (F.col("__at") + place % F.col("__each") * F.col("length")).alias("offset"),
    )
