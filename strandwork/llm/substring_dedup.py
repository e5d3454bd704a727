"""Suffix-array dedup: removes every byte that a 200-byte string covers which also starts anywhere else.

Equal texts are counted and kept once. Each 200-byte string picks the 32-byte gram in it with the lowest hash (the
leftmost of equals); equal strings pick the same gram at the same place, so it is enough to compare strings around
equal grams, called anchors here. Around an anchor, the strings that may have picked it lie within 168 bytes to the
left and 200 to the right: its context.

1. Anchors travel as hashes: of the gram, and 128 bits of the context (whole equal texts and contexts are known by 128
   bits, as nothing else is). A gram that occurs once is done with; contexts that are equal as a whole are repeated.
2. Of contexts that share a gram but differ, one of each set of equals is looked at further. A string in it has 0 to
   168 bytes before the anchor; these numbers are cut in two ranges, and all strings of a range have the 116 bytes
   between them in common, called a piece. Pieces travel as hashes; those that occur once are done with.
3. The 284 bytes around each piece that is left, a slice, travel to where equal pieces meet. Equal slices from different
   places are repeated as a whole, and one of them is looked at further. The different slices of some pieces, cut to the
   strings whose hashes occur twice, are one text, whose suffix array (``suffix_array``) is built over its bytes (the
   piece, which all strings of a slice hold, and what follows it in all slices alike stand as one symbol): strings of 200 bytes are repeated where neighbours
   in its order have 200 bytes in common and start at different places. A piece with so many slices that its text would pass ``TEXT_BYTES`` is divided by longer pieces (172, 193 and 199
   bytes), then by whole strings.
4. A piece with more than ``HOT`` slices is divided before they travel: each goes in three cuts of 228 bytes to where equal
   pieces of 172 bytes meet, so that a common passage's surroundings are spread over many tasks. What a task holds are
   the different slices of one piece.
5. Repeated ranges are gathered per text, united, and cut out.

Nothing is decided by sampling and no group is capped. Equal texts, and equal contexts within a text, are reduced
before any shuffle by gram.

Edge cases: a null text is empty; texts under 200 bytes are left alone; repeated rows are copies of each other and
lose everything if long enough; a text may repeat itself; cuts fall on bytes, so ``kept_text`` drops the halves of
characters that are cut through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm._common import RangeHash, arrow_map, flat_index, spans_by_size, text_bytes
from strandwork.llm.suffix_array import suffix_array

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM + 1  # grams in a string
LEFT, RIGHT = SPAN - 1, LENGTH
BLOCK_BYTES = 1 << 19
#: Numbers of bytes before the anchor go by ranges of this width; longer pieces by the narrower ones.
RANGES = 2
WIDTH, NARROWER = LEFT // RANGES, {84: 28, 28: 7, 7: 1, 1: 0}
#: Bytes to a text that a suffix array is built over.
TEXT_BYTES = 1 << 18
#: Slices of one piece that travel whole.
HOT = 4096
#: Bits of a hash that place grams, and places within so many are told apart.
_PLACES = np.uint64(24)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each text's anchors: text number, place, hash of the gram, two halves of the context's hash."""
    import xxhash

    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    where = np.arange(n - GRAM + 1)
    gram = RangeHash(buf)(where, where + GRAM)
    # 40 bits of the hash, then the place: the same choice in whatever buffer a string stands
    picked, step = np.zeros(n - LENGTH + 1, np.int64), (1 << int(_PLACES)) - SPAN
    for a in range(0, len(picked), step):
        some = gram[a : a + step + SPAN - 1]
        ranked = (some >> _PLACES << _PLACES) | np.arange(len(some), dtype=np.uint64)
        found = _sliding_min(ranked, SPAN) & ((np.uint64(1) << _PLACES) - np.uint64(1))
        picked[a : a + step] = found.astype(np.int64) + a
    whole = np.zeros(n + 1, np.int32)  # strings that lie in one text
    long = sizes >= LENGTH
    whole[begins[long]] += 1
    np.subtract.at(whole, ends[long] - LENGTH + 1, 1)
    at = np.unique(picked[np.cumsum(whole)[: len(picked)] > 0])
    doc = np.searchsorted(ends, at, side="right")
    a, b = np.maximum(begins[doc], at - LEFT), np.minimum(ends[doc], at + RIGHT)
    raw, digest = buf.tobytes(), xxhash.xxh3_128_digest
    context = np.frombuffer(b"".join([digest(raw[x:y], seed=left) for x, y, left in zip(a.tolist(), b.tolist(), (at - a).tolist())]), "<u8").reshape(-1, 2)
    return doc, at - begins[doc], gram[at], context[:, 0], context[:, 1]


def union(spans) -> list[tuple[int, int]]:
    """Ranges as maximal ranges in order; touching ones are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _emit_anchors(batches):
    """``h, c, d, k1, k2, pos``. Contexts that recur within their text are sent once, with ``pos`` odd; what they cover
    is sent as ranges (``pos`` -1, the range in ``h`` and ``c``). Else ``pos`` is twice the place."""
    import pyarrow as pa

    for batch in batches:
        k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        texts = text_bytes(batch.column(3))
        for a, b in spans_by_size([len(t) for t in texts], BLOCK_BYTES):
            doc, pos, gram, one, two = anchors(texts[a:b])
            if not len(doc):
                continue
            order = np.lexsort((pos, two, one, gram, doc))
            doc, pos, gram, one, two = (x[order] for x in (doc, pos, gram, one, two))
            same = (doc[1:] == doc[:-1]) & (gram[1:] == gram[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            again = np.append(False, same) | np.append(same, False)
            first = ~np.append(False, same)
            rows = [gram[first].view(np.int64), one[first].view(np.int64), two[first].view(np.int64), k1[a:b][doc[first]], k2[a:b][doc[first]], 2 * pos[first] + again[first]]
            spans: dict[int, list] = {}
            for d, p in zip(doc[again].tolist(), pos[again].tolist()):
                spans.setdefault(d, []).append((max(0, p - LEFT), min(len(texts[a + d]), p + RIGHT)))
            flat = [(x, y, d) for d, s in spans.items() for x, y in union(s)]
            if flat:
                x, y, d = (np.asarray(c, np.int64) for c in zip(*flat))
                rows = [np.concatenate(c) for c in zip(rows, (x, y, np.zeros(len(d), np.int64), k1[a:b][d], k2[a:b][d], np.full(len(d), -1)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["h", "c", "d", "k1", "k2", "pos"])


FULL, FULL_AND_SEND, SEND, RANGE = 0, 1, 2, 3


def _judge(batches):
    """Rows come sorted by (h, c, d); gives ``k1, k2, h, c, pos, role`` for anchors that have company, and the ranges."""
    import pyarrow as pa

    def work(h, c, d, k1, k2, pos):
        if not len(h):
            return None
        new_h = np.append(True, h[1:] != h[:-1])
        new_c = new_h | np.append(True, (c[1:] != c[:-1]) | (d[1:] != d[:-1]))
        run, gang = np.cumsum(new_c) - 1, np.cumsum(new_h) - 1
        weight = np.bincount(run, 1 + (pos & 1))  # an odd place stands for two or more
        kinds = np.bincount(gang[new_c])
        repeated, mixed = weight[run] > 1, kinds[gang] > 1
        role = np.where(repeated, np.where(mixed & new_c, FULL_AND_SEND, FULL), SEND)
        keep = mixed | (repeated & (np.bincount(run)[run] > 1))
        return h[keep], c[keep], k1[keep], k2[keep], pos[keep] >> 1, role[keep]

    def pack(h, c, k1, k2, pos, role):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, h, c, pos, role.astype(np.int64))], ["k1", "k2", "h", "c", "pos", "role"])

    held = [np.zeros(0, np.int64)] * 6
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        ranges = rows[5] < 0
        if ranges.any():
            h, c, _, k1, k2, pos = (x[ranges] for x in rows)
            yield pack(h, c, k1, k2, pos, np.full(len(h), RANGE))
            rows = [x[~ranges] for x in rows]
        rows = [np.concatenate(x) for x in zip(held, rows)]
        h = rows[0]
        cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
        if (made := work(*(x[:cut] for x in rows))) is not None:
            yield pack(*made)
        held = [x[cut:] for x in rows]
        if len(held[0]) > 100_000:
            # an endless gram: of each context, all rows between the first and the last are repeats for certain
            c, d = held[1:3]
            same = (c[1:] == c[:-1]) & (d[1:] == d[:-1])
            middle = np.zeros(len(c), bool)
            middle[1:-1] = same[:-1] & same[1:]
            if middle.any():
                h, c, _, k1, k2, pos = (x[middle] for x in held)
                yield pack(h, c, k1, k2, pos >> 1, np.full(len(h), FULL))
                held = [x[~middle] for x in held]
    if (made := work(*held)) is not None:
        yield pack(*made)


def _pieces(batches):
    """Texts with their judged anchors; gives ``key, k1, k2, j, at, stop``: a piece (its hash, its range's number and the
    start of its slice), or a range that is repeated for sure (j -1, from ``at`` to ``stop``)."""
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        k1, k2 = (batch.column(i).to_pylist() for i in range(2))
        texts = text_bytes(batch.column(3))
        rows = []
        for i, found in enumerate(batch.column(4)):
            text, spans = texts[i], []
            for h, c, pos, role in zip(*(x.to_pylist() for x in found.values.flatten())):
                if role == RANGE:
                    spans.append((h, c))
                    continue
                if role != SEND:
                    spans.append((max(0, pos - LEFT), min(len(text), pos + RIGHT)))
                if role != FULL:
                    for j in range(RANGES):
                        a = pos - WIDTH * j
                        if a >= 0 and a + LENGTH - WIDTH <= len(text):
                            key = digest(text[a : a + LENGTH - WIDTH], seed=j) - 2**63
                            rows.append((key, k1[i], k2[i], j, a - WIDTH, 0))
            rows += [(k1[i] ^ a, k1[i], k2[i], -1, a, b) for a, b in union(spans) if b - a >= LENGTH]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["key", "k1", "k2", "j", "at", "stop"])


def _shared(batches):
    """Rows come sorted by ``key``; gives the ranges, and the pieces whose key another piece has too."""
    import pyarrow as pa

    def pick(table, before, after):
        key, j = (table.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
        like = np.append(key[1:] == key[:-1], after is not None and key[-1] == after)
        keep = like | np.append(before is not None and key[0] == before, like[:-1]) | (j < 0)
        return table.filter(pa.array(keep))

    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield pick(held, before, batch.column(0)[0].as_py())
            before = held.column(0)[held.num_rows - 1].as_py()
        held = batch
    if held is not None:
        yield pick(held, before, None)


def _slices(batches):
    """Texts with their shared pieces; gives the slices (``width``, ``key``, ``lack``: so many bytes are missing at the left,
    ``k1, k2, at, bytes``), clipped at the text's ends, those of hot pieces in cuts."""
    import pyarrow as pa
    import xxhash

    digest, step = xxhash.xxh3_64_intdigest, NARROWER[WIDTH]

    def pack(rows):
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["width", "key", "lack", "k1", "k2", "at", "bytes"])

    for batch in batches:
        rows, held = [], 0
        for k1, k2, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(3)), batch.column(4)):
            for key, at, hot in zip(*(x.to_pylist() for x in found.values.flatten())):
                for x in range(at, at + WIDTH, step) if hot else [at]:
                    width = step if hot else WIDTH
                    a, b = max(0, x), min(len(text), x + LENGTH + width)
                    if hot:
                        if x + width < 0 or x + LENGTH > len(text):
                            continue  # no string of this cut lies in the text
                        key = digest(text[x + width : x + LENGTH], seed=WIDTH) - 2**63
                    if b - a >= LENGTH:
                        rows.append((width, key, a - x, k1, k2, a, text[a:b]))
                        held += 400
            if held > 1 << 22:
                yield pack(rows)
                rows, held = [], 0
        if rows:
            yield pack(rows)


def _strings(slices: list[bytes], owner: list, at: list[int]) -> tuple[np.ndarray, ...]:
    """Of each 200-byte string of the slices: its slice, its start in the slices laid end to end, and a number for the place
    where it stands."""
    sizes = np.fromiter(map(len, slices), np.int64, len(slices))
    begins = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - LENGTH + 1, 0)
    start = flat_index(begins, count)
    of = np.repeat(np.arange(len(slices)), count)
    number: dict = {}
    text = np.asarray([number.setdefault(o, len(number)) for o in owner], np.int64)
    return of, start, text[of] * (1 << 40) + np.asarray(at, np.int64)[of] + start - begins[of]


def _several(same: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of some rows in order are in a run (``same`` as the row before) with two places or more."""
    run = np.concatenate([[0], np.cumsum(~same)])
    low, high = np.full(run[-1] + 1, np.iinfo(np.int64).max), np.full(run[-1] + 1, -1)
    np.minimum.at(low, run, place)
    np.maximum.at(high, run, place)
    return (low < high)[run]


def repeated_starts(slices: list[bytes], owner: list, at: list[int], middle: list[int], common: int) -> np.ndarray:
    """For each 200-byte string of each slice, one slice after another, whether an equal string starts at another place:
    from the suffix array over the bytes of all slices. ``owner`` is a slice's text, ``at`` its place there; ``common``
    bytes from ``middle`` on are the slice's piece, which all its strings begin before or with. It stands as one symbol,
    and so does what follows it in all slices of the piece alike: no two of them can differ there."""
    of, start, place = _strings(slices, owner, at)
    if len(of) < 2:
        return np.zeros(len(of), bool)
    alike: dict[bytes, list[bytes]] = {}
    for s, m in zip(slices, middle):
        alike.setdefault(s[m : m + common], []).append(s[m + common :])
    symbol = {piece: (256 + k, common + len(os.path.commonprefix(rest))) for k, (piece, rest) in enumerate(alike.items())}
    text: list[int] = []
    base = np.zeros(len(slices), np.int64)
    for i, (s, m) in enumerate(zip(slices, middle)):
        base[i] = len(text)
        text += s[:m]
        sign, length = symbol[s[m : m + common]]
        text.append(sign)
        text += s[m + length :]
        text.append(-1)  # no string crosses it
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, slices), np.int64, len(slices)))])[of]
    number = np.full(len(text), -1)
    number[base[of] + start - first] = np.arange(len(of))
    order = number[np.asarray(suffix_array(text))]
    order = order[order >= 0]  # strings in the order of the suffixes that they begin
    raw = b"".join(slices)
    words = np.ndarray((len(raw) - 7,), np.uint64, raw, strides=(1,))  # the eight bytes from each place on
    column = np.arange(0, LENGTH, 8)
    a = start[order]
    same = np.ones(len(a) - 1, bool)  # whether neighbours have LENGTH bytes in common
    for k in range(0, len(same), 8192):
        some = slice(k, min(k + 8192, len(same)))
        same[some] = (words[a[some, None] + column] == words[a[1:][some, None] + column]).all(axis=1)
    out = np.zeros(len(of), bool)
    out[order] = _several(same, place[order])
    return out


def promising(slices: list[bytes], owner: list, at: list[int]) -> list[tuple[int, int, int]]:
    """``(slice, first, last)``: the slices with a 200-byte string whose hash another place has too, and the first and the
    last such string in them. Equal strings have equal hashes, so no other string can be repeated."""
    of, start, place = _strings(slices, owner, at)
    if not len(of):
        return []
    found = RangeHash(np.frombuffer(b"".join(slices), np.uint8))(start, start + LENGTH)
    order = np.argsort(found, kind="stable")
    again = np.zeros(len(of), bool)
    again[order] = _several(found[order][1:] == found[order][:-1], place[order])
    hit = np.flatnonzero(again)
    if not len(hit):
        return []
    first = np.flatnonzero(np.diff(of[hit], prepend=-1))
    last = np.append(first[1:], len(hit)) - 1
    begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, slices), np.int64, len(slices)))])
    return [(i, x, y) for i, x, y in zip(of[hit[first]].tolist(), (start[hit[first]] - begin[of[hit[first]]]).tolist(), (start[hit[last]] - begin[of[hit[last]]]).tolist())]


def repeated_in(slices: list[bytes], skip: list[int], owner: list, at: list[int], width: int = WIDTH) -> list[tuple]:
    """``(owner, start, stop)``: what the repeated strings of slices that share a piece cover; ``skip`` is what a slice lacks
    at the left of its frame of ``LENGTH + width`` bytes. Divided by longer pieces where they make too long a text."""
    if width and sum(map(len, slices)) > TEXT_BYTES:
        out, step = [], NARROWER[width]
        for a in range(0, width - step + 1, max(step, 1)):
            parts: dict[bytes, list] = {}
            for s, lack, o, x in zip(slices, skip, owner, at):
                low, high = max(a, lack), min(a + LENGTH + step, lack + len(s))  # of the frame
                piece = s[a + step - lack : a + LENGTH - lack] if a + step >= lack else b""
                if len(piece) == LENGTH - step and high - low >= LENGTH:
                    parts.setdefault(piece, []).append((s[low - lack : high - lack], low - a, o, x + low - lack))
            for rows in parts.values():
                if len(rows) > 1:
                    out += repeated_in(*(list(c) for c in zip(*rows)), step)
        return out
    if not width:  # equal strings
        return [(o, x, x + LENGTH) for o, x in zip(owner, at)] if len(set(zip(owner, at))) > 1 else []
    again = repeated_starts(slices, owner, at, [width - lack for lack in skip], LENGTH - width)
    out, k = [], 0
    for s, o, x in zip(slices, owner, at):
        n = max(len(s) - LENGTH + 1, 0)
        edge = np.flatnonzero(np.diff(again[k : k + n], prepend=False, append=False)).tolist()
        out += [(o, x + a, x + b - 1 + LENGTH) for a, b in zip(edge[::2], edge[1::2])]
        k += n
    return out


def _apart(rows: list[tuple], found: dict) -> list[tuple]:
    """One of each set of equal slices; what is in slices that stand at different places is put in ``found``."""
    first: dict[bytes, tuple] = {}
    again: set[bytes] = set()
    for r in rows:
        one = first.setdefault(r[6], r)
        if r[3:6] != one[3:6]:
            again.add(r[6])
    if again:
        for r in rows:
            if r[6] in again:
                found.setdefault(r[3:5], []).append((r[5], r[5] + len(r[6])))
    return list(first.values())


def _compare(batches):
    """Slices come sorted by width and key; gives ``k1, k2, start, stop`` of what is repeated. Pieces are put together up to
    ``TEXT_BYTES``; one that has more is divided."""
    import pyarrow as pa

    found: dict[tuple, list] = {}
    group: list[tuple] = []
    size = 0

    def settle():
        nonlocal group, size
        if len(group) > 1:
            owner = [r[3:5] for r in group]
            left = promising([r[6] for r in group], owner, [r[5] for r in group])
            for o, a, b in repeated_in([group[i][6][a : b + LENGTH] for i, a, b in left], [group[i][2] + a for i, a, _ in left], [owner[i] for i, _, _ in left], [group[i][5] + a for i, a, _ in left], group[0][0]):
                found.setdefault(o, []).append((a, b))
        group, size = [], 0

    def take(rows):
        """All slices of one piece."""
        nonlocal group, size
        rows = _apart(rows, found)
        if len(rows) > 1:
            more = sum(len(r[6]) for r in rows)
            if group and (group[0][0] != rows[0][0] or size + more > TEXT_BYTES):
                settle()
            group += rows
            size += more

    def said():
        flat = [(*o, a, b) for o, spans in found.items() for a, b in union(spans)]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], ["k1", "k2", "start", "stop"])

    held: list[tuple] = []
    for batch in batches:
        for key, rows in itertools.groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: r[:2]):
            if held and held[0][:2] != key:
                take(held)
                held = []
            held += rows
            if len(held) > 20_000:
                held = _apart(held, found)
        if len(found) > 10_000:
            yield said()
    if held:
        take(held)
    settle()
    if found:
        yield said()


def _keys(text):
    """120 bits of a text's MD5, as two longs (never null, so that no join adds a filter to one reader of them only)."""
    digest = F.md5(text.cast("binary"))
    return [F.coalesce(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint"), F.lit(0)).alias(f"k{i + 1}") for i in range(2)]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), *_keys(text))
    judged = cut_texts(docs.select(text.alias("text")), with_text)
    return rows.join(judged, ["k1", "k2"]).drop("k1", "k2").withColumnRenamed("id", id_col)


def cut_texts(texts: DataFrame, with_text: bool, hot: int = HOT) -> DataFrame:
    """``k1, k2`` and the results for each distinct value of ``texts.text``; ``hot`` changes the way, never the result."""
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    distinct = texts.select(*_keys(F.col("text")), "text").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.max("text").alias("text"))
    # all four readers of it take the same columns, so that the texts are shuffled once
    found = arrow_map(distinct, _emit_anchors, "h bigint, c bigint, d bigint, k1 bigint, k2 bigint, pos bigint")
    judged = arrow_map(found.repartition(parts, "h").sortWithinPartitions("h", "c", "d"), _judge, "k1 bigint, k2 bigint, h bigint, c bigint, pos bigint, role bigint")
    per_text = judged.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "pos", "role")).alias("found"))
    pieces = arrow_map(distinct.join(per_text, ["k1", "k2"]).select("k1", "k2", "copies", "text", "found"), _pieces, "key bigint, k1 bigint, k2 bigint, j bigint, at bigint, stop bigint")
    # what has two readers or more is shuffled once: all plans below stand in one query
    shared = arrow_map(pieces.repartition(parts, "key").sortWithinPartitions("key"), _shared, "key bigint, k1 bigint, k2 bigint, j bigint, at bigint, stop bigint")
    sure = shared.where("j < 0").select("k1", "k2", F.col("at").alias("start"), "stop")
    many = shared.where("j >= 0").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("hot"))
    wanted = shared.where("j >= 0").join(many, "key", "left").select("key", "k1", "k2", "at", F.coalesce("hot", F.lit(False)).alias("hot"))
    per_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("key", "at", "hot")).alias("found"))
    slices = arrow_map(distinct.join(per_text, ["k1", "k2"]).select("k1", "k2", "copies", "text", "found"), _slices, "width bigint, key bigint, lack bigint, k1 bigint, k2 bigint, at bigint, bytes binary")
    dealt = slices.repartition(parts, "key").sortWithinPartitions("width", "key")
    runs = sure.unionByName(arrow_map(dealt, _compare, "k1 bigint, k2 bigint, start bigint, stop bigint"))
    runs = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))

    def cut(batches):
        import pyarrow as pa

        names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
        for batch in batches:
            bodies = text_bytes(batch.column(3))
            for a, b in spans_by_size([len(t) for t in bodies], 8 * BLOCK_BYTES):
                out = []
                for copies, body, found in zip(batch.column(2)[a:b].to_pylist(), bodies[a:b], batch.column(4)[a:b].to_pylist()):
                    spans = union((x["start"], x["stop"]) for x in found or [])
                    if copies > 1 and len(body) >= LENGTH:
                        spans = [(0, len(body))]
                    edges = [0, *(x for s in spans for x in s), len(body)]
                    kept = b"".join(body[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    out.append((len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) + ((kept.decode("utf-8", "ignore"),) if with_text else ()))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)

    schema = "k1 bigint, k2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text
    return arrow_map(distinct.join(runs, ["k1", "k2"], "left").select("k1", "k2", "copies", "text", "runs"), cut, schema)


def cut_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, each text without what is repeated."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    body = f"c{names.index(text_col)}"
    text = F.coalesce(F.col(body), F.lit(""))
    kept = cut_texts(plain.select(text.alias("text")), True).select("k1", "k2", "kept_text")
    # the texts themselves stay behind; what is left of them comes from the other side
    out = plain.withColumns(dict(zip(("k1", "k2"), _keys(text)))).withColumn(body, F.col(body).isNull()).join(kept, ["k1", "k2"])
    return out.select(*(F.when(~F.col(body), F.col("kept_text")).alias(body) if c == body else c for c in plain.columns)).toDF(*names)
