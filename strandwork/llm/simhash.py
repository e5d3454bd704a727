"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints are joined exactly at ``MAX_BITS`` (4) differing bits or fewer. The binary Golay code of length 23 is
perfect: each 23-bit word lies within 3 bits of one codeword, and two words at most 2 bits apart share a codeword
within 4 bits of both (decode the word in the middle). A word has one or six codewords that near, so one or six keys.

The 64 bits are cut in four segments of 16. Of two linked fingerprints

* either some segment is the same: the other 48 bits, in two halves of 24, hold 4 errors at most, hence one half
  holds 2 at most. Key: the segment, and a Golay index of (23 bits of) the half;
* or all four segments have one error each: bits 0-22 and bits 23-45 hold 2 at most. Key: a Golay index of each,
  and the segments' parities, which all differ, so that parities and their complement count as one.

Every key of every distinct fingerprint is dealt out by key; within a key, all pairs that aren't tied together yet
are compared in numpy blocks, and only a spanning set of links is emitted, so that a large group of near copies
costs links in proportion to its size. Components come from ``components``.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm._common import arrow_map, lower_bytes, spans_by_size, text_bytes
from strandwork.llm.components import components

MAX_BITS = 4
SEED = 42
BLOCK_BYTES = 1 << 20
_BITS = 23
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, lowest degree last


def fingerprints_of(texts: list[bytes], words: int = 4) -> np.ndarray:
    """SimHash of each text: a bit is set if over half of the XXH64 hashes of its word shingles have it."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = []
    for text in texts:
        parts = lower_bytes(text).split()  # bytes.split() splits at exactly x20 and x09-x0D
        before = len(hashes)
        if len(parts) >= words:
            line = b" ".join(parts)
            at = 0
            begins = []
            for part in parts:
                begins.append(at)
                at += len(part) + 1
            stops = begins[words:]
            stops.append(at)
            hashes += [digest(line[a : b - 1], SEED) for a, b in zip(begins, stops)]
        elif parts:
            hashes.append(digest(b" ".join(parts), SEED))
        counts.append(len(hashes) - before)
    out = np.zeros(len(texts), np.uint64)
    n = np.asarray(counts, np.int64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(np.asarray(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > n[full, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``id_col, fp`` (the fingerprint as a signed long) for every row of ``docs``. Nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in spans_by_size([len(t) for t in texts], BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(fingerprints_of(texts[a:b], words).view(np.int64))], ["id", "fp"])

    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


# --- the code -----------------------------------------------------------------------------------------


def _syndrome(x: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit polynomials by the generator."""
    x = x.astype(np.uint32)
    for bit in range(_BITS - 1, 10, -1):
        x = x ^ (((x >> np.uint32(bit)) & np.uint32(1)) * np.uint32(_GENERATOR << (bit - 11)))
    return x


class Golay:
    """For each syndrome, the errors (of weight 4 at most) that lead to a codeword: one pattern, or six."""

    _made = None

    def __new__(cls):
        if cls._made is None:
            cls._made = super().__new__(cls)
            cls._made._fill()
        return cls._made

    def _fill(self):
        near = [[] for _ in range(2048)]
        for weight in range(5):
            masks = np.asarray([sum(1 << i for i in c) for c in itertools.combinations(range(_BITS), weight)], np.uint32)
            for s, m in zip(_syndrome(masks).tolist(), masks.tolist()):
                near[s].append(m)
        self.counts = np.asarray([len(x) for x in near])
        self.errors = np.zeros((2048, 6), np.uint32)
        for s, found in enumerate(near):
            self.errors[s, : len(found)] = found

    def indices(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Six codeword indices (12 bits) a word, and which of them are real."""
        s = _syndrome(x)
        words = (x.astype(np.uint32)[:, None] ^ self.errors[s]) >> np.uint32(11)
        return words.astype(np.uint64), np.arange(6)[None, :] < self.counts[s][:, None]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit keys: two fingerprints at 4 differing bits or fewer share a key at least."""
    code, u = Golay(), np.uint64
    rows, keys = [], []
    low = u((1 << _BITS) - 1)
    number = np.arange(len(fp))
    segments = [(fp >> u(16 * i)) & u(0xFFFF) for i in range(4)]
    for i in range(4):
        a, b, c = (segments[j] for j in range(4) if j != i)
        rest = a | (b << u(16)) | (c << u(32))
        for half in range(2):
            index, real = code.indices((rest >> u(24 * half)) & low)
            key = (u(2 * i + half) << u(32)) | (segments[i][:, None] << u(12)) | index
            rows.append(np.broadcast_to(number[:, None], real.shape)[real])
            keys.append(key[real])
    parity = sum(((np.bitwise_count(s) & 1).astype(np.uint64) << u(i)) for i, s in enumerate(segments))
    parity = np.minimum(parity, u(15) - parity)
    (left, real_left), (right, real_right) = code.indices(fp & low), code.indices((fp >> u(_BITS)) & low)
    real = real_left[:, :, None] & real_right[:, None, :]
    key = (u(8) << u(32)) | (parity[:, None, None] << u(24)) | (left[:, :, None] << u(12)) | right[:, None, :]
    rows.append(np.broadcast_to(number[:, None, None], real.shape)[real])
    keys.append(key[real])
    return np.concatenate(rows), np.concatenate(keys)


def spanning_links(fp: np.ndarray, max_bits: int = MAX_BITS, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links (as row numbers, towards the first of each component) that tie together what links tie together.

    Every fingerprint outside the largest component is compared with all others, so no link between two components
    is lost, while a group whose members lie close together needs a few blocks only.
    """
    n = len(fp)
    root = np.arange(n)
    done = np.zeros(n, bool)
    while True:
        size = np.bincount(root, minlength=n)
        todo = np.flatnonzero(~done & (root != size.argmax()) if done.any() else ~done)[:block]
        if not len(todo):
            break
        done[todo] = True
        for i in todo:
            near = root[np.bitwise_count(fp ^ fp[i]) <= max_bits]
            low = near.min()
            merged = np.unique(near)
            if len(merged) > 1:
                root[np.isin(root, merged)] = low
    tied = np.flatnonzero(root != np.arange(n))
    return tied, root[tied]


def _links(batches):
    """Within runs of equal keys (rows come sorted by key), the spanning links; a run may cross batches."""
    import pyarrow as pa

    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sent: set[tuple[int, int]] = set()

    def work(key, fp):
        edge = np.flatnonzero(np.diff(key)) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        length = last - first
        out = []
        # pairs are the bulk: compare them all at once
        two = first[length == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS]
        out.append(np.stack([fp[near], fp[near + 1]], 1))
        for a, b in zip(first[length > 2].tolist(), last[length > 2].tolist()):
            x = fp[a:b]
            if b - a <= 24:
                i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x) <= MAX_BITS, 1))
                if len(i) > 2 * (b - a):
                    i, j = spanning_links(x)
            else:
                i, j = spanning_links(x)
            if len(i):
                out.append(np.stack([x[i], x[j]], 1))
        pairs = np.unique(np.sort(np.concatenate(out), 1), axis=0).view(np.int64)
        fresh = [p for p in map(tuple, pairs.tolist()) if p not in sent]
        if len(sent) < 500_000:  # a saving only: repeated links are dropped later as well
            sent.update(fresh)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in fresh], pa.int64()) for k in (0, 1)], ["src", "dst"])

    for batch in batches:
        key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield work(key[:cut], fp[:cut])
        held_key, held_fp = key[cut:], fp[cut:]
    if len(held_key):
        yield work(held_key, held_fp)


def _emit_keys(batches):
    import pyarrow as pa

    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False)
        for a in range(0, len(every), 4096):
            fp = every[a : a + 4096]
            rows, keys = keys_of(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[rows])], ["key", "fp"])


def links(prints: DataFrame) -> DataFrame:
    """``src, dst``: links between distinct values of ``prints.fp``, enough of them to give every component whole."""
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # a fingerprint makes up to 84 keys, so the few bytes of all fingerprints are dealt to all tasks first
    distinct = prints.select("fp").where("fp is not null").distinct().repartition(n, "fp")
    keyed = arrow_map(distinct, _emit_keys, "key bigint, fp bigint")
    return arrow_map(keyed.repartition(n, "key").sortWithinPartitions("key"), _links, "src bigint, dst bigint").distinct()


def classes(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``prints`` (``id_col, fp``, written down by the caller) with ``component_id``: the smallest id of the class.

    Rows with equal fingerprints are in one class, ids may repeat, and a class whose ids are all null has a null id.
    """
    label = components(links(prints)).select(F.col("node").alias("fp"), "root")
    low = prints.groupBy("fp").agg(F.min(id_col).alias("low"))
    rooted = low.join(label, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    best = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(best, "root").select("fp", "component_id")
    return prints.join(named, "fp", "left")
