"""Groups of near copies: prefix keys find the pairs, SimHash fingerprints thin them, exact Jaccard decides.

A text is the set of its distinct five-word shingles (XXH64 hashes). Sets are put in one order for all texts. Of two
sets alike by s (Jaccard) or more, the first n - ceil(s n) + 1 shingles of each (n: its size) have one in common, in
whatever order: these are the keys, and no pair is lost for want of one. Shingles that a sample of the texts shows
often come last in the order, so that common lines seldom are keys; the sample changes the cost, never the result.

Within a key, sizes, places and fingerprints of 128 bits tell which pairs may be alike. Sizes differ by a factor of s at
most. Two sets whose first common key has i and j shingles before it have min(n - i, m - j) in common at most; pairs that
fall short at their first common key aren't alike, and a pair that is alike is met there. Two sets alike by s have a cosine of 2s/(1+s) or more, hence bits that differ with probability acos(2s/(1+s))/pi at
most, and the limit lies ``SIGMAS`` standard deviations above that. Candidates that also pass on 2048 bits are then
decided by the exact Jaccard of their two shingle sets, which are made again from the texts for the rows that have a
candidate at all.

Links are found in two rounds. At first the rows of a key are tied to a middle one of them, and each row keeps the
nearest such tie of all its keys. These are decided and make components. Then, within each key, every row outside the
largest component is compared with all rows of other components, and every candidate is decided: no pair between two
components goes unseen, whatever a run's size.

With ``simhash_too`` the links of SimHash near-dedup (``simhash.links``: Golay keys, all fingerprints of 64 bits at four
differing bits or fewer) are links as well. Neither kind has the other's: shingles that a text repeats count in its
fingerprint, and chance moves few or many bits at one similarity.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm import simhash
from strandwork.llm._common import Scratch, arrow_map, lower_bytes, materialize, mix, spans_by_size, text_bytes
from strandwork.llm.components import components
from strandwork.llm.simhash import BLOCK_BYTES, SEED

CARRIED, WIDE = 2, 32  # lanes that go with the keys, and lanes of the fingerprints that candidates are tried by
SIGMAS = 6  # above what is expected: a pair of the least similarity is passed over once in 10**9
#: One text in so many is looked at for common shingles; one seen so often there is common; so many are told apart.
SAMPLE, COMMON, MOST_COMMON = 64, 8, 1 << 16
SLOTS = 1 << 26  # bits of the table that holds back rows without a candidate


def candidate_bits(similarity: float, lanes: int = CARRIED) -> int:
    """Bits that a candidate pair may differ in: ``SIGMAS`` standard deviations above what is expected of that similarity."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * lanes * share + SIGMAS * math.sqrt(64 * lanes * share * (1 - share)))


def shingles_of(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; fewer words than ``words`` make one shingle."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = []
    for text in texts:
        parts = lower_bytes(text).split()  # bytes.split() splits at exactly x20 and x09-x0D
        hashes: list[int] = []
        if len(parts) >= words:
            line = b" ".join(parts)
            stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
            begins = np.append(0, stops[:-1])
            hashes = [digest(line[a : b - 1], SEED) for a, b in zip(begins.tolist(), stops[words - 1 :].tolist())]
        elif parts:
            hashes = [digest(b" ".join(parts), SEED)]
        out.append(np.unique(np.asarray(hashes, np.uint64)))
    return out


def _prints(sets: list[np.ndarray], lanes: int) -> np.ndarray:
    """A row of ``lanes`` longs for each set: a bit is set if over half of the shingles' hashes have it."""
    out = np.zeros((len(sets), lanes), np.uint64)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(n)
    if len(full):
        lane = np.concatenate(sets)
        first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        for k in range(lanes):
            bits = np.unpackbits(lane.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
            out[full, k] = np.packbits(2 * ones > n[full, None], axis=1).view(">u8").ravel()
            lane = mix(lane + np.uint64(0x9E3779B97F4A7C15))
    return out


def prefix_of(shingles: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The keys of a set: its first shingles, those in ``common`` (ascending) after all others."""
    n = len(shingles)
    if not n:
        return shingles
    often = np.zeros(n, bool)
    if len(common):
        often = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
    return np.concatenate([shingles[~often], shingles[often]])[: n - math.ceil(similarity * n - 1e-9) + 1]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that each of ``x`` and each of ``y`` (n x lanes) differ in."""
    out = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]).astype(np.int16)
    for k in range(1, x.shape[1]):
        out += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    return out


def _near(fp: np.ndarray, n: np.ndarray, at: np.ndarray, limit: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First candidates within a run of equal keys: row numbers, the middle row's number for each, the bits between them;
    and the rows that have any candidate in the run, as far as one block of comparisons tells (all rows otherwise)."""
    bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(len(fp), -1), axis=1)
    middle = np.packbits(2 * bits.sum(axis=0) > len(fp)).view(">u8").astype(np.uint64)
    pivot = int(_apart(middle[None, :], fp)[0].argmin())
    apart = _apart(fp[pivot : pivot + 1], fp)[0]
    good = (apart <= limit) & _may_fit(n[pivot], at[pivot], n, at, similarity)
    good[pivot] = False
    tied = np.flatnonzero(good)
    if len(fp) <= 1024:
        every = (_apart(fp, fp) <= limit) & _may_fit(n[:, None], at[:, None], n, at, similarity)
        some = np.flatnonzero(every.sum(axis=1) > 1)
    else:
        some = np.arange(len(fp))
    return tied, np.full(len(tied), pivot), apart[tied], some


def _may_fit(n, i, m, j, similarity: float):
    """Whether sets of n and m shingles can be alike if what they have in common begins after i and j others."""
    most = np.minimum(n - i, m - j)
    return (1 + similarity) * most >= similarity * (n + m) - 1e-6


def _between(fp: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, limit: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All candidates within a run between different components, as row numbers."""
    _, of, size = np.unique(root, return_inverse=True, return_counts=True)
    todo = np.flatnonzero(of != size.argmax())  # a pair has a row outside the largest one
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 20) // len(fp))
    for a in range(0, len(todo), step):
        mine = todo[a : a + step]
        i, j = np.nonzero((_apart(fp[mine], fp) <= limit) & (root[mine][:, None] != root[None, :]) & _may_fit(n[mine][:, None], at[mine][:, None], n, at, similarity))
        src.append(mine[i])
        dst.append(j)
    return np.concatenate(src), np.concatenate(dst)


def _candidates(limit: int, similarity: float, rooted: bool = False):
    """Rows come sorted by key (``key, row, n, pos, f0, f1``, and ``root`` in the second round); a run may cross batches.

    First round: ``src, dst, bits``, each row's tie to the middle of its run, and ``src, null, null`` for other rows with a
    candidate. Second round: candidates between components, ``src`` the smaller."""

    def work(key, row, n, pos, *lanes):
        import pyarrow as pa

        lanes, root = (lanes[:-1], lanes[-1]) if rooted else (lanes, row)
        fp = np.stack([x.view(np.uint64) for x in lanes], 1)
        edge = np.flatnonzero(np.diff(key)) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        length = last - first
        two = first[length == 2]
        apart = np.bitwise_count(fp[two] ^ fp[two + 1]).sum(axis=1)
        near = (apart <= limit) & (root[two] != root[two + 1]) & _may_fit(n[two], pos[two], n[two + 1], pos[two + 1], similarity)
        two, apart = two[near], apart[near]
        src, dst, bits, alone = [row[two], row[two + 1]], [row[two + 1], row[two]], [apart, apart], []
        for a, b in zip(first[length > 2].tolist(), last[length > 2].tolist()):
            mine = row[a:b]
            if rooted:
                s, d = _between(fp[a:b], n[a:b], pos[a:b], root[a:b], limit, similarity)
                bits.append(np.zeros(len(s), np.int64))
            else:
                s, d, x, some = _near(fp[a:b], n[a:b], pos[a:b], limit, similarity)
                bits.append(x)
                alone.append(mine[some])
            src.append(mine[s])
            dst.append(mine[d])
        s, d, x = np.concatenate(src), np.concatenate(dst), np.concatenate(bits).astype(np.int32)
        if rooted:
            pairs = np.unique(np.stack([np.minimum(s, d), np.maximum(s, d)], 1)[s != d], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["src", "dst"])
        # of a row's ties the nearest, of equally near ones the one with the smallest number
        order = np.lexsort((d, x, s))
        s, d, x = s[order], d[order], x[order]
        best = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
        s, d, x = s[best], d[best], x[best]
        rest = np.setdiff1d(np.concatenate(alone) if alone else s[:0], s)
        none = np.append(np.zeros(len(s), bool), np.ones(len(rest), bool))
        zero = np.zeros(len(rest), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.append(s, rest)), pa.array(np.append(d, zero), mask=none), pa.array(np.append(x, zero).astype(np.int32), mask=none)], ["src", "dst", "bits"])

    def run(batches):
        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if cut:
                yield work(*(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
        if held is not None and len(held[0]):
            yield work(*held)

    return run


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that a sample of the distinct texts (``text``) shows often, ascending; ``MOST_COMMON`` at most."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch.column(0))
            for a, b in spans_by_size([len(t) for t in texts], BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles_of(texts[a:b], words)).view(np.int64))], ["h"])

    some = docs.where(F.crc32(F.col("text").cast("binary")) % SAMPLE == 0).distinct()
    found = arrow_map(some, run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.asarray([r[0] for r in found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()], np.int64).view(np.uint64))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two longs."""
    import xxhash

    return np.frombuffer(b"".join(xxhash.xxh128_digest(x.tobytes()) for x in sets), "<i8").reshape(-1, 2)


def _listed(sets: list[np.ndarray]):
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))


def describe(docs: DataFrame, words: int, similarity: float, common: np.ndarray, simhash_too: bool = False) -> DataFrame:
    """For every row of ``docs`` (``id, text``): ``id``, a digest of its shingle set (``s0, s1``), the set's size ``n``,
    fingerprint lanes and keys; ``fp``, the fingerprint of SimHash near-dedup, if it is asked for. Nothing is shuffled."""
    kind = docs.schema["id"].dataType.simpleString()
    lanes = [f"f{k}" for k in range(CARRIED)]
    handed = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in spans_by_size([len(t) for t in texts], BLOCK_BYTES):
                sets = shingles_of(texts[a:b], words)
                made = np.concatenate([_digests(sets), _prints(sets, CARRIED).view(np.int64)], axis=1)
                columns = [pa.array(np.ascontiguousarray(made[:, k])) for k in range(made.shape[1])]
                keys = _listed([prefix_of(x, similarity, handed.value) for x in sets])
                prints = [pa.array(simhash.fingerprints_of(texts[a:b]).view(np.int64))] if simhash_too else []
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *columns, pa.array([len(x) for x in sets], pa.int32()), keys, *prints], ["id", "s0", "s1", *lanes, "n", "keys"] + ["fp"] * simhash_too)

    schema = f"id {kind}, s0 bigint, s1 bigint, " + ", ".join(f"{c} bigint" for c in lanes) + ", n int, keys array<bigint>" + ", fp bigint" * simhash_too
    return arrow_map(docs, run, schema)


def _sets_of(docs: DataFrame, some: DataFrame, words: int) -> DataFrame:
    """``row, shingles, sketch`` (``WIDE`` lanes) of the nodes in ``some`` (``row, s0, s1``), made from the texts. A table of ``SLOTS`` bits holds
    back most texts of other nodes, and each task sends a set once; the join decides."""
    slot = F.pmod(F.col("s0"), F.lit(SLOTS))
    words_ = some.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(SLOTS >> 6, np.uint64)
    table[words_.column("word").to_numpy()] = words_.column("bits").to_numpy().view(np.uint64)
    handed = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        import pyarrow as pa

        sent: set[tuple[int, int]] = set()
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for a, b in spans_by_size([len(t) for t in texts], BLOCK_BYTES):
                sets = shingles_of(texts[a:b], words)
                made = _digests(sets)
                at = made[:, 0] % SLOTS
                good = np.flatnonzero(handed.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
                fresh = [i for i in good.tolist() if tuple(made[i].tolist()) not in sent]
                if len(sent) > 100_000:  # a saving only
                    sent.clear()
                sent.update(tuple(made[i].tolist()) for i in fresh)
                if fresh:
                    mine = [sets[i] for i in fresh]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(made[fresh, k])) for k in (0, 1)] + [_listed(mine), _listed(list(_prints(mine, WIDE)))], ["s0", "s1", "shingles", "sketch"])

    found = arrow_map(docs.select("text"), run, "s0 bigint, s1 bigint, shingles array<bigint>, sketch array<bigint>")
    return found.join(some, ["s0", "s1"]).groupBy("row").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of ``pairs`` (``src, dst``), those whose shingle sets (``row, shingles, sketch``) are alike by ``similarity`` or more.
    Sketches travel first, so that few sets do."""

    def with_both(column: str):
        a = sets.select(F.col("row").alias("src"), F.col(column).alias("a"))
        b = sets.select(F.col("row").alias("dst"), F.col(column).alias("b"))
        return lambda some: some.join(a, "src").join(b, "dst")

    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    tried = with_both("sketch")(pairs).where(apart <= candidate_bits(similarity, WIDE)).select("src", "dst")
    both = with_both("shingles")(tried).withColumn("same", F.size(F.array_intersect("a", "b")))
    return both.where(F.col("same") / (F.size("a") + F.size("b") - F.col("same")) >= F.lit(float(similarity))).select("src", "dst")


def _print_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst``: the links of SimHash near-dedup between nodes. Each fingerprint's first node stands for it, its other
    nodes are tied to that one."""
    at = rows.select("fp", "s0", "s1").distinct().join(nodes.select("s0", "s1", "row"), ["s0", "s1"]).select("fp", "row")
    first = at.groupBy("fp").agg(F.min("row").alias("first"))
    equal = at.join(first, "fp").where("row <> first").select(F.col("row").alias("src"), F.col("first").alias("dst"))
    a, b = (first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")) for end in ("src", "dst"))
    near = simhash.links(rows).join(a, "src").join(b, "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    return equal.unionByName(near)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, simhash_too: bool = False) -> DataFrame:
    """``s0, s1, low`` for each distinct shingle set (``s0, s1``: its digest): ``low`` is the smallest id of its group.

    Rows with equal sets are one group (texts without words too), with ``simhash_too`` rows that SimHash near-dedup links
    as well; a group whose ids are all null has a null ``low``; an empty table has no groups.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lanes = [f"f{k}" for k in range(CARRIED)]
    common = _common(narrow.select("text"), words)
    keep = Scratch(docs.sparkSession)
    rows = keep(describe(narrow, words, similarity, common, simhash_too).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    nodes = keep(rows.groupBy("s0", "s1").agg(F.min("id").alias("own"), F.min("row").alias("row")), "near-nodes")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    limit = candidate_bits(similarity)

    def candidates(some: DataFrame, schema: str, *more: str) -> DataFrame:
        keyed = rows.select("row", "n", *lanes, "keys").join(some, "row").select(F.posexplode("keys").alias("pos", "key"), "row", "n", *lanes, *more)
        dealt = keyed.repartition(parts, "key").sortWithinPartitions("key", *lanes, "row").select("key", "row", "n", "pos", *lanes, *more)
        return arrow_map(dealt, _candidates(limit, similarity, bool(more)), schema)

    nearest = F.min(F.when(F.col("dst").isNotNull(), F.struct("bits", "dst"))).alias("x")
    ties = keep(candidates(nodes.select("row"), "src bigint, dst bigint, bits int").groupBy("src").agg(nearest).select("src", "x.dst"), "near-ties")
    # rows with a candidate: those in a tie, on either side, and those that the middle of their run is too far from
    some = ties.select(F.col("src").alias("row")).union(ties.where("dst is not null").select("dst")).distinct()
    sets = keep(_sets_of(narrow, nodes.select("row", "s0", "s1").join(some, "row"), words), "near-sets")
    pairs = ties.where("dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    links = _alike(pairs, sets, similarity)
    links = keep(links.unionByName(_print_links(rows, nodes)) if simhash_too else links, "near-links")
    root = keep(components(links), "near-roots")
    labels = sets.select("row").join(root, F.col("row") == F.col("node"), "left").select("row", F.coalesce("root", "row").alias("root"))
    others = keep(candidates(labels, "src bigint, dst bigint", "root").distinct().join(pairs, ["src", "dst"], "left_anti"), "near-others")
    root = components(links.unionByName(_alike(others, sets, similarity)))
    rooted = nodes.join(root, nodes["row"] == root["node"], "left").select("s0", "s1", "own", F.coalesce("root", "row").alias("root"))
    best = rooted.groupBy("root").agg(F.min("own").alias("low"))
    out = materialize(rooted.join(best, "root").select("s0", "s1", "low"), "near-groups")
    keep.drop()
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, simhash_too: bool = False) -> DataFrame:
    """The rows of ``docs``, with all columns, of which each group keeps one: a row with the smallest id.

    Which rows go is decided on ids and shingle sets alone; the ids that stay meet the rows in one join. Ids are meant to
    tell rows apart: where they repeat, all rows with an id that stays do, and rows whose id is null are kept.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key = f"c{names.index(id_col)}"
    kept = groups(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", words, similarity, simhash_too)
    kept = materialize(kept.where("low is not null").select(F.col("low").alias("kept")).distinct(), "near-kept")
    stay = plain.join(kept, plain[key] == kept["kept"], "left_semi")
    return stay.unionByName(plain.where(F.col(key).isNull())).toDF(*names)
