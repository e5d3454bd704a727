"""Words of sequences as numbers, in Arrow batches: what the k-mer operators count where the rows are.

A task holds a piece of ``PIECE`` symbols (one longer text is a piece of its own) and one table of counts; it sends a row
for each word it has seen. Words with symbols outside the alphabet are counted as strings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Symbols to a piece, entries of a table of all words of a length, and of a table of the words that were seen.
PIECE, DENSE, SEEN = 1 << 18, 1 << 20, 1 << 17
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of ``BATCH_BYTES`` at most."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def cores(df: DataFrame) -> int:
    """Partitions that keep all cores busy: a small file with few row groups is few tasks otherwise."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def summed(rows: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """``keys, w``: equal rows as one, with the sum of their weights, dealt to all cores; for what is read several times."""
    equal = rows.groupBy(*keys).agg(F.sum(weight).alias("w"))
    return equal.repartition(cores(rows), F.xxhash64(*keys))


def once(df: DataFrame, *keys: Column) -> bool:
    """Whether no combination of keys has several rows. Reads the keys only."""
    return df.groupBy(*(k.alias(f"__{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def coded(texts: list[str], alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in the alphabet of all symbols of some texts, one text after another (-1: not in it), and the texts' lengths."""
    whole = "".join(texts)
    try:
        points = np.frombuffer(whole.encode("ascii"), np.uint8)
    except UnicodeEncodeError:
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.full(max(max(map(ord, alphabet)) + 2, 128), -1, np.int8)
    table[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    at = points if points.dtype == np.uint8 else np.minimum(points, len(table) - 1)
    return table[at], np.fromiter(map(len, texts), np.int64, len(texts))


def pieces(lengths: np.ndarray, most: int | None = None):
    """Slices of rows with at most so many symbols in all; a longer row is alone."""
    most = PIECE if most is None else most
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
        yield slice(first, last)
        first = last


def words_at(codes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the word that starts at each symbol but the last ``k - 1``, and whether all its symbols are known."""
    n = max(len(codes) - k + 1, 0)
    word, known = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        part = codes[j : j + n]
        word = word * m + part
        known &= part >= 0
    return word, known


def starts(lengths: np.ndarray, k: int) -> np.ndarray:
    """Where the windows of each text start among all symbols."""
    count = np.maximum(lengths - k + 1, 0)
    shift = np.cumsum(lengths) - lengths - (np.cumsum(count) - count)
    return np.repeat(shift, count) + np.arange(int(count.sum()))


def spelled(numbers: np.ndarray, k: int, alphabet: str) -> list[str]:
    m = len(alphabet)
    points = np.asarray([ord(c) for c in alphabet], np.uint32)
    out = np.empty((len(numbers), k), np.uint32)
    for j in reversed(range(k)):
        numbers, digit = np.divmod(numbers, m)
        out[:, j] = points[digit]
    text = out.tobytes().decode("utf-32-le")
    return [text[i : i + k] for i in range(0, len(text), k)]


class Tally:
    """How many units (sequences, or rows of several with one id) hold each word, by group; ``rows`` empties it."""

    def __init__(self, k: int, groups: int, alphabet: str):
        self.k, self.groups, self.alphabet, self.m = k, groups, alphabet, len(alphabet)
        self.size = self.m**k if self.m**k <= DENSE else 0
        self.at_once = DENSE // self.size if self.size else 0
        self.stamp = np.empty(self.at_once * self.size, np.int32)
        self._empty()

    def _empty(self) -> None:
        self.dense = np.zeros((self.groups, self.size), np.int64)
        self.seen = np.zeros(self.size, bool)
        self.sparse: dict = {}
        self.odd: dict = {}

    def add(self, texts: list[str], unit: np.ndarray, group: np.ndarray) -> None:
        """Texts of one piece, equal units side by side; ``group`` -1 counts nowhere."""
        codes, lengths = coded(texts, self.alphabet)
        at = starts(lengths, self.k)
        row = np.repeat(np.arange(len(texts)), np.maximum(lengths - self.k + 1, 0))
        word, known = words_at(codes, self.k, self.m)
        if not len(at):
            return
        word, good = word[at], known[at]
        if not good.all():
            self._odd(texts, lengths, row, np.flatnonzero(~good), unit, group)
            word, row = word[good], row[good]
        own = unit[row]
        if not self.size:
            order = np.lexsort((word, own))
            word, own, row = word[order], own[order], row[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (own[1:] != own[:-1])
            for g in range(-1, self.groups):
                for w, n in zip(*(x.tolist() for x in np.unique(word[new][group[row[new]] == g], return_counts=True))):
                    self._more(self.sparse, w, g, n)
            return
        if not len(own):
            return
        stamp = self.stamp
        cuts = np.searchsorted(own, np.arange(own[0], own[-1] + self.at_once + 1, self.at_once))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            cell = (own[a:b] - own[a]) * self.size + word[a:b]
            place = np.arange(b - a, dtype=np.int32)
            stamp[cell] = place
            only = np.flatnonzero(stamp[cell] == place) + a  # one of each word of a unit, whichever was written last
            self.seen[word[only]] = True
            mine = group[row[only]]
            for g in range(self.groups):
                self.dense[g] += np.bincount(word[only[mine == g]], minlength=self.size)

    def _more(self, table: dict, key, g: int, n: int) -> None:
        cell = table.setdefault(key, [0] * self.groups)
        if g >= 0:
            cell[g] += n

    def _odd(self, texts, lengths, row, at, unit, group) -> None:
        first = np.cumsum(np.maximum(lengths - self.k + 1, 0)) - np.maximum(lengths - self.k + 1, 0)
        held = {(unit[r], group[r], texts[r][i : i + self.k]) for r, i in zip(row[at].tolist(), (at - first[row[at]]).tolist())}
        for _, g, w in held:
            self._more(self.odd, w, int(g), 1)

    def full(self) -> bool:
        return len(self.sparse) + len(self.odd) > SEEN

    def rows(self):
        import pyarrow as pa

        at = np.flatnonzero(self.seen)
        more = np.fromiter(self.sparse, np.int64, len(self.sparse))
        names = spelled(np.concatenate([at, more]), self.k, self.alphabet) + list(self.odd)
        counts = [np.concatenate([self.dense[g][at], np.asarray([c[g] for t in (self.sparse, self.odd) for c in t.values()], np.int64)]) for g in range(self.groups)]
        self._empty()
        for a in range(0, len(names), 10000):
            yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 10000], pa.string()), *(pa.array(c[a : a + 10000]) for c in counts)], ["kmer", *(f"n{g}" for g in range(len(counts)))])


def holders(df: DataFrame, seq: str, k: int, id_col: Column, group: Column | None = None, groups: int = 1, alphabet: str = "ACGT") -> DataFrame:
    """``kmer, n0, n1, ...``: in how many sequences of each group every word occurs, rows with one id in a group being one
    sequence (null ids count nowhere, but their words are listed).

    Where ids don't repeat, each row is read where it is and nothing but counts is shuffled. Where they do, the texts of an
    id are brought together and sorted by it.
    """
    g = F.coalesce(group, F.lit(-1)) if group is not None else F.lit(0)
    rows = df.select(id_col.alias("id"), F.when(id_col.isNull(), -1).otherwise(g).cast("int").alias("g"), F.col(seq).alias("seq")).where("seq is not null")
    apart = once(rows.where("id is not null"), F.col("id"), F.col("g"))
    if apart:
        numbered = rows.select("g", "seq", F.lit(False).alias("more"))
    else:
        order = Window.partitionBy("id", "g").orderBy("id")
        numbered = rows.select("g", "seq", ((F.row_number().over(order) > 1) & (F.col("g") >= 0)).alias("more"))

    def run(batches):
        tally = Tally(k, groups, alphabet)
        held: list = []  # rows of the last unit, which the next batch may continue
        for batch in batches:
            new = [list(x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            if not apart:
                cut = max((i for i, r in enumerate(new) if not r[2]), default=-1)
                if cut < 0:
                    held += new
                    continue
                new, held = held + new[:cut], new[cut:]
            yield from _tallied(tally, new)
        yield from _tallied(tally, held)
        yield from tally.rows()

    found = arrow_map(numbered, run, "kmer string, " + ", ".join(f"n{i} bigint" for i in range(groups)))
    return found.groupBy("kmer").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(groups)))


def _tallied(tally: Tally, rows: list):
    """Rows (group, text, whether the unit goes on) counted piece by piece; a unit isn't divided."""
    if not rows:
        return
    unit = np.cumsum([not r[2] for r in rows])
    lengths = np.bincount(unit - unit[0], [len(r[1]) for r in rows]).astype(np.int64)
    first = np.searchsorted(unit - unit[0], np.arange(len(lengths) + 1))
    group = np.asarray([r[0] for r in rows])
    for s in pieces(lengths):
        a, b = int(first[s.start]), int(first[s.stop])
        tally.add([r[1] for r in rows[a:b]], unit[a:b], group[a:b])
        if tally.full():
            yield from tally.rows()


def row_words(df: DataFrame, seq: str, k: int, keep: list[str], alphabet: str = "ACGT") -> DataFrame:
    """``keep``, ``n`` (windows) and ``words``: the different words of each row, as a bitmap of longs over all words of the
    length (so of a few symbols and lengths only); null rows and texts without a window are left out. Words with other
    symbols come as strings in ``odd``."""
    m = len(alphabet)
    longs = -(-(m**k) // 64)
    if longs > 1024:
        raise ValueError("too many words of that length for a bitmap")
    rows = df.where(F.length(seq) >= k).select(*keep, F.col(seq).alias("__seq"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            for s in pieces(sizes, min(PIECE, 1 << 16)):
                some = texts[s]
                codes, lengths = coded(some, alphabet)
                word, known = words_at(codes, k, m)
                at = starts(lengths, k)
                row = np.repeat(np.arange(len(some)), lengths - k + 1)
                word, good = word[at], known[at]
                bits = np.zeros((len(some), longs * 64), bool)
                bits[row[good], word[good]] = True
                packed = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                odd: list = [None] * len(some)
                if not good.all():
                    first = np.cumsum(lengths - k + 1) - (lengths - k + 1)
                    bad = np.flatnonzero(~good)
                    for r, i in zip(row[bad].tolist(), (bad - first[row[bad]]).tolist()):
                        odd[r] = odd[r] or set()
                        odd[r].add(some[r][i : i + k])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(some) + 1) * longs, longs, dtype=np.int32)), pa.array(packed.ravel()))
                kept = [c.slice(s.start, len(some)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lengths - k + 1), lists, pa.array([sorted(x) if x else None for x in odd], pa.list_(pa.string()))], [*keep, "n", "words", "odd"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return arrow_map(rows, run, ", ".join([*kinds, "n bigint", "words array<bigint>", "odd array<string>"]))


def different(every: Column, odd: Column) -> Column:
    """How many different words some rows have: ``every`` is the array of their bitmaps, ``odd`` that of their other words."""
    either = F.aggregate(F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0))), every[0], lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    total = F.aggregate(either, F.lit(0).cast("bigint"), lambda s, x: s + F.bit_count(x))
    return total + F.size(F.array_distinct(F.flatten(odd)))
