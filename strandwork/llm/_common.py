"""Shared plumbing of the corpus operators: tables, shared folders, byte blocks."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word of every contract here: no blank, no tab .. carriage return.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); one of the machine only where none
    is set and everything runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that are deleted when what they led to has been written (``drop``)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = path, made
        return made

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of some tables, of all by default; nothing that is still to be computed may read them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for key in [id(f) for f in frames] or list(self.paths):
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(key)[0])
            path.getFileSystem(conf).delete(path, True)


#: Bytes to an Arrow batch: what a Python worker holds doesn't grow with the number of rows or with their texts' mean
#: length (a single longer text is a batch of its own).
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def lower_ascii(col):
    """A-Z to a-z, nothing else (``lower`` would fold other scripts as well)."""
    return F.translate(col, UPPER, LOWER)


def lower_bytes(text: bytes) -> bytes:
    return text.translate(_LOWER_BYTES)


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def spans_by_size(sizes, limit: int):
    """Cut ``range(len(sizes))`` into runs of at most ``limit`` in sum (one element at least)."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


# --- polynomial hashes of byte ranges, modulo 2**64 -------------------------------------------------

_MULT = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_MULT**i`` and its inverse for i < n."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_MULT, pow(_MULT, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hashes of any byte range of a buffer in constant time each.

    Ranges with equal bytes have equal hashes. The converse fails for some very regular bytes (sums modulo a power of
    two cancel), so whoever needs equality compares bytes (``equal_ranges``).
    """

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def flat_index(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``first[i], first[i]+1, ...`` (``length[i]`` of them) for every i, in one array."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(first - (ends - length), length)


def equal_ranges(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A number for each range ``buf[starts[i]:stops[i]]``, the same for those with the same bytes: hashes say which may
    be equal, the bytes decide."""
    if not len(starts):
        return np.zeros(0, np.int64)
    _, first, number = np.unique(RangeHash(buf)(starts, stops), return_index=True, return_inverse=True)
    like = first[number]
    length = stops - starts
    wrong = length != length[like]
    if not wrong.any():
        for a, b in spans_by_size(length.tolist(), 1 << 19) if int(length.sum()) > 1 << 21 else [(0, len(starts))]:
            some = slice(a, b)
            if (buf[flat_index(starts[some], length[some])] != buf[flat_index(starts[like[some]], length[some])]).any():
                wrong = None
                break
    if wrong is None or wrong.any():
        raw, seen = buf.tobytes(), {}
        number = np.asarray([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), stops.tolist())], np.int64)
    return number
