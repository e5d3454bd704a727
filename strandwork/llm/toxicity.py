"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag of hashed character n-grams (with its ends marked) and of itself; a text's vector is the mean of its
words' vectors; a linear layer and a softmax give the two labels' probabilities. Embeddings and layer are trained
together by gradient steps. A misspelling shares most n-grams, hence most of its vector, with the word it hides.

As the layer is linear, each word adds one number to a text's logit; scoring looks these numbers up for whole
buffers of words. A long text would drown a few words in a mean over all, so ``score`` also takes the mean over
windows of ``window`` words and keeps the highest: the model judges passages, the text has its worst one's score.

Edge cases: null, empty and word-less texts get the model's bias alone; texts without a label aren't learnt from;
repeated rows are scored alike; an empty table gives an empty result; with no labels at all every score is 0.5.
Learning uses a bounded sample of labelled rows: those with the lowest hashes of their ids, ``max_rows`` and ``max_bytes``
of text at most; scoring has no limit.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm._common import arrow_map, flat_index, lower_bytes, spans_by_size, text_bytes
from strandwork.llm._spans import SpanTable

_STRIP = b".,;:!?\"'()[]{}"
BLOCK_BYTES = 1 << 20
ONE = 1 << 32  # unit of the whole numbers that word logits are kept in
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Settings:
    dim: int = 12
    buckets: int = 1 << 17
    least_gram: int = 3
    most_gram: int = 5
    epochs: int = 14
    rate: float = 0.3
    batch: int = 64
    max_rows: int = 8000
    max_bytes: int = 1 << 26
    window: int = 4
    seed: int = 11


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (table & np.uint32(1)) * np.uint32(0xEDB88320)
    return table


_CRC = _crc_table()


def grams(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (by CRC-32) of each word's subwords, ascending, one word after another, and how many each has. The word
    itself is one of them. All words of a block go together, character by character."""
    flat, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in spans_by_size([len(w) for w in words], BLOCK_BYTES):
        shown = [b"<" + lower_bytes(w).strip(_STRIP) + b">" for w in words[a:b]]
        shown = [x if x.isascii() else x.decode("utf-8", "replace").encode() for x in shown]
        number = np.arange(b - a)
        buf = np.frombuffer(b"".join(shown), np.uint8)
        char = np.flatnonzero((buf & 0xC0) != 0x80)
        wide = np.diff(char, append=len(buf))
        ends = np.searchsorted(char, np.cumsum(np.fromiter(map(len, shown), np.int64, b - a)))
        owner = np.repeat(number, np.diff(ends, prepend=0))
        left = ends[owner] - np.arange(len(char))  # characters to the word's end
        found = [number * s.buckets + np.fromiter((zlib.crc32(x) % s.buckets for x in shown), np.int64, b - a)]
        first, state = np.arange(len(char)), np.full(len(char), 0xFFFFFFFF, np.uint32)
        for k in range(s.most_gram):
            on = left[first] > k
            first, state = first[on], state[on]
            at, width = char[first + k], wide[first + k]
            for i in range(int(width.max(initial=0))):
                some = slice(None) if not i else np.flatnonzero(width > i)
                state[some] = _CRC[(state[some] ^ buf[at[some] + i]) & np.uint32(255)] ^ (state[some] >> np.uint32(8))
            if k + 1 >= s.least_gram:
                found.append(owner[first] * s.buckets + (~state % np.uint32(s.buckets)))
        every = np.sort(np.concatenate(found))
        every = every[np.diff(every, prepend=-1) > 0]  # np.unique hashes, which is slower here
        flat.append(every % s.buckets)
        size.append(np.bincount(every // s.buckets, minlength=b - a))
    return np.concatenate(flat), np.concatenate(size)


class _Bags:
    """The distinct words of a sample as bags of buckets, side by side."""

    def __init__(self, texts: list[bytes], s: Settings):
        number: dict[bytes, int] = {}
        self.words = [np.asarray([number.setdefault(w, len(number)) for w in t.split()], np.int64) for t in texts]
        self.flat, self.size = grams(list(number), s)
        self.first = np.cumsum(self.size) - self.size


@dataclass
class Model:
    """Weights: ``embedding`` (bucket x dim), ``layer`` (dim x 2), ``bias`` (2)."""

    embedding: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    settings: Settings

    def bucket_logits(self) -> np.ndarray:
        return self.embedding @ (self.layer[:, 1] - self.layer[:, 0])

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(texts: list[bytes], labels: list[int], s: Settings = Settings()) -> Model:
    """Joint gradient steps on embeddings and layer. In each epoch a text stands for its highest window so far, the
    one it will be scored by."""
    rng = np.random.default_rng(s.seed)
    model = Model((rng.standard_normal((s.buckets, s.dim)) / s.dim).astype(np.float64), rng.standard_normal((s.dim, 2)) * 0.1, np.zeros(2), s)
    y = np.asarray(labels, np.int64)
    if not len(y):
        model.layer[:] = 0
        return model
    bags = _Bags(texts, s)
    rate_of_one = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.bias[:] = np.log([1 - rate_of_one, rate_of_one])
    sums_e, sums_u = np.zeros(s.buckets), np.zeros((s.dim, 2))
    for epoch in range(s.epochs):
        logits = model.bucket_logits()
        word = np.add.reduceat(logits[bags.flat], bags.first) / bags.size if len(bags.flat) else np.zeros(0)
        chosen = []
        for w in bags.words:
            if len(w) > s.window and epoch:
                sums = np.concatenate([[0.0], np.cumsum(word[w])])
                at = int(np.argmax(sums[s.window :] - sums[: -s.window]))
                w = w[at : at + s.window]
            chosen.append(w)
        order = rng.permutation(len(y))
        for a in range(0, len(order), s.batch):
            some = [i for i in order[a : a + s.batch] if len(chosen[i])]
            if not some:
                continue
            length = np.asarray([len(chosen[i]) for i in some])
            words = np.concatenate([chosen[i] for i in some])
            row = flat_index(bags.first[words], bags.size[words])
            share = np.repeat(np.repeat(1.0 / length, length) / bags.size[words], bags.size[words])
            owner = np.repeat(np.repeat(np.arange(len(some)), length), bags.size[words])
            bucket = bags.flat[row]
            starts = np.searchsorted(owner, np.arange(len(some)))
            x = np.add.reduceat(model.embedding[bucket] * share[:, None], starts, axis=0)
            z = x @ model.layer + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            gu, gx = x.T @ p, p @ model.layer.T
            ids, inverse = np.unique(bucket, return_inverse=True)
            ge = np.stack([np.bincount(inverse, share * gx[owner, k], len(ids)) for k in range(s.dim)], axis=1)
            sums_e[ids] += (ge**2).mean(axis=1)
            sums_u += gu**2
            model.embedding[ids] -= s.rate * ge / (np.sqrt(sums_e[ids]) + 1e-8)[:, None]
            model.layer -= 0.2 * s.rate * gu / (np.sqrt(sums_u) + 1e-8)
            model.bias -= 0.1 * p.sum(axis=0)
    return model


class Scorer:
    def __init__(self, model_logits: np.ndarray, offset: float, s: Settings):
        self.s, self.offset, self.logits = s, offset, model_logits
        self.table = SpanTable(self._learn, np.int64)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's logit, in whole numbers, so that sums don't depend on what else a buffer holds."""
        flat, size = grams(words, self.s)
        means = np.add.reduceat(self.logits[flat], np.cumsum(size) - size) / size if len(words) else np.zeros(0)
        return np.rint(ONE * means).astype(np.int64), np.ones(len(words), np.int64)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        s, n = self.s, len(texts)
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        edges = np.flatnonzero(np.diff(~_SPACE[buf], prepend=False, append=False))
        starts, stops = edges[::2], edges[1::2]
        values, _ = self.table.lookup(buf, starts, stops)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, n))
        last = np.searchsorted(starts, ends)
        first = np.append(0, last[:-1])
        sums = np.concatenate([[0], np.cumsum(values)])
        logit = (sums[last] - sums[first]) / (ONE * np.maximum(last - first, 1))
        long = np.flatnonzero(last - first > s.window)
        if len(long):
            count = last[long] - first[long] - s.window + 1
            at = flat_index(first[long], count)
            means = (sums[at + s.window] - sums[at]) / (ONE * s.window)
            logit[long] = np.maximum.reduceat(means, np.cumsum(count) - count)
        return 1 / (1 + np.exp(-np.clip(logit + self.offset, -500, 500)))


def learning_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, s: Settings, held_in) -> list[tuple]:
    """``text, label`` of labelled rows in the order of their ids' hashes, as far as ``max_rows`` and ``max_bytes`` go (a
    text that doesn't fit any more is passed over). Lengths are looked at first, so the driver gets no more than that."""
    picked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1)).where(held_in("id"))
    picked = picked.orderBy(F.xxhash64("id"), "id", "label").limit(s.max_rows)
    # bounded by max_rows
    narrow = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = narrow.join(F.broadcast(picked), F.col("doc") == F.col("id"))
    order = [F.xxhash64("id"), "id", F.md5("text"), "label"]
    sizes = found.select("id", F.octet_length("text").alias("n"), F.md5("text").alias("md5"), "label", F.xxhash64("id").alias("h")).orderBy("h", "id", "md5", "label").limit(s.max_rows).collect()
    keep, total = [], 0
    for k, r in enumerate(sizes):
        if total + r["n"] <= s.max_bytes:
            total += r["n"]
            keep.append(k)
    longest = max((sizes[k]["n"] for k in keep), default=0)
    rows = found.where(F.octet_length("text") <= longest).select("id", "text", "label", F.md5("text").alias("md5")).join(F.broadcast(docs.sparkSession.createDataFrame([(sizes[k]["id"], sizes[k]["md5"]) for k in keep], f"id {picked.schema['id'].dataType.simpleString()}, md5 string").distinct()), ["id", "md5"])
    got = rows.orderBy(*order).limit(len(keep)).collect() if keep else []
    return [(r["text"], r["label"]) for r in got]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", s: Settings = Settings(), held_in=lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 3 != 1) -> DataFrame:
    """``id_col, score`` for every row of ``docs``, learnt from labelled rows for which ``held_in`` holds."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sample = learning_sample(docs, labels, id_col, text_col, label_col, s, held_in)
    model = train([(r[0] or "").encode() for r in sample], [r[1] for r in sample], s)
    handed = spark.sparkContext.broadcast((model.bucket_logits(), model.offset))

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(*handed.value, s)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in spans_by_size([len(t) for t in texts], BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(scorer(texts[a:b]))], ["id", "score"])

    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, score double").withColumnRenamed("id", id_col)
