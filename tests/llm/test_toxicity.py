"""What the classifier learns: held-out labels, misspellings, whatever else a text holds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.llm import entry, toxicity
from tests.conftest import SMALL

SIZE = SMALL.replace("0.001", "0.01")


def _auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    labels = np.asarray(labels, bool)
    return (rank[labels].sum() - labels.sum() * (labels.sum() + 1) / 2) / (labels.sum() * (~labels).sum())


def test_held_out_labels(spark):
    got = entry.op3_toxicity(spark, SIZE)
    labels = spark.read.parquet(f"{SIZE}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50
    scores, toxic = [r["score"] for r in rows], [r["toxic"] for r in rows]
    assert _auc(scores, toxic) > 0.85  # some labels of these tables are noise, and there are few
    right = [r["predicted"] == r["toxic"] for r in rows]
    assert sum(right) / len(right) > 0.85


def test_misspellings():
    rng = random.Random(4)
    plain = ["garden", "window", "letter", "summer", "kitchen", "river", "morning", "paper"]
    bad = ["horrible", "disgusting", "worthless"]
    texts, labels = [], []
    for k in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if k % 2:
            words[rng.randrange(30)] = rng.choice(bad)
        texts.append(" ".join(words).encode())
        labels.append(k % 2)
    s = toxicity.Settings()
    model = toxicity.train(texts, labels, s)
    scorer = toxicity.Scorer(model.bucket_logits(), model.offset, s)
    clean = " ".join(plain)
    unseen = [f"{clean} {w} {clean}".encode() for w in ("horribble", "disgustting", "worthles", "HORRIBLE")]
    assert (scorer(unseen) > 0.5).all()
    assert (scorer([clean.encode(), b"", b"garden riverr"]) < 0.5).all()
    # one word in a very long text still counts, and where it stands doesn't matter
    long = f"{clean} " * 20_000
    near, far = scorer([f"{long}horrible {clean}".encode(), f"horrible {long}".encode()])
    assert near > 0.5 and far > 0.5


def test_no_labels_and_bounds(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i + 1)) for i in range(30)] + [(None, None), (3, "a b c " * 4)], "doc_id bigint, text string")
    labels = docs.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    assert {r["score"] for r in toxicity.score(docs, labels).collect()} == {0.5}
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    everything = lambda c: F.lit(True)
    s = toxicity.Settings(max_rows=10, max_bytes=300)
    sample = toxicity.learning_sample(docs, labels, "doc_id", "text", "toxic", s, everything)
    assert 0 < len(sample) <= 10 and sum(len(t) for t, _ in sample) <= 300
    every = toxicity.learning_sample(docs, labels, "doc_id", "text", "toxic", toxicity.Settings(), everything)
    assert len(every) == 33 - 1 + 1  # repeated ids meet repeated labels
    assert toxicity.score(docs, labels).count() == 32


def test_subwords_of_many_words():
    """All words at once give what each gives by itself, read plainly from the definition."""
    import zlib

    rng = random.Random(8)
    words = ["a", "...", "(Hello)", "ÜBUNG", "naïve", "中文字", "emoji😀", "x" * 300, "ab" * 9, "it's", "don't", "\x85"]
    words = [w.encode() for w in words + ["".join(rng.choice("abcÄßé中😀.") for _ in range(rng.randrange(1, 12))) for _ in range(500)]] + [b"\xff\xfeab", b"\xc3", b"caf\xc3,\xa9\x80z"]
    for s in (toxicity.Settings(), toxicity.Settings(buckets=1000, least_gram=1, most_gram=7)):
        want = []
        for w in words:
            text = "<" + w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).strip(b".,;:!?\"'()[]{}").decode("utf-8", "replace") + ">"
            found = {text} | {text[i : i + n] for n in range(s.least_gram, s.most_gram + 1) for i in range(len(text) - n + 1)}
            want.append(sorted({zlib.crc32(g.encode()) % s.buckets for g in found}))
        flat, size = toxicity.grams(words, s)
        assert size.tolist() == [len(x) for x in want] and flat.tolist() == [x for one in want for x in one]
        assert [len(x) for x in toxicity.grams([], s)] == [0, 0]
        logits = np.random.default_rng(1).standard_normal(s.buckets)
        scorer = toxicity.Scorer(logits, 0.25, s)
        got = scorer([b" ".join(words[k : k + 3]) for k in range(0, 30, 3)])
        each = [logits[x].mean() for x in want[:30]]
        assert np.allclose(got, [1 / (1 + np.exp(-(np.mean(each[k : k + 3]) + 0.25))) for k in range(0, 30, 3)], atol=1e-8)
