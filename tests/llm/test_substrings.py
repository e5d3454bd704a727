"""Repeated strings against a count of all strings, whichever way they are found."""

import random

import numpy as np
import pytest

from strandwork.llm import substring_dedup as D
from strandwork.llm.suffix_array import suffix_array
from tests.llm import brute


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        text = [rng.randint(-1, rng.choice([0, 1, 3, 200])) for _ in range(rng.randint(0, 60))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    text = [0, 1] * 200 + [0, 0, 1] * 50
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def _texts(seed, n=60):
    """Texts with shared passages of 150 to 420 bytes, some periodic, some that differ in one byte."""
    rng = random.Random(seed)

    def noise(k):
        return "".join(rng.choice("abcdefgh ") for _ in range(k))

    shared = [noise(rng.randint(150, 420)) for _ in range(8)] + ["ab" * 150, noise(30) * 12, "x" * 260]
    out = []
    for _ in range(n):
        t = noise(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            if rng.random() < 0.3:
                k = rng.randrange(len(s))
                s = s[:k] + "#" + s[k + 1 :]
            t += s[rng.randint(0, 30) :] + noise(rng.randint(0, 120))
        out.append(t)
    return out


def test_anchors_do_not_depend_on_the_buffer():
    texts = [t.encode() for t in _texts(3)]
    together = D.anchors(texts)
    for i, t in enumerate(texts):
        alone = D.anchors([t])
        mine = together[0] == i
        assert all((a == b[mine]).all() for a, b in zip(alone[1:], together[1:]))


def test_long_buffers(monkeypatch):
    texts = [t.encode() for t in _texts(4)]
    want = D.anchors(texts)
    monkeypatch.setattr(D, "_PLACES", np.uint64(9))  # pieces of 343 windows; fewer bits for places leave more for the hash
    got = D.anchors(texts)
    assert (got[1] >= 0).all() and set(zip(got[0], got[1])) and len(got[0]) == pytest.approx(len(want[0]), rel=0.02)


@pytest.mark.parametrize("limit", [D.TEXT_BYTES, 3000, 1])
def test_slices_of_a_piece(monkeypatch, limit):
    """Slices of one frame, clipped or not: as one text, and divided down to single strings."""
    monkeypatch.setattr(D, "TEXT_BYTES", limit)
    rng = random.Random(limit)
    w = D.WIDTH
    piece = "".join(rng.choice("ab") for _ in range(200 - w)).encode()
    left, right = ([bytes(rng.choice(b"ab") for _ in range(w)) for _ in range(4)] for _ in range(2))
    rows = []
    for k in range(60):
        s = rng.choice(left) + piece + rng.choice(right)
        lack, cut = rng.choice([0, 0, 5, w - 1, w]), rng.choice([0, 0, 7, w])
        rows.append((s[lack : len(s) - cut], lack, k // 2, lack + 1000 * (k % 2)))
    count: dict = {}
    for s, _, o, x in rows:
        for i in range(len(s) - 199):
            count.setdefault(s[i : i + 200], set()).add((o, x + i))
    want = {(o, x + i) for s, _, o, x in rows for i in range(len(s) - 199) if len(count[s[i : i + 200]]) > 1}
    assert {(o, x) for o, a, b in D.repeated_in(*(list(c) for c in zip(*rows))) for x in range(a, b - 199)} == want
    kept = D.promising([r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
    assert {(rows[i][2], rows[i][3] + a) for i, a, _ in kept} | {(rows[i][2], rows[i][3] + b) for i, _, b in kept} <= want
    assert want <= {(rows[i][2], rows[i][3] + x) for i, a, b in kept for x in range(a, b + 1)}


def test_one_place_twice():
    """A place that comes twice doesn't repeat itself."""
    s = bytes(random.Random(1).choices(b"abcdefgh", k=284))
    assert D.repeated_in([s, s], [0, 0], ["t", "t"], [5, 5]) == [] == D.promising([s, s], ["t", "t"], [5, 5])
    assert set(D.repeated_in([s, s, s], [0, 0, 0], ["t", "t", "u"], [5, 5, 10])) == {("t", 5, 289), ("u", 10, 294)}
    assert D.promising([s, s, s], ["t", "t", "u"], [5, 5, 10]) == [(0, 0, 84), (1, 0, 84), (2, 0, 84)]


@pytest.mark.parametrize("hot", [D.HOT, 3, 1])
def test_whole(spark, hot):
    texts = _texts(5, 120)
    texts += texts[:7] + ["é" * 150, "中" * 90 + texts[3], "q" * 1_000_000 + texts[9]]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = {(r["n_bytes"], r["kept_text"]): r for r in D.cut_texts(docs, True, hot).collect()}
    assert len(got) == len(set(texts))
    every = brute.repeats(texts[:-1] + ["q" * 1000 + texts[9]])  # a million of one letter, as a thousand
    for t, spans in zip(texts[:-1], every):
        kept = brute.cut(t, spans)
        r = got[len(t.encode()), kept.decode("utf-8", "ignore")]
        assert (r["n_removed"], r["n_spans"]) == (len(t.encode()) - len(kept), len(spans))
    long = next(r for r in got.values() if r["n_bytes"] > 1_000_000)
    short = brute.cut("q" * 1000 + texts[9], every[-1])
    assert long["kept_text"].encode() == short
