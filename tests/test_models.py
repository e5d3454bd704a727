"""Models on symbols outside the alphabet and on sequences of other lengths; training against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.functions import scalar as S
from strandwork.operators import models

DNA = "ACGT"
TABLE = [[math.log((i + j) % 4 + 1) for j in range(4)] for i in range(4)]


def seqs(spark, rows):
    return spark.createDataFrame([(i, s, 1.0 + i % 3) for i, s in enumerate(rows)], "id bigint, seq string, weight double")


def one(df, *columns):
    return [tuple(r)[1:] for r in df.select("id", *columns).orderBy("id").collect()]


def test_windows(spark):
    rows = ["ACGTAC", "AC", "", None, "a😀bc\nd"]
    assert [r[0] for r in one(seqs(spark, rows), S.windows(F.col("seq"), 3))] == [["ACG", "CGT", "GTA", "TAC"], [], [], [], ["a😀b", "😀bc", "bc\n", "c\nd"]]


def test_pwm_edges(spark):
    model = models.PWM(DNA, TABLE)
    rows = ["ACGT", "TT", "ACGN", "ACGTNN", "", None, "acgt"]
    got = [r[0] for r in one(seqs(spark, rows), model.score(F.col("seq")))]
    right = sum(TABLE[i][i] for i in range(4))
    assert got == [pytest.approx(right), None, None, pytest.approx(right), None, None, None]


def test_pwm_windows(spark):
    model = models.PWM(DNA, TABLE)
    rng = random.Random(1)
    rows = ["".join(rng.choice("ACGTN" if k % 3 == 0 else DNA) for _ in range(rng.randint(0, 40))) for k in range(30)]
    got = one(seqs(spark, rows), model.best_window(F.col("seq")).alias("b"), model.zoops(F.col("seq"), 0.4).alias("z"))
    for text, (best, zoops) in zip(rows, got):
        scores = [sum(TABLE[j][DNA.index(c)] for j, c in enumerate(text[i : i + 4])) if "N" not in text[i : i + 4] else None for i in range(len(text) - 3)]
        known = [(x, -i) for i, x in enumerate(scores) if x is not None]
        if known:
            top = max(x for x, _ in known)
            assert best["score"] == pytest.approx(top)
            assert -best["minus"] == next(i for i, x in enumerate(scores) if x is not None and abs(x - top) < 1e-9)
        else:
            assert best is None
        assert zoops == pytest.approx(math.log(0.6 + sum(0.4 * math.exp(x) * 4**4 / len(scores) for x, _ in known)))


@pytest.mark.parametrize("order,period", [(0, 1), (1, 1), (2, 1), (1, 3)])
def test_markov(spark, order, period):
    rng = random.Random(order * 10 + period)
    rows = ["".join(rng.choice(DNA) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["ACNGT", None]
    df = seqs(spark, rows)
    model = models.Markov.fit(df, "seq", DNA, order, 2.0, "weight", period)
    counts: dict = {}
    for i, s in enumerate(rows):
        for k in range(order + 1):
            for a in range(len(s or "") - k):
                w = s[a : a + k + 1]
                if set(w) <= set(DNA):
                    counts.setdefault((k, (a + k) % period, w[:-1]), dict.fromkeys(DNA, 0.0))[w[-1]] += 1.0 + i % 3

    def log(k, phase, w):
        row = counts.get((k, phase, w[:-1]))
        return math.log((row[w[-1]] + 0.5) / (sum(row.values()) + 2.0)) if row else -math.inf

    got = [r[0] for r in one(df, model.score(F.col("seq")))]
    for s, score in zip(rows, got):
        if s is None or "N" in s:
            assert score is None
            continue
        want = sum(log(min(a, order), a % period, s[a - min(a, order) : a + 1]) for a in range(len(s)))
        assert score == pytest.approx(want)


HMM = models.HMM(DNA, np.asarray([0.6, 0.4]), np.asarray([[0.9, 0.1], [0.3, 0.7]]), np.asarray([[0.4, 0.3, 0.2, 0.1], [0.1, 0.1, 0.3, 0.5]]))


def paths(text):
    """Probability of the text along each path of states."""
    from itertools import product

    for path in product(range(2), repeat=len(text)):
        p = 1.0
        for t, (s, c) in enumerate(zip(path, text)):
            p *= (HMM.start[s] if t == 0 else HMM.move[path[t - 1], s]) * (HMM.emit[s, DNA.index(c)] if c in DNA else 1.0)
        yield path, p


@pytest.mark.parametrize("text", ["A", "ACGT", "TTTTAACG", "ANGT"])
def test_hmm_by_paths(text):
    every = list(paths(text))
    assert HMM.forward(text) == pytest.approx(math.log(sum(p for _, p in every)))
    best, path = HMM.viterbi(text)
    assert best == pytest.approx(math.log(max(p for _, p in every)))
    assert dict(every)[tuple(path)] == pytest.approx(math.exp(best))
    start, move, emit, total = HMM.counts(text, 1.0)
    mass = sum(p for _, p in every)
    assert total == pytest.approx(math.log(mass))
    assert start == pytest.approx([sum(p for q, p in every if q[0] == s) / mass for s in range(2)])
    want = np.zeros((2, 2))
    for q, p in every:
        for a, b in zip(q, q[1:]):
            want[a, b] += p / mass
    assert move == pytest.approx(want)
    assert emit.sum() == pytest.approx(sum(c in DNA for c in text))


def test_hmm_impossible():
    model = models.HMM("AC", np.asarray([1.0]), np.asarray([[1.0]]), np.asarray([[1.0, 0.0]]))
    assert model.forward("AC") == -math.inf
    assert not np.isnan(np.concatenate([np.ravel(x) for x in model.counts("AC", 1.0)[:3]])).any()


def test_hmm_training(spark):
    df = seqs(spark, ["AAACCC", "ACGT", "GGTTA", None, "", "TTNA"])
    before = sum(HMM.forward(s) for s in ("AAACCC", "ACGT", "GGTTA", "TTNA"))
    made = HMM.baum_welch(df, "seq", 3)
    assert sum(made.forward(s) for s in ("AAACCC", "ACGT", "GGTTA", "TTNA")) > before
    got = [r[0] for r in one(made.scores(df, "seq"), "score")]
    assert got == [pytest.approx(made.forward(s)) for s in ("AAACCC", "ACGT", "GGTTA", None, "", "TTNA")]


def test_log_linear(spark):
    rng = random.Random(5)
    rows = ["".join(rng.choice("AC" if k % 2 else "GT") for _ in range(6)) for k in range(60)] + ["AC", "ACGTNA", "ACGTACGTAC", None]
    df = seqs(spark, rows).withColumn("class_id", (F.col("id") % 2).cast("int"))
    model = models.LogLinear.fit(df, "seq", DNA, 6, steps=10)
    got = [r[0] for r in one(df, model.score(F.col("seq")))]
    assert all((x > 0) == (i % 2 == 0) for i, x in enumerate(got[:60]))
    assert got[60] is None and got[61] is None and got[62] is not None and got[63] is None


def test_mixture(spark):
    """EM by hand over the same start."""
    rng = random.Random(2)
    rows = ["".join(rng.choice(DNA) for _ in range(5)) for _ in range(50)]
    df = seqs(spark, rows)
    model = models.Mixture.fit(df, "seq", DNA, 2, 3, 4.0)
    first = {r["seq"]: r["c"] for r in df.select("seq", F.pmod(F.xxhash64("seq", F.lit(0)), F.lit(2)).alias("c")).collect()}
    weights = [[0.9 if first[s] == c else 0.1 for s in rows] for c in range(2)]
    for _ in range(3):
        logs, shares = [], [sum(w) / len(rows) for w in weights]
        for w in weights:
            n = np.ones((5, 4))
            for s, x in zip(rows, w):
                for i, c in enumerate(s):
                    n[i, DNA.index(c)] += x
            logs.append(np.log(n / n.sum(axis=1, keepdims=True)))
        scores = [[math.log(shares[c]) + sum(logs[c][i, DNA.index(x)] for i, x in enumerate(s)) for s in rows] for c in range(2)]
        total = [math.log(math.exp(a) + math.exp(b)) for a, b in zip(*scores)]
        weights = [[math.exp(x - t) for x, t in zip(row, total)] for row in scores]
    assert [r[0] for r in one(df, model.score(F.col("seq")))] == pytest.approx(total)
