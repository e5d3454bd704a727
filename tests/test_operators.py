"""Operators that queries don't reach, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.functions import scalar as S
from strandwork.operators import distributions as D
from strandwork.operators import annotations, evaluation, genome, intervals, models, motifs, ordered, sets, weights

DNA = "ACGT"


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_symbols(spark):
    df = spark.createDataFrame([("ACGT", "N", "a-b--c"), ("", "R", ""), (None, None, None)], "s string, c string, t string")
    assert one(df, S.code_hash(F.col("s"))) == [(((0 * 31 + 1) * 31 + 2) * 31 + 3,), (0,), (None,)]
    long = spark.createDataFrame([("TGCA" * 10,)], "s string")
    h = 0
    for c in "TGCA" * 10:
        h = (h * 31 + DNA.index(c) + 2**31) % 2**32 - 2**31
    assert one(long, S.code_hash(F.col("s"))) == [(h,)]
    assert one(df, S.to_text(F.col("s"), "|")) == [("A|C|G|T",), ("",), (None,)]
    assert one(df, S.tokens(F.col("t"), "-")) == [(["a", "b", "c"],), ([],), (None,)]
    assert one(df, S.tokens(F.col("t"), "-", ["a", "b"])) == [(None,), ([],), (None,)]
    assert one(df, S.iupac_within(F.lit("R"), F.col("c"))) == [(True,), (True,), (None,)]
    mixed = one(long, S.permuted(F.col("s"), 3))[0][0]
    assert sorted(mixed) == sorted("TGCA" * 10)


def test_translation(spark):
    df = spark.createDataFrame([("ATGTAANNNG",), ("AT",)], "s string")
    assert one(df, S.translate_codons(F.col("s"))) == [("M*X",), ("",)]
    assert one(df, S.translate_codons(F.col("s"), unknown="")) == [("M*",), ("",)]
    assert one(df, S.translate_codons(F.col("s"), unknown=None)) == [(None,), ("",)]
    assert one(df, S.translate_codons(F.col("s"), 1)) == [("CXX",), ("",)]


def test_running_sums(spark):
    values = list(range(500))
    df = spark.createDataFrame([(values,), ([],)], "v array<int>")
    assert one(df, S.running_sums(F.col("v"))) == [([sum(values[:i]) for i in range(500)],), ([],)]


def test_distributions(spark):
    move = np.asarray([[0.9, 0.1, 0], [0.2, 0.5, 0.3], [0, 0.4, 0.6]])
    pi = D.stationary(move)
    assert np.allclose(pi @ move, pi) and pi.sum() == pytest.approx(1)
    assert D.integrate(np.sin, 0, math.pi) == pytest.approx(2, abs=1e-9)
    assert D.integrate(np.sin, 0, math.pi, 2000, "trapezoid") == pytest.approx(2, abs=1e-5)
    assert D.nice_ticks(0, 97) == (0, 100, 10) and D.nice_ticks(0.13, 0.87, 5) == pytest.approx((0, 1.0, 0.2))
    df = spark.createDataFrame([(0.0,), (1.96,), (-1.0,), (None,)], "x double")
    got = [r[0] for r in one(df, D.normal_cdf(F.col("x")))]
    assert got[:3] == pytest.approx([0.5, 0.9750021, 0.1586553], abs=1e-6) and got[3] is None
    rows = spark.createDataFrame([([[1, 2, 3], [4, 5, 6]],)], "m array<array<int>>")
    assert one(rows, D.transpose(F.col("m"))) == [([[1, 4], [2, 5], [3, 6]],)]
    p = spark.createDataFrame([([0.25] * 4,), ([1.0, 0.0, 0.0, 0.0],), ([0.5, 0.5, 0.0, 0.0],)], "p array<double>")
    assert one(p, D.entropy(F.col("p"), True)) == [(2.0,), (0.0,), (1.0,)]
    assert one(p, D.information(F.col("p"))) == [(0.0,), (1.0,), (0.5,)]
    logs = [[math.log(x) for x in row] for row in ((0.7, 0.1, 0.1, 0.1), (0.25, 0.25, 0.25, 0.25))]
    drawn = D.sample_words(spark, logs, DNA, 4000, 1)
    share = {r["c"]: r["n"] / 4000 for r in drawn.groupBy(F.substring("seq", 1, 1).alias("c")).agg(F.count("*").alias("n")).collect()}
    assert share["A"] == pytest.approx(0.7, abs=0.04) and share["C"] == pytest.approx(0.1, abs=0.03)
    model = models.PWM(DNA, logs)
    best = D.most_probable(spark, DNA, 2, model.score).first()
    assert (best["kmer"], best["score"]) == ("AA", pytest.approx(logs[0][0] + logs[1][0]))


def test_outlier_weights(spark):
    rng = random.Random(3)
    x = [rng.gauss(0, 1) for _ in range(200)] + [30.0, 40.0, 50.0]
    df = spark.createDataFrame(list(enumerate(x)), "id bigint, score double")

    def share(repeat):
        help_, n1, n2 = sorted(x), 0, len(x)
        while True:
            low, high = help_[int(0.25 * n2)], help_[int(0.75 * n2)]
            limit = high + 1.5 * (high - low)
            below = sum(v < limit for v in help_)
            edge = below if limit in help_ else below + 2
            if not repeat or edge >= n2:
                return 1 - edge / len(x)
            n2 = edge

    for mode, repeat in (("rank_outlier", False), ("rank_outlier_repeated", True)):
        got = {r["id"]: r["weight"] for r in weights.interpolate(df, "score", mode).collect()}
        s = share(repeat)
        rank = {i: sum(v > x[i] for v in x) for i in range(len(x))}
        last = max(rank.values())
        for i in range(len(x)):
            h = rank[i] / last
            want = 0.0 if h == 1 or s <= 0 else 1 / (1 + h / (1 - h) * (1 - s) / s)
            assert got[i] == pytest.approx(want)
    assert weights.interpolate(df.limit(0), "score", "linear").count() == 0
    with pytest.raises(ValueError):
        weights.interpolate(df, "score", "none such")


def _brands(spark, n=300, length=5, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = i % 2
        rows.append((i, "".join(rng.choices(DNA, weights=[4, 3, 2, 1] if c else [1, 2, 3, 4])[0] for _ in range(length)), c, float(1 + i % 3)))
    return rows, spark.createDataFrame(rows, "id bigint, seq string, class_id int, weight double")


@pytest.mark.parametrize("principle", ["ML", "MAP"])
def test_gen_dis_mix_closed_forms(spark, principle):
    rows, df = _brands(spark)
    model = models.GenDisMix.fit(df, "seq", DNA, 5, beta=models.PRINCIPLES[principle], strength=4.0, steps=60)
    logs = models.GenDisMix._logs(model.theta)
    pc = {"ML": 0.0, "MAP": 1.0}[principle]
    for c in (0, 1):
        for k in range(5):
            n = np.asarray([sum(w for _, s, y, w in rows if y == c and s[k] == a) + pc for a in DNA])
            assert np.exp(logs[c, k]) == pytest.approx(n / n.sum(), abs=2e-3)


def test_gen_dis_mix_discriminative(spark):
    rows, df = _brands(spark)

    def conditional(model):
        a, b = model.scores(F.col("seq"))
        out = df.select("class_id", "weight", a.alias("a"), b.alias("b")).collect()
        return sum(r["weight"] * ((r["b"] if r["class_id"] else r["a"]) - np.logaddexp(r["a"], r["b"])) for r in out)

    fitted = {p: models.GenDisMix.fit(df, "seq", DNA, 5, beta=models.PRINCIPLES[p], steps=40) for p in ("ML", "MCL", "MSP")}
    assert conditional(fitted["MCL"]) >= conditional(fitted["MSP"]) >= conditional(fitted["ML"]) - 1e-6
    for prior in ("gaussian", "laplace", "none"):
        assert np.isfinite(models.GenDisMix.fit(df, "seq", DNA, 5, prior=prior, strength=1.0, steps=5).theta).all()
    short = spark.createDataFrame([("AC",), ("ACGTN",), ("ACGTA",)], "seq string")
    assert [r[0] is None for r in one(short, fitted["ML"].score(F.col("seq")))] == [True, False, False] or [r[0] is None for r in one(short, fitted["ML"].score(F.col("seq")))] == [True, True, False]


def test_structure_learning(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        s = [rng.choice(DNA) for _ in range(5)]
        s[3] = s[0] if rng.random() < 0.95 else rng.choice(DNA)
        s[1] = s[4] if rng.random() < 0.95 else rng.choice(DNA)
        rows.append((i, "".join(s), 1.0))
    df = spark.createDataFrame(rows, "id bigint, seq string, weight double")
    model = models.Dependent.learn(df, "seq", DNA)
    tied = {frozenset((i, *up)) for i, up in enumerate(model.parents) if up}
    assert {frozenset((0, 3)), frozenset((1, 4))} <= tied
    plain = models.Dependent.markov(df, "seq", DNA, 5, 0, 1.0)
    total = [df.agg(F.sum(m.score(F.col("seq")))).first()[0] for m in (model, plain)]
    assert total[0] > total[1] + 300
    words = D.all_words(spark, DNA, 5).select(model.score(F.col("kmer")).alias("s")).agg(F.sum(F.exp("s"))).first()[0]
    assert words == pytest.approx(1)


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 4 == 0 and 1 or 0) for i in range(2000)], "id bigint, class_id int")
    for train, test in sets.hold_outs(df, "id", 70, 2):
        assert train.count() + test.count() == 2000 and 1300 < train.count() < 1500
        assert train.join(test, "id").count() == 0
    for a, b in sets.sampled_pairs(df, 0.5, 1, 3):
        assert 850 < a.count() < 1150 and a.join(b, "id").count() > 0
    for train, test in sets.sampled_hold_outs(df, "id", "class_id", 1, 80, 1):
        n = {r[0]: r[1] for r in train.unionByName(test).groupBy("class_id").count().collect()}
        assert n[1] == 500 and abs(n[0] - 500) < 80
    parts = {r["part"]: r["n"] for r in sets.split(df, "id", [50, 30, 20]).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert abs(parts[0] - 1000) < 100 and abs(parts[1] - 600) < 90
    assert 800 < sets.subsample(df, 0.5, 1).count() < 1200


def test_cross_validation(spark):
    rows, df = _brands(spark, 200)
    found = evaluation.cross_validate(df, "id", 3, lambda train: models.Generative.fit(train, lambda x: models.PWM.fit(x, "seq", DNA, 4.0, F.col("weight")), 2), lambda model, test: test.withColumn("score", model.ratio(F.col("seq"))))
    assert len(found) == 3 and all(0.6 < f["auc_roc"]["auc_roc"] <= 1 for f in found)


def test_thresholds(spark):
    rng = random.Random(2)
    for _ in range(8):
        x = sorted(round(rng.random() * 4) / 4 for _ in range(rng.randint(1, 12)))
        df = spark.createDataFrame([(v,) for v in x], "s double")
        for p in (0.01, 0.3, 1.0):
            index = math.ceil(len(x) * (1 - p))
            while 0 < index < len(x) and x[index - 1] == x[index]:
                index += 1
            got = motifs.threshold_for(df, "s", p)
            assert got == (x[index] if index < len(x) else math.nextafter(x[-1], math.inf))
    assert motifs.threshold_for(df.limit(0), "s", 0.5) is None


def test_spliced(spark):
    rng = random.Random(4)
    text = "".join(rng.choice(DNA) for _ in range(1000))
    g = spark.createDataFrame([("c", text)], "chrom string, seq string")
    parts = [("t1", "c", "+", 10, 22, 0), ("t1", "c", "+", 130, 145, 0), ("t2", "c", "-", 500, 520, 1), ("t2", "c", "-", 300, 310, 2)]
    df = spark.createDataFrame(parts, "transcript string, chrom string, strand string, start bigint, end bigint, phase int")
    got = {r["transcript"]: r for r in genome.spliced(g, df, size=64, longest=32).collect()}
    flip = str.maketrans("ACGT", "TGCA")
    assert got["t1"]["cds"] == text[10:22] + text[130:145]
    assert got["t2"]["cds"] == text[500:520][::-1].translate(flip) + text[300:310][::-1].translate(flip)
    code = S.genetic_code()
    assert got["t2"]["protein"] == "".join(code[got["t2"]["cds"][1:][i : i + 3]] for i in range(0, 27, 3))


def test_repeats(spark):
    df = spark.createDataFrame([(1, "TTACGACGACGTT"), (2, "ACGT")], "id bigint, seq string")
    assert one(genome.tandem_repeats(df, "id", "seq", 2, 4, 3), "id", "unit", "text") == [(1, "ACG", "ACGACGACG")]


def test_annotations(spark):
    df = spark.createDataFrame([("Motif:m1(5, 8, FORWARD); Motif: x.2(10,3,REVERSE)",), ("none",)], "h string")
    got = [r[0] for r in df.select(annotations.motifs_of(F.col("h"))).collect()]
    assert [tuple(x) for x in got[0]] == [("m1", 5, 8, "FORWARD"), ("x.2", 10, 3, "REVERSE")] and got[1] == []


def test_long_intervals(spark):
    """Short and very long intervals: pairs by brute force."""
    rng = random.Random(6)

    def some(n, p):
        rows = []
        for i in range(n):
            a = rng.randint(-50, 100_000)
            rows.append((i, "c", a, a + rng.choice([0, 1, 5, 63, 64, 65, 900, 1100, 17_000, 90_000])))
        return rows, spark.createDataFrame(rows, f"{p}_id bigint, chrom string, {p}_start bigint, {p}_end bigint")

    (left, ldf), (right, rdf) = some(80, "l"), some(80, "r")
    got = sorted((r["l_id"], r["r_id"], r["overlap"]) for r in intervals.overlap_join(ldf, rdf, ["chrom"], 64).collect())
    want = sorted((i, j, min(b, y) - max(a, x)) for i, _, a, b in left for j, _, x, y in right if a < y and x < b and b > a and y > x)
    assert got == want
    outer = intervals.overlap_join(ldf, rdf, ["chrom"], 64, "left")
    assert outer.where("r_id is null").count() == 80 - len({i for i, _, _ in want})


def test_ranges_do_not_matter(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, "ab"[i % 2] if i % 11 else None, rng.randint(0, 300), float(rng.randint(0, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, k string, pos bigint, value double")

    def every():
        return [
            sorted(map(repr, ordered.running_total(df, "pos", ["value"], keys=["k"]).select("id", "cum_value").collect())),
            sorted(map(repr, ordered.numbered(df, ["k"], ["pos", "id"], "n").select("id", "n").collect())),
            sorted(map(repr, intervals.islands(df.withColumn("end", F.col("pos") + 2), ["k"], "pos", "end").select("id", "island").collect())),
            sorted(map(repr, intervals.nearest(df, df.where("id % 7 = 0"), ["k"], "pos").collect())),
            sorted(map(repr, ordered.neighbours(df, ["k"], ["pos", "id"], "value", 2, 1).select("id", "m2", "m1", "p1").collect())),
            sorted(map(repr, ordered.detrended(df, ["k"], "pos", "value", 3, 0.5).select("id", "detrended").collect())),
            sorted(map(repr, intervals.coverage(df.where("k is not null").withColumn("end", F.col("pos") + 5), ["k"], "pos", "end", "value").collect())),
        ]

    want = every()
    monkeypatch.setattr(ordered, "SEGMENT_ROWS", 7)
    monkeypatch.setattr(ordered, "SEGMENT_REACHES", 1)
    plain = ordered._ranges
    monkeypatch.setattr(ordered, "_ranges", lambda d, by, ranges=5: plain(d, by, ranges))
    assert every() == want
    by: dict = {}
    for i, k, pos, v in sorted(rows, key=lambda r: (r[2], r[0])):
        by.setdefault(k, []).append((i, pos, v))
    numbers = sorted(repr(n) for n in [(i, k) for rows_ in by.values() for k, (i, _, _) in enumerate(rows_)])
    assert sorted(s.replace("Row(id=", "(").replace("n=", "") for s in want[1]) == numbers


def test_steps_in_bins(spark):
    rows = [(i, "c", i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, 1.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "id bigint, chrom string, pos bigint, value double")
    r = intervals.bin_features(df, ["chrom"], "pos", "value", 100, ["pos", "id"]).first()
    assert (r["n"], r["changes"], r["up"], r["down"]) == (7, 5, 2, 2)


def test_discovery(spark):
    """A planted motif is found again, and about how many sequences have it."""
    rng = random.Random(11)
    motif = "TGACGTCA"

    def noise(n):
        return "".join(rng.choice(DNA) for _ in range(n))

    rows, truth = [], {}
    for i in range(240):
        s = noise(60)
        if i % 4:
            at = rng.randrange(52)
            copy = "".join(c if rng.random() < 0.9 else rng.choice(DNA) for c in motif)
            s, truth[i] = s[:at] + copy + s[at + 8 :], at
        rows.append((i, s))
    df = spark.createDataFrame(rows, "id bigint, seq string")
    bg = spark.createDataFrame([(i, noise(60)) for i in range(240)], "id bigint, seq string")
    best = motifs.seeds(df, bg, "seq", "id", 5, 3)
    assert all(w in motif for w in best[:2])
    model, share = motifs.discover(df, "seq", 10, best[0], steps=8)
    assert share == pytest.approx(0.75, abs=0.12)
    text = "".join(DNA[int(np.argmax(row))] for row in model.logs)
    assert any(motif[k : k + 6] in text for k in range(3))
    found = motifs.occurrences(df, bg, "id", "seq", model, 0.001, both_strands=False)
    per = {r["id"]: r for r in motifs.bound(found, df, "id").collect()}
    hits = sum(per[i]["sites"] > 0 for i in truth)
    assert hits > 0.6 * len(truth) and len(per) == 240
    shift = text.find(motif[2:6]) - 2
    predicted = found.select("id", (F.col("pos") + shift).alias("pos"))
    r = motifs.assess(spark.createDataFrame(list(truth.items()), "id bigint, pos int"), predicted, 8, 1).first()
    assert r["sn"] > 0.6 and r["ppv"] > 0.6 and r["n_asp"] > 0.5


def test_attributes(spark):
    from strandwork.operators import stats

    df = spark.createDataFrame([(1, {"a": "x", "b": "y"}), (2, {"b": "z"}), (3, {})], "id bigint, m map<string,string>")
    got = stats.attributes_wide(df, ["id"], "m").orderBy("id").collect()
    assert [r.asDict() for r in got] == [{"id": 1, "a": "x", "b": "y"}, {"id": 2, "a": None, "b": "z"}]
