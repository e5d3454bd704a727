"""Containment and merging, which the sketches are for."""

import random

import pytest
from pyspark.sql import functions as F

from strandwork.llm import fingerprints
from tests.llm import brute


def test_containment_of_unequal_texts(spark):
    rng = random.Random(2)
    words = [f"w{rng.getrandbits(30)}" for _ in range(30_000)]
    long, part = " ".join(words), " ".join(words[1000:4000])
    half = " ".join(words[5000:7000] + [f"x{k}" for k in range(2000)])
    df = spark.createDataFrame([(part, long), (half, long), (long, part), ("", long), ("a b", long)], "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    got = [r[0] for r in df.select(fingerprints.containment(a, b)).collect()]
    # of 2996 and 3996 shingles one in eight is kept: three standard deviations
    assert got[0] == 1.0 and got[1] == pytest.approx(0.5, abs=0.07) and got[2] == pytest.approx(0.1, abs=0.02)
    assert got[3] == 1.0 and got[4] == 0.0


def test_merge(spark):
    rng = random.Random(3)
    rows = [tuple(" ".join(f"w{rng.randrange(40)}" for _ in range(n)) for n in (rng.choice([0, 3, 5, 6, 60, 400]), rng.choice([0, 3, 5, 6, 60, 400]))) for _ in range(40)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(fingerprints.merge(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).collect()]
    limit = -(2**63) + 2**64 // fingerprints.FRACTION
    for (a, b), mine in zip(rows, got):
        every = set(brute.sketch(a)) | set(brute.sketch(b))
        low = {h for h in every if h < limit}
        assert mine == sorted(low or ({min(every)} if every else set()))
