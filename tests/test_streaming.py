"""Streams against the same numbers of a table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandwork.operators import models
from strandwork.streaming import incremental as I

KIND = "id bigint, ts timestamp, k string, value double, seq string"


@pytest.fixture
def events(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    seconds = [0, 5, 20, 61, 62, 130, 131, 300, 301, 400]
    rows = [(i, start + dt.timedelta(seconds=s), "ab"[i % 2], float(i), "ACGT"[i % 4] * 3 + "AC") for i, s in enumerate(seconds)]
    for part in (rows[:4], rows[4:8], rows[8:]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), rows


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows(spark, events, tmp_path):
    folder, rows = events
    s = I.read_stream(spark, folder, KIND, per_trigger=1)
    got = drain(I.windowed(s, "ts", ["k"], "value", "1 minute", "10 seconds"), "w", "update", tmp_path)
    last = got.groupBy("start", "k").agg(F.max("n").alias("n"), F.max("total").alias("total"))
    want: dict = {}
    for _, ts, k, v, _ in rows:
        n, t = want.get((ts.replace(second=0), k), (0, 0.0))
        want[ts.replace(second=0), k] = n + 1, t + v
    assert {(r["start"], r["k"]): (r["n"], r["total"]) for r in last.collect()} == want
    slid = drain(I.windowed(s, "ts", [], "value", "2 minutes", "10 seconds", "1 minute"), "ws", "complete", tmp_path)
    assert sum(r["n"] for r in slid.collect()) == 2 * len(rows)


def test_sessions(spark, events, tmp_path):
    folder, _ = events
    s = I.read_stream(spark, folder, KIND)
    got = drain(I.sessions(s.withColumn("all", F.lit(1)), "ts", ["all"], "30 seconds", "1 hour"), "s", "complete", tmp_path)
    assert sorted(r["n"] for r in got.collect()) == [1, 2, 2, 2, 3]


def test_counts_and_scores(spark, events, tmp_path):
    folder, rows = events
    s = I.read_stream(spark, folder, KIND, per_trigger=1)
    got = drain(I.kmer_counts(s, "seq", 2), "c", "complete", tmp_path)
    want: dict = {}
    for r in rows:
        for i in range(4):
            want[r[4][i : i + 2]] = want.get(r[4][i : i + 2], 0) + 1
    assert {r["kmer"]: r["cnt"] for r in got.collect()} == want
    model = models.PWM("ACGT", [[-1.0, -2.0, -3.0, -4.0]] * 5)
    scored = drain(I.scored(s, model.score(F.col("seq"))), "sc", "append", tmp_path)
    table = spark.read.parquet(folder).withColumn("score", model.score(F.col("seq")))
    assert sorted(map(tuple, scored.select("id", "score").collect())) == sorted(map(tuple, table.select("id", "score").collect()))


def test_state(spark, events, tmp_path):
    folder, rows = events
    spark.read.parquet(folder).write.mode("append").parquet(folder)  # every row twice
    s = I.read_stream(spark, folder, KIND)
    once = drain(I.distinct_within(s, "ts", ["id"], "1 hour"), "d", "append", tmp_path)
    assert sorted(r["id"] for r in once.collect()) == list(range(len(rows)))


def test_smoothed(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), "ab"[i % 2], float(i * i), "A") for i in range(8)]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(folder)
    got = drain(I.smoothed(I.read_stream(spark, folder, KIND), "k", "ts", "value", 0.5), "m", "update", tmp_path)
    want = {}
    for _, _, k, v, _ in rows:
        want[k] = v if k not in want else 0.5 * want[k] + 0.5 * v
    assert {r["k"]: r["smoothed"] for r in got.collect()} == want
