"""Incremental forms on Structured Streaming: counts, windows, sessions, sequences scored as they come, smoothing with
state. Checkpoints and sinks are the caller's."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions.scalar import windows


def read_stream(spark: SparkSession, folder: str, schema, kind: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(folder)


def windowed(stream: DataFrame, ts: str, keys: list[str], value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; rows later than ``late`` are dropped by the watermark."""
    by = F.window(ts, width, slide) if slide else F.window(ts, width)
    found = stream.withWatermark(ts, late).groupBy(by.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    found = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def kmer_counts(stream: DataFrame, seq: str, k: int) -> DataFrame:
    """Running k-mer counts (complete or update mode)."""
    return stream.select(F.explode(windows(F.col(seq), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("cnt"))


def scored(stream: DataFrame, score: Column, out: str = "score") -> DataFrame:
    """Scoring is a projection, so a fitted model's expression works on a stream as on a table."""
    return stream.withColumn(out, score)


def distinct_within(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def smoothed(stream: DataFrame, key: str, ts: str, value: str, rate: float = 0.2) -> DataFrame:
    """Exponentially smoothed value of each key after each trigger, with state kept between triggers."""

    def step(k, batches: Iterator, state):
        import pandas as pd

        (now,) = state.get if state.exists else (None,)
        for rows in batches:
            for x in rows.sort_values(ts)[value]:
                now = float(x) if now is None else (1 - rate) * now + rate * float(x)
        state.update((now,))
        yield pd.DataFrame({key: [k[0]], "smoothed": [now]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, smoothed double", "now double", "update", "NoTimeout")
