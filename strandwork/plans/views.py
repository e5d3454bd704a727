"""Views of the driver's tables as sequences, scores, intervals, signals and vectors, each also as DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators.words import BATCH_BYTES

LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_DNA = "ACGTACGTACGTACGTACGTACGTAC"
_CODES = np.zeros(256, np.uint8)
for _letter, _symbol in zip(LETTERS, AS_DNA):
    _CODES[[ord(_letter), ord(_letter.upper())]] = ord(_symbol)


def as_dna(texts: pa.Array) -> pa.Array:
    """The letters of texts without nulls, dealt to A, C, G, T, byte by byte through one table (bytes of other symbols are
    none of letters). Patterns and translations took 320 ns a symbol in the JVM."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    new = _CODES[data]
    kept = np.zeros(len(new) + 1, np.int32)
    np.cumsum(new > 0, out=kept[1:])
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(kept[ends - ends[0]].astype(np.int64)), pa.py_buffer(new[new > 0])).cast(pa.string())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_id, seq, weight``: the letters of every whole text, dealt to A, C, G, T."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.arrow_udf(as_dna, "string")(F.coalesce("text", F.lit(""))).alias("seq"), (F.col("doc_id") % 5 + 1).cast("double").alias("weight"))


SEQS = f"""seqs AS (SELECT doc_id AS seq_id, translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{AS_DNA}') AS seq,
 CAST(doc_id % 5 + 1 AS DOUBLE) AS weight FROM documents)"""


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, seq, class_id, weight``: sequences of one length in two classes."""
    digits = F.translate(F.lpad((F.col("p_partkey") * 7919 % 65536).cast("string"), 6, "0"), "0123456789", "ACGTACGTAC")
    tail = F.translate(F.lpad(F.col("p_size").cast("string"), 2, "0"), "0123456789", "ACGTACGTAC")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(digits, tail).alias("seq"), F.when(F.col("p_size") > 25, 0).otherwise(1).alias("class_id"), (F.col("p_size") % 4 + 1).cast("double").alias("weight"))


BRANDS = """brands AS (SELECT p_partkey AS id, translate(lpad(CAST(p_partkey * 7919 % 65536 AS VARCHAR), 6, '0'), '0123456789', 'ACGTACGTAC')
 || translate(lpad(CAST(p_size AS VARCHAR), 2, '0'), '0123456789', 'ACGTACGTAC') AS seq, CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS class_id, CAST(p_size % 4 + 1 AS DOUBLE) AS weight FROM part)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, class_id, score, weight``: orders, two classes."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("class_id"), F.round("o_totalprice", 0).alias("score"), (F.col("o_custkey") % 3 + 1).cast("double").alias("weight"))


SCORES = "scores AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS class_id, round(o_totalprice, 0) AS score, CAST(o_custkey % 3 + 1 AS DOUBLE) AS weight FROM orders)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, chrom, start, end, strand, cov``: one for each line item, chromosomes are suppliers."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("chrom"), (F.col("l_partkey") * 17 + F.col("l_linenumber") * 5).alias("start"),
        (F.col("l_partkey") * 17 + F.col("l_linenumber") * 5 + F.col("l_quantity").cast("bigint")).alias("end"), F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"), F.round(F.col("l_discount") * 100).cast("bigint").alias("cov"), F.col("l_returnflag").alias("flag"),
    )


INTERVALS = """intervals AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS chrom, l_partkey * 17 + l_linenumber * 5 AS "start",
 l_partkey * 17 + l_linenumber * 5 + CAST(l_quantity AS BIGINT) AS "end", CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, CAST(round(l_discount * 100) AS BIGINT) AS cov, l_returnflag AS flag FROM lineitem)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, chrom, pos, value``: events, seconds as places."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("chrom"), F.unix_timestamp("ts").alias("pos"), "value")


SIGNAL = "signal AS (SELECT event_id AS id, event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS pos, value FROM events)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


VECTORS = "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
