"""A corpus pipeline of five stages, each one of the ten operators.

Every stage works on all rows that the one before it kept. The stages that change texts bring ``n_chars`` in line; a
null text stays null, and so does a null count of a text that didn't change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm import near_groups, packing, quality_rules, secret_scan, substring_dedup
from strandwork.llm._common import materialize, table
from strandwork.llm.entry import SEQUENCE_TOKENS, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that op4 links (SimHash fingerprints at four differing bits or fewer), or that are alike by 0.8 or more
    (Jaccard of five-word shingles, which the bits alone can't find), that with the smallest id stays."""
    return near_groups.keep_first(docs, simhash_too=True)


def _counted(docs: DataFrame, before: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = before.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What repeats by 200 bytes or more is cut out of the texts."""
    return _counted(substring_dedup.cut_docs(docs), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked."""
    return _counted(secret_scan.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed in sequences."""
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), SEQUENCE_TOKENS), SEQUENCE_TOKENS)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeats),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]
#: SQL can't express the stages (polynomial hashes, codes, tokenizers); tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
