"""The ten corpus operators as queries: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm import bpe, fingerprints, lm_scoring, packing, quality_rules, secret_scan, simhash, substring_dedup, toxicity, warc
from strandwork.llm._common import materialize, shared_dir, table

SEQUENCE_TOKENS = 2048


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(simhash.fingerprint(table(spark, sf_dir, "documents")), "simhash")
    found = simhash.classes(prints)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_bpe_encoding_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), outputs=("ids_sha256", "decoded_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files, path = warc.open_fs(folder)
    files.create_dir(path, recursive=True)
    pages = table(spark, sf_dir, "pages")
    written = materialize(warc.write(pages, folder), "warc-written")
    members = materialize(warc.normalise(warc.spread(written), folder), "warc-members")
    found = warc.read(warc.spread(members), folder, pages.schema["page_id"].dataType.simpleString())
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), SEQUENCE_TOKENS)
    return packing.pack(parts, SEQUENCE_TOKENS)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    every = F.array_union("base", "live")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"), said(F.sort_array(every)).alias("spans"), F.size("live").alias("n_live"))


def queries() -> dict:
    every = (
        op1_document_fingerprints,
        op2_suffix_array_dedup,
        op3_toxicity,
        op4_simhash_near_dedup,
        op5_bpe_encoding_decoding,
        op6_warc,
        op7_lm_scoring,
        op8_quality_rules,
        op9_best_fit_packing,
        op10_secret_scans,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {}
