"""Opaque tokens of any length are found and masked."""

from strandwork.llm import secret_scan
from tests.llm import brute


def test_long_opaque_token(spark):
    token = "aB3" * 100
    docs = spark.createDataFrame([(1, f"see {token} here", "s", "en")], "doc_id bigint, text string, source string, lang string")
    r = secret_scan.scan(docs).first()
    assert [(s["kind"], s["start"], s["end"]) for s in r["live"]] == [("owned", 4, 304)]
    assert secret_scan.redact(docs).first()["text"] == "see [SECRET] here"


def test_many_matches(spark):
    """More matches than a block holds: places are right to the last."""
    text = "é ".join(f"token={i:06d}x" for i in range(300)) + " AKIA" + "A" * 20
    docs = spark.createDataFrame([(1, text, "s", "en"), (2, None, None, None)], "doc_id bigint, text string, source string, lang string")
    r, none = secret_scan.scan(docs).orderBy("doc_id").collect()
    want = brute.secrets(text)
    assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["base"]] == [s[:4] for s in want] and len(want) == 301
    assert none["base"] == []
    assert secret_scan.redact(docs).orderBy("doc_id").first()["text"] == "é ".join(["[SECRET]"] * 300) + " [SECRET]"


def test_copied_examples_stay(spark):
    example = "password = correcthorse"
    rows = [(i, f"{example} {i}", f"s{i}", "en") for i in range(4)] + [(9, "password = own-secret-9 " + example, "s9", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    assert got == {i: f"{example} {i}" for i in range(4)} | {9: "[SECRET] " + example}
