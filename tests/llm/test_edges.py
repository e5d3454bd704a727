"""Null ids, repeated rows, extra columns with clashing names, and very long texts, by value."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from strandwork.llm import _common, bpe, entry, fingerprints, lm_scoring, near_groups, packing, quality_rules, secret_scan, simhash, substring_dedup, toxicity, warc
from tests.llm import brute

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORD, BYTE = (entry.tokenizer_path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


@pytest.fixture(scope="module")
def clashing(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    more = {c: F.lit(7) for c in ("id", "key", "row", "c0", "k1", "live", "found", "start", "kept", "low", "__text", "next", "length", "fp", "ids", "sha", "payload", "turn", "score", "label", "piece", "block")}
    # one task, so that what models learn doesn't depend on how rows are dealt
    return docs.unionByName(docs.where("doc_id % 4 = 0")).unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("bigint"))).withColumns(more).coalesce(1)


def _pages(docs):
    spark = docs.sparkSession
    folder = f"{_common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files, path = warc.open_fs(folder)
    files.create_dir(path, recursive=True)
    pages = docs.withColumn("url", F.col("source"))
    written = _common.materialize(warc.write(pages, folder, "doc_id", "url", "text"), "w")
    members = _common.materialize(warc.normalise(written, folder), "m")
    return warc.read(members, folder).drop("row")


def _classes(docs):
    return simhash.classes(_common.materialize(simhash.fingerprint(docs), "prints"))


def _labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()


OPERATORS = {
    "fingerprints": fingerprints.compare_edited, "substring": substring_dedup.dedup, "cut": substring_dedup.cut_docs, "near": near_groups.keep_first, "quality": quality_rules.measure, "good": quality_rules.keep_good,
    "secrets": secret_scan.scan, "redact": secret_scan.redact, "packing": lambda d: packing.pack(packing.pieces(d, WORD, 64), 64).drop("sequence_id", "offset"), "toxicity": lambda d: toxicity.score(d, _labels(d)),
    "simhash": _classes, "bpe": lambda d: bpe.encode(d, BYTE), "lm": lambda d: lm_scoring.score(d, WORD), "warc": _pages,
}


def _rows(df, names):
    return sorted(repr(tuple(r)) for r in df.select(*names).collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing(clashing, name):
    """The same values as without the extra columns, which whole rows keep."""
    got, plain = OPERATORS[name](clashing), OPERATORS[name](clashing.select(*COLUMNS))
    if name in ("cut", "near", "good", "redact"):
        assert got.columns == clashing.columns
        names = plain.columns
        assert _rows(got, got.columns) == sorted(repr(tuple([*eval(r), *[7] * (len(got.columns) - len(names))])) for r in _rows(plain, names))
    else:
        names = [c for c in plain.columns if c not in ("url",)]
        rows = _rows(got, names)
        assert rows == _rows(plain, names)
        if name != "packing":
            assert len(rows) == clashing.count()


def test_repeated_rows(clashing):
    """What brute force says of rows with null and repeated ids."""
    rows = clashing.select(*COLUMNS).collect()
    texts = [r["text"] for r in rows]
    cut = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(clashing).collect()}
    want = {(r["doc_id"], len((t or "").encode()), len((t or "").encode()) - len(k), hashlib.sha256(k).hexdigest()) for r, t, s in zip(rows, texts, brute.repeats([t or "" for t in texts])) for k in [brute.cut(t or "", s)]}
    assert cut == want
    prints = [brute.simhash(t or "") for t in texts]
    ids = [r["doc_id"] if r["doc_id"] is not None else 10**9 for r in rows]
    low = brute.classes(prints, ids, 4)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else 10**9, r["fp"] % 2**64, r["component_id"]) for r in _classes(clashing).collect()) == sorted(zip(ids, prints, low))
    first: dict = {}
    for r in rows:
        first.setdefault(r["text"] or "", []).append(r["doc_id"])
    pages = _pages(clashing).collect()
    for r in pages:
        assert r["record_type"] in ("response", "revisit")
        if r["record_type"] == "revisit":
            assert r["refers_to"] is not None and (r["page_id"] is None or r["refers_to"] < r["page_id"])
    least = {min(i for i in v if i is not None) for v in first.values()}
    assert {r["page_id"] for r in pages if r["record_type"] == "response"} == least


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(9)
    words = ["alpha", "Beta", "don't", "straße", "12.5", "x|y", "中文", "token=abcdef1", "end.\n"]
    return " ".join(rng.choice(words) + (str(rng.randrange(1000)) if rng.random() < 0.3 else "") for _ in range(140_000))


def test_very_long_text(spark, long_text):
    from tokenizers import Tokenizer

    assert len(long_text.encode()) > 1_000_000
    docs = spark.createDataFrame([(1, long_text, "en", "a", 1), (2, long_text[500:], "en", "b", 1), (3, "short text", "en", "c", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")

    def of(df, key="doc_id"):
        return {r[key]: r for r in df.collect()}

    got = of(quality_rules.measure(docs))
    assert tuple(got[1][c] for c in (*quality_rules.COUNTS, "base_failed")) == brute.quality(long_text)
    assert of(simhash.fingerprint(docs))[1]["fp"] % 2**64 == brute.simhash(long_text)
    assert of(fingerprints.compare_edited(docs))[1]["sketch"] == brute.sketch(long_text)
    for path, n, extra in ((BYTE, lambda: of(bpe.encode(docs, BYTE))[1]["n_tokens"], 0), (WORD, lambda: sum(r["length"] for r in packing.pieces(docs, WORD, 2048).collect() if r["doc_id"] == 1), 1)):
        library = Tokenizer.from_file(path)
        library.no_truncation()
        assert n() == len(library.encode(long_text, add_special_tokens=False).ids) + extra
    assert len(of(secret_scan.scan(docs))[1]["base"]) == len(brute.secrets(long_text))
    cut = of(substring_dedup.dedup(docs))
    n = len(long_text.encode()) - len(long_text[:500].encode())
    assert (cut[2]["n_bytes"], cut[2]["n_removed"], cut[3]["n_removed"]) == (n, n, 0) and cut[1]["n_removed"] >= n
    assert {r["doc_id"] for r in near_groups.keep_first(docs).collect()} == {1, 3}
    scores = of(lm_scoring.score(docs, WORD))
    assert scores[1]["n_tokens"] == len(brute.words(long_text)) + 1 and scores[1]["score"] < scores[3]["score"] < 0
    assert 0 <= of(toxicity.score(docs, _labels(docs)))[1]["score"] <= 1
    pages = of(_pages(docs), "page_id")
    assert bytes(pages[1]["payload"]).decode() == long_text
