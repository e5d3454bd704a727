"""The pipeline stage by stage, each on its own input, against brute force; and run() as a whole."""

import pytest

import corpus_pipeline
from strandwork.llm import quality_rules
from tests.conftest import SMALL
from tests.llm import brute

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """The rows before and after each stage, on the small tables."""
    out, docs = {}, spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SMALL)
        assert k == 4 or made.columns == docs.columns
        path = str(tmp_path_factory.mktemp("chain") / str(k))
        made.write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = [tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()]
        docs = after
    return out


def test_quality(chain):
    before, after = chain["quality rules"]
    limits = quality_rules.DEFAULT

    def good(text):
        n, chars, symbols, _, _, failed = brute.quality(text)
        return not failed and brute.line_share(text) <= limits.line_share and symbols <= limits.symbol_share * max(1, chars) and all(brute.shares(text, k) <= most for k, most in limits.ngram_share)

    assert sorted(after) == sorted(r for r in before if good(r[1]))


def test_near_copies(chain):
    """Against the exact Jaccard of all pairs of rows, grouped by links."""
    before, after = chain["SimHash near-dedup"]
    sets = [brute.shingles(r[1], 5) for r in before]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or len(a & b) >= 0.8 * len(a | b)]
    want = [r for r, low in zip(before, brute.lowest([r[0] for r in before], links)) if r[0] == low]
    assert sorted(after) == sorted(want)


def test_repeats(chain):
    before, after = chain["suffix-array dedup"]
    got = {r[0]: r for r in after}
    for r, spans in zip(before, brute.repeats([r[1] or "" for r in before])):
        text = brute.cut(r[1] or "", spans).decode("utf-8", "ignore")
        assert got[r[0]] == (r[0], text, r[2], r[3], len(text))


def test_secrets(chain):
    before, after = chain["secret scans"]
    got = {r[0]: r for r in after}
    for r, spans in zip(before, brute.live([(r[1], r[3], r[2]) for r in before])):
        text = brute.redact(r[1] or "", spans)
        assert got[r[0]] == (r[0], text, r[2], r[3], len(text))


def test_packing(chain):
    before, after = chain["best-fit packing"]
    assert {r[0] for r in after} == {r[0] for r in before}


def test_run(spark, chain):
    got = corpus_pipeline.run(spark, SMALL)
    # the last stage's numbers are any; pieces are what they are
    assert sorted(r[:5] for r in map(tuple, got.collect())) == sorted(r[:5] for r in chain["best-fit packing"][1])


def test_odd_tables(spark, odd_dir, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert {r[0] for r in stage(spark, docs, odd_dir).collect()} <= ids, name
    assert corpus_pipeline.run(spark, odd_dir).count() > 0
