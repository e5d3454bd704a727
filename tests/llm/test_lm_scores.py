"""What the model knows of texts that it hasn't seen, against the unigram base over words."""

from strandwork.llm import entry
from tests.conftest import SMALL


def test_close_to_the_base(spark):
    """Eight hundred texts teach the model about as much as they teach word counts; with more it gets ahead (README)."""
    rows = entry.op7_lm_scoring(spark, SMALL.replace("0.001", "0.01")).where("held_out").collect()
    assert len(rows) > 150
    score, base = sum(r["score"] for r in rows), sum(r["base_score"] for r in rows)
    assert score > 1.08 * base, (score, base)
