"""The groups of near copies don't depend on how the rows are dealt to tasks."""

from strandwork.llm import near_groups
from tests.conftest import SMALL


def test_dealt_otherwise(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    found = [
        sorted(r[0] for r in near_groups.keep_first(docs.repartition(n, "doc_id")).select("doc_id").collect())
        for n in (3, 17)
    ]
    assert found[0] == found[1]
