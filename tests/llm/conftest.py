import pytest

from tests.conftest import SMALL
from tests.llm.data import SCHEMA, awkward


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, ties and repeated texts."""
    where = str(tmp_path_factory.mktemp("odd"))
    rows = awkward()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(r[0], r[0] % 2, r[0] % 3 == 0 and 1 or 0) for r in rows[::2]] + [(None, None, None), (6, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    pages = [(i, f"http://x/{i}" if i % 4 else None, t) for i, (_, t, *_) in enumerate(rows)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3).write.parquet(f"{where}/pages.parquet")
    return where


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{where}/{t}.parquet")
    return where


@pytest.fixture(scope="session", params=["odd", "small"])
def any_dir(request, odd_dir):
    return odd_dir if request.param == "odd" else SMALL


@pytest.fixture(scope="session")
def docs_of(spark):
    def read(sf_dir, name="documents"):
        return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]

    return read
