"""Every query with SQL gives the rows that DuckDB gives; those without run and give rows."""

import math
import os

import duckdb
import pytest

from strandwork.plans.catalog import QUERIES, SQL
from tests.conftest import SMALL

DIR = os.environ.get("ORACLE_DIR", SMALL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5) + 0.0
        return int(x) if isinstance(x, int) and not isinstance(x, bool) else x

    return sorted(([cell(r[i]) for i in order] for r in rows), key=repr), sorted(names)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, DIR)
    got, names = plain([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(SQL[name])
    want, want_names = plain(cur.fetchall(), [c[0] for c in cur.description])
    assert names == want_names
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a == b or all(x == y or (isinstance(x, float) and x == pytest.approx(y, abs=2e-5)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
