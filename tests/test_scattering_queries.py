"""Every registered scattering query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from quartzfield.plans import scale_queries  # noqa: F401  registers its queries
from quartzfield.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = [sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)) for df in (ours, theirs)]
    assert rows[0] == rows[1]
