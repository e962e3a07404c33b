"""Every query with SQL, at the smallest scale, against DuckDB."""

import os

import duckdb
import pytest

from quire.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    cur = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()], key=str)
    assert got == want


def test_registry_needs_no_session():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
