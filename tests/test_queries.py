"""Every registered query of the media engine against its oracle, on the smallest tables."""

import os

import duckdb
import pytest

import mediaprism.more_queries  # noqa: F401 - registers its queries
from mediaprism import queries

DATA = "/root/testdata/sf0.001"
TABLES = "part pages documents events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(rows):
    plain = lambda v: None if v is None else round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(df.select(*want.columns).collect()) == canonical(want.fetchall())


def test_every_query_has_an_oracle():
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
