"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(repr([show(r[i]) for i in order]) for r in records)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = con.execute(catalog.SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([x[0] for x in want.description], want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "chunk_id", "doc_id", "score", "text"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
