"""What SQL can say of operators whose whole results it can't, on given tables and on odd texts."""

import os

import duckdb
import pytest

from corpusloom.llm import queries

DATA = "/root/testdata/sf0.001"
NAMES = ("bpe_decoded_text", "private_base_spans", "quality_statistics", "winnowing_edits")

ODD = [
    None, "", " \n\t", "a b c a b c a b", "x\nx\n \n \nX\nx", "é😀 #1 <b>\u00a0</b>\n", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8", "a@b.c,d@e.f. a@b @c.d é a@b.cc",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (234) 567-8901 or +12 or +1234567890123456", "😀 +49 30 1234567 x@y.zz 10.0.0.1",
]


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if os.path.isfile(f'{folder}/{t}.parquet') else '/*.parquet'}')")
    want = con.execute(queries.ORACLES[name])
    names = sorted(x[0] for x in want.description)
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == names
    at = [[x[0] for x in want.description].index(n) for n in names]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_given_tables(spark, name):
    compare(spark, DATA, name)


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(spark, tmp_path, name):
    rows = [(i, t) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    compare(spark, str(tmp_path), name)
