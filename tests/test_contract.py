"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, (bool, int, float)):
        return (1, "nan") if isinstance(v, float) and math.isnan(v) else (1, repr(float(v)))
    return (2, str(v))


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert table(df.collect(), df.columns) == table(result.fetchall(), result.columns)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_returns_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    got = {r["label"]: r["users"] for r in entry.entry(spark).collect()}
    assert got["bookie"] == 2


def test_every_oracle_has_a_query():
    from tidewatch.contract.oracles import ORACLES

    assert set(ORACLES) <= set(entry.queries())


def test_documents_are_cleaned_whole(spark):
    import hashlib

    from tests.test_functions import expected_clean

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entry.queries()["etl_desc_documents"](spark, SF).collect():
        clean = expected_clean(texts[r["doc_id"]])
        assert r["n_chars"] == len(clean)
        assert r["digest"] == hashlib.md5(clean.encode()).hexdigest()
