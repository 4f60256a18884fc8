"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from proofmill import catalogue, catalogue_evidence, catalogue_filings, catalogue_findings  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in catalogue.SQL:
        assert got
        return
    want = duck.sql(catalogue.SQL[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_chunks(spark):
    from proofmill.operators import claims

    rows = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate([5, 6, 4, 11, 1])], "doc string, n int, b string")
    got = claims.chunks(rows, "doc", "n", "b", cap=10).orderBy("chunk").collect()
    assert [(r["first"], r["last"], r["bytes"]) for r in got] == [(0, 0, 5), (1, 2, 10), (3, 3, 11), (4, 4, 1)]


def test_journal(spark, tmp_path):
    from proofmill.sources import journals

    events = spark.createDataFrame([(1, "s-000001", None, "s", 5, "stage", "{}"), (1, "s-000002", "s-000001", "s", 6, "llm", "x" * 5000)], journals.EVENT)
    journals.write_events(events, f"{tmp_path}/j")
    assert [r.id for r in journals.read_events(spark, f"{tmp_path}/j").collect()] == ["s-000001"]
