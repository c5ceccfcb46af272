"""Every record-pipeline query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from recordmill.queries import crawls, feeds, pages, pipelines, records, services, texts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = {**feeds.QUERIES, **texts.QUERIES, **pipelines.QUERIES, **records.QUERIES, **crawls.QUERIES, **services.QUERIES, **pages.QUERIES}, {**feeds.SQL, **texts.SQL, **pipelines.SQL, **records.SQL, **crawls.SQL, **services.SQL, **pages.SQL}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def tidy(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.4f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(tidy(v) for v in r) for r in df.select(*columns).collect())
    want = con.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(tidy(v) for v in r) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
