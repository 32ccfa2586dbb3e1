"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from corvina.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0" + str(v)  # unlike any text
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf)
    want = duck.sql(plans.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    ours = sorted(tuple(text(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert ours == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())


def test_every_query_is_registered(spark):
    assert plans.QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0


def test_chunks(spark, sf):
    from corvina.operators.corpus import chunk_bounds

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = plans.QUERIES["chunk_documents"](spark, sf).collect()
    assert sorted((r.id, r.pos, r.n_chars) for r in got) == sorted((d, i, len(c)) for d, t in docs.items() for i, c in enumerate(chunk_bounds(t)))
    for t in docs.values():
        pieces = list(chunk_bounds(t))
        assert all(0 < len(p) <= 3000 for p in pieces)
        at = 0
        for p in pieces:  # in order, and nothing but white space between or around them
            found = t.find(p, max(0, at - 121))
            assert found >= 0 and not t[at:found].strip()
            at = found + len(p)
        assert not t[at:].strip()
