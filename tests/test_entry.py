"""Every registered query of the algebra against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tuplewise import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def norm(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, db, name):
    df = own.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(norm(r[n]) for n in names) for r in df.collect())
    rel = db.sql(own.SQL[name])
    at = [list(rel.columns).index(n) for n in names]
    assert sorted(rel.columns) == names and got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5 and set(own.QUERIES) <= set(entry.queries())
