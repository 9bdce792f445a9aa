"""Joins by an array of keys take the whole of both tables."""

from __future__ import annotations

from collections import Counter

from tuplewise import queries as own

DATA = "/root/testdata/sf0.01"


def test_join_keys_array_whole(spark):
    suppliers, customers = (spark.read.parquet(f"{DATA}/{t}.parquet").collect() for t in ("supplier", "customer"))
    per_nation = Counter(c.c_nationkey for c in customers)
    got = own.QUERIES["join_keys_array"](spark, DATA)
    assert got.count() == sum(per_nation[s.s_nationkey] for s in suppliers)
    assert {r.s_suppkey for r in got.select("s_suppkey").distinct().collect()} == {s.s_suppkey for s in suppliers if per_nation[s.s_nationkey]}
