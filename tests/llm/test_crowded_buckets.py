"""Near-duplicates where many rows have no id or one id, and where many pages share a template but no link."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tuplewise.llm import kernel
from tuplewise.llm import near_duplicates as near

SCHEMA = "doc_id long, text string"


def text(n, seed):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(10**9)}" for _ in range(n)]


def test_rows_without_an_id_or_with_one_id(spark):
    texts = [" ".join(text(30, i // 3) + (["end"] if i % 3 else [])) for i in range(3000)]  # a text, and twice its near copy
    for rows in ([(None, t) for t in texts], [(7, t) for t in texts]):
        got = near.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == 3000 and {r.component_id for r in got} == {rows[0][0]} and all(r.kept for r in got)
    got = near.near_duplicates(spark.createDataFrame([(i if i % 3 == 2 else None, t) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert sorted(r.component_id for r in got) == sorted(3 * (i // 3) + 2 for i in range(3000)) and sum(r.kept for r in got) == 1000


def test_pages_of_a_template_are_not_all_compared(spark, monkeypatch):
    template, tests = text(170, "t"), []
    confirmed = near._confirmed
    monkeypatch.setattr(near, "_confirmed", lambda edges, sets: tests.append(edges.count()) or confirmed(edges, sets))
    rows = []
    for i in range(3000):  # similarity 0.7 to each other; every tenth has a copy with another last word
        rows.append((i, " ".join(template + text(40, i))))
        if i % 10 == 0:
            rows.append((10_000 + i, rows[-1][1] + " more"))
    got = near.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i % 10_000) for i, _ in rows}
    assert sum(tests) < 60_000 and len(tests) < 6  # all pairs would be 5,400,000


def test_words_that_met_by_construction():
    pattern = lambda n, a, b: "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))
    for n in (1024, 2048, 4096):
        words = pa.array([pattern(n, "x", "y"), pattern(n, "y", "x")])
        _, _, got = next(kernel.words_of(words, kernel.SPACE_WORDS, True))
        assert len(np.unique(got.hash)) == 2
