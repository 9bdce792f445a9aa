"""Any 50 words that repeat inside a line are found, with or without sentence marks."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tuplewise.llm import kernel
from tuplewise.llm import substring_dedup as sub


def prose(n, seed, mark=""):
    rnd = random.Random(seed)
    return [f"w{rnd.randint(0, 10**6)}{mark if rnd.random() < 0.1 else ''}" for _ in range(n)]


def test_passages_inside_lines(spark):
    rows = []
    for k in range(200):
        mark, passage = ("", "。", ".")[k % 3], prose(50 + k % 3, 3 * k, ("", "。", ".")[k % 3])
        for copy in (0, 1):
            before, after = prose(20 + k % 7, 1000 + 2 * k + copy, mark), prose(15 + k % 11, 5000 + 2 * k + copy, mark)
            rows.append((copy * 1000 + k, " ".join(before + passage + after), " ".join(passage)))
    out = sub.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, passage string")).collect()
    for r in out:
        words, kept = r.passage.split(), r.text.split()
        left = sum(w in set(kept) for w in words)
        assert left == len(words) if r.doc_id < 1000 else left <= len(words) - sub.RUN_WORDS, (r.doc_id, left)


def test_passages_over_lines():
    for k in range(300):
        rnd, shared = random.Random(k), prose(50, k)
        joined = "".join(w + ("\n" if rnd.random() < 0.05 else " ") for w in shared)
        texts = [" ".join(prose(9 + k % 9, 10**4 + k + 10**5 * c)) + f" {joined}" + " ".join(prose(9, 10**6 + k + 10**5 * c)) for c in (0, 1)]
        (_, _, words), = kernel.words_of(pa.array(texts), kernel.SPACE_WORDS, True)
        units = sub.Units(words)
        first, second = units.digest[: units.first[1]], units.digest[units.first[1] :]
        gone = np.isin(second, first)
        runs = np.cumsum(np.r_[True, gone[1:] != gone[:-1]]) - 1
        assert np.bincount(runs, weights=units.size[units.first[1] :] * gone).max() >= sub.RUN_WORDS
