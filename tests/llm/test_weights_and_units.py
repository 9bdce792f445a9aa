"""Importance weights recomputed from n-grams as text, and repeated units found by plain loops over words."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tuplewise.llm import importance, kernel
from tuplewise.llm import substring_dedup as sub


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def hashed(words):
    """The kernel's hash of each word, one by one."""
    return [int(next(kernel.words_of(pa.array([w]), kernel.SPACE_WORDS, False))[2].hash[0]) for w in words]


def test_importance_weights(spark):
    rnd = random.Random(5)
    vocabulary = ["Alpha", "beta", "GAMMA", "délta", "eps.", "zeta!", "eta", "theta"]
    texts = [(i, " ".join(rnd.choice(vocabulary[: 4 + i % 5]) for _ in range(rnd.randint(0, 40)))) for i in range(60)] + [(None, "alpha beta"), (61, None), (62, " \n "), (5, "beta beta")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(40)] + [(0, 0, "x"), (None, 1, "x"), (3, None, "x")], "doc_id long, quality int, tie string")
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, tie string, kept int")
    got = importance.importance_resample(frame, labels, share=0.3).collect()

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        return [(a,) for a in w] + list(zip(w, w[1:]))

    def bucket(gram, known={}):  # noqa: B006
        if gram not in known:
            known[gram] = int(kernel.grams(np.array(hashed(gram), dtype=np.uint64), len(gram))[0]) >> 50
        return known[gram]

    raw, target = Counter(), Counter()
    good = {i for i in range(40) if i % 3 == 0}
    for i, t in texts:
        for g in grams(t):
            raw[bucket(g)] += 1
            target[bucket(g)] += i in good
    n_raw, n_target, b = sum(raw.values()), sum(target.values()), importance.BUCKETS
    ratio = lambda x: math.log((target[x] + 1) / (n_target + b)) - math.log((raw[x] + 1) / (n_raw + b))
    want = sorted((str(i), sum(len(g) == 1 for g in grams(t)), round(sum(ratio(bucket(g)) for g in grams(t)), 9)) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_words, round(r.log_weight, 9)) for r in got) == want
    noise = {r.doc_id: r.g for r in frame.select("doc_id", importance.gumbel(importance.SEED, F.col("doc_id")).alias("g")).collect()}
    assert all(r.sampling_key == round((r.log_weight + noise[r.doc_id]) * 65536) for r in got)
    k = round(0.3 * len(texts))
    assert sorted((r.sampling_key for r in got if r.kept), reverse=True) == sorted((r.sampling_key for r in got), reverse=True)[:k]


def test_ties_at_the_last_rank_are_not_all_drawn(spark):
    rows = [(None, f"{'same words ' * 3}{'!' * (i % 4)}") for i in range(40)] + [(i, "other words") for i in range(40)]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for share in (0.1, 0.35, 0.6):  # without labels all weights are 0, and rows without an id have one noise
        got = importance.importance_resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, share=share).collect()
        assert 0 <= sum(r.kept for r in got) - round(share * 80) < 10  # ten rows are equal in id and text


def units_of(text):
    """(words of the unit, whether a line ends with it) by plain loops."""
    out = []
    for line in (text or "").split("\n"):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(line))
        if not w:
            continue
        h = hashed(w)
        mark = [x.encode()[-1:] in (b".", b"!", b"?") for x in w]
        pair = [int(kernel.mix(np.array([h[k]], dtype=np.uint64) * sub._ODD + np.uint64(h[k - 1]))[0]) for k in range(1, len(w))]
        value = [None] + [0 if mark[k] else pair[k - 1] | 1 for k in range(1, len(w))]
        ends = {k for k in range(len(w)) if mark[k]} | {len(w) - 1}
        for k in range(1, len(w) - sub.WINDOW + 1):
            window = range(k, k + sub.WINDOW)
            ends.add(min(window, key=lambda j: (value[j], -j)))
        start = 0
        for k in sorted(ends):
            out.append((tuple(w[start : k + 1]), k == len(w) - 1))
            start = k + 1
    return out


def test_removal_against_plain_loops(spark):
    rnd = random.Random(11)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("aeiou") + rnd.choice(["", ".", "!", "ß", "。", "X"]) + str(rnd.randrange(30))
    lines = [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    rows = []
    for i in range(120):
        parts = [rnd.choice(lines) if rnd.random() < 0.4 else " ".join(word() for _ in range(rnd.randint(1, 50))) for _ in range(rnd.randint(1, 6))]
        if i % 5 == 0:  # a stretch of another text, within a line
            other = rnd.choice(lines).split() + rnd.choice(lines).split()
            parts.append(" ".join([word() for _ in range(7)] + other + [word() for _ in range(4)]))
        rows.append((i if i % 11 else None, rnd.choice(["\n", "\n\n", " \n\t"]).join(parts) + rnd.choice(["", "\n", "  "])))
    rows += [(500, None), (501, ""), (502, "\n \n")]
    rank = {r.t: (r.i is None, r.k) for r in spark.createDataFrame(rows, "i long, t string").select("i", "t", F.coalesce("i", F.xxhash64("t")).alias("k")).collect()}
    first: dict = {}
    for _, t in rows:
        for u, _ in units_of(t):
            first[u] = min(first.get(u, (True, 1 << 70)), rank[t])
    want = []
    for i, t in rows:
        units, seen, repeat = units_of(t), set(), []
        for u, _ in units:
            repeat.append(u in seen or first[u] < rank[t])
            seen.add(u)
        gone, run, line = [False] * len(units), [], []
        for k in range(len(units) + 1):
            if k < len(units) and repeat[k]:
                run.append(k)
            else:
                if sum(len(units[j][0]) for j in run) >= sub.RUN_WORDS:
                    for j in run:
                        gone[j] = True
                run = []
        for k, (_, ends) in enumerate(units):
            line.append(k)
            if ends:
                if all(repeat[j] for j in line) and sum(len(units[j][0]) for j in line) >= sub.LINE_WORDS:
                    for j in line:
                        gone[j] = True
                line = []
        left = [w for (u, _), g in zip(units, gone) if not g for w in u]
        want.append((str(i), t is None, left))
    got = sub.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    key = lambda x: (x[0], x[1], x[2])
    assert sorted(((str(r.doc_id), r.text is None, re.findall(r"[^\x20\x09-\x0D]+", low(r.text))) for r in got), key=key) == sorted(want, key=key)
    assert sum(bool(r.removed_from) for r in got) > 40 and defaultdict(int, Counter(r.doc_id for r in got))[None] == 11
