"""The text operators against brute force, on small tables with nulls, repeats and odd texts."""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tuplewise.llm import near_duplicates as near
from tuplewise.llm import pieces
from tuplewise.llm import quality_rules as quality
from tuplewise.llm import substring_dedup as sub
from tuplewise.llm.decontaminate import decontaminate
from tuplewise.llm.importance import importance_resample, key_at_rank
from tuplewise.llm.pieces import Encoder, decode, encode_decode
from tuplewise.llm.queries import model_path
from tuplewise.llm.token_counts import token_counts
from tuplewise.llm.tool_calls import link_tool_calls
from tuplewise.llm.toxicity import THRESHOLD, toxicity
from tuplewise.llm.warc import read_warc, write_warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, node string"


def docs(spark, rows):
    """Rows (doc_id, text), with extra columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en" if t else None, "s", None if t is None else len(t), "x", "y") for i, t in rows], DOC)


def words(n, seed):
    rnd = random.Random(seed)
    return [rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()) + str(rnd.randint(0, 40)) for _ in range(n)]


ODD = [(None, None), (None, "null id"), (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "Repeat " * 60), (905, "é" * 3000), (906, " ".join(words(30_000, 5))), (907, "same text\nsame text\n" * 3), (907, "same text\nsame text\n" * 3)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = list(ODD)
    passage = " ".join(words(70, 99)) + "."
    for i in range(60):
        w = words(80 + i, i)
        rows.append((i, " ".join(w)))
        if i % 3 == 0:  # near copies, exact copies, and texts that share a passage
            changed = list(w)
            changed[i % len(w)] = "changed"
            rows.append((100 + i, " ".join(changed).upper()))
        if i % 10 == 0:
            rows.append((200 + i, " ".join(w)))
        if i % 7 == 0:
            rows.append((300 + i, f"{' '.join(words(20, i + 500))} {passage}\n{' '.join(words(12, i + 700))}"))
    return docs(spark, rows).repartition(3).cache()


def empty(spark):
    return docs(spark, [])


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_decontaminate(spark, corpus):
    rows = corpus.select("doc_id", "text").collect()
    own = [r.text for r in rows if r.doc_id in (3, 12)]
    items = [(1, " ".join(own[0].split()[5:40])), (10, own[1].upper()), (2, "alpha1 BETA2"), (3, None), (4, "..."), (5, words(1, 3)[0]), (None, "one"), (10, "repeat repeat repeat"), (7, "Repeat " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = pattern.findall(low(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    want = []
    for r in rows:
        w, hit, found = pattern.findall(low(r.text)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= {str(i) for i in windows[tuple(w[k : k + n])] if i is not None}
        want.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    for size in (8 << 20, 100):
        got = decontaminate(corpus, bench, block_bytes=size).collect()
        assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
        assert all(r.n_hit == sum(b - a for a, b in zip(r.hit_from, r.hit_to)) for r in got)
    assert decontaminate(empty(spark), bench).count() == 0 and decontaminate(corpus, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_warc(spark, tmp_path):
    big = "x" * 150
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (None, "u", big), (2, "http://b\r\nX: y", big)]
    rnd = random.Random(2)
    for k in range(10, 60):
        rows.append((k, "u", "".join(rnd.choice(["abc", "é", "\r\n\r\n", "WARC/1.1\r\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "0123456789" * 9]) for _ in range(rnd.randint(0, 9)))))
    rows += [(70, "u", "".join(f"WARC/1.1\r\nContent-Length: {k % 9}\r\n\r\n{'z' * (k % 13)}\r\n\r\n" for k in range(4000))), (71, "after", "WARC/1.1\r\nContent-Length: 9223372036854775800\r\n\r\n")]
    first = {}
    for i, _, h in rows:
        if i is not None and len(data := (h or "").encode()) >= 100:
            first[data] = min(i, first.get(data, i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and first.get(data, i) < i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    write_warc(pages.repartition(2), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "3000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = read_warc(spark, str(tmp_path / "w")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    write_warc(pages.limit(0), str(tmp_path / "e"))
    assert read_warc(spark, str(tmp_path / "e")).count() == 0


def test_pieces_and_counts(spark, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rows = encode_decode(corpus, model_path())
    assert {"lang", "kept"} <= set(rows.columns)
    for r in rows.collect():
        assert r.ids == library.encode(r.text or "") and r.n_tokens == len(r.ids) and r.round_trip
    back = decode(rows.drop("text"), model_path()).select("doc_id", "text").collect()
    assert Counter(map(tuple, back)) == Counter((r.doc_id, r.text or "") for r in corpus.collect())
    counts = Counter(tuple(r) for r in token_counts(corpus, model_path()).collect())
    assert counts == Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in corpus.collect())
    assert encode_decode(empty(spark), model_path()).count() == token_counts(empty(spark), model_path()).count() == 0


def test_streaming_viterbi(monkeypatch):
    import sentencepiece

    library, own, rnd = sentencepiece.SentencePieceProcessor(model_file=model_path()), Encoder(model_path()), random.Random(4)
    parts = [*"abcdeinorst   \n\t ▁0123=-é中😀\x00", "the ", "ing", "    ", "<s>", "includegraphics"]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80)))
        ids = library.encode(text)
        seen = "▁" + text.replace(" ", "▁") if text else ""
        assert own.encode(text).tolist() == ids and list(own.stream(seen[i : i + 5] for i in range(0, len(seen), 5))) == ids
    monkeypatch.setattr(pieces, "CHUNK", 7)
    for _ in range(300):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80)))
        assert own.encode(text).tolist() == library.encode(text) and len(list(own.chunks("a b\nc d" * 9))) > 3
    long = "abcdeinorst" * 500
    assert list(own.stream(["▁" + long])) == library.encode(long)


def test_quality(spark, corpus):
    got = quality.quality_rules(corpus, min_group=20).collect()
    want = []
    for r in corpus.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {i for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(twice), failed))
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, want))
    assert not any(r.kept and r.base_failed for r in got) and quality.quality_rules(empty(spark)).count() == 0


def test_mcd_finds_planted_outliers(spark):
    rnd = random.Random(1)
    rows = [(i, "en", "a" if i % 3 else "b", rnd.gauss(0, 1), rnd.gauss(5, 2)) for i in range(900)] + [(1000 + i, "en", "a", 12 + rnd.random(), -9.0) for i in range(90)]
    table = spark.createDataFrame(rows, "id long, lang string, source string, x double, y double")
    out = {r.id: r.distance2 for r in quality.mcd_distances(table, {"x": 0.01, "y": 0.01}, min_group=50).collect()}
    assert min(out[1000 + i] for i in range(90)) > 40 and sum(out[i] > quality.chi2_point(0.999, 2) for i in range(900)) < 20
    assert abs(quality.chi2_point(0.95, 5) - 11.0705) < 1e-3


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, corpus, monkeypatch):
    rows = corpus.select("doc_id", "text").collect()
    family = [" ".join(words(60, 4242))]  # a family of near copies, for crowded buckets
    rnd = random.Random(8)
    for _ in range(60):
        w = family[0].split()
        w[rnd.randrange(60)] = f"edit{rnd.randrange(9)}"
        family.append(" ".join(w))
    more = docs(spark, [(1000 + i, t) for i, t in enumerate(family)])
    sets = [(r.doc_id, shingles(r.text)) for r in rows] + [(1000 + i, shingles(t)) for i, t in enumerate(family)]
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j][1])
            if a and sets[j][1] and 100 * both >= 75 * (len(a) + len(sets[j][1]) - both):
                top[find(i)] = find(j)
    smallest = {}
    for i, (d, a) in enumerate(sets):
        if a and d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    want = [(d, len(a), smallest.get(find(i)) if a else d) for i, (d, a) in enumerate(sets)]
    monkeypatch.setattr(near, "CROWDED", 8)
    got = near.near_duplicates(corpus.unionByName(more)).collect()
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, want))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in near.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_substrings(spark, corpus):
    rows = {(r.doc_id, r.text) for r in corpus.collect()}
    out = sub.substring_dedup(corpus)
    assert [c for c in out.columns if c not in ("text", "removed_from", "removed_to")] == [c for c in corpus.columns if c != "text"]
    got = out.collect()
    assert len(got) == corpus.count()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in got:
        if r.doc_id is None or r.text is None:
            continue
        raw = texts[r.doc_id][0].encode()
        spans = list(zip(r.removed_from, r.removed_to))
        assert sub.restore(r.text.encode(), [(a, raw[a:b]) for a, b in spans]) == raw
    by = {r.doc_id: r for r in got}
    mark = " ".join(words(70, 99)[30:])
    assert mark in by[300].text and not any(mark in by[300 + i].text for i in range(7, 60, 7))  # the first keeps it
    assert by[200].text == "" and by[0].removed_from == [] and by[1].removed_from == []
    assert by[900].text is None and by[901].text == "" and sub.substring_dedup(empty(spark)).count() == 0


def test_importance(spark, corpus):
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(160)], "doc_id long, quality int")
    got = importance_resample(corpus, labels, share=0.5).collect()
    keys = sorted((r.sampling_key for r in got), reverse=True)
    assert len(got) == corpus.count() and all(r.kept == (r.sampling_key >= keys[round(len(got) * 0.5) - 1]) for r in got)
    assert all(r.log_weight == 0 for r in importance_resample(corpus, labels.limit(0)).collect())
    assert importance_resample(empty(spark), labels).count() == 0
    values = spark.range(1000).selectExpr("(id - 500) * 7777777 AS k")
    assert [key_at_rank(values, "k", n) for n in (1, 500, 1000)] == [499 * 7777777, 0, -500 * 7777777]


def test_toxicity(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        w, bad = words(60, i), i % 4 == 0
        rows.append((i, " ".join(w if not bad else [x if rnd.random() > 0.1 else rnd.choice(["blockhead", "nincompoop"]) for x in w])))
        labels.append((i, int(bad)))
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity(docs(spark, [*rows, *ODD]), known).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= THRESHOLD) for r in got) and len(got) == len(rows) + len(ODD)
    assert toxicity(empty(spark), known).count() == 0 and toxicity(docs(spark, rows[:3]), known.limit(0)).count() == 3


def test_tool_calls(spark):
    calls = [("c", "a", 1, "f", '{"x": 1}', ["b"]), ("c", "b", 2, "f", '{"x":"no"}', None), ("c", "d", 3, "f", "{", ["d"]), ("e", "a", 1, "g", "{}", ["zz"]), ("e", "a", 0, "f", '{"y":3, "x": 2}', []), (None, None, None, None, None, None)]
    results = [("c", "a", 5, "late"), ("c", "a", 4, "é"), ("q", "a", 1, "orphan")]
    frame = spark.createDataFrame(calls, "conv_id string, call_id string, turn long, name string, arguments string, after array<string>")
    tools = spark.createDataFrame([("f", '{"type":"object","properties":{"x":{"type":"integer"}},"additionalProperties":false}')], "name string, schema string")
    got = {(r.conv_id, r.call_id): r for r in link_tool_calls(frame, spark.createDataFrame(results, "conv_id string, call_id string, turn long, content string"), tools).collect()}
    assert [(got["c", k].level, got["c", k].valid) for k in "abd"] == [(1, True), (0, False), (None, False)]
    assert got["c", "a"].json == '{"after":["b"],"arguments":{"x":1},"id":"a","name":"f","result":"é","status":"linked"}'
    assert got["e", "a"].errors == ["$.y: not allowed"] and got["q", "a"].status == "no call" and got[None, None].errors == ["no such tool"]
    assert json.loads(got["q", "a"].json)["result"] == "orphan"
    assert link_tool_calls(frame.limit(0), spark.createDataFrame([], "conv_id string, call_id string, turn long, content string"), tools).count() == 0
