"""The pipeline, stage by stage, against brute force over each stage's own input."""

from __future__ import annotations

import random
import re
import uuid
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from tuplewise.llm import common
from tuplewise.llm.queries import model_path

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    seen = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/pipeline_test/{k}"
        stage(spark, seen[-1], DATA).write.mode("overwrite").parquet(path)
        seen.append(spark.read.parquet(path))
    return seen


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_columns_and_rows(stages):
    docs, *_, last = stages
    counts = [d.count() for d in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0] and counts[2] == counts[3]
    assert all(d.columns == docs.columns for d in stages[:-1]) and last.columns == [*docs.columns, "ids", "n_tokens", "round_trip"]


def test_quality_rules(stages):
    before, after = rows(stages[0]), rows(stages[1])
    for i, r in before.items():
        w = space_words(r.text)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        if len(w) < 10 or 100 * len(twice) > 20 * len(w):
            assert i not in after
    assert all(after[i] == before[i] for i in after)


def test_near_duplicates(stages):
    before, after = rows(stages[1]), rows(stages[2])
    sets = {}
    for i, r in before.items():
        w = space_words(low(r.text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * (n := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    assert set(after) == {i for i in sets if find(i) == i} and all(after[i] == before[i] for i in after)


def test_substrings(stages):
    before, after = rows(stages[2]), rows(stages[3])
    for i, r in after.items():
        kept, left = space_words(r.text), iter(space_words(before[i].text))
        assert all(w in left for w in kept) and r.n_chars == len(r.text)  # what stays is in order


def test_decontamination(spark, stages):
    before, after = rows(stages[3]), rows(stages[4])
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = pattern.findall(low(r.text))
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    for i, r in before.items():
        w, hit = pattern.findall(low(r.text)), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        assert (i in after) == (not (hit and 20 * len(hit) >= len(w)))


def test_encoding(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert all(r.ids == library.encode(r.text or "") and r.round_trip for r in stages[5].collect())


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _row long, _gone string, _repeats string, _id long, _nameless string, removed_from string, kept string, _t string, _i string, distance2 string, component_id string, node string"


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["stone", "river", "cloud", "maple", "ember", "harbor", "lantern", "meadow"]) + str(rnd.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats and ids that many rows share, among 400 plain rows."""
    rest = (None, "x", "x", 7, "x", "x", "x", "x", "x", "x", "x", "x")
    texts = [(i, prose(120, i)) for i in range(400)]
    texts += [(None, "two words"), (None, prose(120, 3)), (None, prose(120, 3)), (None, prose(130, 9001)), (None, None), (None, "")]
    texts += [(5, prose(120, 5)), (5, prose(120, 5)), (5, "short"), (5, prose(125, 9002)), (900, None)]
    passage = prose(80, 9003)
    texts += [(None, f"{prose(40, 9004)}\n{passage}\n{prose(30, 9005)}"), (901, f"{prose(40, 9006)}\n{passage}\n{prose(30, 9007)}"), (None, f"{prose(40, 9008)}\n{passage}\n{prose(30, 9009)}")]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 200").orderBy("item_id").first().text
    texts += [(None, f"{prose(20, 9010)} {item}"), (902, f"{item} {prose(20, 9011)}"), (902, prose(100, 9012))]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *rest) for i, t in texts], CLASH)


def test_rows_are_judged_one_by_one(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/pipeline_odd/{name.replace(' ', '_')}"
        stage(spark, docs, DATA).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if name != "encoding":
            assert docs.columns == odd.columns, name
    got = Counter((r.doc_id, r.text) for r in docs.collect())
    assert set(got.values()) == {1} and not any(t is None or len(t.split()) < 10 for _, t in got)
    texts = [t for _, t in got]
    assert texts.count(prose(120, 3)) == 1 and (3, prose(120, 3)) in got and texts.count(prose(120, 5)) == 1
    assert {(5, prose(125, 9002)), (None, prose(130, 9001)), (902, prose(100, 9012))} <= set(got)  # as good as any, whoever shares their ids
    assert not any(prose(20, 9010) in t or prose(20, 9011) in t for t in texts)  # contaminated, with an id or without
    holders = [i for i, t in got if prose(80, 9003) in t]
    assert holders == [901] and sum(prose(40, k) in t for t in texts for k in (9004, 9006, 9008)) == 3
    assert sum(got.values()) >= 400


def test_a_run_leaves_its_result_alone(spark, stages, tmp_path, monkeypatch):
    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "shared_folder", lambda s: f"{tmp_path}/{uuid.uuid4().hex}")
    got = corpus_pipeline.run(spark, DATA)
    left = [p for p in tmp_path.rglob("*") if p.is_dir() and any(x.suffix == ".parquet" for x in p.iterdir())]
    assert [p.name for p in left] == ["4"] and {r.doc_id for r in got.collect()} == set(rows(stages[5]))


def test_empty_tables(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd.limit(0), DATA)
        assert out.count() == 0 and set(odd.columns) <= set(out.columns), name


def test_each_stage_takes_something_out(stages):
    counts = [d.count() for d in stages]
    assert counts[0] > counts[1] > counts[2] and counts[3] > counts[4]
    before, after = rows(stages[2]), rows(stages[3])
    changed = {i for i in after if after[i].text != before[i].text}
    assert changed and all(len(after[i].text) < len(before[i].text) for i in changed)


def test_substrings_against_brute_force(stages):
    """Runs of 50 words that an earlier document has, found word by word, are broken; words that no other place has stay."""
    before, after = rows(stages[2]), rows(stages[3])
    seen: dict = {}
    for i in sorted(before):
        w = space_words(low(before[i].text))
        left = Counter(space_words(low(after[i].text)))
        lines = [space_words(low(x)) for x in (before[i].text or "").split("\n")]
        for line in lines:
            for k in range(len(line) - 49):
                run = tuple(line[k : k + 50])
                if seen.get(run, i) != i:
                    assert any(left[x] < Counter(w)[x] for x in run), i
                seen.setdefault(run, i)
    where: dict = {}
    for i, r in before.items():
        for x in space_words(low(r.text)):
            where.setdefault(x, Counter())[i] += 1
    once = {x for x, c in where.items() if sum(c.values()) == 1}
    for i, r in after.items():
        assert once & set(space_words(low(before[i].text))) <= set(space_words(low(r.text)))
