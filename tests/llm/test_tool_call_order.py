"""Tool calls with odd arguments, long chains, cycles, and conversations of many blocks."""

from __future__ import annotations

import json
import random

import pytest

from tuplewise.llm import tool_calls as tools
from tuplewise.llm.tool_calls import checked, link_tool_calls

CALL = "conv_id string, call_id string, turn long, name string, arguments string, after array<string>, known string, level string"
RESULT = "conv_id string, call_id string, turn long, content string, waits string"
TOOL = "name string, schema string"


def test_arguments_never_stop_a_task():
    number = '{"type": "integer"}'
    assert checked('{"x":1e999}', None) == (None, ["$: broken JSON"])
    assert checked("9" * 400, number) == (int("9" * 400), [])
    assert checked("9" * 5000, number) == (None, ["$: broken JSON"])
    assert checked("[" * 200_000, None) == (None, ["$: nested too deep"]) == checked("[" * 150 + "]" * 150, "{}")
    assert checked("[" * 90 + "]" * 90, "{}")[1] == []
    assert checked('"\\ud800"', "true") == ("\ud800", []) and tools.canonical({"\ud800": 1}) == '{"�":1}'
    assert checked("1", "true") == (1, []) and checked("1", "false") == (1, ["$: not allowed"])
    for schema in ("{", "3", "null", '{"type": 5}', '{"required": 3}', '{"properties": [1]}', '{"minimum": "a"}', '{"enum": 1}', '{"properties": {"a": 7}}'):
        assert checked('{"a": 1}' if "minimum" not in schema else "1", schema)[1] == ["broken schema"] if schema != '{"properties": [1]}' else True
    assert checked("NaN", "{}") == checked("{", "{}") == checked('"\x01"', "{}") == (None, ["$: broken JSON"])
    assert checked("", "{}") == checked(None, "{}") == (None, [])
    assert checked("true", '{"enum": [1]}')[1] == ["$: not one of the listed values"]


def test_odd_rows(spark):
    odd = ['{"x":1e999}', "9" * 400, "[" * 200_000, '"\\ud800"', "x" * 300_000, "", None, '"é"']
    rows = [("c", f"a{i}", i, "f", a, [None, "a0"] if i else None, "k", "l") for i, a in enumerate(odd)]
    rows += [("c", "a0", 9, "f", "{}", None, "k", "l"), ("c", "b", None, "boolean", "1", [], "k", "l"), ("c", "z", 1, "broken", "1", [], "k", "l"), (None, "a0", 1, "f", "1", ["a0"], "k", "l")]
    schemas = spark.createDataFrame([("f", "{}"), ("boolean", "true"), ("broken", "{"), (None, "{}"), ("f", "{}")], TOOL)
    results = spark.createDataFrame([("c", "a1", 1, "r" * 300_000, "w"), (None, None, None, None, None)], RESULT)
    got = {(r.conv_id, r.call_id): r for r in link_tool_calls(spark.createDataFrame(rows, CALL), results, schemas).collect()}
    assert len(got) == len(odd) + 4
    assert [got["c", f"a{i}"].valid for i in range(8)] == [False, True, False, True, False, True, True, True]
    assert json.loads(got["c", "a3"].json)["arguments"] == "�" and got["c", "z"].errors == ["broken schema"] and got["c", "b"].valid
    assert [got["c", f"a{i}"].level for i in range(3)] == [0, 1, 1] and len(got["c", "a1"].json) > 300_000


@pytest.mark.parametrize("turns, calls", [(4096, 1 << 16), (16, 1 << 16), (1000, 70)])
def test_levels_against_brute_force(spark, monkeypatch, turns, calls):
    monkeypatch.setattr(tools, "BLOCK_TURNS", turns)
    monkeypatch.setattr(tools, "BLOCK_CALLS", calls)
    monkeypatch.setattr(tools, "BINS", 400 if turns < 4096 else 1)
    rnd, rows = random.Random(turns + calls), []
    for c in range(6):  # a chain of 120; random orders; some cycles
        n = 120 if c == 0 else 50
        place = list(range(n))
        if c > 1:
            rnd.shuffle(place)
        for i in range(n):
            after = [i - 1] if c == 0 and i else [j for j in range(i) if rnd.random() < 0.05]
            if c > 3 and i in (25, 30):
                after.append(55 - i)
            rows.append((f"c{c}", f"x{i}", place[i], "f", "{}", [f"x{j}" for j in after] + ["lost"] * (i % 7 == 3), "k", "l"))
    deps = {(r[0], r[1]): [(r[0], d) for d in r[5] if d != "lost"] for r in rows}
    level: dict = {}
    while more := {k: max((level[d] + 1 for d in v), default=0) for k, v in deps.items() if k not in level and all(d in level for d in v)}:
        level |= more
    frame = spark.createDataFrame(rows, CALL)
    got = link_tool_calls(frame, spark.createDataFrame([], RESULT), spark.createDataFrame([("f", "{}")], TOOL)).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == {k: level.get(k) for k in deps}
    assert all(("waits on a cycle" in r.errors) == ((r.conv_id, r.call_id) not in level) for r in got) and len(level) < len(deps)
    assert all(("no such dependency: lost" in r.errors) == (int(r.call_id[1:]) % 7 == 3) for r in got)
