"""Calls and results with a null id match nothing, and each is a row of its own."""

from __future__ import annotations

from tuplewise.llm.tool_calls import link_tool_calls


def test_null_ids_stay_apart(spark):
    calls = [(None, "a", k, "f", f'{{"x":{k}}}', None) for k in range(5)] + [("c", None, k, "f", "{}", None) for k in range(3)] + [("c", "a", 1, "f", "{}", None)] * 2
    results = [(None, "a", 9, f"r{k}") for k in range(4)] + [("c", "a", 2, "r")]
    frame = spark.createDataFrame(calls, "conv_id string, call_id string, turn long, name string, arguments string, after array<string>").repartition(3)
    answers = spark.createDataFrame(results, "conv_id string, call_id string, turn long, content string").repartition(2)
    got = link_tool_calls(frame, answers, spark.createDataFrame([], "name string, schema string")).collect()
    null = [r for r in got if r.conv_id is None or r.call_id is None]
    assert sorted(r.turn for r in null if r.status == "no result") == [0, 0, 1, 1, 2, 2, 3, 4]
    assert sum(r.status == "no call" for r in null) == 4 and len(null) == 12
    assert [(r.turn, r.status) for r in got if r not in null] == [(1, "linked")]
