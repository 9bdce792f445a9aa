from __future__ import annotations

import datetime

import tuplewise as tw
from tuplewise import DEE, DUM, Relation


def lines(*x):
    return "".join(f"{line}\n" for line in x)


def test_tables(spark):
    rows = [{"id": 1, "name": "Alice"}, {"id": 20, "name": None}]
    want = lines("+----+--------+", "| id | name   |", "+----+--------+", "|  1 | Alice  |", "| 20 | [null] |", "+----+--------+")
    assert tw.to_text(rows) == want and Relation.of(rows).to_text() == want
    assert tw.to_text({"id": 1}) == lines("+----+", "| id |", "+----+", "|  1 |", "+----+")


def test_values():
    assert "3.142" in tw.to_text([{"x": 3.14159}]) and "3.1 " in tw.to_text([{"x": 3.14159}], float_precision=1) and "|  3 |" in tw.to_text([{"xx": 3.0}])
    assert "[1, 2]" in tw.to_text([{"x": [1, 2]}]) and '{"a":1}' in tw.to_text([{"x": {"a": 1}}]) and "| true |" in tw.to_text([{"x": True}])
    assert "2024-01-15T12:30:00.000Z" in tw.to_text([{"x": datetime.datetime(2024, 1, 15, 12, 30)}])
    long = tw.to_text([{"x": ["a" * 12, "b" * 12]}])
    assert "| [aaaaaaaaaaaa, |" in long and "|  bbbbbbbbbbbb] |" in long


def test_nested_trimmed_and_borders():
    nested = tw.to_text([{"k": 1, "r": [{"a": 1}]}])
    assert nested == lines("+---+-------+", "| k | r     |", "+---+-------+", "| 1 | +---+ |", "|   | | a | |", "|   | +---+ |", "|   | | 1 | |", "|   | +---+ |", "|   |       |", "+---+-------+")
    assert max(map(len, tw.to_text([{"x": "y" * 50}], trim_at=20).splitlines())) == 20
    assert tw.to_text([{"a": 1}], border="rounded") == lines("╭───╮", "│ a │", "├───┤", "│ 1 │", "╰───╯")
    assert tw.to_text([{"a": 1}], border="double").startswith("╔═══╗")


def test_no_attributes(spark):
    assert DEE(spark).to_text() == lines("+--+", "|  |", "+--+", "|  |", "+--+") and DUM(spark).to_text() == lines("+--+", "|  |", "+--+", "+--+")
