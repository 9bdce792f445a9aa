"""Relations as plain-text tables."""

from __future__ import annotations

import datetime
import decimal
import json
from collections.abc import Mapping, Sequence
from typing import Any

# The characters of each border style.
BORDERS = {
    "ascii": {
        "top_left": "+",
        "top_center": "+",
        "top_right": "+",
        "mid_left": "+",
        "mid_center": "+",
        "mid_right": "+",
        "bottom_left": "+",
        "bottom_center": "+",
        "bottom_right": "+",
        "horizontal": "-",
        "vertical": "|",
    },
    "single": {
        "top_left": "┌",
        "top_center": "┬",
        "top_right": "┐",
        "mid_left": "├",
        "mid_center": "┼",
        "mid_right": "┤",
        "bottom_left": "└",
        "bottom_center": "┴",
        "bottom_right": "┘",
        "horizontal": "─",
        "vertical": "│",
    },
    "double": {
        "top_left": "╔",
        "top_center": "╦",
        "top_right": "╗",
        "mid_left": "╠",
        "mid_center": "╬",
        "mid_right": "╣",
        "bottom_left": "╚",
        "bottom_center": "╩",
        "bottom_right": "╝",
        "horizontal": "═",
        "vertical": "║",
    },
    "rounded": {
        "top_left": "╭",
        "top_center": "┬",
        "top_right": "╮",
        "mid_left": "├",
        "mid_center": "┼",
        "mid_right": "┤",
        "bottom_left": "╰",
        "bottom_center": "┴",
        "bottom_right": "╯",
        "horizontal": "─",
        "vertical": "│",
    },
}


def border_of(style: str | Mapping[str, str]) -> dict[str, str]:
    return BORDERS[style] if isinstance(style, str) else dict(style)


def _number(value: Any) -> bool:
    return isinstance(value, int | float | decimal.Decimal) and not isinstance(value, bool)


def _time(value: Any) -> str | None:
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(timespec="milliseconds") + "Z"
    return f"{value.isoformat()}T00:00:00.000Z" if isinstance(value, datetime.date) else None


def _json(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _json(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_json(v) for v in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return _time(value) or value


def as_key(value: Any) -> str:
    """A value as the name of a dictionary entry."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return _time(value) or str(value)


def _cell(value: Any, precision: int, trim_at: int | None, border: Any) -> str:
    if value is None:
        return "[null]"
    if isinstance(value, bool):
        return str(value).lower()
    if _number(value):
        return str(int(value)) if value == value and abs(value) != float("inf") and value == int(value) else ("NaN" if value != value else f"{value:.{precision}f}")
    if isinstance(value, list | tuple):
        if all(isinstance(v, dict) for v in value):
            return render(value, precision, trim_at, border)
        parts = [_cell(v, precision, trim_at, border) for v in value]
        return "[" + (", " if sum(map(len, parts)) < 20 else ",\n ").join(parts) + "]"
    if isinstance(value, dict):
        return json.dumps(_json(value), separators=(",", ":"), ensure_ascii=False)
    return _time(value) or str(value)


def render(rows: Sequence[Mapping[str, Any]] | Mapping[str, Any], float_precision: int = 3, trim_at: int | None = None, border: str | Mapping[str, str] = "ascii", columns: Sequence[str] | None = None) -> str:
    """A table of ``rows`` (or of one row), a line end after each of its lines."""
    rows = [rows] if isinstance(rows, Mapping) else list(rows)
    b = border_of(border)
    names = list(columns) if columns is not None else list(dict.fromkeys(n for r in rows for n in r))
    cells = [[_cell(r.get(n), float_precision, trim_at, border).split("\n") for n in names] for r in rows]
    wide = [max([len(line) for line in n.split("\n")] + [len(line) for c in cells for line in c[i]]) for i, n in enumerate(names)]

    def rule(place: str) -> str:
        h = b["horizontal"]
        return b[f"{place}_left"] + h + (h + b[f"{place}_center"] + h).join(h * w for w in wide) + h + b[f"{place}_right"]

    def line(parts: Sequence[str]) -> str:
        return f"{b['vertical']} " + f" {b['vertical']} ".join(parts) + f" {b['vertical']}"

    out = [rule("top"), line([n.split("\n")[0].ljust(w) for n, w in zip(names, wide, strict=True)]), rule("mid")]
    for row, own in zip(rows, cells, strict=True):
        for k in range(max(map(len, own), default=1)):
            parts = []
            for n, lines, w in zip(names, own, wide, strict=True):
                part = lines[k] if k < len(lines) else ""
                parts.append(part.rjust(w) if _number(row.get(n)) and k < len(lines) else part.ljust(w))
            out.append(line(parts))
    out.append(rule("bottom"))
    return "".join((x if trim_at is None else x[:trim_at]).rstrip() + "\n" for x in out)
