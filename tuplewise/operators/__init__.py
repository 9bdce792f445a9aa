"""The operators as standalone functions.

Each takes relations, DataFrames or sequences of dicts; what comes back has the form
of the (left) operand.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame


def _operator(name: str) -> Callable[..., Any]:
    def call(operand: Any, *args: Any, **options: Any) -> Any:
        from tuplewise.relation import Relation, frame

        own = operand if isinstance(operand, Relation) else Relation(frame(operand))
        out = getattr(own, name)(*args, **options)
        if not isinstance(out, Relation) or isinstance(operand, Relation):
            return out
        return out.df if isinstance(operand, DataFrame) else out.to_array()

    call.__name__ = call.__qualname__ = name
    call.__doc__ = f"``Relation.{name}`` of an operand."
    return call


NAMES = (
    "restrict", "where", "exclude", "project", "allbut", "extend", "constants", "rename", "prefix", "suffix", "union", "minus", "intersect", "matching", "not_matching",
    "join", "left_join", "cross_product", "cross_join", "group", "ungroup", "wrap", "unwrap", "image", "summarize", "autowrap", "transform", "one", "y_by_x", "is_equal", "to_array",
)
for _name in NAMES:
    globals()[_name] = _operator(_name)


def to_text(operand: Any, **options: Any) -> str:
    """A table of a relation, a sequence of dicts, or one dict."""
    from tuplewise.relation import Relation
    from tuplewise.text import render

    return Relation(operand).to_text(**options) if isinstance(operand, DataFrame) else operand.to_text(**options) if isinstance(operand, Relation) else render(operand, **options)


__all__ = [*NAMES, "to_text"]
