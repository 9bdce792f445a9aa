"""The public interface as text, for editors and playgrounds: the types that it names, and a line for each function and method."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from tuplewise.functions.aggregates import Aggregator
from tuplewise.functions.predicates import Predicate
from tuplewise.plans.keys import Keys
from tuplewise.relation import Operand, Relation


def _shown(annotation: object) -> str:
    return annotation.strip("'\"") if isinstance(annotation, str) else inspect.formatannotation(annotation)


def _line(name: str, function: Callable) -> str:
    parts = []
    signature = inspect.signature(function)
    for p in signature.parameters.values():
        star = {p.VAR_POSITIONAL: "*", p.VAR_KEYWORD: "**"}.get(p.kind, "")
        kind = "" if p.annotation is p.empty else f": {_shown(p.annotation)}"
        default = "" if p.default is p.empty else f" = {p.default!r}"
        parts.append(f"{star}{p.name}{kind}{default}")
    returns = "" if signature.return_annotation is signature.empty else f" -> {_shown(signature.return_annotation)}"
    return f"def {name}({', '.join(parts)}){returns}: ..."


def definitions() -> str:
    import tuplewise

    types = {"Predicate": Predicate, "Aggregator": Aggregator, "Keys": Keys, "Operand": Operand}
    lines = [f"{name} = {_shown(kind)}" for name, kind in types.items()] + ["", "class Relation:"]
    for name, member in sorted(inspect.getmembers(Relation, callable)):
        if not name.startswith("_"):
            lines.append(f"    {_line(name, member)}")
    lines.append("")
    for name in sorted(tuplewise.__all__):
        member = getattr(tuplewise, name)
        if inspect.isfunction(member):
            own = getattr(Relation, name, None)  # a standalone operator has its method's types
            lines.append(_line(name, own if own is not None else member).replace("(self", "(operand: Operand", 1))
    return "\n".join(lines) + "\n"
