"""Join keys: how they are given, checked and turned into conditions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplewise.plans.values import kinds, matches, ref

Keys = Sequence[str] | Mapping[str, str] | None


def pairs(left: DataFrame, right: DataFrame, keys: Keys) -> dict[str, str]:
    """{left name: right name}; without ``keys``, all common names.  Unknown names are an error."""
    if keys is None:
        return {n: n for n in left.columns if n in right.columns}
    named = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    for n, side in [*((n, left) for n in named), *((n, right) for n in named.values())]:
        if n not in side.columns:
            raise ValueError(f"no such attribute to join on: {n}")
    return named


class Sides:
    """Two operands under names that can't clash, so self-joins are as any other."""

    def __init__(self, left: DataFrame, right: DataFrame, keys: Keys) -> None:
        self.pairs = pairs(left, right, keys)
        self.l_names = {n: f"l{i}" for i, n in enumerate(left.columns)}
        self.r_names = {n: f"r{i}" for i, n in enumerate(right.columns)}
        self.l_kinds, self.r_kinds = kinds(left), kinds(right)
        self.left = left.select(*[ref(n).alias(a) for n, a in self.l_names.items()])
        self.right = right.select(*[ref(n).alias(a) for n, a in self.r_names.items()])
        gone = set(self.pairs.values())
        self.rest = [n for n in right.columns if n not in gone]

    def condition(self, nan: bool = False) -> Column:
        out = F.lit(True)
        for k, (a, b) in enumerate(self.pairs.items()):
            same = matches(F.col(self.l_names[a]), self.l_kinds[a], F.col(self.r_names[b]), self.r_kinds[b], nan)
            out = same if k == 0 else out & same
        return out

    def output(self, right_wins: bool = True) -> list[Column]:
        """Left attributes, then the right ones that aren't keys; on a clash one side's value stands in the left one's place."""
        clash = set(self.rest) & set(self.l_names)
        cols = [F.col(self.r_names[n] if right_wins and n in clash else a).alias(n) for n, a in self.l_names.items()]
        return cols + [F.col(self.r_names[n]).alias(n) for n in self.rest if n not in clash]
