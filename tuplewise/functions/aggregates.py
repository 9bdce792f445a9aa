"""Aggregators: count, sum, min, max, avg, collect, and callables over a group."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuplewise.functions.predicates import Tuple
from tuplewise.plans.values import family, is_float, kinds, ref

Aggregator = str | Mapping[str, str] | Callable[[Tuple], Column]


def _number(value: Column, kind: T.DataType) -> Column:
    """A value as a number: truth values as 0 and 1, text by its digits, anything else null."""
    if family(kind) == "number":
        return value
    if isinstance(kind, T.BooleanType):
        return value.cast("int")
    return value.try_cast("double") if family(kind) == "text" else F.lit(None).cast("double")


def _without_nan(value: Column, kind: T.DataType) -> Column:
    return value if family(kind) == "number" and not is_float(kind) else F.when(~F.isnan(value), value)


def _sum(value: Column, kind: T.DataType) -> Column:
    return F.coalesce(F.sum(_without_nan(_number(value, kind), kind)), F.lit(0))


def _extreme(pick: Callable[[Column], Column]):
    def of(value: Column, kind: T.DataType) -> Column:
        """Of numbers, where one NaN spoils the group; texts and times are taken in their own order."""
        if family(kind) not in ("number", "boolean"):
            return pick(value)
        value = _number(value, kind)
        return F.when(F.max(F.isnan(value)), F.lit(float("nan"))).otherwise(pick(value)) if is_float(kind) else pick(value)

    return of


def _avg(value: Column, kind: T.DataType) -> Column:
    """A null counts as 0, in the sum and in the number of values; what isn't a number doesn't count."""
    number = _number(value, kind)
    return F.avg(F.when(value.isNull(), F.lit(0)).otherwise(_without_nan(number, kind)))


def _collect(value: Column, kind: T.DataType) -> Column:
    """All values, nulls and duplicates too."""
    return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda x: x["v"])


_BY_NAME = {"sum": _sum, "min": _extreme(F.min), "max": _extreme(F.max), "avg": _avg, "collect": _collect}


def aggregate(df: DataFrame, how: Aggregator) -> Column:
    """The aggregate expression of an aggregator over groups of ``df``."""
    if isinstance(how, Column):
        return how
    if callable(how):
        out: Any = how(Tuple(df))
        return out if isinstance(out, Column) else F.lit(out)
    op, attr = (how, None) if isinstance(how, str) else (how["op"], how.get("attr"))
    if op == "count":
        return F.count(F.lit(1))
    if op not in _BY_NAME:
        raise ValueError(f"Unknown aggregator: {op}")
    kind = kinds(df).get(attr)
    if kind is None:  # an attribute that no tuple has
        kind, value = T.DoubleType(), F.lit(None).cast("double")
        return {"avg": F.lit(None).cast("double"), "min": F.max(value), "max": F.max(value)}.get(op, _BY_NAME[op](value, kind))
    return _BY_NAME[op](ref(attr), kind)
