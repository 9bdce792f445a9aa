"""Predicates and row functions as column expressions.

A callable gets a ``Tuple``, whose attributes are columns, and returns a column;
``row_function`` wraps a Python function of a plain dict where no column will do.
"""

from __future__ import annotations

import datetime
import decimal
import math
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuplewise.plans.values import family, kinds, ref


class Tuple:
    """A row as a callable sees it: ``t.name`` or ``t["name"]`` is the attribute's column."""

    def __init__(self, df: DataFrame) -> None:
        object.__setattr__(self, "_df", df)

    def __getitem__(self, name: str) -> Column:
        if name not in self._df.columns:
            raise ValueError(f"no such attribute: {name}")
        return ref(name)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __iter__(self):
        raise TypeError("attributes of a tuple are columns; name them one by one")


def plain_row(row: Any) -> dict:
    return row.asDict(recursive=True) if hasattr(row, "asDict") else dict(row)


class RowFunction:
    """A Python function of a row (a dict), with a declared result; evaluated over Arrow batches."""

    def __init__(self, body: Callable[[dict], Any], returns: T.DataType | str) -> None:
        self.body, self.returns = body, returns

    def __call__(self, row: Tuple) -> Column:
        body = self.body
        fields = [ref(n).alias(n) for n in row._df.columns]
        apply = F.udf(lambda r: body(plain_row(r)), self.returns, useArrow=True)
        return apply(F.struct(*fields))


def row_function(returns: T.DataType | str) -> Callable[[Callable[[dict], Any]], RowFunction]:
    """Decorator: ``@row_function("string")`` over a function of a dict."""
    return lambda body: RowFunction(body, returns)


class GroupFunction:
    """A Python function of a group (a list of dicts), with a declared result.

    An aggregator for what no expression says: a group becomes one list in one task.
    """

    def __init__(self, body: Callable[[list[dict]], Any], returns: T.DataType | str) -> None:
        self.body, self.returns = body, returns

    def __call__(self, group: Tuple) -> Column:
        body = self.body
        rows = F.collect_list(F.struct(*[ref(n).alias(n) for n in group._df.columns]))
        return F.udf(lambda rows: body([plain_row(r) for r in rows]), self.returns, useArrow=True)(rows)


def group_function(returns: T.DataType | str) -> Callable[[Callable[[list[dict]], Any]], GroupFunction]:
    """Decorator: ``@group_function("double")`` over a function of a list of dicts, for ``summarize``."""
    return lambda body: GroupFunction(body, returns)


class ValueFunction:
    """A Python function of a value, with a declared result; evaluated over Arrow batches."""

    def __init__(self, body: Callable[[Any], Any], returns: T.DataType | str) -> None:
        self.body, self.returns = body, returns

    def __call__(self, value: Column) -> Column:
        return F.udf(self.body, self.returns, useArrow=True)(value)


def value_function(returns: T.DataType | str) -> Callable[[Callable[[Any], Any]], ValueFunction]:
    """Decorator: ``@value_function("string")`` over a function of a value, for ``transform``."""
    return lambda body: ValueFunction(body, returns)


Predicate = Mapping[str, Any] | Callable[[Tuple], Any] | Column | str | bool


def value_family(value: Any) -> str:
    if value is None:
        return "void"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float | decimal.Decimal):
        return "number"
    if isinstance(value, str):
        return "text"
    if isinstance(value, datetime.date):
        return "time"
    return {bytes: "binary", bytearray: "binary", list: "array", dict: "struct"}.get(type(value), "other")


def _equals(df: DataFrame, name: str, value: Any) -> Column:
    kind = kinds(df).get(name)
    if kind is None or (isinstance(value, float) and math.isnan(value)):
        return F.lit(False)
    if value is None:
        return ref(name).isNull()
    if value_family(value) != family(kind):
        return F.lit(False)
    return ref(name).eqNullSafe(F.lit(value))


def truth(df: DataFrame, value: Any) -> Column:
    """The truthiness of a column: null, false, 0, NaN and '' are false."""
    if not isinstance(value, Column):
        return F.lit(bool(value))
    kind = df.select(value.alias("x")).schema[0].dataType
    if isinstance(kind, T.BooleanType):
        return value
    if isinstance(kind, T.NumericType):
        out = value != 0
        return out & ~F.isnan(value) if isinstance(kind, T.FloatType | T.DoubleType) else out
    if family(kind) == "text":
        return value != ""
    return value.isNotNull()


def condition(df: DataFrame, predicate: Predicate) -> Column:
    """The filter condition of a predicate over ``df``."""
    if isinstance(predicate, Mapping):
        out = F.lit(True)
        for k, (name, value) in enumerate(predicate.items()):
            same = _equals(df, name, value)
            out = same if k == 0 else out & same
        return out
    if isinstance(predicate, str):
        predicate = F.expr(predicate)
    elif callable(predicate) and not isinstance(predicate, Column):
        predicate = predicate(Tuple(df))
    return truth(df, predicate)


def extension(df: DataFrame, how: Callable[[Tuple], Any] | str | Column) -> Column:
    """The value of a new attribute: a copied one, by its name, or what a callable makes of the row."""
    if isinstance(how, str):
        return Tuple(df)[how]
    if isinstance(how, Column):
        return how
    if not callable(how):
        raise TypeError("an extension is a callable, a column or the name of an attribute")
    value = how(Tuple(df))
    return value if isinstance(value, Column) else F.lit(value)
