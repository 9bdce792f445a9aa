"""What it means for two values to be equal, as column expressions.

Two notions are used.  *Matching* is strict: values of different families (number,
text, truth value, time, ...) never match, null matches null, NaN matches nothing.
*Keys*, by which rows are grouped and duplicates found, treat NaN as null, compare a
nested relation as a bag (order-free, duplicates count) and anything else by value.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def literal(value: Any) -> Column:
    """A Python value as a column: a dict is a tuple; a list of dicts, or a relation, is a nested relation (null where a tuple lacks an attribute)."""
    if hasattr(value, "to_array"):
        value = value.to_array()
    if isinstance(value, Mapping):
        return F.struct(*[literal(v).alias(n) for n, v in value.items()])
    if isinstance(value, list | tuple):
        if any(isinstance(v, Mapping) for v in value):
            names = list(dict.fromkeys(n for v in value for n in v))
            value = [{n: v.get(n) for n in names} for v in value]
        return F.array(*map(literal, value))
    return F.lit(value)


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType | T.CharType | T.VarcharType):
        return "text"
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "time"
    return kind.typeName()


def kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.FloatType | T.DoubleType)


def is_relation_valued(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def key(value: Column, kind: T.DataType) -> Column:
    """An expression that is equal for two values just if they are the same key."""
    if is_float(kind):
        return F.when(~F.isnan(value), value)
    if is_relation_valued(kind):
        fields = sorted(kind.elementType.fields, key=lambda f: f.name)
        return F.sort_array(F.transform(value, lambda x: F.struct(*[key(x.getField(f.name), f.dataType).alias(f.name) for f in fields])))
    if isinstance(kind, T.ArrayType) and plain(kind.elementType) is False:
        return F.transform(value, lambda x: key(x, kind.elementType))
    if isinstance(kind, T.StructType) and not plain(kind):
        return F.when(value.isNotNull(), F.struct(*[key(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(value))
    return value


def plain(kind: T.DataType) -> bool:
    """Whether a value is its own key."""
    if isinstance(kind, T.StructType):
        return all(plain(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return plain(kind.elementType) and not is_relation_valued(kind)
    return not (is_float(kind) or isinstance(kind, T.MapType))


def keys_of(df: DataFrame) -> list[Column]:
    """The keys of all columns; a constant where there is none, as set operators need one."""
    return [key(ref(n), k) for n, k in kinds(df).items()] or [F.lit(1)]


def matches(left: Column, left_kind: T.DataType, right: Column, right_kind: T.DataType, nan: bool = False) -> Column:
    """Null-safe strict equality; with ``nan``, NaN is a null, and else matches nothing."""
    families = {family(left_kind), family(right_kind)} - {"void"}
    if len(families) > 1:
        return left.isNull() & right.isNull()
    if nan:
        return key(left, left_kind).eqNullSafe(key(right, right_kind))
    same = left.eqNullSafe(right)
    return same & ~F.coalesce(F.isnan(left), F.lit(False)) if is_float(left_kind) else same


def distinct(df: DataFrame) -> DataFrame:
    """``df`` without duplicates; of several rows of one key, one is kept as it is."""
    types = kinds(df)
    if all(map(plain, types.values())):
        return df.distinct()
    names = {f"__key{i}": key(ref(n), k) for i, (n, k) in enumerate(types.items()) if not plain(k)}
    out = df.withColumns(names)
    return out.dropDuplicates([*(n for n, k in types.items() if plain(k)), *names]).drop(*names)
