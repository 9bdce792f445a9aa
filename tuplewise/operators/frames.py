"""The operators as functions of DataFrames.

All of them are planned from schemas alone and run no job.  Operators that work on
sets say so; all others keep duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuplewise.functions.aggregates import Aggregator, aggregate
from tuplewise.functions.predicates import Predicate, condition, extension
from tuplewise.plans.keys import Keys, Sides
from tuplewise.plans.values import distinct, family, is_relation_valued, key, keys_of, kinds, literal, plain, ref

# filters


def restrict(df: DataFrame, predicate: Predicate) -> DataFrame:
    return df.filter(condition(df, predicate))


def exclude(df: DataFrame, predicate: Predicate) -> DataFrame:
    """What ``restrict`` doesn't keep: rows of an unknown condition stay."""
    return df.filter(~F.coalesce(condition(df, predicate), F.lit(False)))


# projection, extension, renaming


def project(df: DataFrame, attrs: Iterable[str], is_set: bool = False) -> DataFrame:
    """The named attributes that exist, without duplicates."""
    known = [n for n in dict.fromkeys(attrs) if n in df.columns]
    if is_set and set(known) == set(df.columns):
        return df.select(*map(ref, known))
    return distinct(df.select(*map(ref, known)))


def allbut(df: DataFrame, attrs: Iterable[str], is_set: bool = False) -> DataFrame:
    gone = set(attrs)
    return project(df, [n for n in df.columns if n not in gone], is_set)


def extend(df: DataFrame, extensions: Mapping[str, Any]) -> DataFrame:
    """New attributes from the original row; an existing one is overwritten."""
    new = {n: extension(df, how) for n, how in extensions.items()}
    cols = [new[n].alias(n) if n in new else ref(n) for n in df.columns]
    return df.select(*cols, *[c.alias(n) for n, c in new.items() if n not in df.columns])


def constants(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    return extend(df, {n: literal(v) for n, v in values.items()})


def rename(df: DataFrame, renaming: Mapping[str, str] | Callable[[str], str]) -> DataFrame:
    """All at once; of attributes that get one name, the last stands in the first one's place."""
    name = renaming if callable(renaming) else lambda n: renaming.get(n) or n
    out: dict[str, str] = {}
    for old in df.columns:
        out[name(old)] = old
    return df.select(*[ref(old).alias(new) for new, old in out.items()])


def prefix(df: DataFrame, text: str, except_: Iterable[str] = ()) -> DataFrame:
    kept = set(except_)
    return rename(df, lambda n: n if n in kept else text + n)


def suffix(df: DataFrame, text: str, except_: Iterable[str] = ()) -> DataFrame:
    kept = set(except_)
    return rename(df, lambda n: n if n in kept else n + text)


def transform(df: DataFrame, how: Callable | Sequence[Callable] | Mapping[str, Callable | Sequence[Callable]]) -> DataFrame:
    """One function, or several in turn, over all values or those of the named attributes.

    A function gets a column; a ``value_function`` gets each Python value.
    """

    def applied(value: Column, steps: Callable | Sequence[Callable]) -> Column:
        out = reduce(lambda v, f: f(v), [steps] if callable(steps) else steps, value)
        return out if isinstance(out, Column) else F.lit(out)

    steps_of = (lambda n: how.get(n, ())) if isinstance(how, Mapping) else (lambda n: how)
    return df.select(*[applied(ref(n), steps_of(n)).alias(n) for n in df.columns])


# set operators


def _aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """``right`` in the order of the attributes of ``left``; both have the same ones."""
    lk, rk = kinds(left), kinds(right)
    for n in left.columns:
        if len({family(lk[n]), family(rk[n])} - {"void"}) > 1:
            raise TypeError(f"attribute {n} is {lk[n].simpleString()} on one side and {rk[n].simpleString()} on the other")
    return right.select(*map(ref, left.columns))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Set union by name; attributes of one side only are null in rows of the other."""
    if set(left.columns) == set(right.columns):
        return distinct(left.unionByName(_aligned(left, right)))
    return distinct(left.unionByName(right, allowMissingColumns=True))


def _keyed(df: DataFrame, mark: str) -> tuple[DataFrame, list[str]]:
    names = [f"__{mark}{i}" for i in range(max(1, len(df.columns)))]
    return df.withColumns(dict(zip(names, keys_of(df), strict=True))), names


def _against(left: DataFrame, right: DataFrame, how: str, is_set: bool) -> DataFrame:
    rows, own = _keyed(left, "l")
    others, theirs = _keyed(_aligned(left, right), "r")
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, theirs, strict=True)])
    out = rows.join(others.select(*theirs), same, how).drop(*own)
    return out if is_set else distinct(out)


def minus(left: DataFrame, right: DataFrame, is_set: bool = False) -> DataFrame:
    """Set difference; rows of other attributes are never equal."""
    if set(left.columns) != set(right.columns):
        return left if is_set else distinct(left)
    return _against(left, right, "left_anti", is_set)


def intersect(left: DataFrame, right: DataFrame, is_set: bool = False) -> DataFrame:
    if set(left.columns) != set(right.columns):
        return left.filter(F.lit(False))
    return _against(left, right, "left_semi", is_set)


# joins


def matching(left: DataFrame, right: DataFrame, keys: Keys = None, how: str = "left_semi") -> DataFrame:
    s = Sides(left, right, keys)
    return s.left.join(s.right, s.condition(nan=True), how).select(*[F.col(a).alias(n) for n, a in s.l_names.items()])


def not_matching(left: DataFrame, right: DataFrame, keys: Keys = None) -> DataFrame:
    return matching(left, right, keys, "left_anti")


def join(left: DataFrame, right: DataFrame, keys: Keys = None, how: str = "inner") -> DataFrame:
    """Natural or equi-join; no keys mean no condition.  On a clash of other attributes the right one's value is taken."""
    s = Sides(left, right, keys)
    both = s.left.crossJoin(s.right) if how == "inner" and not s.pairs else s.left.join(s.right, s.condition(), how)
    return both.select(*s.output())


def left_join(left: DataFrame, right: DataFrame, keys: Keys = None) -> DataFrame:
    return join(left, right, keys, "left")


def _as_set(df: DataFrame, is_set: bool) -> DataFrame:
    if is_set:
        return df
    return distinct(df) if df.columns else df.limit(1)


def cross_product(left: DataFrame, right: DataFrame, left_is_set: bool = False, right_is_set: bool = False) -> DataFrame:
    """All pairs, as a set; on a clash the left one's value is taken.

    The product of sets is a set, so duplicates are looked for in the operands alone.
    """
    clash = [n for n in right.columns if n in left.columns]
    rest = right.select(*[ref(n) for n in right.columns if n not in clash])
    s = Sides(_as_set(left, left_is_set), _as_set(rest, right_is_set and not clash), [])
    return s.left.crossJoin(s.right).select(*s.output())


def image(left: DataFrame, right: DataFrame, as_: str, keys: Keys = None) -> DataFrame:
    """Each left row with the relation of its right matches, empty where it has none.

    A row holds all its matches: without keys, each holds the whole right relation.
    """
    s = Sides(left, right, keys)
    nested = F.collect_list(F.struct(*[F.col(s.r_names[n]).alias(n) for n in s.rest])).alias("image")
    if s.pairs:
        by = [F.col(s.r_names[b]) for b in dict.fromkeys(s.pairs.values())]
        both = s.left.join(s.right.groupBy(*by).agg(nested), s.condition(), "left")
    else:
        both = s.left.crossJoin(s.right.agg(nested))
    kind = T.ArrayType(T.StructType([T.StructField(n, s.r_kinds[n]) for n in s.rest]), False)
    value = F.coalesce(F.col("image"), F.array().cast(kind)).alias(as_)
    kept = [F.col(a).alias(n) for n, a in s.l_names.items() if n != as_]
    return both.select(*kept, value)


# grouping and nesting


def _grouped(df: DataFrame, by: Sequence[str]):
    """Groups by keys; without any, the one group of all rows, if there are rows."""
    types = kinds(df)
    return df.groupBy(*[key(ref(n), types[n]).alias(n) if not plain(types[n]) else ref(n) for n in by], *([] if by else [F.lit(1).alias("__all")]))


def summarize(df: DataFrame, by: Sequence[str], aggregators: Mapping[str, Aggregator]) -> DataFrame:
    for n in by:
        if n not in df.columns:
            raise ValueError(f"no such attribute to group by: {n}")
    by = list(dict.fromkeys(by))
    names = [f"__a{i}" for i in range(len(aggregators))]
    made = [aggregate(df, how).alias(a) for a, how in zip(names, aggregators.values(), strict=True)]
    out = _grouped(df, by).agg(*(made or [F.count(F.lit(1)).alias("__none")]))
    new = dict(zip(aggregators, names, strict=True))
    cols = [F.col(new[n]).alias(n) if n in new else ref(n) for n in by]
    return out.select(*cols, *[F.col(a).alias(n) for n, a in new.items() if n not in by])


def group(df: DataFrame, attrs: Iterable[str], as_: str, allbut: bool = False) -> DataFrame:
    """Nests the named attributes (or all but these) of the rows that agree on the others.

    A group becomes one row: with all attributes named, the whole relation does.
    """
    named = set(attrs)
    inner = [n for n in df.columns if (n in named) != allbut]
    by = [n for n in df.columns if n not in inner]
    out = _grouped(df, by).agg(F.collect_list(F.struct(*map(ref, inner))).alias("__nested"))
    return out.select(*[ref(n) for n in by if n != as_], F.col("__nested").alias(as_))


def _present(value: Column, kind: T.DataType, message: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(message)).cast(kind)).otherwise(value)


def ungroup(df: DataFrame, attr: str) -> DataFrame:
    """A row for each nested tuple, whose attributes win over the row's; rows without any go."""
    kind = kinds(df).get(attr)
    if kind is None or not is_relation_valued(kind):
        raise ValueError("Value is not a relation or array")
    inner = kind.elementType.names
    base = [n for n in df.columns if n != attr and n not in inner]
    rows = df.select(*map(ref, base), F.explode(_present(ref(attr), kind, "Value is not a relation or array")).alias("__tuple"))
    return rows.select(*map(ref, base), *[F.col("__tuple").getField(n).alias(n) for n in inner])


def wrap(df: DataFrame, attrs: Iterable[str], as_: str, allbut: bool = False) -> DataFrame:
    """Nests the named attributes (or all but these) of each row into one tuple."""
    named = set(attrs)
    inner = [n for n in df.columns if (n in named) != allbut]
    rest = [n for n in df.columns if n not in inner and n != as_]
    return df.select(*map(ref, rest), F.struct(*map(ref, inner)).alias(as_))


def unwrap(df: DataFrame, attr: str) -> DataFrame:
    kind = kinds(df).get(attr)
    if not isinstance(kind, T.StructType):
        raise ValueError(f"Attribute '{attr}' is not a tuple (object)")
    base = [n for n in df.columns if n != attr and n not in kind.names]
    value = _present(ref(attr), kind, f"Attribute '{attr}' is not a tuple (object)")
    rows = df.select(*map(ref, base), value.alias("__tuple"))
    return rows.select(*map(ref, base), *[F.col("__tuple").getField(n).alias(n) for n in kind.names])


def autowrap(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nests attributes whose names share what precedes the separator; one level."""
    types = kinds(df)
    parts: dict[str, dict[str, Column]] = {}
    whole: dict[str, Column] = {}
    order: list[str] = []
    for n in df.columns:
        first, *rest = n.split(separator) if separator else list(n)
        if first not in order:
            order.append(first)
        if not rest:
            whole[first] = ref(n)
            kind = types[n]
            parts[first] = {f: ref(n).getField(f) for f in kind.names} if isinstance(kind, T.StructType) else {}
        elif first in whole and not isinstance(types[first], T.StructType):
            raise ValueError(f"attribute {first} is a scalar and can't hold {n}")
        else:
            whole.pop(first, None)
            parts.setdefault(first, {})[separator.join(rest)] = ref(n)
    tuple_of = lambda first: F.struct(*[c.alias(n) for n, c in parts[first].items()])
    return df.select(*[(whole[f] if f in whole else tuple_of(f)).alias(f) for f in order])
