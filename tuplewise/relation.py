"""``Relation``: an immutable, lazy relation over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any, TypeAlias

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuplewise import text
from tuplewise.functions.aggregates import Aggregator
from tuplewise.functions.predicates import Predicate
from tuplewise.operators import frames
from tuplewise.plans.keys import Keys
from tuplewise.plans.values import ref


#: what operators take as another operand
Operand: TypeAlias = "Relation | DataFrame | Sequence[Mapping[str, Any]]"


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def frame_of(rows: Sequence[Mapping[str, Any]], schema: T.StructType | str | None = None) -> DataFrame:
    """Rows as a DataFrame: the union of their attributes, null where a row lacks one."""
    spark = session()
    rows = [dict(r) for r in rows]
    names = list(dict.fromkeys(n for r in rows for n in r))
    if schema is None and not names:
        return spark.range(len(rows)).select()
    if schema is None:
        schema = T.StructType([T.StructField(n, _kind([r.get(n) for r in rows])) for n in names])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return spark.createDataFrame([tuple(_plain(r.get(f.name), f.dataType) for f in schema.fields) for r in rows], schema)


def _plain(value: Any, kind: T.DataType) -> Any:
    if isinstance(value, Relation):
        value = value.to_array()
    if value is None:
        return None
    if isinstance(kind, T.DoubleType) and isinstance(value, int):
        return float(value)
    if isinstance(kind, T.ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return tuple(_plain(value.get(f.name), f.dataType) for f in kind.fields)
    return value


def _kind(values: Iterable[Any]) -> T.DataType:
    """The type that holds all of some Python values."""
    import datetime
    import decimal

    out: T.DataType = T.NullType()
    structs: list[dict] = []
    items: list[Any] = []
    for v in values:
        v = v.to_array() if isinstance(v, Relation) else v
        if v is None:
            continue
        if isinstance(v, dict):
            structs.append(v)
            new: T.DataType = T.StructType()
        elif isinstance(v, list | tuple):
            items.extend(v)
            new = T.ArrayType(T.NullType())
        else:
            new = next(k for t, k in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (datetime.datetime, T.TimestampType()), (datetime.date, T.DateType()), (decimal.Decimal, T.DecimalType(38, 18)), ((bytes, bytearray), T.BinaryType())) if isinstance(v, t))
        if type(out) in (T.NullType, type(new)):
            out = new
        elif {type(out), type(new)} == {T.LongType, T.DoubleType}:
            out = T.DoubleType()
        else:
            raise TypeError(f"an attribute holds {out.simpleString()} and {new.simpleString()}")
    if isinstance(out, T.StructType):
        return T.StructType([T.StructField(n, _kind([s.get(n) for s in structs])) for n in dict.fromkeys(n for s in structs for n in s)])
    return T.ArrayType(_kind(items)) if isinstance(out, T.ArrayType) else out


class Relation:
    """A relation.  Operators return new ones and run nothing; terminals run a job.

    ``is_set`` says that the rows are known to have no duplicates, so that operators
    on sets needn't look for them again.
    """

    __slots__ = ("df", "is_set")

    def __init__(self, df: DataFrame, is_set: bool = False) -> None:
        object.__setattr__(self, "df", df)
        object.__setattr__(self, "is_set", is_set)

    def __setattr__(self, *_: Any) -> None:
        raise AttributeError("a Relation is immutable")

    @classmethod
    def of(cls, rows: Sequence[Mapping[str, Any]], schema: T.StructType | str | None = None) -> "Relation":
        return cls(frame_of(rows, schema))

    def _with(self, df: DataFrame, is_set: bool = False) -> "Relation":
        return Relation(df, is_set)

    # filters
    def restrict(self, predicate: Predicate) -> "Relation":
        return self._with(frames.restrict(self.df, predicate), self.is_set)

    where = restrict

    def exclude(self, predicate: Predicate) -> "Relation":
        return self._with(frames.exclude(self.df, predicate), self.is_set)

    # projection, extension, renaming
    def project(self, attrs: Iterable[str]) -> "Relation":
        return self._with(frames.project(self.df, attrs, self.is_set), True)

    def allbut(self, attrs: Iterable[str]) -> "Relation":
        return self._with(frames.allbut(self.df, attrs, self.is_set), True)

    def extend(self, extensions: Mapping[str, Any]) -> "Relation":
        return self._with(frames.extend(self.df, extensions), self.is_set and not set(extensions) & set(self.df.columns))

    def constants(self, values: Mapping[str, Any]) -> "Relation":
        return self._with(frames.constants(self.df, values), self.is_set and not set(values) & set(self.df.columns))

    def rename(self, renaming: Mapping[str, str] | Callable[[str], str]) -> "Relation":
        out = frames.rename(self.df, renaming)
        return self._with(out, self.is_set and len(out.columns) == len(self.df.columns))

    def prefix(self, text_: str, except_: Iterable[str] = ()) -> "Relation":
        return self._with(frames.prefix(self.df, text_, except_))

    def suffix(self, text_: str, except_: Iterable[str] = ()) -> "Relation":
        return self._with(frames.suffix(self.df, text_, except_))

    def transform(self, how: Callable | Sequence[Callable] | Mapping[str, Callable | Sequence[Callable]]) -> "Relation":
        return self._with(frames.transform(self.df, how))

    # set operators
    def union(self, other: Operand) -> "Relation":
        return self._with(frames.union(self.df, frame(other)), True)

    def minus(self, other: Operand) -> "Relation":
        return self._with(frames.minus(self.df, frame(other), self.is_set), True)

    def intersect(self, other: Operand) -> "Relation":
        return self._with(frames.intersect(self.df, frame(other), self.is_set), True)

    # joins
    def matching(self, other: Operand, keys: Keys = None) -> "Relation":
        return self._with(frames.matching(self.df, frame(other), keys), self.is_set)

    def not_matching(self, other: Operand, keys: Keys = None) -> "Relation":
        return self._with(frames.not_matching(self.df, frame(other), keys), self.is_set)

    def join(self, other: Operand, keys: Keys = None) -> "Relation":
        return self._with(frames.join(self.df, frame(other), keys))

    def left_join(self, other: Operand, keys: Keys = None) -> "Relation":
        return self._with(frames.left_join(self.df, frame(other), keys))

    def cross_product(self, other: Operand) -> "Relation":
        return self._with(frames.cross_product(self.df, frame(other), self.is_set, isinstance(other, Relation) and other.is_set), True)

    cross_join = cross_product

    def image(self, other: Operand, as_: str, keys: Keys = None) -> "Relation":
        return self._with(frames.image(self.df, frame(other), as_, keys))

    # grouping and nesting
    def summarize(self, by: Sequence[str], aggregators: Mapping[str, Aggregator]) -> "Relation":
        return self._with(frames.summarize(self.df, by, aggregators))

    def group(self, attrs: Iterable[str], as_: str, allbut: bool = False) -> "Relation":
        return self._with(frames.group(self.df, attrs, as_, allbut))

    def ungroup(self, attr: str) -> "Relation":
        return self._with(frames.ungroup(self.df, attr))

    def wrap(self, attrs: Iterable[str], as_: str, allbut: bool = False) -> "Relation":
        return self._with(frames.wrap(self.df, attrs, as_, allbut))

    def unwrap(self, attr: str) -> "Relation":
        return self._with(frames.unwrap(self.df, attr))

    def autowrap(self, separator: str = "_") -> "Relation":
        return self._with(frames.autowrap(self.df, separator))

    # terminals
    def one(self) -> dict[str, Any]:
        rows = self.df.take(2)
        if len(rows) > 1:
            raise ValueError("More than one tuple found")
        if not rows:
            raise ValueError("Relation is empty")
        return rows[0].asDict(recursive=True)

    def to_array(self) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.df.collect()]

    def to_relation(self) -> "Relation":
        """The same relation, kept in memory from its first use on."""
        return Relation(self.df.cache(), self.is_set)

    def __iter__(self) -> Iterator[dict[str, Any]]:
        return (r.asDict(recursive=True) for r in self.df.toLocalIterator())

    def y_by_x(self, y: str, x: str, order: str | Sequence[str] | None = None) -> dict[str, Any]:
        """Values of ``y`` by those of ``x``; of several the last in the ``order`` of some attributes, or else any one."""
        pairs = self.df.select(ref(x), ref(y))
        if order is not None:
            by = F.struct(*map(ref, [order] if isinstance(order, str) else order))
            pairs = self.df.groupBy(ref(x).alias("x")).agg(F.max_by(F.struct(ref(y)), by).alias("last")).select("x", F.col("last")[y])
        return {text.as_key(r[0]): _native(r[1]) for r in pairs.collect()}

    def is_equal(self, other: Operand) -> bool:
        """Whether both are the same set of tuples; all empty relations are equal."""
        right = frame(other)
        empty = lambda df: not df.limit(1).count()
        try:
            if set(self.df.columns) == set(right.columns):
                there = frames._aligned(self.df, right)
                return empty(frames.minus(self.df, there, True)) and empty(frames.minus(there, self.df, True))
        except TypeError:
            pass
        return empty(self.df) and empty(right)

    def to_text(self, float_precision: int = 3, trim_at: int | None = None, border: str | Mapping[str, str] = "ascii") -> str:
        return text.render(self.to_array(), float_precision, trim_at, border, self.df.columns)


def _native(value: Any) -> Any:
    return value.asDict(recursive=True) if hasattr(value, "asDict") else value


def is_relation(value: Any) -> bool:
    return isinstance(value, Relation)


def frame(operand: Any) -> DataFrame:
    """The DataFrame of an operand: a relation, a DataFrame, or a sequence of dicts."""
    if isinstance(operand, Relation):
        return operand.df
    if isinstance(operand, DataFrame):
        return operand
    if isinstance(operand, Sequence) and not isinstance(operand, str):
        return frame_of(operand)
    raise TypeError(f"Unable to iterate {operand!r}")


def DEE(spark: SparkSession | None = None) -> Relation:
    """The relation of no attributes and one tuple: the identity of join."""
    return Relation((spark or session()).range(1).select(), True)


def DUM(spark: SparkSession | None = None) -> Relation:
    """The relation of no attributes and no tuple: the identity of union."""
    return Relation((spark or session()).range(1).select().filter(F.lit(False)), True)
