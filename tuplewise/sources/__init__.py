"""Sources and sinks: any format that Spark reads, and a keyed layout whose restriction prunes files."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewise.operators import frames
from tuplewise.plans.values import kinds, ref
from tuplewise.relation import Relation, frame

BUCKET = "_bucket"


def read(spark: SparkSession, path: str, format: str = "parquet", **options: Any) -> Relation:  # noqa: A002
    """A lazy relation over files; filters and needed columns reach the scan."""
    return Relation(spark.read.format(format).options(**options).load(path))


def write(relation: Any, path: str, format: str = "parquet", mode: str = "error", **options: Any) -> None:  # noqa: A002
    frame(relation).write.format(format).mode(mode).options(**options).save(path)


def _bucket(value: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def write_keyed(relation: Any, path: str, key: str, buckets: int) -> None:
    """Writes files by a hash of ``key``, for ``KeyedRelation``."""
    df = frame(relation).withColumn(BUCKET, _bucket(ref(key), buckets))
    df.repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(path)


class KeyedRelation(Relation):
    """A relation with an operator of its own: a restriction of the key reads one bucket's files."""

    __slots__ = ("stored", "key", "buckets")

    def __init__(self, stored: DataFrame, key: str, buckets: int) -> None:
        super().__init__(stored.drop(BUCKET))
        for name, value in (("stored", stored), ("key", key), ("buckets", buckets)):
            object.__setattr__(self, name, value)

    def restrict(self, predicate: Any) -> Relation:
        if not isinstance(predicate, Mapping) or predicate.get(self.key) is None:
            return super().restrict(predicate)
        value = F.lit(predicate[self.key]).cast(kinds(self.df)[self.key])
        pruned = self.stored.filter(F.col(BUCKET) == _bucket(value, self.buckets))
        return Relation(frames.restrict(pruned, predicate).drop(BUCKET))

    where = restrict


def read_keyed(spark: SparkSession, path: str, key: str, buckets: int) -> KeyedRelation:
    return KeyedRelation(spark.read.parquet(path), key, buckets)
