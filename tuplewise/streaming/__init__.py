"""Relations over streams.

Row-wise operators, semi- and anti-joins with a stored right side, and set operators
work on a streaming relation as they are.  Their memory of rows seen is unbounded,
though; the helpers here bound it by a watermark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tuplewise.functions.aggregates import Aggregator, aggregate
from tuplewise.plans.values import ref
from tuplewise.relation import Relation


def as_set(relation: Relation, time: str, delay: str) -> Relation:
    """The relation without duplicates that come within ``delay`` of each other."""
    return Relation(relation.df.withWatermark(time, delay).dropDuplicatesWithinWatermark(), True)


def summarize_windows(relation: Relation, time: str, length: str, by: Sequence[str], aggregators: Mapping[str, Aggregator], delay: str, slide: str | None = None) -> Relation:
    """``summarize`` by windows of event time, with ``window_start`` and ``window_end``; a window is final ``delay`` after its end."""
    df = relation.df.withWatermark(time, delay)
    made = [aggregate(df, how).alias(name) for name, how in aggregators.items()]
    out = df.groupBy(F.window(ref(time), length, slide), *map(ref, by)).agg(*made)
    return Relation(out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *map(ref, by), *map(ref, aggregators)))


def start(relation: Relation, name: str, mode: str = "append") -> StreamingQuery:
    """Runs all that is there into the in-memory table ``name``."""
    return relation.df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
