"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: the most rows and bytes of a batch handed to a Python worker
BATCH_ROWS, BATCH_BYTES = "2048", "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds a batch that goes to Python, so that a run of long texts stays small.

    These are settings of the session, read when a query runs, so they stay.  With a
    local master, Python workers also learn where the package is, wherever the driver
    was started; clusters get it as any other library.
    """
    if spark.sparkContext.master.startswith("local"):
        own = str(Path(__file__).resolve().parents[2])
        paths = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
        if own not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), own])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Only where neither is set, as in tests on one machine, a folder below the
    warehouse takes its place.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = given.get() if given.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tuplewise"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


class _Open(threading.local):
    """The tables of each ``temporary`` block that is open in this thread."""

    def __init__(self) -> None:
        self.blocks: list[list[str]] = []


_open = _Open()


def cut(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    The lineage ends there; a lost executor costs a reread, never a recomputation.
    Within ``temporary`` the table goes at the block's end; a ``lasting`` one goes with
    the block around that, if there is one.
    """
    path = shared_folder(df.sparkSession)
    for block in _open.blocks[: -1 if lasting else None][-1:]:
        block.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes what is ``cut`` within, once nothing reads it any more: what leaves the block must be lasting."""
    _open.blocks.append([])
    try:
        yield
    finally:
        for path in _open.blocks.pop():
            remove(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has no column of, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_of(column: str) -> "F.Column":
    """An id as the text under which crc32 splits are taken."""
    return F.col(column).cast("string")
