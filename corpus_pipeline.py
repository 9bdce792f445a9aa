"""A training-corpus pipeline: one operator after another, each over all that the one before kept.

Rows keep the columns of documents until the last stage, which adds the token ids.
A stage that rejects rows finds them by doc_id (null is a value of its own), a hash of
the text and whatever else its verdict depends on, so a verdict is about one text,
whether its doc_id is null, repeated or shared with other texts.  Of near duplicates one
row stays, that of the smallest doc_id (null last; then of the smallest hash); rows that
are equal in both are one document, of which one row stays.  A stage that rewrites texts
keeps every row.  Extra columns pass through, of whatever names; an empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewise.llm.common import cut, fresh, remove, shared_folder, table, temporary
from tuplewise.llm.decontaminate import decontaminate
from tuplewise.llm.near_duplicates import near_duplicates
from tuplewise.llm.pieces import encode_decode
from tuplewise.llm.quality_rules import quality_rules
from tuplewise.llm.queries import model_path
from tuplewise.llm.substring_dedup import substring_dedup


def _same(docs: DataFrame, table: DataFrame, *more: str) -> tuple[DataFrame, Column]:
    """``table`` (doc_id, text_hash, *more) under names that ``docs`` lacks, and the condition by which rows of ``docs`` are its."""
    own = {"doc_id": docs["doc_id"].cast("long"), "text_hash": F.xxhash64(docs["text"].cast("string"))} | {c: docs[c].cast("string") for c in more}
    named = table.select(*[F.col(c).alias(fresh(docs, f"_same_{c}")) for c in own])
    return named, reduce(Column.__and__, [v.eqNullSafe(named[fresh(docs, f"_same_{c}")]) for c, v in own.items()])


def _without(docs: DataFrame, verdicts: DataFrame, rejected: str, *more: str) -> DataFrame:
    gone, condition = _same(docs, verdicts.filter(rejected).select("doc_id", "text_hash", *more).distinct(), *more)
    return docs.join(gone, condition, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, quality_rules(docs), "NOT kept", "lang", "source")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = near_duplicates(docs).select("doc_id", "text_hash", "group")
    counted = rows.groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash", "copies")).alias("x")
    stay = counted.filter("group IS NOT NULL").groupBy("group").agg(first).select("x.doc_id", "x.text_hash", "x.copies")
    alone = counted.filter("group IS NULL").select("doc_id", "text_hash", F.lit(1).alias("copies"))  # without words: linked with nothing
    stay = cut(stay.union(alone))
    single, condition = _same(docs, stay.filter("copies = 1"))
    out = docs.join(single, condition, "left_semi")
    if not stay.filter("copies > 1").limit(1).count():
        return out
    repeated, condition = _same(docs, stay.filter("copies > 1"))
    key = {fresh(docs, "_id"): F.col("doc_id").cast("long"), fresh(docs, "_hash"): F.xxhash64(F.col("text").cast("string"))}
    return out.unionByName(docs.join(repeated, condition, "left_semi").withColumns(key).dropDuplicates(list(key)).drop(*key))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clash = {c: fresh(docs, c) for c in ("removed_from", "removed_to") if c in docs.columns}
    out = substring_dedup(docs.withColumnsRenamed(clash)).drop("removed_from", "removed_to").withColumnsRenamed({v: k for k, v in clash.items()})
    out = out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
    return out.select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")), "contaminated")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs, model_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near),
    ("substring dedup", substrings),
    ("decontamination", benchmark),
    ("encoding", pieces),
]
ORACLE_SQL: str | None = None  # SQL has no covariance estimates by concentration, no components and no vocabulary


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read back for the next.

    What a stage has written on its way, and what the one before it has returned, go
    once its own result is written.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = shared_folder(spark), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
