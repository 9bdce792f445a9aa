"""Quality by importance resampling with hashed n-gram models.

Two bag-of-n-gram models over ``BUCKETS`` hash buckets (words and word pairs,
A-Z lower-cased) are estimated: one of target text (documents labelled as of good
quality), one of the raw corpus (all documents).  A text's log importance weight is
the sum over its n-grams of log p_target - log p_raw.  Adding Gumbel noise to the log
weights and taking the k largest draws k documents without replacement with
probabilities in proportion to their weights; k is a share of the corpus, by default
the share of good labels among all.

Plan.  One pass counts all n-grams: a task adds up a vector of fixed size and emits
its non-zero buckets, which are summed by bucket.  Target ids are a bounded sample of
the labels (``TARGET`` ids, those of the smallest hash), so the counting pass looks
them up map-side and no text is shuffled.  A second pass scores all texts against the
broadcast log ratios (``BUCKETS`` numbers).  The k-th largest noisy weight is found by
counting: 2**16 cells of the key's leading bits, then of the next ones within the cell
that holds rank k; of equal keys at rank k the rest is drawn in the same way by a hash of
doc_id and text.  No sort, and no list of documents anywhere.

The noise is a hash of the seed and the doc_id, so results don't depend on tasks.

Defined results: a null, empty or wordless text has weight 0 (log), as any text of no
evidence; null doc_ids draw the noise of the text 'null'; repeated rows are rows of
their own, of equal noise, and are drawn together (only then more than k are); without
labels of good quality all weights are 0, and without labels all documents are drawn; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplewise.llm import kernel
from tuplewise.llm.common import cut, small_batches

BUCKETS = 1 << 14
TARGET = 20_000
SEED = 17
SMOOTH = 1.0
#: parts of a log weight's unit that the sampling key tells apart
_STEPS = 1 << 16


def _buckets(words: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and each pair of neighbouring words."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    pair = kernel.grams(words.hash, 2)
    inside = text[1:] == text[:-1]
    where = np.concatenate([text, text[:-1][inside] if len(text) else text])
    hashes = np.concatenate([kernel.grams(words.hash, 1), pair[inside] if len(text) else pair])
    return where, (hashes >> np.uint64(50)).astype(np.int64)


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(bucket, raw, target) from rows (text, is_target)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, _, words in kernel.words_of(batch.column(0), kernel.SPACE_WORDS, True):
                where, bucket = _buckets(words)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[chosen[row + where]], minlength=BUCKETS)
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(raw[full]), pa.array(target[full])], names=["bucket", "raw", "target"])

    return texts.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """log p_target - log p_raw of each bucket, both smoothed; 0 everywhere without target text."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts:
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: (x + SMOOTH) / (x.sum() + SMOOTH * BUCKETS)
    return np.log(share(target)) - np.log(share(raw))


def gumbel(seed: int, key: Column) -> Column:
    """Standard Gumbel noise from a hash of seed and key."""
    unit = (F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null")), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit))


def key_at_rank(rows: DataFrame, key: str, rank: int) -> int:
    """The ``rank``-th largest value of a column of whole numbers, by counting cells of 2**32, 2**16 and 1."""
    low, left = None, rank
    for shift in (32, 16, 0):
        within = rows if low is None else rows.filter(F.shiftright(F.col(key), shift + 16) == low)
        cells = within.groupBy(F.shiftright(F.col(key), shift).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
        for cell, n in sorted(((r["cell"], r["n"]) for r in cells), reverse=True):
            if left <= n:
                low = cell
                break
            left -= n
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, target: int = TARGET) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n_words, log_weight, sampling_key, kept (drawn)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.filter("quality > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target).withColumn("is_target", F.lit(True))  # at most ``target`` ids
    marked = rows.join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    counts = [(r["bucket"], r["raw"], r["target"]) for r in ngram_counts(marked).collect()]  # at most BUCKETS rows
    ratios = spark.sparkContext.broadcast(log_ratios(counts))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratios.value
        for batch in batches:
            for row, to, words in kernel.words_of(batch.column(1), kernel.SPACE_WORDS, True):
                where, bucket = _buckets(words)
                weight = np.bincount(where, weights=table[bucket], minlength=to - row)
                own = [batch.column(k).slice(row, to - row) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([own[0], pa.array(np.diff(words.first)), pa.array(weight), own[1]], names=["doc_id", "n_words", "log_weight", "tie"])

    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 24).alias("tie")
    weighed = rows.select("doc_id", "text", tie).mapInArrow(weigh, "doc_id long, n_words long, log_weight double, tie long")
    key = F.round((F.col("log_weight") + gumbel(seed, F.col("doc_id"))) * _STEPS).cast("long")
    weighed = cut(weighed.withColumn("sampling_key", key))
    n = weighed.count()
    if not n:
        return weighed.drop("tie").withColumn("kept", F.lit(True))
    if share is None:
        share = labels.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0] or 1.0
    k = max(1, round(share * n))
    limit = key_at_rank(weighed, "sampling_key", k)
    above = F.col("sampling_key") > limit
    tied = weighed.filter(F.col("sampling_key") == limit)
    at = key_at_rank(tied, "tie", k - weighed.filter(above).count())
    return weighed.withColumn("kept", above | ((F.col("sampling_key") == limit) & (F.col("tie") >= at))).drop("tie")
