"""Token counts of whole texts by a map-side two-tier lookup.

A text's count is the sum over its stretches (pre-tokens): words with the space
before them, runs of spaces, line ends.  The vocabulary holds no piece across the
cut of two stretches (``pieces.Encoder`` checks that, and takes the whole text as
one stretch otherwise), so counts add up to what the library gives.

Tier one is a table of the corpus's frequent stretches with their lengths in
tokens, broadcast to all tasks.  Its size is fixed (``FREQUENT`` entries).  It is
found in one pass over all texts: each task keeps a Misra-Gries summary, and the
summaries, one row for each task, are merged in a tree; pre-tokens are never
shuffled.  Tier two is a bounded memory of each Python worker; what neither knows
is encoded by the library, a batch's unknown stretches at once.

Defined results: a null text counts as empty (0 bytes, 0 tokens); strings such as
``<s>`` within texts are ordinary text; repeated rows are rows of their own; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplewise.llm.common import small_batches
from tuplewise.llm.pieces import Recent, encoder

#: entries of the broadcast table and of each summary; a task's counter holds up to 16 times as many
FREQUENT = 8192
FAN_IN = 32
LIMIT = 4096

_SUMMARY = "part int, stretch array<string>, n array<long>"
_COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def pruned(counts: Counter, size: int) -> Counter:
    """The Misra-Gries step: subtracts the (size + 1)-th largest count from all and keeps what is positive."""
    if len(counts) <= size:
        return counts
    cut = heapq.nlargest(size + 1, counts.values())[-1]
    return Counter({k: n - cut for k, n in counts.items() if n > cut})


def _row(part: int, counts: Counter) -> pa.RecordBatch:
    top = counts.most_common(FREQUENT)
    columns = [pa.array([part], pa.int32()), pa.array([[k for k, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "stretch", "n"])


def frequent(texts: DataFrame, model: str, size: int = FREQUENT) -> list[str]:
    """The frequent stretches of all texts (one string column), most frequent first."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = encoder(model), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(own.stretches(text))
                if len(counts) > 16 * size:
                    counts = pruned(counts, 8 * size)
        yield _row(TaskContext.get().partitionId(), counts)

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for names, numbers in zip(table["stretch"].to_pylist(), table["n"].to_pylist(), strict=True):
            for name, n in zip(names, numbers, strict=True):
                counts[name] += n
        return pa.Table.from_batches([_row(key[0].as_py(), pruned(counts, size))])

    tasks = texts.rdd.getNumPartitions()
    found = texts.mapInArrow(summary, _SUMMARY)
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        found = found.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("part").applyInArrow(merged, _SUMMARY)
    return list(chain.from_iterable(r["stretch"] for r in found.collect()))[:size]


@lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def lengths(path: str, stretches: list[str]) -> list[int]:
    """Tokens of each stretch on its own.  A line end before it keeps the library from putting a space there, and costs two tokens."""
    if not stretches:
        return []
    return [len(ids) - 2 for ids in _library(path).encode(["\n" + s for s in stretches], num_threads=1)]


@lru_cache(maxsize=2)
def _memory(path: str) -> Recent:
    return Recent(lambda stretch: lengths(path, [stretch])[0])


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``model`` is a SentencePiece model's path, the same on every machine.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    top = frequent(rows.select("text"), model)
    table = spark.sparkContext.broadcast(dict(zip(top, lengths(model, top), strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, second = encoder(model), table.value, _memory(model)
        for batch in batches:
            texts = batch.column(1)
            parts = [list(own.stretches(t)) for t in texts.to_pylist()]
            rare = set(chain.from_iterable(parts)).difference(first)
            new = [s for s in rare if s not in second and s not in second.old]
            fresh = dict(zip(new, lengths(model, new), strict=True))
            known = first | {s: fresh[s] if s in fresh else second[s] for s in rare}
            second.learn(fresh)
            tokens = [sum(map(known.__getitem__, p)) for p in parts]
            sizes = texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())
            n_bytes = pc.cast(pc.binary_length(sizes), pa.int64())
            over = pa.array([n > limit for n in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens, pa.int64()), over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        second.forget()

    return rows.mapInArrow(count, _COUNTS)
