"""Removal of repeated text by hashing units of lines and paragraphs.

Units.  A line falls into units: runs of words that end at the line's end, at a
sentence's end, or after the word whose hash, taken with its predecessor's, is the
least of ``WINDOW`` in a row (a sentence's end is less than any hash; of equals, the
last counts).  Every window that two lines share gives both the same end, so a
passage within lines is cut alike wherever it stands, save for its first
``WINDOW + 1`` and its last ``WINDOW`` words at most.  Of any 2 * WINDOW + 1 +
RUN_WORDS = 50 shared words, broken into lines alike, whole units thus make up
``RUN_WORDS`` in a row: no such passage is left whole.
Units are normalised: A-Z lower-cased, white space between words disregarded.

Rank.  The earliest occurrence of a unit is the one in the document of the smallest
doc_id, and there the first.  All others are repeats.

Removal.  Repeats go if they form a run of at least ``run_words`` words (a passage),
or if they make up a whole line of at least ``line_words`` words.  Shorter repeats
are ordinary speech, and stay.  A removed run reaches from its first word to the
next kept word, or to the end of the text, so no blank lines build up; byte offsets
of what went are kept, with which ``restore`` puts the text together again.

Plan.  A document sends each distinct unit once, as a 64-bit digest with its
doc_id: 16 bytes and a bit, combined map-side into a count and a smallest doc_id for each
digest.  Digests of two documents or more go back to the documents that aren't the
earliest, and texts meet their own repeats only.  A line that a third of all
documents share is one row for each task in the first step, and in the second a
skewed side against a unique one, which splits.

Defined results: a null text stays null and has no units; rows with a null doc_id rank
last, and among themselves by a hash of their texts; rows that repeat a doc_id, and
rows without one that repeat a text, count as one document, and repeats within each of
them go; extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplewise.llm import kernel
from tuplewise.llm.common import cut, fresh, small_batches, temporary

WINDOW = 12
RUN_WORDS = 25
LINE_WORDS = 4

_U = np.uint64
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?")] = True
_ODD = _U(0x9E3779B97F4A7C15)


def _least(value: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The words of the least value (of equals the last) of each ``WINDOW`` that lies in one line, the line's first word left out."""
    n = len(value)
    if n <= WINDOW:
        return np.zeros(0, dtype=np.int64)
    best, at, size = value, np.arange(n), 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        right = best[step:] <= best[:-step]
        best, at = np.where(right, best[step:], best[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    return at[1:][line[: n - WINDOW] == line[WINDOW:]]


class Units:
    """The units of a run of texts: first and last word, digest, size, and whether a line ends with the unit."""

    def __init__(self, words: kernel.Words) -> None:
        n = len(words.hash)
        h = words.hash
        last_byte = words.data[words.end - 1] if n else np.zeros(0, dtype=np.uint8)
        breaks = np.flatnonzero(words.data == 10)
        line = np.searchsorted(breaks, words.start) if n else np.zeros(0, dtype=np.int64)
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        new_line = np.ones(n, dtype=bool)
        if n:
            new_line[:-1] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
        pair = kernel.mix(h * _ODD + np.r_[np.zeros(min(n, 1), dtype=_U), h[:-1]]) if n else h
        marked = _ENDS[last_byte]
        ends = new_line | marked
        ends[_least(np.where(marked, _U(0), pair | _U(1)), np.cumsum(np.r_[0, new_line[:-1]]) if n else line)] = True
        self.to = np.flatnonzero(ends) + 1
        self.at = np.r_[0, self.to[:-1]] if n else self.to
        step = np.arange(n) - np.repeat(self.at, self.to - self.at)
        sums = np.add.reduceat(kernel.mix(h + (step + 1).astype(_U) * _ODD), self.at) if n else h
        self.digest = kernel.mix(sums + (self.to - self.at).astype(_U)).view(np.int64)
        self.size = self.to - self.at
        self.line_end = new_line[self.to - 1]
        self.text = text[self.at]
        self.first = np.searchsorted(self.text, np.arange(len(words.first)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, to, words in kernel.words_of(batch.column(2), kernel.SPACE_WORDS, True):
            units = Units(words)
            order = np.lexsort((units.digest, units.text))
            digest, text = units.digest[order], units.text[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (digest[1:] != digest[:-1]) | (text[1:] != text[:-1])
            who = [batch.column(k).slice(row, to - row).take(pa.array(text[new])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*who, pa.array(digest[new])], names=["nameless", "id", "digest"])


def repeated_runs(digest: np.ndarray, size: np.ndarray, line_end: np.ndarray, elsewhere: np.ndarray, run_words: int, line_words: int) -> np.ndarray:
    """Which units of one text go; ``elsewhere``: sorted digests of which an earlier document has an occurrence."""
    n = len(digest)
    repeat = np.ones(n, dtype=bool)
    repeat[np.unique(digest, return_index=True)[1]] = False  # the first within the text
    if len(elsewhere):
        repeat |= elsewhere[np.minimum(np.searchsorted(elsewhere, digest), len(elsewhere) - 1)] == digest
    if not repeat.any():
        return repeat

    def long_groups(group: np.ndarray, least: int, whole: bool) -> np.ndarray:
        words = np.bincount(group, weights=size * repeat) if not whole else np.bincount(group, weights=size)
        good = words >= least
        if whole:
            good &= np.bincount(group, weights=~repeat) == 0
        return repeat & good[group]

    runs = np.cumsum(np.r_[True, repeat[1:] != repeat[:-1]]) - 1
    lines = np.r_[0, np.cumsum(line_end[:-1])]
    return long_groups(runs, run_words, False) | long_groups(lines, line_words, True)


def _cleaned(run_words: int, line_words: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.num_columns
            column, lists = batch.column(width - 2), batch.column(width - 1).to_pylist()
            texts: list[bytes | None] = []
            spans: list[tuple[list[int], list[int]]] = []
            for row, to, words in kernel.words_of(column, kernel.SPACE_WORDS, True):
                units = Units(words)
                valid = column.slice(row, to - row).is_valid().to_pylist()
                limits = np.r_[words.base, len(words.data)]
                for i in range(to - row):
                    low, high = units.first[i], units.first[i + 1]
                    raw = words.data[limits[i] : limits[i + 1]]
                    elsewhere = np.sort(np.array(lists[row + i] or [], dtype=np.int64))
                    gone = repeated_runs(units.digest[low:high], units.size[low:high], units.line_end[low:high], elsewhere, run_words, line_words) if high > low else np.zeros(0, dtype=bool)
                    if not gone.any():
                        texts.append(raw.tobytes() if valid[i] else None)
                        spans.append(([], []))
                        continue
                    edge = np.diff(np.r_[False, gone, False].astype(np.int8))
                    a, b = low + np.flatnonzero(edge == 1), low + np.flatnonzero(edge == -1)
                    start = words.start[units.at[a]] - limits[i]
                    after = np.minimum(b, len(units.at) - 1)
                    end = np.where(b < high, words.start[units.at[after]] - limits[i], len(raw))
                    keep = np.ones(len(raw) + 1, dtype=np.int64)
                    keep[:] = 0
                    np.add.at(keep, start, 1)
                    np.add.at(keep, end, -1)
                    texts.append(raw[np.cumsum(keep)[:-1] == 0].tobytes())
                    spans.append((start.tolist(), end.tolist()))
            cleaned = pa.array(texts, pa.binary()).cast(pa.string())
            removed = pa.array([a for a, _ in spans], pa.list_(pa.int64())), pa.array([b for _, b in spans], pa.list_(pa.int64()))
            columns = [*batch.columns[: width - 2], cleaned, *removed]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: width - 2], "text", "removed_from", "removed_to"])

    return clean


def substring_dedup(docs: DataFrame, run_words: int = RUN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeats removed from ``text``, and ``removed_from``/``removed_to`` (byte offsets in the original)."""
    spark = docs.sparkSession
    small_batches(spark)
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    rank = {"nameless": doc_id.isNull(), "id": F.coalesce(doc_id, F.xxhash64(text))}
    units = docs.select(*[v.alias(k) for k, v in rank.items()], text.alias("text")).mapInArrow(_digests, "nameless boolean, id long, digest long")
    least = lambda nameless: F.min(F.when(F.col("nameless") == nameless, F.col("id")))  # noqa: E731  longs, which are combined in place
    by = {k: fresh(docs, f"_{k}") for k in rank}
    with temporary(spark):
        units = cut(units)  # 16 bytes a unit; read twice
        shared = units.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), least(False).alias("named"), least(True).alias("rest")).filter("n > 1").drop("n")
        later = F.when(F.col("nameless"), F.col("named").isNotNull() | (F.col("id") > F.col("rest"))).otherwise(F.col("id") > F.col("named"))
        repeats = units.join(shared, "digest").filter(later)
        lists = repeats.groupBy("nameless", "id").agg(F.collect_list("digest").alias(fresh(docs, "_repeats"))).withColumnsRenamed(by)
        lists = cut(lists, lasting=True)
    others = [c for c in docs.columns if c not in ("text", "removed_from", "removed_to")]
    rows = docs.withColumns({by[k]: v for k, v in rank.items()}).join(lists, [*by.values()], "left")
    rows = rows.select(*map(_quoted, others), text.alias("text"), fresh(docs, "_repeats"))
    schema = rows.drop(fresh(docs, "_repeats")).withColumns({"removed_from": F.array().cast("array<long>"), "removed_to": F.array().cast("array<long>")}).schema
    return rows.mapInArrow(_cleaned(run_words, line_words), schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def restore(kept: bytes, removed: list[tuple[int, bytes]]) -> bytes:
    """The original text from what was kept and the removed pieces with their original offsets."""
    out = kept
    for at, piece in sorted(removed):
        out = out[:at] + piece + out[at:]
    return out
