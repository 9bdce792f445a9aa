"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
A *window* is ``span`` (13) consecutive words of a benchmark item; an item of
fewer words, but not none, is one window.  Every document word inside any
occurrence of a window is *hit*.

Method.  Of each run of ``span - gram + 1`` consecutive ``gram``-word hashes the
smallest is a fingerprint (winnowing), so any shared run of ``span`` words shares
a fingerprint, whatever surrounds it.  Document fingerprints are joined with
benchmark fingerprints, and each match is extended left and right, word by word,
to its full length; matches that reach ``span`` words are hits.  Items shorter
than ``span`` have one window that is looked up whole, by length.

Plan.  The benchmark side is small by nature, but it isn't assumed to be: its
size is measured, and it is cut into blocks of at most ``block_bytes`` of text.
Each block's fingerprints are broadcast and joined map-side against all
documents, so documents are never shuffled for one block; with more blocks, the
hit spans of a document (not its text) are merged by row afterwards.

Defined results: null or wordless texts have ``n_words = 0`` and no hits; an item
without words has no window; items with a null id mark words but are not listed;
repeated rows of documents each give a row, repeated ids of items count once;
extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplewise.llm import kernel
from tuplewise.llm.common import small_batches

SPAN = 13
GRAM = 5
BLOCK_BYTES = 8 << 20
#: matches that are extended at once
PAIRS = 1 << 20

_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_from array<int>, hit_to array<int>"


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the minimum (the rightmost of equals) of each run of ``window`` hashes."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, window):
        other = hashes[j : j + n]
        take = other <= low
        low[take] = other[take]
        at[take] = np.flatnonzero(take) + j
    return np.unique(at)


class Fingerprints:
    """The fingerprints of some benchmark items: what a document task looks up."""

    def __init__(self, items: list[tuple[str | None, str | None]], span: int = SPAN, gram: int = GRAM) -> None:
        self.span, self.gram = span, gram
        self.ids: list[str | None] = []
        words: list[np.ndarray] = []
        prints: list[np.ndarray] = []
        places: list[np.ndarray] = []
        short: dict[int, dict[int, list[int]]] = {}
        at = 0
        for _, _, got in kernel.words_of(pa.array([t for _, t in items], pa.large_string()), kernel.ALNUM_WORDS, True):
            for i in range(len(got.first) - 1):
                own = got.hash[got.first[i] : got.first[i + 1]]
                item = len(self.ids)
                self.ids.append(items[item][0])
                if 0 < len(own) < span:
                    key = int(kernel.grams(own, len(own))[0])
                    short.setdefault(len(own), {}).setdefault(key, []).append(item)
                elif len(own):
                    hashes = kernel.grams(own, gram)
                    picked = winnow(hashes, span - gram + 1)
                    prints.append(hashes[picked])
                    places.append(picked + at)
                words.append(own)
                at += len(own)
        none = [np.zeros(0, dtype=np.uint64)]
        self.words = np.concatenate(words + none)
        self.owner = np.repeat(np.arange(len(words)), [len(w) for w in words]).astype(np.int64)
        found, where = np.concatenate(prints + none), np.concatenate(places + [np.zeros(0, dtype=np.int64)])
        order = np.argsort(found, kind="stable")
        self.prints, self.places = found[order], where[order]
        self.short = {n: (np.array(sorted(by), dtype=np.uint64), by) for n, by in short.items()}

    def hits(self, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, item) of every match, as word positions; ``text`` numbers the text of each word."""
        out = [self._long(words, text)] if len(self.prints) else []
        for n, (keys, by) in self.short.items():
            found = kernel.grams(words, n)
            inside = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found)
            inside = inside[text[inside] == text[inside + n - 1]]
            pairs = [(p, item) for p in inside.tolist() for item in by[int(found[p])]]
            if pairs:
                start, item = np.array(pairs, dtype=np.int64).T
                out.append((start, start + n, item))
        if not out:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _long(self, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = kernel.grams(words, self.gram)
        # A document window of all-equal minima may pick another of its equal grams than the item did;
        # comparing every selected hash by value, not by position, makes that harmless.
        picked = self._picked(found)
        low = np.searchsorted(self.prints, found[picked], side="left")
        high = np.searchsorted(self.prints, found[picked], side="right")
        many = high - low
        if many.sum() <= PAIRS or len(picked) == 1:
            return self._extended(words, text, picked, low, many)
        # texts and items of one word over and over match everywhere: by runs of matches that fit in memory
        cuts = np.searchsorted(np.cumsum(many), np.arange(PAIRS, int(many.sum()), PAIRS)) + 1
        parts = [self._extended(words, text, *x) for x in zip(*(np.split(y, np.unique(cuts)) for y in (picked, low, many)), strict=True)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _extended(self, words: np.ndarray, text: np.ndarray, picked: np.ndarray, low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc = np.repeat(picked, many)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = self.places[np.repeat(low, many) + step]
        same = text[doc] == text[np.minimum(doc + self.gram - 1, len(text) - 1)] if len(doc) else np.zeros(0, dtype=bool)
        doc, place = doc[same], place[same]
        start, end = doc.copy(), doc + self.gram
        self._extend(words, text, start, place, -1)
        self._extend(words, text, end, place + self.gram + (end - doc - self.gram), +1)
        owner = self.owner[place]
        spans = np.unique(np.stack([start, end, owner], axis=1), axis=0) if len(doc) else np.zeros((0, 3), dtype=np.int64)
        spans = spans[spans[:, 1] - spans[:, 0] >= self.span]
        return spans[:, 0], spans[:, 1], spans[:, 2]

    def _picked(self, found: np.ndarray) -> np.ndarray:
        """Winnowed positions, with every position whose hash equals its window's minimum."""
        window = self.span - self.gram + 1
        n = len(found) - window + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        low = found[:n].copy()
        for j in range(1, window):
            np.minimum(low, found[j : j + n], out=low)
        keep = np.zeros(len(found), dtype=bool)
        for j in range(window):
            keep[j : j + n] |= found[j : j + n] == low
        keep &= np.isin(found, self.prints) if keep.sum() * 4 > len(found) else True
        return np.flatnonzero(keep)

    def _extend(self, words: np.ndarray, text: np.ndarray, edge: np.ndarray, place: np.ndarray, way: int) -> None:
        """Moves each edge outward while the next word of the text equals the next word of the item."""
        place = place.copy()
        live = np.arange(len(edge))
        while len(live):
            i, j = (edge[live] - 1, place[live] - 1) if way < 0 else (edge[live], place[live])
            inner_i, inner_j = (edge[live], place[live]) if way < 0 else (edge[live] - 1, place[live] - 1)
            ok = (i >= 0) & (i < len(words)) & (j >= 0) & (j < len(self.words))
            live, i, j, inner_i, inner_j = live[ok], i[ok], j[ok], inner_i[ok], inner_j[ok]
            ok = (words[i] == self.words[j]) & (text[i] == text[inner_i]) & (self.owner[j] == self.owner[inner_j])
            live = live[ok]
            edge[live] += way
            place[live] += way


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of half-open spans."""
    out: list[list[int]] = []
    for a, b in sorted(set(zip(start.tolist(), end.tolist(), strict=True))):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _row(doc_id, n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    hit = sum(b - a for a, b in spans)
    return doc_id, n_words, hit, len(items), _digest(items), hit > 0 and 20 * hit >= n_words, sorted(items), [a for a, _ in spans], [b for _, b in spans]


def _arrow_schema() -> pa.Schema:
    listed = {"items": pa.list_(pa.string()), "hit_from": pa.list_(pa.int32()), "hit_to": pa.list_(pa.int32())}
    plain = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_()}
    return pa.schema(plain | listed)


def _marker(table):
    """A task's function: marks the documents of a batch against one block's fingerprints."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: Fingerprints = table.value
        schema, empty = _arrow_schema(), _digest(set())
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for row, to, got in kernel.words_of(texts, kernel.ALNUM_WORDS, True):
                counts = np.diff(got.first)
                text = np.repeat(np.arange(to - row), counts)
                start, end, item = prints.hits(got.hash, text)
                rows = [(ids[row + i], n, 0, 0, empty, False, [], [], []) for i, n in enumerate(counts.tolist())]
                if len(start):
                    order = np.argsort(text[start], kind="stable")
                    start, end, item = start[order], end[order], item[order]
                    owner = text[start]
                    for i, low, high in zip(*_runs(owner), strict=True):
                        names = {str(prints.ids[k]) for k in set(item[low:high].tolist()) if prints.ids[k] is not None}
                        spans = _spans(start[low:high] - got.first[i], end[low:high] - got.first[i])
                        rows[i] = _row(ids[row + i], int(counts[i]), spans, names)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return mark


def _runs(owner: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return owner[at].tolist(), at.tolist(), np.r_[at[1:], len(owner)].tolist()


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's (id, text) rows, as blocks of at most ``block_bytes`` of text (or one longer item)."""
    block: list[tuple[str | None, str | None]] = []
    size = 0
    for row in items.toLocalIterator():
        more = len((row[1] or "").encode())
        if block and size + more > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += more
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Marks each document (doc_id, text) with its hits from ``benchmark`` (item_id, text).

    Returns a row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated (hit words are a twentieth of the text or more), the sorted
    item ids, the hit spans as word positions, and xxhash64 of the text.  See the
    module's docstring.
    """
    if not 0 < gram <= span:
        raise ValueError("gram must lie between 1 and span")
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    many = items.agg(F.sum(F.octet_length(F.col("text")))).first()[0] or 0
    if many <= block_bytes:
        only = spark.sparkContext.broadcast(Fingerprints([tuple(r) for r in items.collect()], span, gram))
        return rows.mapInArrow(_keyed(_marker(only)), _SCHEMA + ", text_hash long")
    # More than one block: spans of the same document meet again by its id and hash, never its text.
    parts = []
    for block in _blocks(items, block_bytes):
        table = spark.sparkContext.broadcast(Fingerprints(block, span, gram))
        parts.append(rows.mapInArrow(_keyed(_marker(table)), _SCHEMA + ", text_hash long"))
    every = parts[0].withColumn("block", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("block", F.lit(k)))
    merged = every.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("block") == 0, 1)).alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.size("hit_from") > 0, F.arrays_zip("hit_from", "hit_to"))))).alias("spans"),
    )
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to"), F.array().cast("array<int>").alias("a"), F.array().cast("array<int>").alias("b")),
        lambda s, x: F.struct(
            (s.hit + F.greatest(F.lit(0), x.hit_to - F.greatest(s.to, x.hit_from))).alias("hit"),
            F.greatest(s.to, x.hit_to).alias("to"),
            F.when((F.size(s.a) > 0) & (x.hit_from <= s.to), s.a).otherwise(F.concat(s.a, F.array(x.hit_from))).alias("a"),
            F.when((F.size(s.a) > 0) & (x.hit_from <= s.to), F.concat(F.slice(s.b, 1, F.size(s.b) - 1), F.array(F.greatest(s.to, x.hit_to)))).otherwise(F.concat(s.b, F.array(x.hit_to))).alias("b"),
        ),
    )
    merged = merged.withColumn("s", step).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    hit = F.col("s.hit").cast("long")
    return merged.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
        "items", F.col("s.a").alias("hit_from"), F.col("s.b").alias("hit_to"), "text_hash",
    )


def _keyed(mark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for out in mark(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2).slice(row, out.num_rows)], names=[*out.schema.names, "text_hash"])
                row += out.num_rows

    return run
