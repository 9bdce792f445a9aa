"""SentencePiece encoding and decoding by a streaming Viterbi, and token counts by two-tier lookup.

Encoding
--------
The model's kind is byte-pair encoding, so the best path through the lattice of
pieces isn't the one with the largest score sum but the one that the merges make.
That path too can be found from left to right: an encoding is what the merges
make exactly if every two neighbouring pieces, merged on their own, stay as they
are.  So each boundary of the lattice has one surviving backpointer, to the piece
that ends there and is stable beside the piece that ends where it starts.  Future
pieces can start at the last ``longest piece`` boundaries only: that window is
all that is kept, and ids are committed up to the boundary on which the paths
from all boundaries of the window converge.  Results equal the library's.

Between two characters that no piece holds side by side, all paths converge at
once.  ``Encoder.encode`` cuts texts there (words, runs of spaces, line ends), some ten
thousand characters at a time, and keeps the ids of recent short stretches, so the
lattice is built for new ones only.

Decoding joins the bytes of the pieces, byte pieces included, and drops the space
that encoding puts before a text.  A text returns unchanged, save that the
character U+2581 is read as a space, as in the library.

Defined results: a null or empty text has no ids and decodes to the empty text;
repeated rows are rows of their own; extra columns are kept; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplewise.llm.common import fresh, small_batches

SPACE = "▁"
#: stretches of text that a worker remembers, twice over; longer ones than KEPT_CHARS are not remembered
KEPT, KEPT_CHARS = 1 << 18, 64
#: characters of a long text that are cut into stretches at once, to the next place where paths converge
CHUNK = 1 << 16


class Recent(dict):
    """A bounded memory of ``make(key)``: two generations, of which the older one goes when the younger is full."""

    def __init__(self, make, limit: int = KEPT) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.learn({key: value})
        return value

    def learn(self, more: dict) -> None:
        for key, value in more.items():
            if len(key) <= KEPT_CHARS:
                if len(self) >= self.limit:
                    self.old = dict(self)
                    self.clear()
                self[key] = value


    def forget(self) -> None:
        """Drops the older generation: what a worker holds between tasks."""
        self.old = {}


class Encoder:
    """A SentencePiece byte-pair model with byte fallback, read from ``path``."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(self.size)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        self.longest = max(map(len, self.ids))
        # what each id stands for in a decoded text
        raw = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.bytes_at = np.cumsum([0, *map(len, raw)])
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        together = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        cuts = not any(a != SPACE == b for a, b in together) and not any("\n" in pair for pair in together)
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if cuts else r"(?s:.+)").findall
        self.cut = re.compile(f"\n|(?<=[^{SPACE}\n])(?={SPACE})" if cuts else r"(?s:\Z)").search
        self.pairs = Recent(lambda pair: self.merge(pair[0] + pair[1]) == [p for p in pair if p])
        self.recent = Recent(self._encoded)

    def merge(self, text: str) -> list[str]:
        """Merges a few characters: best score first, of equals the leftmost."""
        parts = list(text)
        while True:
            best = max(((self.score[p], -k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _extend(self, text: str, last: list[str]) -> None:
        """Finds the backpointer of each further boundary: ``last[b]`` is the piece that ends at b, ``last[0]`` the one before the window.

        Just one piece ends the encoding of a prefix, so the order of trial doesn't matter.
        """
        known, stable = self.ids, self.pairs
        seen = stable.get
        for before in range(len(last) - 1, len(text)):
            at = before + 1
            piece = text[before]  # a character on its own may end an encoding, known or not
            pair = last[before], piece
            fits = seen(pair)
            while not (stable[pair] if fits is None else fits):
                before -= 1
                while (piece := text[before:at]) not in known:
                    before -= 1
                pair = last[before], piece
                fits = seen(pair)
            last.append(piece)

    def stream(self, chunks) -> Iterator[int]:
        """Ids of the chunks joined, in which spaces already are U+2581; yields ids as soon as they are certain."""
        text, last = "", [""]  # the window, and the piece that ends at each boundary of it
        step = 4 * self.longest
        for chunk in chunks:
            for start in range(0, len(chunk), step):
                if len(text) >= step and (sure := self._converged(last)):
                    yield from self._ids(last, sure)
                    text, last = text[sure:], last[sure:]
                text += chunk[start : start + step]
                self._extend(text, last)
        yield from self._ids(last, len(text))

    def _encoded(self, text: str) -> bytes:
        """The ids of a stretch; a short one is all window."""
        if len(text) > 4 * self.longest:
            return array("i", self.stream([text])).tobytes()
        last = [""]
        self._extend(text, last)
        return array("i", self._ids(last, len(text))).tobytes()

    def _converged(self, last: list[str]) -> int:
        """The last boundary that the paths from all boundaries of the window share."""
        at = set(range(max(0, len(last) - self.longest), len(last)))
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - len(last[far]))
        return at.pop()

    def _ids(self, last: list[str], to: int) -> list[int]:
        out: list[int] = []
        known = self.ids.get
        while to:
            piece = last[to]
            if (own := known(piece)) is not None:
                out.append(own)
            else:
                out.extend(self.byte_ids[b] for b in reversed(piece.encode()))
            to -= len(piece)
        out.reverse()
        return out

    def chunks(self, text: str) -> Iterator[str]:
        """The text with its leading space and visible spaces, in runs of about CHUNK characters that end where all paths converge."""
        text, start = SPACE + text.replace(" ", SPACE) if text else "", 0
        while len(text) - start > CHUNK and (found := self.cut(text, start + CHUNK)):
            yield text[start : found.end()]
            start = found.end()
        yield text[start:]

    def stretches(self, text: str) -> Iterator[str]:
        """The text, cut where all paths converge."""
        return chain.from_iterable(map(self.stretch, self.chunks(text)))

    def encode(self, text: str) -> np.ndarray:
        parts = [b"".join(map(self.recent.__getitem__, self.stretch(chunk))) for chunk in self.chunks(text)]
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of runs ``ids[offsets[i]:offsets[i + 1]]``, as an Arrow binary column."""
        size = (self.bytes_at[1:] - self.bytes_at[:-1])[ids]
        ends = np.r_[0, np.cumsum(size)]
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.bytes_at[ids], size)
        data = self.bytes[place] if len(place) else np.zeros(0, dtype=np.uint8)
        at = ends[offsets]
        first = at[:-1] + ((at[1:] > at[:-1]) & (data[np.minimum(at[:-1], max(len(data) - 1, 0))] == 32) if len(data) else 0)
        keep = np.ones(len(data), dtype=bool)
        keep[at[:-1][first > at[:-1]]] = False
        kept = np.r_[0, np.cumsum(keep)][at].astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(kept.tobytes()), pa.py_buffer(data[keep].tobytes())])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    return Encoder(path)


def encode_decode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``round_trip`` (decoding the ids gives the text again).

    The model's file must be at ``model`` on every machine.  Map-only: nothing is
    shuffled, and a worker holds one batch of texts at a time.
    """
    small_batches(docs.sparkSession)
    clash = {"ids", "n_tokens", "round_trip"} & set(docs.columns)
    schema = docs.drop(*clash).withColumns({"ids": F.lit(None).cast("array<int>"), "n_tokens": F.lit(0).cast("long"), "round_trip": F.lit(True)}).schema
    own_text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.withColumn(fresh(docs, "_t"), own_text).drop(*clash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            strings = texts.to_pylist()
            parts = [own.encode(t) for t in strings]
            offsets = np.r_[0, np.cumsum([len(p) for p in parts])]
            ids = np.concatenate([*parts, np.zeros(0, dtype=np.int32)])
            again = own.decoded(ids, offsets).to_pylist()
            same = [a == t.replace(SPACE, " ").encode() for a, t in zip(again, strings, strict=True)]
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            columns = [*batch.columns[:-1], listed, pa.array(np.diff(offsets), pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "ids", "n_tokens", "round_trip"])
        own.recent.forget()
        own.pairs.forget()

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the decoded text of their ``ids`` as column ``out``."""
    small_batches(rows.sparkSession)
    rows = rows.drop(out) if out in rows.columns and out != ids else rows
    schema = rows.withColumn(out, F.lit("")).schema
    rows = rows.withColumn(fresh(rows, "_i"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
            raw = own.decoded(np.fromiter(chain.from_iterable(lists), np.int64, int(offsets[-1])), offsets).to_pylist()
            text = pa.array([b.decode("utf-8", "replace") for b in raw], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=[*batch.schema.names[:-1], out])

    return rows.mapInArrow(run, schema)
