"""Vectorised word hashing over Arrow string columns.

All text operators of this subpackage that need words, word n-grams or shingle
sets use this one kernel.  It works on the raw UTF-8 buffer of an Arrow column:
word boundaries come from a 256-entry byte table, and a word is hashed by its blocks
of eight bytes: each is mixed with its position before they are added up, so sums
of different words don't meet by their structure, as those of a polynomial mod 2**64
do.  No Python string is created per word.  Word classes used here treat every byte
>= 0x80 alike, which makes byte-level splitting agree with code-point-level splitting.

Work is done in slices of at most ``SLICE_BYTES`` bytes of text (a longer single
text forms its own slice), so memory follows the slice and not the Arrow batch.
Hashes depend on the word's bytes only: equal across tasks, machines and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _table(separators: bytes) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: words are runs of anything but ASCII white space
SPACE_WORDS = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: words are runs of ASCII letters and digits and of anything beyond ASCII
ALNUM_WORDS = _table(bytes(b for b in range(128) if not chr(b).isalnum()))


_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
#: the low bytes of a block that belong to a word of which so many are left
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of each run ``data[start:start + size]`` of at least one byte."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    block = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    total = mix((block[start] & _LEFT[np.minimum(size, 8)]) + _STEP)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        first = np.cumsum(more) - more
        k = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        left = np.minimum(np.repeat(size[long], more) - 8 * k, 8)
        values = block[np.repeat(start[long], more) + 8 * k] & _LEFT[left]
        total[long] += np.add.reduceat(mix(mix(values + _STEP) + (k + 1).astype(U64) * _STEP), first)
    return mix(total + size.astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """The words of a run of texts.

    ``start``/``end`` are byte positions within ``data``; ``hash`` is the word's
    64-bit hash; ``first[i]:first[i + 1]`` are the words of text ``i``.
    """

    __slots__ = ("data", "start", "end", "hash", "first", "base")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool) -> None:
        self.data = data
        self.base = offsets[:-1]
        inside = table[data]
        n = len(data)
        breaks = np.zeros(n + 1, dtype=bool)
        breaks[offsets] = True
        opens = inside.copy()
        closes = inside.copy()
        if n:
            opens[1:] &= ~inside[:-1] | breaks[1:n]
            closes[:-1] &= ~inside[1:] | breaks[1:n]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.hash = _hashes(_LOWERED[data] if lower else data, self.start, self.end - self.start)
        self.first = np.searchsorted(self.start, offsets)


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) for runs of rows of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return
    kind, wide = column.type, pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(kind) or pa.types.is_binary(kind)):
        column, wide = column.cast(pa.large_string()), True
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        to = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, row + 1), len(column))
        yield row, to, raw[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def words_of(column: pa.Array | pa.ChunkedArray, table: np.ndarray, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """The words of each run of rows of a string column."""
    for row, to, data, offsets in slices(column):
        yield row, to, Words(data, offsets, table, lower)


@lru_cache(maxsize=64)
def _factors(k: int) -> np.ndarray:
    return mix(np.arange(k, dtype=U64) + U64(0x51ED270B + k)) | U64(1)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` consecutive word hashes (across text boundaries too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    factors = _factors(k)
    out = hashes[:n] * factors[0]
    for j in range(1, k):
        out += hashes[j : j + n] * factors[j]
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct ``k``-word shingles of one text; with fewer words, the whole sequence as one."""
    if not len(hashes):
        return np.zeros(0, dtype=U64)
    found = grams(hashes, k) if len(hashes) >= k else grams(hashes, len(hashes))
    return np.unique(found)
