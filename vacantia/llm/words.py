"""Words of whole Arrow text columns, cut and hashed without a loop over rows.

Texts are handled as UTF-8 bytes: every class of bytes used here holds ASCII bytes and,
as a block, all bytes from 0x80 up, so a word never ends inside a character. Work is done in
slices of rows of about ``SLICE_BYTES``, which bounds memory whatever the batch size; one
text longer than that is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_SEED = 20240229
_ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_classes(**ranges: str) -> np.ndarray:
    """Class 1, 2, ... for the bytes of each given set, in order; 0 (a gap) for all others."""
    table = np.zeros(256, np.uint8)
    for number, members in enumerate(ranges.values(), 1):
        table[np.frombuffer(members.encode("latin-1"), np.uint8)] = number
    return table


def _span(first: int, last: int) -> str:
    return "".join(map(chr, range(first, last + 1)))


_HIGH = _span(0x80, 0xFF)
_BLANK = "\x20" + _span(0x09, 0x0D)
# Words between white space: [^\x20\x09-\x0D]+
PLAIN = byte_classes(word="".join(c for c in _span(0, 255) if c not in _BLANK))
# Words of digits, lower-case letters and non-ASCII characters: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
LETTERS = byte_classes(word=_span(0x30, 0x39) + _span(0x61, 0x7A) + _HIGH)
# Runs of letters and digits, and runs of other visible characters.
_ALNUM = _span(0x30, 0x39) + _span(0x41, 0x5A) + _span(0x61, 0x7A) + _HIGH
PIECES = byte_classes(word=_ALNUM, sign="".join(c for c in _span(0x21, 0x7E) if c not in _ALNUM))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    out = values ^ (values >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


@dataclass(frozen=True)
class Texts:
    """Rows ``first`` to ``first + rows`` of a column as bytes; row i is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column in slices of whole rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    rows = len(column)
    if not rows:
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, rows + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, rows)
        begin, end = offsets[first], offsets[last]
        yield Texts(first, whole[begin:end], offsets[first : last + 1] - begin)
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    upper = (data >= 0x41) & (data <= 0x5A)
    return np.where(upper, data + np.uint8(32), data)


@dataclass(frozen=True)
class Words:
    """Words in text order: ``hash`` per word, bytes ``start`` to ``end``, words of row i from ``first[i]`` to ``first[i + 1]``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(texts: Texts, classes: np.ndarray, data: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes of one class, never across rows."""
    data = texts.data if data is None else data
    kind = classes[data]
    change = np.empty(len(kind) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[texts.offsets] = True
    inside = kind > 0
    begins = change[:-1] & inside
    start = np.flatnonzero(begins)
    end = np.flatnonzero(change[1:] & inside) + 1
    first = np.searchsorted(start, texts.offsets)
    if not len(start):
        return Words(np.zeros(0, np.uint64), start, end, first)
    at = np.flatnonzero(inside)
    length = end - start
    place = at - np.repeat(start, length)
    powers = np.cumprod(np.full(int(length.max()), _ODD, np.uint64))
    values = _byte_values()[data[at]] * powers[place]
    cuts = np.concatenate(([0], np.cumsum(length)[:-1]))
    return Words(mixed(np.add.reduceat(values, cuts) + length.astype(np.uint64)), start, end, first)


def joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` neighbours, rows not regarded."""
    count = max(0, len(hashes) - size + 1)
    out = hashes[:count].copy()
    for step in range(1, size):
        out *= _ODD
        out += hashes[step : step + count]
    return mixed(out + np.uint64(size))


def within_rows(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """For each run of ``size`` neighbours of ``total`` words: does it stay in one row?"""
    count = max(0, total - size + 1)
    inside = np.ones(count, bool)
    for step in range(1, size):
        edge = first[(first >= step) & (first - step < count)] - step
        inside[edge] = False
    return inside


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values, 0 where a row has none."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]
