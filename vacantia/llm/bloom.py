"""Bloom filters of fixed size, filled by many tasks and merged slice by slice.

A filter has ``BITS`` bits whatever the number of hashes, so what a task holds, what is merged and what is broadcast are
bounded. A fuller filter says "maybe" more often and never "no" wrongly: callers confirm what it lets through.

``Seen`` holds two filters: bits that one document has set, and bits that two documents have set. Two tasks' filters
merge into ``(once | once', twice | twice' | once & once')``. They are cut into slices of ``SLICE`` bits; empty slices
are not sent, and the slices of one number are folded one after the other, two at a time in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 1 << 26
SLICE = 1 << 18
_PROBES = (np.uint64(0), np.uint64(32))
_MASK = np.uint64(BITS - 1)
SLICES = "slice int, once binary, twice binary"


def places(hashes: np.ndarray) -> list[np.ndarray]:
    """The bits of each 64-bit hash; the hash should be spread over all its bits."""
    return [((hashes >> shift) & _MASK).astype(np.int64) for shift in _PROBES]


class Seen:
    """The filters of one task, a byte per bit while they are filled."""

    def __init__(self) -> None:
        self.once = np.zeros(BITS, bool)
        self.twice = np.zeros(BITS, bool)

    def add(self, hashes: np.ndarray) -> None:
        """Count each entry as one more sight of its hash; a document's hashes should be distinct."""
        for at in places(hashes):
            order = np.sort(at)
            again = order[1:][order[1:] == order[:-1]]
            self.twice[again] = True
            self.twice[at[self.once[at]]] = True
            self.once[at] = True

    def slices(self) -> Iterator[pa.RecordBatch]:
        for number in range(BITS // SLICE):
            part = slice(number * SLICE, (number + 1) * SLICE)
            if self.once[part].any():
                blobs = [np.packbits(x[part]).tobytes() for x in (self.once, self.twice)]
                yield pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int32()), "once": [blobs[0]], "twice": [blobs[1]]})


class Once:
    """The filter of one task where a second sight does not matter, in BITS / 8 bytes."""

    def __init__(self) -> None:
        self.packed = np.zeros(BITS // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for at in places(hashes):
            np.bitwise_or.at(self.packed, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))

    def slices(self) -> Iterator[pa.RecordBatch]:
        step = SLICE // 8
        for number in range(BITS // SLICE):
            part = self.packed[number * step : (number + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int32()), "once": [part.tobytes()], "twice": [bytes(step)]})


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        blobs = {"once": [once.tobytes()], "twice": [twice.tobytes()]}
        return pa.RecordBatch.from_pydict({"slice": pa.array([now], pa.int32()), **blobs})

    for batch in batches:
        for number, one, two in zip(batch["slice"].to_pylist(), batch["once"], batch["twice"]):
            one, two = (np.frombuffer(x.as_buffer(), np.uint8) for x in (one, two))
            if number != now:
                if now is not None:
                    yield done()
                now, once, twice = number, one.copy(), two.copy()
            else:
                twice |= two | (once & one)
                once |= one
    if now is not None:
        yield done()


def merged(parts: DataFrame, which: str) -> np.ndarray:
    """The packed bits of ``which`` filter ("once" or "twice") over all tasks' ``SLICES`` rows: BITS / 8 bytes."""
    tasks = min(BITS // SLICE, parts.sparkSession.sparkContext.defaultParallelism)
    whole = parts.repartition(tasks, "slice").sortWithinPartitions("slice").mapInArrow(_folded, SLICES)
    out = np.zeros(BITS // 8, np.uint8)
    for row in whole.select("slice", which).toLocalIterator():
        begin = row["slice"] * (SLICE // 8)
        out[begin : begin + SLICE // 8] = np.frombuffer(row[which], np.uint8)
    return out


def holds(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """May each hash be in the filter?"""
    maybe = np.ones(len(hashes), bool)
    for at in places(hashes):
        maybe &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return maybe
