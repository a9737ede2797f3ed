"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``WINDOW`` consecutive words of an item, or the whole item if it is shorter. As a
window occurs only if all its words do, the prefix that must be joined is one word: the window's
rarest by its count over the whole corpus. Documents are probed with these words only. A hit
fixes where the window would begin; length and position bounds drop windows that would begin
before the text, end after it or cross into another text; what is left is compared word by word.

Items come in blocks of at most ``BLOCK_WINDOWS`` windows. A block's index is broadcast, with
that bound; more items mean more blocks, each held against all documents, never a larger
broadcast.

Defined results: null and empty texts have no words and are never hit. An item without words has
no window. Items of one id count as one item. A null item id is hit like others but is not named
among the items. An id is named once however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.words import LETTERS, Words, lowered, slices, split_words, sums_by_row
from vacantia.staging import stage

WINDOW = 13
SHARE = 20  # contaminated from one hit word in so many
BLOCK_WINDOWS = 500_000
_PROBE_BITS = 20


def _words(texts) -> Words:
    return split_words(texts, LETTERS, lowered(texts.data))


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def item_windows(items: DataFrame) -> DataFrame:
    """All distinct windows: item_id, and the words of the window as hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch["text"]):
                words = _words(texts)
                ids, windows = [], []
                for i in range(texts.rows):
                    mine = _signed(words.hash[words.first[i] : words.first[i + 1]])
                    size = min(WINDOW, len(mine))
                    for start in range(len(mine) - size + 1 if size else 0):
                        ids.append(batch["item_id"][texts.first + i].as_py())
                        windows.append(mine[start : start + size])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(windows, pa.list_(pa.int64()))], ["item_id", "words"]
                )

    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return named.mapInArrow(cut, "item_id string, words array<long>").distinct()


def _common(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """How often each of the ``wanted`` (sorted) words occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Keys(shared.value)
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for texts in slices(batch["text"]):
                _, key = known.find(_words(texts).hash)
                total += np.bincount(key, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": _signed(shared.value[at]), "n": total[at]})

    return docs.select("text").mapInArrow(tally, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Keys:
    """Where sorted hashes occur among many; most are turned away by one look into a bit table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(1 << _PROBE_BITS, bool)
        self.seen[self._slot(keys)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _PROBE_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that hold a key, and the number of the key."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.flatnonzero(self.seen[self._slot(hashes)])
        key = np.minimum(np.searchsorted(self.keys, hashes[place]), len(self.keys) - 1)
        hit = self.keys[key] == hashes[place]
        return place[hit], key[hit]


@dataclass(frozen=True)
class Index:
    """Windows ordered by their rarest word; those of key k are ``first[k]`` to ``first[k + 1]``."""

    keys: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    words: np.ndarray
    item: np.ndarray
    names: list[str | None]


def _index(windows: list[tuple[str | None, list[int]]], counts: dict[int, int]) -> Index:
    """Every window under its rarest word; of equally rare words the one of least hash counts."""
    key, offset, size, item = [], [], [], []
    words = np.zeros((len(windows), WINDOW), np.int64)
    names: dict[str | None, int] = {}
    for i, (name, window) in enumerate(windows):
        rarest = min(range(len(window)), key=lambda j: (counts.get(window[j], 0), window[j], j))
        key.append(window[rarest])
        offset.append(rarest)
        size.append(len(window))
        words[i, : len(window)] = window
        item.append(names.setdefault(name, len(names)))
    hashes = np.array(key, np.int64).view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    keys, first = np.unique(hashes[order], return_index=True)
    return Index(
        keys,
        np.append(first, len(order)).astype(np.int64),
        np.array(offset, np.int64)[order],
        np.array(size, np.int64)[order],
        words[order].view(np.uint64),
        np.array(item, np.int64)[order],
        list(names),
    )


def _occurrences(words: Words, index: Index, known: Keys) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of each window that occurs."""
    place, key = known.find(words.hash)
    many = index.first[key + 1] - index.first[key]
    window = np.repeat(index.first[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = np.repeat(place, many) - index.offset[window]
    end = start + index.size[window]
    # Bounds first: within the texts, and both ends in the text of the joined word.
    row_of = np.searchsorted(words.first, np.repeat(place, many), "right") - 1
    inside = (start >= words.first[row_of]) & (end <= words.first[row_of + 1])
    start, window = start[inside], window[inside]
    for step in range(WINDOW):
        part = step < index.size[window]
        same = ~part
        same[part] = words.hash[start[part] + step] == index.words[window[part], step]
        start, window = start[same], window[same]
    return start, window


def _block(docs: DataFrame, index: Index):
    """A column function from text to its word count, hit stretches of words and items."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # BLOCK_WINDOWS windows at most

    @F.arrow_udf("n_words long, hits array<struct<b: long, e: long>>, items array<string>")
    def match(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        known = Keys(index.keys)
        stretch = pa.struct([("b", pa.int64()), ("e", pa.int64())])
        kinds = [pa.int64(), pa.list_(stretch), pa.list_(pa.string())]
        for column in columns:
            counts, hits, items = [], [], []
            for texts in slices(column):
                words = _words(texts)
                start, window = _occurrences(words, index, known)
                counts.append(words.counts.astype(np.int64))
                row = np.searchsorted(words.first, start, "right") - 1
                mine: list[list] = [[] for _ in range(texts.rows)]
                named: list[list] = [[] for _ in range(texts.rows)]
                for r in np.unique(row):
                    here = row == r
                    edge = np.zeros(words.first[r + 1] - words.first[r] + 2, np.int64)
                    begin = start[here] - words.first[r]
                    np.add.at(edge, begin + 1, 1)
                    np.add.at(edge, begin + 1 + index.size[window[here]], -1)
                    step = np.diff((np.cumsum(edge) > 0).astype(np.int8))
                    mine[r] = [{"b": b, "e": e} for b, e in zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist())]
                    named[r] = [index.names[i] for i in np.unique(index.item[window[here]])]
                hits += mine
                items += named
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays(
                [pa.array(total), pa.array(hits, kinds[1]), pa.array(items, kinds[2])], ["n_words", "hits", "items"]
            )

    return match



@dataclass(frozen=True)
class Plan:
    """The indexes of all blocks of items."""

    blocks: list[Index]


def plan(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS) -> Plan:
    """Cut the items into windows, count their words over all documents, index block by block."""
    windows = stage(item_windows(items), "windows")
    blocks = max(1, -(-windows.rows // block_windows))
    # Range cuts of the written table in hash order bound every block.
    numbered = windows.table.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    out = []
    for number in range(blocks):
        part = [(row["item_id"], row["words"]) for row in numbered.where(F.col("block") == number).select("item_id", "words").collect()]
        part.sort(key=lambda window: (window[0] is None, window[0] or "", window[1]))
        wanted = np.unique(np.array([w for _, window in part for w in window], np.int64).view(np.uint64))
        counts = {row["word"]: row["n"] for row in _common(docs, wanted).collect()} if len(wanted) else {}
        out.append(_index(part, counts))
    return Plan(out)


def with_hits(docs: DataFrame, found: Plan, into: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct column (n_words, n_hit, items); no row moves.

    With several blocks the stretches of all blocks are united per row.
    """
    parts = [_block(docs, index)(F.col(text)) for index in found.blocks]
    names = [f"_{into}_{i}" for i in range(len(parts))]
    out = docs.withColumns(dict(zip(names, parts)))
    hits = F.flatten(F.array(*[F.col(f"{name}.hits") for name in names]))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{name}.items") for name in names]))))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, h):
        end = F.greatest(acc["end"], h["e"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.least(end, F.greatest(acc["end"], h["b"]))).alias("n"))

    united = F.aggregate(F.array_sort(hits), start, add, lambda acc: acc["n"])
    return out.withColumn(
        into, F.struct(F.col(f"{names[0]}.n_words").alias("n_words"), united.alias("n_hit"), F.array_compact(items).alias("items"))
    ).drop(*names)


def contaminated(result: str):
    """Is at least one word in ``SHARE`` hit?"""
    return (F.col(f"{result}.n_hit") > 0) & (SHARE * F.col(f"{result}.n_hit") >= F.col(f"{result}.n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    rows = docs.select("doc_id", "text")
    found = with_hits(rows, plan(rows, items, block_windows), "found")
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated("found").alias("contaminated"),
        F.col("found.items").alias("items"),
    )
