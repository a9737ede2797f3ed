"""Lines that many documents share, found with two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least ``FEWEST_CHARACTERS`` that
``DOCUMENTS`` documents or more hold stay in one document only, that of the greatest doc_id; all other documents lose
every line of the key.

1. Tasks put the hash of each document's distinct long keys into two filters, seen once and seen twice. The merged
   second filter, of a fixed number of bits, is broadcast.
2. Only keys that it knows, suspected repeats, are shuffled: a 128-bit digest and the document. They are counted
   exactly, and the document that keeps the key is chosen.
3. Confirmed keys meet the suspects by digest, lost line numbers are gathered per document and meet the texts. A
   key that very many documents hold is reduced by aggregation and split by adaptive execution in the join.

The filters have one size for every input. When they fill up, more keys are suspected and shuffled, down to all of them: the
result is the same.

Defined results: a null or empty text is one empty line. A document is a doc_id: rows of one id are one document, null ids
are one document that comes before all others. Rows of one id lose the same keys, each from its own text. Rows of equal id
and text stay apart. Other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm import bloom
from vacantia.llm.words import _BLANK, Texts, _byte_values, lowered, mixed, slices
from vacantia.staging import stage

FEWEST_CHARACTERS = 20
DOCUMENTS = 3
# Tasks that fill filters read this many input partitions or more each: filters are sent per task, not per partition.
FILTERS_PER_CORE = 1

_ODD = np.uint64(0x9E3779B97F4A7C15)
_IS_BLANK = np.isin(np.arange(256), np.frombuffer(_BLANK.encode("latin-1"), np.uint8))


class _Lines:
    """The long keys of a slice of texts: row, number of the line in its text, bytes ``start`` to ``end``, hash."""

    def __init__(self, texts: Texts) -> None:
        self.data = data = lowered(texts.data)
        cuts = np.flatnonzero(data == 10)
        # A line starts where a text does and behind every line feed.
        starts = np.concatenate((texts.offsets[:-1], cuts + 1))
        row = np.concatenate((np.arange(texts.rows), np.searchsorted(texts.offsets, cuts, "right") - 1))
        order = np.lexsort((starts, row))
        starts, row = starts[order], row[order]
        ends = np.append(starts[1:] - 1, texts.offsets[-1])
        last = np.append(row[1:] != row[:-1], True)
        ends[last] = texts.offsets[row[last] + 1]
        self.lines = np.bincount(row, minlength=texts.rows)
        number = np.arange(len(row)) - (np.cumsum(self.lines) - self.lines)[row]
        visible = np.flatnonzero(~_IS_BLANK[data])
        low, high = np.searchsorted(visible, starts), np.searchsorted(visible, ends)
        some = high > low
        begin, end = visible[low[some]], visible[high[some] - 1] + 1
        characters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        long = characters[end] - characters[begin] >= FEWEST_CHARACTERS
        self.row, self.number = row[some][long], number[some][long]
        self.start, self.end = begin[long], end[long]

    def hashes(self) -> np.ndarray:
        length = self.end - self.start
        if not len(length):
            return np.zeros(0, np.uint64)
        first = np.cumsum(length) - length
        place = np.arange(length.sum()) - np.repeat(first, length)
        powers = np.cumprod(np.full(int(length.max()), _ODD, np.uint64))
        values = _byte_values()[self.data[np.repeat(self.start, length) + place]] * powers[place]
        return mixed(np.add.reduceat(values, first) + length.astype(np.uint64))


def _filters(texts: DataFrame) -> np.ndarray:
    """The filter of keys that two documents may hold."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            for part in slices(batch["text"]):
                lines = _Lines(part)
                hashes = lines.hashes()
                seen = seen or bloom.Seen()
                order = np.lexsort((hashes, lines.row))
                row, hashes = lines.row[order], hashes[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                seen.add(hashes[new])
        if seen is not None:
            yield from seen.slices()

    context = texts.sparkSession.sparkContext
    few = texts.select("text").coalesce(FILTERS_PER_CORE * context.defaultParallelism)
    return bloom.merged(few.mapInArrow(fill, bloom.SLICES), "twice")


_KEY = ["doc_id", "h1", "h2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with 128 bits of their text, which tell texts of one id apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2"))


def _suspects(keyed: DataFrame, twice: np.ndarray) -> DataFrame:
    """(doc_id, h1, h2, key, lines): a row per document and suspected key, with the numbers of its lines."""
    shared = keyed.sparkSession.sparkContext.broadcast(twice)  # BITS / 8 bytes

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch["text"]):
                lines = _Lines(part)
                at = np.flatnonzero(bloom.holds(shared.value, lines.hashes()))
                data, found = lines.data.tobytes(), {}
                for row, number, start, end in zip(*(x[at].tolist() for x in (lines.row, lines.number, lines.start, lines.end))):
                    key = hashlib.blake2b(data[start:end], digest_size=16).digest()
                    found.setdefault((row, key), []).append(number)
                rows = pa.array([row + part.first for row, _ in found], pa.int64())
                columns = [batch[name].take(rows) for name in _KEY]
                columns += [pa.array([key for _, key in found], pa.binary()), pa.array(list(found.values()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, [*_KEY, "key", "lines"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.select(*_KEY, "text").mapInArrow(look, f"doc_id {kind}, h1 long, h2 long, key binary, lines array<int>")


def repeated_keys(suspects: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(key, keeper) of the keys that so many documents hold; the greatest doc_id keeps the key."""
    once = suspects.select("key", "doc_id").distinct()
    counted = once.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("n") >= documents).select("key", "keeper")


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, lost: pa.Array) -> pa.Array:
    """Texts without the lines of the given numbers."""
    out = []
    for text, numbers in zip(texts, lost):
        if not numbers.is_valid:
            out.append(text.as_py())
        else:
            gone = set(numbers.values.to_pylist())
            out.append("\n".join(line for i, line in enumerate(text.as_py().split("\n")) if i not in gone))
    return pa.array(out, pa.string())


def without_repeated_lines(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (what is kept of it; empty for null)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = _keyed(rows)
    suspects = stage(_suspects(keyed, _filters(rows)), "line-suspects").table
    repeated = stage(repeated_keys(suspects, documents), "line-repeated").table
    met = suspects.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # The same key of equal rows is one entry, so that a group is bounded by the lines of one text.
    lost = met.groupBy(*_KEY).agg(F.flatten(F.collect_set("lines")).alias("lost"))
    lost = stage(lost, "line-lost").table.select(*(F.col(c).alias(f"_{c}") for c in _KEY), "lost")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return keyed.join(lost, same, "left").select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        _without(F.col("text"), F.col("lost")).alias("text"),
    )


def summary(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents
), keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), repeated as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
  select k.*, r.key is not null and k.doc_id <> r.keeper as dropped from keyed k left join repeated r on k.key = r.key
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""
