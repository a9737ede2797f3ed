"""Quality rules: counts of bad signs, and a log-likelihood ratio of hashed n-grams.

The ratio compares a multinomial over hashed single words and pairs of trusted documents with
that of the raw corpus. A document's score is the mean of ``ln p_trusted - ln p_raw`` over its
n-grams, so it does not depend on length. The limit is set from the trusted documents alone:
their mean less ``DEVIATIONS`` standard deviations. Every document is judged by the same limit.

Raw counts cover every document. The trusted multinomial and the limit cover every document that
the caller names.

Defined results: a null or empty text has no words and all counts 0, and fails the base rule. A
document without n-grams scores 0. Without trusted documents the ratio decides nothing. A line
repeats an earlier one if both hold the same characters and at least one word. Rows of equal ids
are judged each by its own text. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import sample
from vacantia.llm.jaccard import maybe_in
from vacantia.llm.words import PLAIN, Texts, Words, joined, slices, split_words, sums_by_row, within_rows
from vacantia.staging import stage

BITS = 16
SIZE = 1 << BITS
DEVIATIONS = 4.0
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50
WINDOW = 3
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all words and pairs in row order, and where each row begins."""
    pair = joined(words.hash, 2)[keep := within_rows(words.first, 2, len(words.hash))]
    row = words.row
    rows = np.concatenate((row, row[: len(keep)][keep]))
    order = np.argsort(rows, kind="stable")
    at = ((np.concatenate((words.hash, pair)) >> np.uint64(8)) & np.uint64(SIZE - 1)).astype(np.int64)[order]
    return at, np.searchsorted(rows[order], np.arange(len(words.first)))


def _repeated_words(words: Words) -> np.ndarray:
    """Per row, the words covered by a window of three that occurs more than once in the row."""
    window = joined(words.hash, WINDOW)
    keep = np.flatnonzero(within_rows(words.first, WINDOW, len(words.hash)))
    covered = np.zeros(len(words.hash), bool)
    if len(keep):
        row = words.row
        # The same window in another row gets another key.
        key = window[keep] ^ (row[keep].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(keep), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for step in range(WINDOW):
            covered[keep[twice] + step] = True
    return sums_by_row(covered.astype(np.int64), words.first)


def _repeated_lines(texts: Texts) -> np.ndarray:
    data, out = texts.data.tobytes(), np.zeros(texts.rows, np.int64)
    for i in range(texts.rows):
        seen: set[bytes] = set()
        for line in data[texts.offsets[i] : texts.offsets[i + 1]].split(b"\n"):
            if line in seen:
                out[i] += 1
            elif line.strip(_BLANKS):
                seen.add(line)
    return out


def _base(texts: Texts, words: Words) -> dict[str, np.ndarray]:
    """The counts that do not depend on the corpus."""
    inside = np.zeros(len(texts.data), np.int64)
    begins_character = (texts.data & 0xC0) != 0x80
    inside[begins_character & (PLAIN[texts.data] > 0)] = 1
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": sums_by_row(inside, texts.offsets),
        "n_symbols": sums_by_row(_SYMBOLS[texts.data].astype(np.int64), texts.offsets),
        "n_dup_lines": _repeated_lines(texts),
        "n_repeat_words": _repeated_words(words),
    }


@dataclass(frozen=True)
class Ratio:
    """Per coordinate ``ln p_trusted - ln p_raw``, and the least score that passes."""

    values: np.ndarray
    limit: float

    def scores(self, words: Words) -> np.ndarray:
        at, first = _grams(words)
        return sums_by_row(self.values[at], first) / np.maximum(np.diff(first), 1)


def gram_counts(docs: DataFrame) -> np.ndarray:
    """How often each coordinate occurs in all texts; tasks add up vectors of fixed size first."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE, np.int64)
        for batch in batches:
            for texts in slices(batch["text"]):
                total += np.bincount(_grams(split_words(texts, PLAIN))[0], minlength=SIZE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "n": total[at]})

    out = np.zeros(SIZE, np.int64)
    for row in docs.select("text").mapInArrow(tally, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out


def fit(docs: DataFrame, trusted_ids: DataFrame, deviations: float = DEVIATIONS) -> Ratio:
    """The ratio of the documents named by ``trusted_ids`` (doc_id) to all documents.

    Only documents that may be trusted move; their texts are written once and read for the counts and for the limit.
    """
    spark = docs.sparkSession
    ids = stage(trusted_ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "trusted-ids").table
    trusted = stage(maybe_in(docs.select("doc_id", "text"), ids).join(ids, "doc_id", "left_semi").select("text"), "trusted")
    if not trusted.rows:
        return Ratio(np.zeros(SIZE), -np.inf)
    raw, good = gram_counts(docs), gram_counts(trusted.table)
    values = np.log((good + 1) / (good.sum() + SIZE)) - np.log((raw + 1) / (raw.sum() + SIZE))
    shared = spark.sparkContext.broadcast(Ratio(values, 0.0))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, 0.0, 0.0
        for batch in batches:
            for texts in slices(batch["text"]):
                words = split_words(texts, PLAIN)
                score = shared.value.scores(words)[words.counts > 0]
                n, total, squares = n + len(score), total + score.sum(), squares + (score * score).sum()
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [float(total)], "squares": [float(squares)]})

    sums = trusted.table.mapInArrow(moments, "n long, total double, squares double")
    n, total, squares = sums.agg(F.sum("n"), F.sum("total"), F.sum("squares")).first()
    if not n:
        return Ratio(values, -np.inf)
    mean = total / n
    # Rounded, so that the order in which tasks are added up cannot move a document across the limit.
    return Ratio(values, round(mean - deviations * np.sqrt(max(squares / n - mean * mean, 0.0)), 9))


_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"


def measures(docs: DataFrame, ratio: Ratio):
    """A column function from text to the counts and the length-normalised ratio."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # SIZE doubles

    @F.arrow_udf(_RESULT)
    def measure(column: pa.Array) -> pa.Array:
        parts: list[dict[str, np.ndarray]] = []
        for texts in slices(column):
            words = split_words(texts, PLAIN)
            parts.append({**_base(texts, words), "llr": shared.value.scores(words)})
        names = [field.split()[0] for field in _RESULT.split(", ")]
        if not parts:
            return pa.StructArray.from_arrays([pa.array([], pa.float64() if n == "llr" else pa.int64()) for n in names], names)
        return pa.StructArray.from_arrays([pa.array(np.concatenate([part[n] for part in parts])) for n in names], names)

    return measure


def judge(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, llr, kept."""
    found = docs.select("doc_id", measures(docs, ratio)(F.col("text")).alias("found")).select("doc_id", "found.*")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.round("llr", 9) >= ratio.limit))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Judge all documents, trusting those labelled as good outside the held-out fold."""
    good = labels.where((F.col("quality") == 1) & sample.learnable(F.col("doc_id")))
    return judge(docs, fit(docs, good))
