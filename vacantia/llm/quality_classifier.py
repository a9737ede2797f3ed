"""Quality classifier: logistic regression on hashed word n-grams.

Words are runs of letters and digits and runs of other visible characters; single words and
pairs are hashed to ``SIZE`` coordinates, counted, damped by a logarithm and brought to length
one. The weights come from follow-the-regularised-leader updates over a bounded sample of
labelled documents, and every document is scored as one sparse dot product.

Defined results: a null or empty text has no n-gram and is scored by the bias alone. Labels that
are neither 0 nor 1 are ignored; of repeated labels of one id the largest counts, and every row
of an id is scored. With labels of one kind only, or none, every score is 0.5 or leans to that
kind. Other columns of the input are neither used nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm import ftrl, sample
from vacantia.llm.words import PIECES, joined, slices, split_words, sums_by_row, within_rows
from vacantia.staging import stage

BITS = 17
SIZE = 1 << BITS
# At most so many documents of each label are learned from.
SAMPLE_PER_LABEL = 5000
THRESHOLD = 0.7
PENALTIES = ftrl.Penalties(alpha=4.0, beta=1.0, l1=0.002, l2=0.01)
# A word followed by itself is one pair, whichever word it is.
_SAME_TWICE = np.uint64(0x2545F4914F6CDD1D)


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first row, and of all its rows the coordinates, values and where each row begins."""
    for texts in slices(column):
        words = split_words(texts, PIECES)
        row = words.row
        pair = joined(words.hash, 2)
        pair[words.hash[1:] == words.hash[:-1]] = _SAME_TWICE
        pair = pair[keep := within_rows(words.first, 2, len(words.hash))]
        pair_row = row[: len(keep)][keep]
        where = np.concatenate((words.hash, pair)) & np.uint64(SIZE - 1)
        key = (np.concatenate((row, pair_row)).astype(np.int64) << BITS) | where.astype(np.int64)
        key, count = np.unique(key, return_counts=True)
        first = np.searchsorted(key, np.arange(texts.rows + 1, dtype=np.int64) << BITS)
        value = 1 + np.log(count)
        norm = np.sqrt(sums_by_row(value * value, first))
        value = value / np.repeat(np.maximum(norm, 1e-12), np.diff(first))
        yield texts.first, (key & (SIZE - 1)).astype(np.int32), value, first


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, at, value, first in _features(batch["text"]):
            rows = len(first) - 1
            # The bias is one more coordinate of every row.
            ends = first + np.arange(rows + 1)
            bias = np.zeros(ends[-1], bool)
            bias[ends[1:] - 1] = True
            where, x = np.full(ends[-1], SIZE, np.int32), np.ones(ends[-1], np.float32)
            where[~bias], x[~bias] = at, value
            part = batch.slice(begin, rows)
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part["shard"],
                    part["place"],
                    part["label"],
                    pa.ListArray.from_arrays(offsets, pa.array(where)),
                    pa.ListArray.from_arrays(offsets, pa.array(x)),
                ],
                ["shard", "place", "label", "at", "x"],
            )


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> np.ndarray:
    """Weights per coordinate, the bias last: towards label 1 if positive.

    Only ids outside the held-out fold are learned from, ``per_label`` ids and as many rows of each label at most.
    """
    marked = (
        labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & sample.learnable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    # Labels may name ids that no longer have a document, so twice as many are not needed: those are few.
    chosen = sample.first_by_hash(marked, "label", [0, 1], per_label, "doc_id")
    of_ids = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * per_label narrow rows at most
    # An id may stand for any number of rows; the sample is bounded by rows.
    shard = F.pmod("place", F.lit(ftrl.SHARDS)).cast("int")
    texts = sample.first_rows(of_ids, "label", per_label).select(shard.alias("shard"), "place", "label", "text")
    rows = stage(texts.mapInArrow(_sparse_rows, "shard int, place long, label int, at array<int>, x array<float>"), "quality-sample")
    learned = ftrl.train(rows.table, SIZE + 1, 2, PENALTIES)
    return learned[:, 1] - learned[:, 0]


def scorer(docs: DataFrame, weights: np.ndarray):
    """A column function from text to the score of label 1."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # SIZE + 1 floats

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        w, out = model.value.astype(np.float64), np.empty(len(column))
        for begin, at, value, first in _features(column):
            logit = sums_by_row(value * w[at], first) + w[SIZE]
            out[begin : begin + len(logit)] = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        return pa.array(out)

    return score


def with_score(docs: DataFrame, weights: np.ndarray, into: str = "score", text: Column | str = "text") -> DataFrame:
    """``docs`` with one more column; no row moves."""
    return docs.withColumn(into, scorer(docs, weights)(F.col(text) if isinstance(text, str) else text))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels, per_label))
    return scored.select(
        "doc_id",
        sample.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
