"""Language identification: sparse softmax regression on TF-IDF character n-grams.

Texts are lower-cased and everything between letters becomes one space. Runs of one to three
characters are hashed to ``SIZE`` coordinates; a document's value there is ``(1 + ln count) *
idf``, brought to length one. Document frequencies are counted over every learnable document.
Weights come from follow-the-regularised-leader updates with elastic-net penalties over a
bounded sample; a temperature, fitted on a part of the sample that was not trained on, turns
the logits into calibrated chances.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where no
language could be learned. Null languages teach nothing. Repeated rows are each predicted and
each counted. Ties between languages go to the first by code point. Columns other than doc_id
and text never reach a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import ftrl, sample
from vacantia.staging import stage

BITS = 15
SIZE = 1 << BITS
LONGEST = 3
# At most so many rows of each language are learned from, equal ones counting once; every fifth only calibrates.
SAMPLE_PER_LANGUAGE = 2000
CALIBRATION_SHARE = 5
# More distinct values than this are not languages, and the model would not fit a broadcast.
MOST_LANGUAGES = 256
UNKNOWN = "und"
PENALTIES = ftrl.Penalties(alpha=1.0, beta=1.0, l1=0.01, l2=0.05)
TEMPERATURES = np.geomspace(0.05, 20, 121)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(point).isalpha() for point in range(0x10000)])


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with 32 for each gap and at both ends; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return points
    letter = _letters()[np.minimum(points, 0xFFFF)]
    if points.max() > 0xFFFF:
        high = points > 0xFFFF
        letter[high] = [chr(point).isalpha() for point in points[high]]
    if not letter.any():
        return points[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    shown = np.where(letter, points, np.uint32(32))[keep]
    head = [] if shown[0] == 32 else [np.array([32], np.uint32)]
    tail = [] if shown[-1] == 32 else [np.array([32], np.uint32)]
    return np.concatenate([*head, shown, *tail])


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct coordinates of a text's n-grams, and how often each occurs."""
    codes = _codes(text) if text else np.zeros(0, np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = codes.astype(np.uint64)
    grams, out = codes, []
    for size in range(1, LONGEST + 1):
        if size > 1:
            grams = grams[:-1] * np.uint64(0x1F351F35) + codes[size - 1 :]
        spread = (grams + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((spread >> np.uint64(64 - BITS)).astype(np.int64))
    tally = np.bincount(np.concatenate(out), minlength=SIZE)
    at = np.flatnonzero(tally)
    return at, tally[at]


def _vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = _counts(text)
    value = (1 + np.log(np.maximum(count, 1))) * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / norm if norm > 0 else value


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per coordinate and documents with a letter, over all rows.

    Each task adds up one vector of fixed size; its non-zero entries are summed on Spark.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(SIZE + 1, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                at, _ = _counts(text.as_py())
                total[at] += 1
                rows += len(at) > 0
        total[SIZE] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "n": total[at]})

    sums = docs.select("text").mapInArrow(tally, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE + 1, np.int64)
    for row in sums:
        out[row["at"]] = row["n"]
    return out[:SIZE], int(out[SIZE])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, text: str | None) -> np.ndarray | None:
        at, value = _vector(text, self.idf)
        return value @ self.weights[at] + self.weights[SIZE] if len(at) else None

    def predict(self, text: str | None) -> tuple[str, float]:
        logits = self.logits(text) if self.languages else None
        if logits is None:
            return UNKNOWN, 0.0
        chance = ftrl.softmax(logits / self.temperature)
        best = int(np.argmax(chance))
        return self.languages[best], float(chance[best])


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from the documents outside the held-out fold that have a language."""
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & sample.learnable(F.col("doc_id")))
    names = [row["lang"] for row in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct values of lang")
    names.sort()
    frequency, documents = document_frequencies(known)
    idf = np.log((1 + documents) / (1 + frequency)) + 1
    if not names:
        return Model([], idf, np.zeros((SIZE + 1, 0)), 1.0)
    number = {name: i for i, name in enumerate(names)}
    texts = sample.first_rows(known, "lang", per_language).select(
        F.pmod("place", F.lit(ftrl.SHARDS)).cast("int").alias("shard"),
        "place",
        (F.pmod("place", F.lit(CALIBRATION_SHARE)) == 0).alias("calibrates"),
        "lang",
        "text",
    )
    shared = spark.sparkContext.broadcast(idf)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = [], []
            for text in batch["text"]:
                where, value = _vector(text.as_py(), shared.value)
                at.append(np.append(where, SIZE).astype(np.int32))
                x.append(np.append(value, 1).astype(np.float32))
            label = [number[name.as_py()] for name in batch["lang"]]
            yield pa.RecordBatch.from_arrays(
                [batch["shard"], batch["place"], batch["calibrates"], pa.array(label, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))],
                ["shard", "place", "calibrates", "label", "at", "x"],
            )

    rows = stage(
        texts.mapInArrow(sparse, "shard int, place long, calibrates boolean, label int, at array<int>, x array<float>"), "language-sample"
    ).table
    weights = ftrl.train(rows.where(~F.col("calibrates")), SIZE + 1, len(names), PENALTIES)
    model = spark.sparkContext.broadcast(weights)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                x.values.to_numpy(zero_copy_only=False).astype(np.float64) @ model.value[at.values.to_numpy(zero_copy_only=False)]
                for at, x in zip(batch["at"], batch["x"])
            ]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array([o.tolist() for o in out], pa.list_(pa.float64()))], ["label", "logits"])

    kept_back = rows.where("calibrates").mapInArrow(logits, "label int, logits array<double>")
    return Model(names, idf, weights.astype(np.float64), ftrl.best_temperature(kept_back, TEMPERATURES))


def predictor(docs: DataFrame, model: Model):
    """A column function from text to (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE * languages floats

    @F.arrow_udf("lang_pred string, score double")
    def predict(column: pa.Array) -> pa.Array:
        found = [shared.value.predict(text.as_py()) for text in column]
        return pa.StructArray.from_arrays(
            [pa.array([name for name, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())],
            ["lang_pred", "score"],
        )

    return predict


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = fit(docs, per_language)
    found = docs.select("doc_id", predictor(docs, model)(F.col("text")).alias("found"))
    return found.select("doc_id", sample.held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")
