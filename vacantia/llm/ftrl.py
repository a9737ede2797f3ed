"""Softmax regression trained with follow-the-regularised-leader updates on Spark.

The labelled sample, bounded by a parameter of the caller, is written once as sparse rows
and dealt over ``SHARDS`` shards. In each round every shard goes over its rows from the
common state and the shards' states are averaged (iterative parameter mixing), so no task
holds more than its shard and the driver holds ``SHARDS`` states of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 6
ROUNDS = 5


@dataclass(frozen=True)
class Penalties:
    """Learning rate, its offset, and the two penalties of the elastic net."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


def weights_of(z: np.ndarray, n: np.ndarray, p: Penalties) -> np.ndarray:
    """The weights that minimise the regularised linearised loss: exact zeros inside the l1 ball."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0)
    return -shrunk / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def learn(z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, label: int, p: Penalties) -> None:
    """One update in place; ``at`` holds distinct coordinates."""
    zs, ns = z[at], n[at]
    w = weights_of(zs, ns, p)
    error = softmax(x @ w)
    error[label] -= 1
    g = np.outer(x, error)
    squared = ns + g * g
    z[at] = zs + g - (np.sqrt(squared) - np.sqrt(ns)) / p.alpha * w
    n[at] = squared


def train(rows: DataFrame, size: int, classes: int, penalties: Penalties, rounds: int = ROUNDS) -> np.ndarray:
    """Weights ``(size, classes)`` from rows of (shard, place, label, at array<int>, x array<float>).

    ``rows`` should be a written table. Rows are taken in the order of ``place`` and label within a
    shard. Without rows all weights are zero.
    """
    spark = rows.sparkSession
    z, n = np.zeros((size, classes), np.float64), np.zeros((size, classes), np.float64)
    dealt = rows.select("shard", "place", "label", "at", "x").repartition(SHARDS, "shard").sortWithinPartitions("shard", "place", "label")
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z.astype(np.float32), n.astype(np.float32)))

        def one_pass(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            mine, seen = None, 0
            for batch in batches:
                for label, at, x in zip(batch["label"], batch["at"], batch["x"]):
                    if mine is None:
                        mine = [a.astype(np.float64) for a in state.value]
                    where = at.values.to_numpy(zero_copy_only=False)
                    learn(*mine, where, x.values.to_numpy(zero_copy_only=False).astype(np.float64), label.as_py(), penalties)
                    seen += 1
            if seen:
                blobs = [a.astype(np.float32).tobytes() for a in mine]
                yield pa.RecordBatch.from_pydict({"seen": [seen], "z": [blobs[0]], "n": [blobs[1]]})

        parts = dealt.mapInArrow(one_pass, "seen long, z binary, n binary").collect()
        state.destroy()
        if not parts:
            break
        total = sum(part["seen"] for part in parts)
        z, n = (
            sum(np.frombuffer(part[name], np.float32).reshape(size, classes).astype(np.float64) * (part["seen"] / total) for part in parts)
            for name in ("z", "n")
        )
    return weights_of(z, n, penalties).astype(np.float32)


def best_temperature(rows: DataFrame, grid: np.ndarray) -> float:
    """Temperature of least log loss from rows of (label int, logits array<double>); 1.0 without rows.

    Each task sums the loss for every temperature of the grid, and only the sums meet.
    """

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grid))
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch["label"].to_numpy(zero_copy_only=False)
            logits = np.array(batch["logits"].to_pylist(), np.float64)
            for i, t in enumerate(grid):
                chance = softmax(logits / t)[np.arange(len(label)), label]
                total[i] -= np.log(np.maximum(chance, 1e-300)).sum()
        yield pa.RecordBatch.from_pydict({"step": np.arange(len(grid), dtype=np.int32), "loss": total})

    sums = rows.select("label", "logits").mapInArrow(losses, "step int, loss double").groupBy("step").agg(F.sum("loss").alias("loss")).collect()
    known = {row["step"]: row["loss"] for row in sums}
    if not any(known.values()):
        return 1.0
    return float(grid[min(known, key=lambda step: (known[step], step))])
