"""Whitening of embeddings by spectral divide and conquer.

Each entry c becomes the whole number ``floor(1024 * c) + 100000``. Sums per dimension are exact, and every covariance is
summed over rows that are centred first. The covariance is cut in two by the polar factor of its shifted self: with
``V - shift`` = U H, the matrix (U + 1) / 2 projects on the space of all eigenvalues above the shift. Polar factors come from
dynamically weighted Halley iterations, each one QR decomposition, six or seven of them whatever the condition. The upper space is cut
again until its parts have one dimension; lower spaces are left alone once enough components are known. The components,
of fixed size, are broadcast and applied to all rows.

Spark counts, sums, multiplies and projects. The driver sees one number per pair of dimensions.

Defined results: rows whose vector is null or empty, or holds an entry that is null, not finite or beyond ``LARGEST``, are dropped, as
are rows whose vector has another length than most (of equally frequent lengths the greatest counts). Each row left, also a
repeated one or one with a null vec_id, counts for itself. Components whose eigenvalue is not above rounding are left out: they
cannot be scaled to one. So all rows equal, or a single row, give no rows, as an empty table does. A deviation beyond 64
bits is null. The entry of greatest magnitude in a component is positive. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.staging import stage

SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 30)
COMPONENTS = 8
_EPS = float(np.finfo(np.float64).eps)
RESULT = "vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a square matrix; singular directions of it stay undecided."""
    size = len(a)
    x = a / max(np.linalg.norm(a, 2), np.finfo(np.float64).tiny)
    low, one = _EPS, np.eye(size)
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        basis = np.linalg.qr(np.concatenate((np.sqrt(r) * x, one)))[0]
        after = (q / r) * x + ((p - q / r) / np.sqrt(r)) * basis[:size] @ basis[size:].T
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        moved = np.linalg.norm(after - x)
        x = after
        if 1 - low < 10 * _EPS and moved < 1e-12 * np.sqrt(size):
            break
    return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """The mean eigenvalue, which always lies between two, then points around it should an eigenvalue sit there."""
    middle, width = np.trace(a) / len(a), np.linalg.norm(a - np.trace(a) / len(a) * np.eye(len(a))) / np.sqrt(len(a))
    yield middle
    for part in np.random.default_rng(len(a)).uniform(-1, 1, 24):
        yield middle + part * width


def split_space(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces above and below a shift, or None where all eigenvalues are equal up to rounding."""
    size, scale = len(a), np.linalg.norm(a)
    if np.linalg.norm(a - np.trace(a) / size * np.eye(size)) <= 4 * size * _EPS * scale:
        return None
    best, least = None, np.inf
    for shift in _shifts(a):
        projector = (polar_factor(a - shift * np.eye(size)) + np.eye(size)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < size:
            continue
        basis = np.linalg.qr(projector @ np.random.default_rng(size).standard_normal((size, rank)), mode="complete")[0]
        basis = np.linalg.qr(projector @ basis[:, :rank], mode="complete")[0]
        left = np.linalg.norm(basis[:, rank:].T @ a @ basis[:, :rank])
        if left < least:
            best, least = (basis[:, :rank], basis[:, rank:]), left
        if least <= 16 * size * _EPS * scale:
            break
    return best


def components_of(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    found: list[np.ndarray] = []
    waiting = [np.eye(len(v))]
    while waiting and sum(x.shape[1] for x in found) < most:
        basis = waiting.pop()
        parts = split_space(basis.T @ v @ basis) if basis.shape[1] > 1 else None
        if parts is None:
            found.append(basis)
        else:
            waiting += [basis @ parts[1], basis @ parts[0]]
    vectors = np.linalg.qr(np.concatenate(found, axis=1))[0]
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")[:most]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(order))])
    return values[order], vectors * signs


def usable(rows: DataFrame, column: str = "embedding") -> tuple[DataFrame, int, int]:
    """Rows (vec_id, vector) that can be fitted, how many there are, and their dimension."""
    good = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    rows = rows.select("vec_id", F.col(column).alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & good)
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    if first is None:
        return rows, 0, 0
    return rows.where(F.size("vector") == first["length"]), first["n"], first["length"]


def _whole(column: pa.Array, dimension: int) -> np.ndarray:
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * entries).astype(np.int64).reshape(-1, dimension) + OFFSET


def sums(rows: DataFrame, dimension: int) -> list[int]:
    """The exact sum of each dimension's whole numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dimension
        for batch in batches:
            if batch.num_rows:
                total = [a + int(b) for a, b in zip(total, _whole(batch["vector"], dimension).sum(axis=0))]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(dimension), pa.int32()), "total": [str(x) for x in total]})

    added = rows.select("vector").mapInArrow(add, "at int, total string")
    found = added.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    known = {row["at"]: int(row["total"]) for row in found}
    return [known.get(i, 0) for i in range(dimension)]


@dataclass(frozen=True)
class Centre:
    """The mean as a whole part and a rest over n, so that centring loses nothing: x - S/n = (x - whole) - rest / n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2 per row, exact; None beyond 64 bits."""
        apart = x - self.whole
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if x.shape[1] * most * most < 1 << 63:
            return ((self.n * apart - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * apart.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [value if value < 1 << 63 else None for value in exact]


def covariance(rows: DataFrame, centre: Centre) -> np.ndarray:
    """Covariance of the whole numbers, divisor n; tasks add up their products, one number per pair of dimensions."""
    dimension = len(centre.whole)
    upper = np.triu_indices(dimension)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            if batch.num_rows:
                apart = centre.centred(_whole(batch["vector"], dimension))
                total += apart.T @ apart
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(upper[0])), pa.int32()), "total": total[upper]})

    added = rows.select("vector").mapInArrow(multiply, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(len(upper[0]))
    out[added["at"].to_numpy()] = added["total"].to_numpy()
    full = np.zeros((dimension, dimension))
    full[upper] = out / centre.n
    return full + np.triu(full, 1).T


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def fit(rows: DataFrame, n: int, dimension: int, most: int = COMPONENTS) -> Whitening:
    """Mean and greatest components of usable rows."""
    total = sums(rows, dimension)
    centre = Centre(n, np.array([s // n for s in total], np.int64), np.array([s % n for s in total], np.int64))
    v = covariance(rows, centre)
    trace = float(np.trace(v))
    values, vectors = components_of(v, min(most, dimension))
    above = values > dimension * _EPS * trace
    return Whitening(centre, values[above], vectors[:, above], values[above] / (trace or 1.0))


def projected(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array) of usable rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a number per dimension and component
    kind = rows.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scaled = model.vectors / np.sqrt(model.values)
        for batch in batches:
            x = _whole(batch["vector"], len(model.centre.whole))
            white = model.centre.centred(x) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * scaled.shape[1], pa.int32()), pa.array(white.ravel()))
            columns = [batch["vec_id"], pa.array(model.centre.deviations(x), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(project, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, size: int) -> float:
    """Largest entry, without sign, of the covariance of ``whitened`` less the identity; centred before multiplying."""
    entry = [F.col("whitened")[i] for i in range(size)]
    means = white.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(entry)]).first()
    apart = [e - F.lit(means[i]) for i, e in enumerate(entry)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    products = white.agg(*[F.avg(apart[i] * apart[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(products[k] - (i == j)) for k, (i, j) in enumerate(pairs))


def whiten(table: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = table.sparkSession
    rows, n, dimension = usable(table, column)
    model = fit(rows, n, dimension, most) if n else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], RESULT.format(kind=table.schema["vec_id"].dataType.simpleString()))
    white = stage(projected(rows, model), "whitened").table
    error = identity_error(white, len(model.values))
    explained = F.array(*[F.lit(float(x)) for x in model.explained])
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
