"""Written intermediate tables.

Loops and results that are read twice are cut by writing a table into the folder the
cluster names in ``spark.checkpoint.dir``, so a lost executor costs a re-read and never
the lineage of earlier rounds.

A staging scope belongs to the context (thread or task) that opened it: streams, whose batches run on threads of their own, and
runs next to them never remove each other's tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
# Written tables hold whole texts, which this makes much smaller than the default codec does.
CODEC = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor reaches; a session without one cannot stage."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
    return folder.rstrip("/")


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("staging_scopes", default=())


def new_path(spark: SparkSession, label: str, outlives: bool = False) -> str:
    """A new folder; the innermost staging scope removes it, or the one around that where it ``outlives`` the first."""
    path = f"{shared_folder(spark)}/vacantia/{label}-{uuid.uuid4().hex}"
    scopes = _scopes.get()
    around = scopes[:-1] if outlives else scopes
    if around:
        around[-1].append(path)
    return path


_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_removing: dict[str, int] = {}
_removing_lock = Lock()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside removes its shuffle files when it ends; they stay until the driver happens to collect its garbage otherwise.

    A written table is read instead of what it was made of, so nothing asks for these files again. A choice that the session has made stays.
    Writes of one session that run at a time share the setting; the last one takes it back.
    """
    session = spark._jsparkSession.sessionUUID()
    with _removing_lock:
        if session not in _removing and spark._jsparkSession.sessionState().conf().contains(_SHUFFLES_GO):
            session = None
        else:
            if session not in _removing:
                spark.conf.set(_SHUFFLES_GO, "true")
            _removing[session] = _removing.get(session, 0) + 1
    try:
        yield
    finally:
        if session is not None:
            with _removing_lock:
                _removing[session] -= 1
                if not _removing[session]:
                    del _removing[session]
                    spark.conf.unset(_SHUFFLES_GO)


@dataclass(frozen=True)
class Staged:
    table: DataFrame
    rows: int
    path: str
    seen: dict = field(default_factory=dict)


def stage(df: DataFrame, label: str, outlives: bool = False, **measures: Column) -> Staged:
    """Write ``df`` once and return the written table with its row count.

    The count, and any further aggregates named in ``measures``, are observed by the writing
    job itself, so they cost no second pass. ``outlives`` is for the result of a staging scope.
    """
    spark = df.sparkSession
    path = new_path(spark, label, outlives)
    seen = Observation()
    wanted = [F.count(F.lit(1)).alias("rows"), *(column.alias(name) for name, column in measures.items())]
    with _shuffles_removed(spark):
        df.observe(seen, *wanted).write.option("compression", CODEC).parquet(path)
    return Staged(spark.read.schema(df.schema).parquet(path), seen.get["rows"], path, seen.get)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end; what must outlive it has to be written elsewhere."""
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in mine:
            discard(spark, path)
