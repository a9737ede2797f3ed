"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HELD_OUT = 2
FOLDS = 4


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """True in the fold kept for measuring; false for a null id, which is not learned from either."""
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) != HELD_OUT, F.lit(False))


def first_by_hash(rows: DataFrame, label: str, labels: list, limit: int, *key: str) -> DataFrame:
    """For each of ``labels`` the ``limit`` rows of least hash of ``key``; fewer if there are fewer.

    A bounded top-k per label: every task keeps ``limit`` narrow rows at most.
    """
    order = F.xxhash64(*key)
    parts = [rows.where(F.col(label) == value).orderBy(order, *key).limit(limit) for value in labels]
    return reduce(DataFrame.unionByName, parts) if parts else rows.limit(0)


def first_rows(rows: DataFrame, label: str, limit: int) -> DataFrame:
    """(label, place, text): of each label ``limit`` rows at most, those of least hash of (doc_id, text).

    Rows that repeat id and text count once, so an id or a row that repeats very often takes no more room than others, and
    ``place``, the hash, tells the rows of a label apart. One narrow pass chooses, a second one picks the texts.
    """
    placed = rows.select(label, F.xxhash64("doc_id", "text").alias("place"), "text")
    order = Window.partitionBy(label).orderBy("place")
    chosen = placed.select(label, "place").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    picked = placed.join(F.broadcast(chosen), [label, "place"])  # limit narrow rows of each label at most
    return picked.groupBy(label, "place").agg(F.min("text").alias("text"))
