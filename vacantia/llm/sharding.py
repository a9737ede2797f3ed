"""Sharding by longest-processing-time scheduling: largest first, to the least loaded shard.

Rows of equal text form a group and stay together. Groups of more than a fixed share of all bytes
are units of their own; there are few of them by construction. The small rest is dealt by hash into
bundles, a fixed number, and a bundle is a unit. All units, sorted by size, go through a heap of shard
loads on the driver, which therefore never sees more than ``MOST_LARGE + BUNDLES`` of
them. In a small table every group is large and the schedule is the plain one.

A unit smaller than the least share decides how even the loads are, except where one group alone
exceeds a shard's share: it is not split.

Defined results: a null text has no bytes and is grouped with the empty text, its crc32 is 0. Repeated rows are
one group and each gets a slot. Slots follow doc_id within a slice of the shard, null first. Other columns are kept.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.staging import stage

SHARDS = 24
PER_ROW = 8
MOST_LARGE = SHARDS * 1024
BUNDLES = SHARDS * 256
# A shard's rows are numbered in slices of about so many rows, but in no fewer than ``SLICES``.
SLICE_ROWS = 50_000
SLICES = 64


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def size() -> Column:
    return (F.octet_length(_text()) + PER_ROW).cast("long")


def group() -> Column:
    """Groups by the text's hash: equal texts always meet."""
    return F.xxhash64(_text())


def _bundle(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("bundle"), key), F.lit(BUNDLES))


def schedule(units: list[tuple], shards: int) -> list[int]:
    """Shard of each (size, ...) unit; largest first, then as given; of equal loads the first shard."""
    order = sorted(range(len(units)), key=lambda i: -units[i][0])
    loads = [(0, shard) for shard in range(shards)]
    out = [0] * len(units)
    for i in order:
        load, shard = heapq.heappop(loads)
        out[i] = shard
        heapq.heappush(loads, (load + units[i][0], shard))
    return out


@dataclass(frozen=True)
class Plan:
    """Shards of large groups (group, shard) and of bundles (bundle, shard)."""

    large: DataFrame
    bundles: DataFrame


def plan(rows: DataFrame, shards: int = SHARDS, most_large: int = MOST_LARGE) -> Plan:
    """Decide from (group, size)."""
    spark = rows.sparkSession
    groups = stage(rows.groupBy("group").agg(F.sum("size").alias("size")), "groups").table
    total = groups.agg(F.sum("size")).first()[0] or 0
    is_large = F.col("size") * most_large > total
    large = groups.where(is_large).select("size", "group").collect()
    rest = groups.where(~is_large).groupBy(_bundle(F.col("group")).alias("bundle")).agg(F.sum("size").alias("size")).collect()
    units = sorted((row["size"], 0, row["group"]) for row in large) + sorted((row["size"], 1, row["bundle"]) for row in rest)
    placed = schedule(units, shards)
    tables = [[], []]
    for (_, kind, name), shard in zip(units, placed):
        tables[kind].append((name, shard))
    return Plan(*(spark.createDataFrame(table, f"{name} long, shard int") for table, name in zip(tables, ("group", "bundle"))))


def with_shard(rows: DataFrame, decided: Plan, key: Column, into: str = "shard") -> DataFrame:
    """``rows`` with their shard; both tables are of bounded size, and no row moves."""
    large = decided.large.select(F.col("group").alias("_group"), F.col("shard").alias("_large"))
    bundles = decided.bundles.select(F.col("bundle").alias("_bundle"), F.col("shard").alias("_small"))
    return (
        rows.join(F.broadcast(large), key == F.col("_group"), "left")
        .join(F.broadcast(bundles), _bundle(key) == F.col("_bundle"), "left")
        .withColumn(into, F.coalesce("_large", "_small"))
        .drop("_group", "_large", "_bundle", "_small")
    )


def with_slot(rows: DataFrame, counted: DataFrame, *order: str, shard: str = "shard", into: str = "slot") -> DataFrame:
    """``rows`` numbered from 0 in each shard, without a gap.

    ``counted`` holds the same rows and may be narrower. Slices of a shard are counted first; a row's slot is the
    number of rows in earlier slices plus its place in its own, so no task holds a shard. There are as many slices as the
    fullest shard needs.
    """
    fullest = counted.groupBy(shard).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    piece = F.pmod(F.xxhash64(*order), F.lit(max(SLICES, -(-fullest // SLICE_ROWS)))).cast("int")
    earlier = Window.partitionBy("_shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        counted.groupBy(F.col(shard).alias("_shard"), piece.alias("_slice"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_shard", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    )
    inside = Window.partitionBy(shard, "_slice_of").orderBy(*order)
    return (
        rows.withColumn("_slice_of", piece)
        .withColumn("_place", F.row_number().over(inside) - 1)
        .join(begins, (F.col(shard) == F.col("_shard")) & (F.col("_slice_of") == F.col("_slice")))  # a row per slice
        .withColumn(into, (F.col("_begin") + F.col("_place")).cast("long"))
        .drop("_shard", "_slice", "_begin", "_slice_of", "_place")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = stage(
        docs.select("doc_id", size().alias("size"), F.crc32(_text().cast("binary")).alias("text_crc32"), group().alias("group")), "to-shard"
    ).table
    placed = with_shard(rows, plan(rows.select("group", "size"), shards), F.col("group"))
    return with_slot(placed, placed, "doc_id", "group").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
