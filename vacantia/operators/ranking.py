"""Rank over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.staging import Staged, stage

# ``monotonically_increasing_id`` holds the row's place within its partition in 33 bits.
_PLACE_BITS = 33


@dataclass(frozen=True)
class Ranges:
    """A sorted, written table: a file per range of the order, and how many rows lie in earlier ranges."""

    staged: Staged
    starts: dict[int, int]

    @property
    def rows(self) -> int:
        return self.staged.rows

    def ranked(self, rank: str = "rank", part: str | None = None, table: DataFrame | None = None) -> DataFrame:
        """The rows with their place in the whole order, and their range's number where ``part`` names a column for it."""
        table = self.staged.table if table is None else table
        starts = table.sparkSession.createDataFrame(list(self.starts.items()), "_part int, _start long")
        place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
        out = table.withColumn("_part", F.shiftright("_at", _PLACE_BITS).cast("int")).join(F.broadcast(starts), "_part")
        out = out.withColumn(rank, F.col("_start") + place + 1)
        return (out.withColumn(part, F.col("_part")) if part else out).drop("_part", "_start", "_at")

    def in_files(self) -> DataFrame:
        """The written rows, a file per task and in the file's order."""
        spark = self.staged.table.sparkSession.newSession()  # its settings are its own
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 60))
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 60))
        return spark.read.schema(self.staged.table.schema).parquet(self.staged.path)


def sort_ranges(rows: DataFrame, *order: Column | str, cut_by: Sequence[Column | str] = ()) -> Ranges:
    """Sort once and write; the counts are one row per sorted partition.

    The limits of the ranges come from sampled values that are sent to the driver. Where ``order`` holds long texts, ``cut_by`` names
    narrow columns that never order two rows the other way; rows that are equal in them share a range.
    """
    ordered = rows.repartitionByRange(*cut_by).sortWithinPartitions(*order) if cut_by else rows.orderBy(*order)
    placed = ordered.withColumn("_at", F.monotonically_increasing_id())
    staged = stage(placed, "ranked")
    sizes = staged.table.groupBy(F.shiftright("_at", _PLACE_BITS).cast("int").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts, before = {}, 0
    for row in sorted(sizes.collect()):
        starts[row["_part"]] = before
        before += row["_n"]
    return Ranges(staged, starts)


def rank_rows(rows: DataFrame, *order: Column | str, rank: str = "rank", cut_by: Sequence[Column | str] = ()) -> DataFrame:
    """Number rows 1..n in ``order``, which should end in a unique column.

    A global sort cuts the rows into ranges by the full order, so that even one score held
    by a third of the rows spreads over many tasks. The sorted table is written with each
    row's range and place; ranges are then counted, and a rank is the number of rows in
    earlier ranges plus the place. ``cut_by`` is that of ``sort_ranges``.
    """
    return sort_ranges(rows, *order, cut_by=cut_by).ranked(rank)


def best_first(offers: DataFrame) -> DataFrame:
    """Highest score first; equal scores by id."""
    return offers.orderBy(F.desc("score"), "id")


def rank_by_score(offers: DataFrame, rank: str = "rank") -> DataFrame:
    return rank_rows(offers, F.desc("score"), F.col("id"), rank=rank)


def scoring_queue(waiting: DataFrame, limit: int | None = V.DEFAULT_SCORING_LIMIT) -> DataFrame:
    """Newest offers first; without a limit, all of them."""
    newest = waiting.orderBy(F.desc("collected_at"), "id")
    return newest if limit is None else newest.limit(limit)
