"""Where collected data lands, and the order in which landings count.

Requests are numbered from 0 in every collection, so two landings in one folder hold the same (request, position). Each landing
therefore gets an epoch, issued by a log next to the data, and writes into a folder of that epoch. What lies outside such
folders is of epoch 0. Rows come in the order of (epoch, request, position).

Within one epoch a place belongs to one row. A row that comes again at its place with its content counts once. Other rows of
a place that is taken, and rows without a place, are numbered behind all others by content; none is refused, and none stops the
rows of another source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.ids import UNPLACED_REQUEST
from vacantia.operators.ranking import rank_rows
from vacantia.plans.commits import CommitLog
from vacantia.sources.readers import CORRUPT, observed, parse_json
from vacantia.staging import Staged, stage

_FOLDER = "epoch="
_HELPERS = ("epoch", "_row")
# Rows without a place are cut into ranges by this much of their content, and sorted by all of it.
_CUT = 256


def open_landing(spark: SparkSession, folder: str) -> str:
    """Issue the next epoch of a landing folder and return the folder to write its files into."""
    log = CommitLog(spark, f"{folder.rstrip('/')}/_epochs")
    writer = uuid.uuid4().hex
    while (number := log.publish(writer, 0, log.last())) is None:
        pass
    return f"{folder.rstrip('/')}/{_FOLDER}{number}"


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Landed JSON lines of all epochs, parsed, with their ``epoch``; broken lines are in one column."""
    reader = spark.read.option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true")
    number = F.regexp_extract("_metadata.file_path", f"/{_FOLDER}([0-9]+)/[^/]*$", 1)
    lines = reader.text(path).select("value", F.coalesce(F.try_to_number(number, F.lit("999999999999999999")).cast("long"), F.lit(0)).alias("epoch"))
    return parse_json(lines.where(F.trim("value") != ""), "value", schema)


def land(read: DataFrame, label: str, broken: Column | None = None) -> tuple[Staged, int]:
    """Parsed rows, written once with a number each (``_row``), and how many lines were broken.

    Requests are numbered anew over all epochs where there is more than one.
    """
    seen = Observation()
    rows = observed(read, seen, broken).withColumn("_row", F.monotonically_increasing_id())
    landed = stage(rows, f"landed-{label}", first=F.min("epoch"), last=F.max("epoch"))
    if landed.rows and landed.seen["first"] != landed.seen["last"]:
        pairs = landed.table.select("epoch", "request_no").where(F.col("request_no").isNotNull()).distinct()
        numbered = rank_rows(pairs, "epoch", "request_no", rank="_number")
        numbered = stage(numbered, f"epochs-{label}").table
        table = landed.table.join(numbered, ["epoch", "request_no"], "left")
        table = table.withColumn("request_no", F.col("_number") - 1).drop("_number")
        landed = Staged(table, landed.rows, landed.path, landed.seen)
    return landed, seen.get["broken"]


def one_per_place(landed: DataFrame) -> DataFrame:
    """Rows with a place of their own each; all but ``request_no`` and ``position`` stays as landed.

    Places are compared by narrow rows; of the wide ones only those move whose place is missing or taken.
    """
    fields = [c for c in landed.columns if c not in ("request_no", "position", *_HELPERS)]
    content = [F.xxhash64(*fields).alias("_h1"), F.xxhash64(F.lit("content"), *fields).alias("_h2")]
    place = ["request_no", "position"]
    lacks = F.col("request_no").isNull() | F.col("position").isNull()
    narrow = landed.select(*place, "_row", *content)
    taken = narrow.where(~lacks).groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("_h1").alias("_least"))
    taken = stage(taken.where(F.col("n") > 1).drop("n"), "places-taken").table
    # Of equal rows one counts; it keeps a taken place if its content is the least of that place.
    crowd = narrow.where(~lacks).join(taken, place).groupBy(*place, "_least", "_h1", "_h2").agg(F.min("_row").alias("_row"))
    stays = crowd.groupBy(*place).agg(F.min(F.when(F.col("_h1") == F.col("_least"), F.col("_row"))).alias("_row"))
    stays = stage(stays.select("_row"), "places-kept").table
    late = crowd.select("_row").join(stays, "_row", "left_anti")
    late = late.unionByName(narrow.where(lacks).groupBy("_h1", "_h2").agg(F.min("_row").alias("_row")).select("_row"))
    late = stage(late, "places-late")
    free = landed.where(~lacks).join(taken.select(*place), place, "left_anti")
    kept = landed.join(stays, "_row", "left_semi")
    out = free.select(*place, *fields).unionByName(kept.select(*place, *fields))
    if not late.rows:
        return out
    behind = landed.join(late.table, "_row", "left_semi").select("epoch", *place, *fields)
    text = F.to_json(F.struct(*fields))
    order = [F.col(c).asc_nulls_last() for c in ("epoch", *place)]
    ranked = rank_rows(behind, *order, text, rank="_rank", cut_by=[*order, F.substring(text, 1, _CUT)])
    last = ranked.withColumns({"request_no": F.lit(UNPLACED_REQUEST).cast("bigint"), "position": F.col("_rank") - 1})
    return out.unionByName(last.select(*place, *fields))


def broken_lines(read: DataFrame, source: str, lost: Column | None = None) -> DataFrame:
    """(source, record) of lines that cannot be parsed, and of parsed ones that ``lost`` picks, as JSON."""
    broken = read.where(F.col(CORRUPT).isNotNull()).select(F.lit(source).alias("source"), F.col(CORRUPT).alias("record"))
    if lost is None:
        return broken
    fields = [c for c in read.columns if c not in (CORRUPT, "epoch")]
    rows = read.where(F.col(CORRUPT).isNull() & lost)
    return broken.unionByName(rows.select(F.lit(source).alias("source"), F.to_json(F.struct(*fields)).alias("record")))
