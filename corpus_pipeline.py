"""The training-data pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import decontaminate, jaccard, mixing, quality_classifier, sharding
from vacantia.session import ship_package
from vacantia.staging import discard, stage, staging_scope

# Follow-the-regularised-leader training cannot be written in SQL.
ORACLE_SQL: str | None = None

_NEW = "_pipeline"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, by their text alone; null and empty texts are scored like others.

    Rows of equal text are judged alike. An empty table gives an empty one; all columns stay as they are.
    """
    ship_package(spark)
    weights = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.with_score(docs, weights, into=_NEW)
    return scored.where(F.col(_NEW) >= quality_classifier.THRESHOLD).drop(_NEW)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id, once; documents without words all stay.

    Rows are told apart by doc_id and class, as rows of one id may differ in text and null ids are many documents. Null
    ids come last, the least class decides between rows of one id. Only documents whose id is in some group are looked
    up, so the texts of all others do not move. Rows of one id and class leave one, that of the least text hash. An empty table
    gives an empty one; all columns stay as they are.
    """
    ship_package(spark)
    groups = jaccard.group(docs).where(F.col("class").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")
    shared = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where(F.col("n") > 1)
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("class") == F.col("first.class"))
    grouped = groups.join(shared.select("component", "first"), "component").groupBy("doc_id", "class", is_first.alias("stays"))
    ids = stage(grouped.agg((F.count(F.lit(1)) > 1).alias("again")), "pipeline-grouped", again=F.max(F.col("again") & F.col("stays")))
    # Rows without words are in no group and need no look-up.
    flagged = jaccard.with_maybe(docs, ids.table, f"{_NEW}_maybe")
    maybe = F.col(f"{_NEW}_maybe") & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    apart = flagged.where(~maybe).select(*docs.columns)
    met = flagged.where(maybe).select(*docs.columns).withColumns({f"{_NEW}_id": F.col("doc_id"), f"{_NEW}_class": jaccard.class_of(F.col("text"))})
    known = ids.table.select(*(F.col(c).alias(f"{_NEW}_{c}_of") for c in ("doc_id", "class", "stays", "again")))
    same = F.col(f"{_NEW}_id").eqNullSafe(F.col(f"{_NEW}_doc_id_of")) & (F.col(f"{_NEW}_class") == F.col(f"{_NEW}_class_of"))
    met = met.join(known, same, "left")
    stays, again = F.col(f"{_NEW}_stays_of"), F.col(f"{_NEW}_again_of")
    out = apart.unionByName(met.where(stays.isNull() | (stays & ~again)).select(*docs.columns))
    if not ids.seen["again"]:
        return out
    # Only repeated rows are told apart by more than their id and set.
    one = F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias(_NEW)
    first = met.where(stays & again).groupBy(f"{_NEW}_id", f"{_NEW}_class").agg(one).select(f"{_NEW}.*")
    return out.unionByName(first)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to speak of; null and empty texts have no words and stay.

    Without items, or without documents, nothing goes. Rows of equal text are judged alike; all columns stay as they are.
    """
    ship_package(spark)
    found = decontaminate.plan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    checked = decontaminate.with_hits(docs, found, into=_NEW)
    return checked.where(~decontaminate.contaminated(_NEW)).drop(_NEW)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row per pass, none for those it leaves out.

    Null is a source like others, the last. Null and empty texts cost nothing and stay once. Equal rows are taken alike. An empty
    table gives an empty one; all columns stay as they are.
    """
    ship_package(spark)
    members, size = F.array(F.col("source")), mixing.words(F.col("text"))
    decided = mixing.plan(docs, members, size)
    timed = mixing.with_times(docs, members, size, decided, into=_NEW)
    # A document without words costs nothing and stays once.
    times = F.when(size == 0, F.lit(1)).otherwise(F.col(_NEW).cast("int"))
    return timed.withColumn(f"{_NEW}_pass", F.explode(F.array_repeat(F.lit(0), times))).drop(_NEW, f"{_NEW}_pass")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their place in it; ``shard`` and ``slot`` replace columns of these names, all others stay."""
    ship_package(spark)
    key = f"{_NEW}_group"
    narrow = stage(docs.select("doc_id", sharding.group().alias(key), sharding.size().alias("size")), "pipeline-shard").table
    decided = sharding.plan(narrow.select(F.col(key).alias("group"), "size"))
    counted = sharding.with_shard(narrow, decided, F.col(key))
    placed = sharding.with_shard(docs.withColumn(key, sharding.group()), decided, F.col(key))
    return sharding.with_slot(placed, counted, "doc_id", key).drop(key)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mix", mix),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    earlier = None
    for name, apply in STAGES[:-1]:
        with staging_scope(spark):  # what a stage writes on the way goes with it
            written = stage(apply(spark, docs, sf_dir), f"pipeline-{name}", outlives=True)
        if earlier:
            discard(spark, earlier)
        docs, earlier = written.table, written.path
    return STAGES[-1][1](spark, docs, sf_dir)
