"""Counts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.ids import artifact_slug
from vacantia.functions.labels import status_or_default
from vacantia.operators.filters import scored


def dashboard_metrics(offers: DataFrame) -> DataFrame:
    """Metrics over all scored offers, before any dashboard filter. The mean stays a number."""
    return scored(offers).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("score") >= V.PRIORITY_DASHBOARD[0][0]).alias("prioritaires"),
        F.count_if(status_or_default(F.col("statut")) == V.APPLIED_STATUS).alias("postulees"),
        F.avg("score").alias("score_moyen"),
    )


def row_count(rows: DataFrame, name: str = "total") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias(name))


def count_by(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def target_counters(found: DataFrame, inserted: DataFrame, target: str = "target") -> DataFrame:
    """Found, rejected and new offers per target, and in all (target null).

    ``found`` carries the boolean ``rejected``. Both inputs shrink to counters per target
    before anything else, so no join is needed and the total is made of few rows.
    """
    zero = F.lit(0)
    marks = found.select(target, F.lit(1).alias("found"), F.col("rejected").cast("int").alias("rejected"), zero.alias("inserted"))
    marks = marks.unionByName(
        inserted.select(target, zero.alias("found"), zero.alias("rejected"), F.lit(1).alias("inserted"))
    )
    sums = [F.sum(name).alias(name) for name in ("found", "rejected", "inserted")]
    return marks.groupBy(target).agg(*sums).rollup(target).agg(*sums)


def score_outcome(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count_if(F.col("score") >= 0).alias("ok"), F.count_if(F.col("score") == -1).alias("failed")
    )


def slug_collisions(offers: DataFrame) -> DataFrame:
    """Slugs that several offers share, and how many do."""
    slugs = offers.select(artifact_slug(F.col("id")).alias("slug"))
    return count_by(slugs, "slug", "offers").where(F.col("offers") > 1)
