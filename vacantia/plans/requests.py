"""All requests of a run, numbered in the order in which their answers compete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.config import Config
from vacantia.operators.ranking import rank_rows
from vacantia.sources.requests import apec_search_url, request_plan, search_plan

_COLUMNS = ("source", "target_no", "keyword_no", "pays", "what", "where", "results_wanted", "distance", "salary_min", "hours_old", "url")


def plan_run(targets: DataFrame, config: Config) -> DataFrame:
    """One row per request of sources A, B and C, with the ``request_no`` under which its answer is landed.

    Source A asks once per target and keyword, source B once per term and source C once per run. Numbers
    count from 0 within a source.
    """
    spark = targets.sparkSession
    criteria = config.criteria
    asked = request_plan(
        search_plan(targets, config.default_keyword), config.max_results, criteria.get("distance_km"), criteria.get("salaire_min_annuel")
    )
    from_a = asked.select(
        F.lit("adzuna").alias("source"), "target_no", "keyword_no", "pays", "what", "where",
        F.col("results_per_page").alias("results_wanted"), "distance", "salary_min",
        F.lit(None).cast("int").alias("hours_old"), F.lit(None).cast("string").alias("url"),
    )
    place = config.apec.get("location", V.DEFAULT_PLACE)
    terms = [(i, term, place) for i, term in enumerate(config.apec.get("search_terms") or [])]
    from_b = spark.createDataFrame(terms, "keyword_no int, what string, `where` string").select(
        F.lit("apec").alias("source"), "keyword_no", "what", "where", apec_search_url(F.col("what"), F.col("where")).alias("url")
    )
    wanted = (
        0, config.default_keyword, config.indeed.get("location", V.DEFAULT_PLACE),
        config.indeed.get("results_wanted", V.DEFAULT_RESULTS_WANTED), config.indeed.get("hours_old", V.DEFAULT_HOURS_OLD),
    )
    from_c = spark.createDataFrame([wanted], "keyword_no int, what string, `where` string, results_wanted int, hours_old int").withColumn("source", F.lit("indeed"))
    every = from_a.unionByName(from_b, allowMissingColumns=True).unionByName(from_c, allowMissingColumns=True).select(*_COLUMNS)
    ranked = rank_rows(every, "source", "target_no", "keyword_no", rank="_rank")
    first = ranked.groupBy("source").agg(F.min("_rank").alias("_first"))
    return ranked.join(F.broadcast(first), "source").select((F.col("_rank") - F.col("_first")).alias("request_no"), *_COLUMNS)
