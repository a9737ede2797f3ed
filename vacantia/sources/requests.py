"""What to ask each source for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.text import is_set, or_empty, percent_encode


def search_plan(targets: DataFrame, default_keyword: str) -> DataFrame:
    """One row per target and keyword, in the order the keywords are written.

    ``mots_cles`` is JSON text: a list, a bare string, or nothing. An empty list or string
    counts as nothing and takes the default keyword.
    """
    value = F.try_parse_json("mots_cles")
    one = F.try_variant_get(value, "$", "string")
    several = F.try_variant_get(value, "$", "array<string>")
    keywords = (
        F.when(F.schema_of_variant(value).startswith("ARRAY") & (F.size(several) > 0), several)
        .when((F.schema_of_variant(value) == "STRING") & (one != ""), F.array(one))
        .otherwise(F.array(F.lit(default_keyword)))
    )
    others = [c for c in targets.columns if c != "mots_cles"]
    return targets.select(*others, F.posexplode(keywords).alias("keyword_no", "mot_cle"))


def request_plan(
    plan: DataFrame,
    max_results: int | Column,
    distance_km: float | Column | None = None,
    salary_min: float | Column | None = None,
) -> DataFrame:
    """Request parameters of source A. Distance and salary are left out unless set."""
    limit, distance, salary = (
        value if isinstance(value, Column) else F.lit(value).cast("double")
        for value in (max_results, distance_km, salary_min)
    )
    limit = limit.cast("int")
    return plan.where(limit > 0).select(
        "*",
        F.col("mot_cle").alias("what"),
        F.col("localisation").alias("where"),
        F.least(F.lit(V.PAGE_SIZE_LIMIT), limit).alias("results_per_page"),
        F.when(is_set(distance), distance).alias("distance"),
        F.when(is_set(salary), salary).alias("salary_min"),
    )


def apec_search_url(term: Column, location: Column) -> Column:
    """Search URL of source B. "France" in any case means no place filter."""
    place = F.when(
        (or_empty(location) != "") & (F.lower(location) != "france"),
        F.concat(F.lit("&lieu="), percent_encode(location)),
    ).otherwise("")
    return F.concat(F.lit(V.APEC_SEARCH_URL), percent_encode(term), F.lit("&" + V.APEC_CONTRACTS), place)
