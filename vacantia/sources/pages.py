"""Landed result pages of source A."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia import fixed_values as V


def ingest_pages(pages: DataFrame, max_results: int, request: str = "request_no") -> DataFrame:
    """Results that a sequential reader of each request would have kept.

    Pages count in order from page 1 until one that failed, is empty or was not landed, or one that is short (whose
    own results still count); a request yields ``max_results`` results at most. Of a page
    landed more than once one copy counts: one that succeeded, and of equal ones the first by content.

    A reader that wants ``max_results`` never asks beyond page ``max_results / per page``,
    so later pages are dropped first; with one copy per page this bounds the rows of one window, however many pages a
    request has. Pages cross one shuffle, before their results are exploded.
    """
    per_page = min(V.PAGE_SIZE_LIMIT, max_results)
    last_page = -(-max_results // per_page) if max_results > 0 else 0
    copies = Window.partitionBy(request, "page")
    of_page = copies.orderBy((F.col("status") == 200).desc_nulls_last(), F.desc("_size"), "_content")
    of_request = Window.partitionBy(request).orderBy("page")
    before = of_request.rowsBetween(Window.unboundedPreceding, -1)
    unread = F.coalesce((F.col("status") != 200) | (F.col("_size") <= 0), F.lit(True)) | (F.col("page") != F.col("_place"))
    ends = unread | (F.col("_size") < per_page)
    return (
        pages.where(F.col("page").between(1, last_page))
        .withColumn("_size", F.coalesce(F.size("results"), F.lit(0)))
        .repartition(request)
        # Only pages that landed more than once are told apart by content.
        .withColumn("_content", F.when(F.count(F.lit(1)).over(copies) > 1, F.xxhash64(F.to_json("results"))))
        .withColumn("_copy", F.row_number().over(of_page))
        .where(F.col("_copy") == 1)
        .withColumn("_place", F.row_number().over(of_request))
        .withColumn("_ended", F.coalesce(F.max(ends).over(before), F.lit(False)))
        .withColumn("_earlier", F.coalesce(F.sum("_size").over(before), F.lit(0)).cast("int"))
        .where(~F.col("_ended") & ~unread & (F.col("_earlier") < max_results))
        .select(
            *[c for c in pages.columns if c != "results"],
            "_earlier",
            F.posexplode(F.slice("results", 1, F.lit(max_results) - F.col("_earlier"))).alias("_at", "offer"),
        )
        .withColumn("position", F.col("_earlier") + F.col("_at"))
        .drop("_earlier", "_at")
    )
