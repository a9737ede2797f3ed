"""Written results: text report, table export, adapted documents, run summary."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.ids import artifact_slug
from vacantia.operators.filters import scored
from vacantia.operators.metrics import slug_collisions
from vacantia.operators.ranking import Ranges, best_first, rank_by_score, sort_ranges
from vacantia.operators.views import export_table, report_block
from vacantia.plans.sinks import DocumentSink, write_parts

REPORT_COLUMNS = [
    "id", "intitule", "entreprise_nom", "lieu_travail", "type_contrat", "salaire_libelle", "url",
    "score", "score_explication", "score_points_forts", "score_points_faibles",
]


def report_blocks(offers: DataFrame) -> DataFrame:
    """(rank, block) of every scored offer, best first."""
    ranked = rank_by_score(scored(offers).select(*REPORT_COLUMNS))
    return ranked.select("rank", report_block(F.col("rank")).alias("block"))


def _head(rows: int, as_of: datetime) -> str:
    rule = "=" * V.REPORT_WIDTH
    title = V.REPORT_TITLE + as_of.strftime(V.REPORT_MOMENT)
    return "\n".join([rule, title, f"  {rows}{V.REPORT_COUNT}", rule, "", ""])


def _foot() -> str:
    rule = "=" * V.REPORT_WIDTH
    return "\n" + "\n".join([rule, V.REPORT_END, rule])


def report_parts(ranges: Ranges, as_of: datetime) -> DataFrame:
    """(range, rank, block) of a sorted table of offers, with the report's head and foot in the first and last block.

    The sorted files are read as they lie, so nothing is exchanged but the count of rows per file.
    """
    ranked = ranges.ranked("rank", "range", ranges.in_files())
    block = report_block(F.col("rank"))
    block = F.when(F.col("rank") == 1, F.concat(F.lit(_head(ranges.rows, as_of)), block)).otherwise(block)
    block = F.when(F.col("rank") == ranges.rows, F.concat(block, F.lit(_foot()))).otherwise(block)
    return ranked.select("range", "rank", block.alias("block")).sortWithinPartitions("range", "rank")


def write_report(offers: DataFrame, path: str, as_of: datetime) -> str | None:
    """Write the text report, or nothing when no offer is scored.

    Offers are sorted once. Parts are in rank order: reading them one after the other gives the report.
    """
    ranges = sort_ranges(scored(offers).select(*REPORT_COLUMNS), F.desc("score"), "id")
    if not ranges.rows:
        return None
    write_parts(report_parts(ranges, as_of), path)
    return path


def write_export(offers: DataFrame, path: str, form: str = "csv") -> str | None:
    """Write the table export, best first, or nothing when no offer is scored."""
    if scored(offers).isEmpty():
        return None
    table = export_table(best_first(scored(offers)))
    writer = table.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(form).save(path)
    return path


def write_documents(documents: DataFrame, path: str, by_id: bool = False) -> str:
    """Publish adapted documents, each in its own ``name=cv_adapte_<slug>.html`` folder; see ``DocumentSink``.

    Two offers may share a slug. The write is refused then, unless the full id is used.
    For very many documents prefer one table (``documents.write.parquet``): this form makes
    a folder per document.
    """
    done = documents.where(F.col("html").isNotNull())
    if not by_id and not slug_collisions(done).isEmpty():
        raise ValueError("several offers share a slug: write by id")
    short = F.col("id") if by_id else artifact_slug(F.col("id"))
    name = F.concat(F.lit(V.DOCUMENT_PREFIX), short, F.lit(V.DOCUMENT_SUFFIX)).alias("name")
    DocumentSink(documents.sparkSession, path).write(done.select(name, "html"))
    return path


def report_name(as_of: datetime) -> str:
    return as_of.strftime(V.REPORT_NAME)


def run_summary(
    inserted: DataFrame, scores: DataFrame, version: int, run_at: Column, report_path: str | None, export_path: str | None
) -> DataFrame:
    """One row: what a run collected, scored and wrote."""
    new = inserted.select(F.lit(1).alias("n"), F.lit(0).alias("s"))
    ok = scores.where(F.col("score") >= 0).select(F.lit(0).alias("n"), F.lit(1).alias("s"))
    return new.unionByName(ok).agg(
        F.lit(version).cast("bigint").alias("version"),
        F.lit(run_at).alias("run_at"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("new_offers"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("scored_offers"),
        F.lit(report_path).cast("string").alias("report_path"),
        F.lit(export_path).cast("string").alias("export_path"),
    )
