"""Tables as the dashboard and the exports show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.labels import (
    fill_colour,
    priority_dashboard,
    priority_export,
    priority_report,
    source_dashboard,
    source_export,
    status_or_default,
    text_colour,
)
from vacantia.functions.text import json_list, or_default, or_empty


def dashboard_table(offers: DataFrame) -> DataFrame:
    """The dashboard's ten columns, and the text colour of the row, best score first."""
    return offers.orderBy(F.desc("score"), "id").select(
        F.col("score").alias("Score"),
        priority_dashboard(F.col("score")).alias("Priorité"),
        F.col("intitule").alias("Poste"),
        F.col("entreprise_nom").alias("Entreprise"),
        F.col("lieu_travail").alias("Lieu"),
        F.col("type_contrat").alias("Contrat"),
        F.col("salaire_libelle").alias("Salaire"),
        source_dashboard(F.col("url")).alias("Source"),
        status_or_default(F.col("statut")).alias("Statut"),
        F.col("url").alias("URL"),
        text_colour(F.col("score")).alias("couleur"),
    )


def export_table(offers: DataFrame) -> DataFrame:
    """The export's twelve columns, and the fill colour of the row."""
    score = F.coalesce("score", F.lit(0))
    values = [
        score,
        priority_export(score),
        *[or_empty(F.col(c)) for c in ("intitule", "entreprise_nom", "lieu_travail", "type_contrat", "salaire_libelle")],
        source_export(or_empty(F.col("url"))),
        *[or_empty(F.col(c)) for c in ("score_explication", "score_points_forts", "score_points_faibles", "url")],
    ]
    named = [value.alias(name) for value, name in zip(values, V.EXPORT_COLUMNS, strict=True)]
    return offers.select(*named, fill_colour(score).alias("remplissage"))


def point_rows(offers: DataFrame) -> DataFrame:
    """Strong and weak points, one row each; an offer without points of a kind has none."""
    kinds = {"fort": "score_points_forts", "faible": "score_points_faibles"}
    listed = F.array(
        *[F.struct(F.lit(kind).alias("kind"), json_list(F.col(c)).alias("points")) for kind, c in kinds.items()]
    )
    return (
        offers.select("id", F.inline(listed))
        .select("id", "kind", F.posexplode("points").alias("point_no", "point"))
    )


def _bullets(points_json: str, title: str, mark: str) -> Column:
    points = json_list(F.col(points_json))
    lines = F.array_join(F.transform(points, lambda p: F.concat(F.lit(mark), or_empty(p))), "\n")
    return F.when(F.size(points) > 0, F.concat(F.lit(title + "\n"), lines, F.lit("\n")))


def report_block(rank: Column) -> Column:
    """One offer of the text report; absent parts leave no line."""
    rule = "─" * V.REPORT_WIDTH
    fields = [
        F.concat(F.lit(label), F.col(c) if default is None else or_default(F.col(c), default))
        for label, c, default in V.REPORT_FIELDS
    ]
    headline = F.concat(
        F.lit("  #"), rank.cast("string"), F.lit("  ["), F.col("score").cast("string"), F.lit("/100] "),
        priority_report(F.col("score")),
    )
    analysis = F.when(
        or_empty(F.col("score_explication")) != "",
        F.concat(F.lit(V.REPORT_ANALYSIS + "\n  "), F.col("score_explication"), F.lit("\n")),
    )
    return F.concat_ws(
        "\n",
        F.lit(rule),
        headline,
        F.lit(rule),
        *fields,
        F.lit(""),
        analysis,
        _bullets("score_points_forts", *V.REPORT_STRONG),
        _bullets("score_points_faibles", *V.REPORT_WEAK),
        F.lit(""),
    )
