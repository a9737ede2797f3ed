"""Readers of landed source data and their common shape."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia import fixed_values as V
from vacantia.functions.ids import id_from_raw, id_from_url
from vacantia.functions.labels import contract_label, salary_label
from vacantia.functions.text import or_default, or_empty
from vacantia.schemas import EXTERNAL, PAGE_A, RAW_A, RAW_C
from vacantia.staging import stage

CORRUPT = "_corrupt_record"


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Landed JSON lines with a fixed schema; broken lines are kept aside in one column.

    Lines are read as text and then parsed, so that the broken ones can be asked for alone.
    """
    lines = spark.read.option("ignoreMissingFiles", "true").text(path)
    return parse_json(lines.where(F.trim("value") != ""), "value", schema)


def parse_json(rows: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """JSON held in a text column, its fields as columns.

    The record goes through a one-element ``inline``: a later filter on its fields then
    stays above the parsing and does not parse the text a second time.
    """
    record = F.from_json(
        text, with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    others = [c for c in rows.columns if c != text]
    return rows.select(*others, F.inline(F.array(record)))


def good_rows(read: DataFrame) -> DataFrame:
    return read.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantined(read: DataFrame, source: str) -> DataFrame:
    return read.where(F.col(CORRUPT).isNotNull()).select(F.lit(source).alias("source"), F.col(CORRUPT).alias("record"))


def read_pages_a(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, PAGE_A)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Base documents, one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")
    )


# --- source A ---------------------------------------------------------------------------


def fields_a(offer: Column) -> list[Column]:
    """The fields of one landed offer, each read for itself: one of another kind is null and costs no other.

    Text that holds a number counts as that number, and a number counts as its text.
    """

    def read(path: str, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StructType):
            inner = [read(f"{path}.{f.name}", f.dataType, f.name) for f in kind.fields]
            return F.struct(*inner).alias(name)
        return F.try_variant_get(offer, path, kind.simpleString()).alias(name)

    return [read(f"$.{f.name}", f.dataType, f.name) for f in RAW_A.fields]


def read_a(rows: DataFrame, offer: str = "offer") -> DataFrame:
    """Variants as columns of source A, with the whole record as JSON in ``record``. The variant is bound once."""
    one = F.struct(*fields_a(F.col(offer)), F.to_json(F.col(offer)).alias("record"))
    others = [c for c in rows.columns if c != offer]
    return rows.select(*others, one.alias("_offer")).select(*others, "_offer.*")


def normalise_a(raw: DataFrame, country: str = "pays", keep: tuple[str, ...] = ()) -> DataFrame:
    """Source A offers, as ``read_a`` gives them, as stored offers, with the salary bounds kept as numbers."""
    place = F.col(country)
    return raw.select(
        *keep,
        id_from_raw(place, F.col("id")).alias("id"),
        or_empty(F.col("title")).alias("intitule"),
        or_empty(F.col("description")).alias("description"),
        or_empty(F.col("company.display_name")).alias("entreprise_nom"),
        or_empty(F.col("location.display_name")).alias("lieu_travail"),
        contract_label(F.col("contract_time"), F.col("contract_type"), place).alias("type_contrat"),
        salary_label(F.col("salary_min"), F.col("salary_max"), place).alias("salaire_libelle"),
        or_empty(F.col("created")).alias("date_creation"),
        or_empty(F.col("redirect_url")).alias("url"),
        F.col("record").alias("raw_json"),
        "salary_min",
        "salary_max",
    )


def raw_json(*fields: Column) -> Column:
    """The record as JSON. Equal to the landed record in value, not in bytes."""
    return F.to_json(F.struct(*fields))


# --- source B ---------------------------------------------------------------------------


def _item_b(item: Column) -> Column:
    """One parsed item as (keep, common fields)."""

    def field(name: str) -> Column:
        return or_empty(F.try_variant_get(item, f"$.{name}", "string"))

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))

    has_id = (
        F.when(kind("id") == "STRING", field("id") != "")
        .when(kind("id") == "BOOLEAN", F.try_variant_get(item, "$.id", "boolean"))
        .when(kind("id").isNull() | (kind("id") == "VOID"), F.lit(False))
        .otherwise(F.coalesce(F.try_variant_get(item, "$.id", "double") != 0, F.lit(True)))
    )
    company = F.when(kind("entreprise").startswith("OBJECT"), field("entreprise.nom")).otherwise(field("entreprise"))
    return F.struct(
        has_id.alias("keep"),
        field("intitule").alias("titre"),
        company.alias("entreprise"),
        field("lieuTexte").alias("localisation"),
        field("texteOffre").alias("description"),
        F.concat(F.lit(V.APEC_OFFER_URL), field("id")).alias("url"),
        F.lit("apec").alias("source"),
        field("datePublication").alias("date_publication"),
        field("salaireTexte").alias("salaire"),
        field("typeContrat").alias("type_contrat"),
    )


def read_b(items: DataFrame, text: str = "item") -> DataFrame:
    """Source B items, one JSON text each. The company is an object or a plain string.

    The parsed item is bound as the one element of an array; otherwise the filter on the id
    and the projection would each parse the text.
    """
    parsed = F.transform(F.array(F.try_parse_json(text)), _item_b)
    others = [c for c in items.columns if c != text]
    return items.select(*others, F.inline(F.filter(parsed, lambda item: item["keep"]))).drop("keep")


# --- source C ---------------------------------------------------------------------------


def read_c(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Source C rows. Missing cells become '' and rows without URL are dropped."""
    cells = {c: F.col(c).cast("string") for c in RAW_C.fieldNames()}
    url = or_empty(or_default(cells["job_url"], cells["url"]))
    description = or_empty(or_default(cells["description"], cells["job_description"]))
    return rows.select(
        *keep,
        or_empty(cells["title"]).alias("titre"),
        or_empty(cells["company"]).alias("entreprise"),
        or_empty(cells["location"]).alias("localisation"),
        description.alias("description"),
        url.alias("url"),
        F.lit("indeed").alias("source"),
        or_empty(cells["date_posted"]).alias("date_publication"),
    ).where(F.col("url") != "")


def newest_c(
    rows: DataFrame, as_of: Column, hours_old: int, results_wanted: int, request: str = "request_no", posted: str = "posted_at", tie: str = "seq"
) -> DataFrame:
    """What one request asks source C for: posted within ``hours_old``, the newest ``results_wanted``; undated rows stay.

    This stands for the source's own side of a request. Landed rows are an answer already and are not cut again.
    """
    recent = F.col(posted) >= as_of - F.make_dt_interval(hours=F.lit(hours_old))
    newest = Window.partitionBy(request).orderBy(F.desc(posted), tie)
    dated = rows.where(recent).withColumn("_newest", F.row_number().over(newest)).where(F.col("_newest") <= results_wanted).drop("_newest")
    return dated.unionByName(rows.where(F.col(posted).isNull()))


# --- common shape -------------------------------------------------------------------------


def union_external(*parts: DataFrame) -> DataFrame:
    """Sources B and C together; columns a source lacks become ''."""
    first, *others = parts
    for part in others:
        first = first.unionByName(part, allowMissingColumns=True)
    texts = EXTERNAL.fieldNames()
    extra = [c for c in first.columns if c not in texts]
    present = [or_empty(F.col(c)).alias(c) if c in first.columns else F.lit("").alias(c) for c in texts]
    return first.select(*extra, *present)


def external_to_stored(offers: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sources B and C as stored offers."""
    return offers.select(
        *keep,
        id_from_url(F.col("source"), F.col("url")).alias("id"),
        F.col("titre").alias("intitule"),
        "description",
        F.col("entreprise").alias("entreprise_nom"),
        F.col("localisation").alias("lieu_travail"),
        "type_contrat",
        F.col("salaire").alias("salaire_libelle"),
        F.col("date_publication").alias("date_creation"),
        "url",
        raw_json(*[F.col(c) for c in EXTERNAL.fieldNames()]).alias("raw_json"),
    )


_STORED_AS = {
    "titre": "intitule", "entreprise": "entreprise_nom", "localisation": "lieu_travail",
    "date_publication": "date_creation", "salaire": "salaire_libelle",
}


def with_external_json(stored: DataFrame, source: str) -> DataFrame:
    """Stored offers of source B or C with ``raw_json`` made from their columns, so that it need not be written beside them."""
    fields = [(F.lit(source) if c == "source" else F.col(_STORED_AS.get(c, c))).alias(c) for c in EXTERNAL.fieldNames()]
    return stored.withColumn("raw_json", raw_json(*fields))


@dataclass(frozen=True)
class Collected:
    """What each source gave: written tables, the errors of the sources that failed, and how many of its lines were broken."""

    tables: dict[str, DataFrame]
    failed: dict[str, str]
    broken: dict[str, int]


def read_available(readers: dict[str, Callable[[], tuple[DataFrame, int]]]) -> Collected:
    """Read each source into a written table; one that fails does not stop the others.

    A source can fail anywhere in its data, so it only counts as read once it is written. A reader gives its rows and
    how many of its lines were broken.
    """
    out = Collected({}, {}, {})
    for source, reader in readers.items():
        try:
            rows, broken = reader()
            out.tables[source] = stage(rows, f"read-{source}").table
            out.broken[source] = broken
        except Exception as problem:  # whatever stops one source is that source's problem
            out.failed[source] = str(problem)
    return out


def observed(read: DataFrame, seen: Observation, also_broken: Column | None = None) -> DataFrame:
    """Good rows of parsed lines, and their number of broken ones in ``seen``."""
    broken = F.col(CORRUPT).isNotNull()
    if also_broken is not None:
        broken = broken | also_broken
    return read.observe(seen, F.count_if(broken).alias("broken")).where(~broken).drop(CORRUPT)
