"""One full run: collect, admit, score, report."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.config import Config
from vacantia.functions.ids import arrival_order
from vacantia.operators.admission import admit
from vacantia.operators.dedup import first_by_url, last_value_first_place
from vacantia.operators.filters import has_forbidden_term, scored, to_score, with_url
from vacantia.operators.metrics import target_counters
from vacantia.operators.ranking import scoring_queue
from vacantia.operators.scoring import score_offers, score_rows
from vacantia.plans.exports import REPORT_COLUMNS, report_name, run_summary, write_export, write_report
from vacantia.plans.store import OfferStore
from vacantia.schemas import ITEM_B, OFFER_TEXTS, PAGE_A, ROW_C
from vacantia.sources.landing import broken_lines, land, one_per_place, read_landed
from vacantia.sources.pages import ingest_pages
from vacantia.sources.readers import (
    Collected,
    external_to_stored,
    normalise_a,
    read_a,
    read_available,
    read_b,
    read_c,
    union_external,
    with_external_json,
)
from vacantia.staging import Staged, stage, staging_scope


@dataclass(frozen=True)
class Landing:
    """Folders of landed JSON lines, see ``sources.landing``; a source that was not collected is None."""

    pages_a: str | None = None
    items_b: str | None = None
    rows_c: str | None = None


@dataclass(frozen=True)
class RunResult:
    """``broken_lines`` counts, per source, the landed lines that could not be read; they are written to ``broken_path``."""

    version: int
    new_offers: int
    scored_offers: int
    report_path: str | None
    export_path: str | None
    failed_sources: dict[str, str]
    broken_lines: dict[str, int]
    broken_path: str | None
    counters: DataFrame | None


def moment(as_of: datetime) -> Column:
    """A point in time in the session's zone, as a constant."""
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def typed_a(pages: DataFrame, config: Config) -> DataFrame:
    """Source A: accepted results as stored offers, with what later decisions need."""
    order = arrival_order(F.lit(V.SOURCE_RANK["adzuna"]), F.col("request_no"), F.col("position"))
    results = read_a(ingest_pages(pages, config.max_results).select("target_no", "pays", order.alias("seq"), "offer"))
    marked = results.withColumn("raw_id", F.col("id"))
    return _marked(normalise_a(marked, keep=("seq", "target_no", "raw_id")), config)


def typed_external(rows: DataFrame, config: Config) -> DataFrame:
    """Source B or C as stored offers; they have no target."""
    stored = external_to_stored(union_external(rows), keep=("seq",))
    target = F.lit(None).cast("bigint")
    return _marked(stored.withColumns({"target_no": target, "raw_id": F.lit(None).cast("string")}), config)


def _marked(offers: DataFrame, config: Config) -> DataFrame:
    rejected = has_forbidden_term(F.col("intitule"), F.col("description"), config.forbidden_terms)
    return offers.select("seq", "target_no", "raw_id", *OFFER_TEXTS, rejected.alias("rejected"))


def _ordered(landed: DataFrame, source: str) -> DataFrame:
    """Landed rows of source B or C with their number in the order of all rows."""
    order = arrival_order(F.lit(V.SOURCE_RANK[source]), F.col("request_no"), F.col("position"))
    return one_per_place(landed).withColumn("seq", order).drop("request_no", "position")


def _no_place() -> Column:
    """A page that belongs to no request, or has no number, cannot be put in order."""
    return F.col("request_no").isNull() | F.col("page").isNull()


def collect(spark: SparkSession, landing: Landing, config: Config) -> tuple[DataFrame | None, Collected]:
    """Typed offers of all sources that can be read, each written once, and how reading went.

    Every landed row counts: limits on number and age are part of a request, not of its answer. Landed text is parsed once.
    The record of sources B and C is not written, as the other columns hold all of it.
    """

    def from_a() -> tuple[DataFrame, int]:
        landed, broken = land(read_landed(spark, landing.pages_a, PAGE_A), "adzuna", _no_place())
        return typed_a(landed.table.drop("epoch", "_row"), config), broken

    def from_b() -> tuple[DataFrame, int]:
        landed, broken = land(read_landed(spark, landing.items_b, ITEM_B), "apec")
        return typed_external(read_b(_ordered(landed.table, "apec")), config).drop("raw_json"), broken

    def from_c() -> tuple[DataFrame, int]:
        landed, broken = land(read_landed(spark, landing.rows_c, ROW_C), "indeed")
        return typed_external(read_c(_ordered(landed.table, "indeed"), keep=("seq",)), config).drop("raw_json"), broken

    sources = [("adzuna", landing.pages_a, from_a), ("apec", landing.items_b, from_b), ("indeed", landing.rows_c, from_c)]
    got = read_available({name: reader for name, path, reader in sources if path})
    for name in ("apec", "indeed"):
        if name in got.tables:
            got.tables[name] = with_external_json(got.tables[name], name)
    return (reduce(DataFrame.unionByName, got.tables.values()) if got.tables else None), got


def broken_records(spark: SparkSession, landing: Landing, only: Iterable[str] = ("adzuna", "apec", "indeed")) -> DataFrame | None:
    """(source, record) of every landed line that cannot be used.

    This is a pass of its own over the landed text, for whoever wants to see the lines.
    """
    sources = [
        ("adzuna", landing.pages_a, PAGE_A, _no_place()),
        ("apec", landing.items_b, ITEM_B, None),
        ("indeed", landing.rows_c, ROW_C, None),
    ]
    parts = [broken_lines(read_landed(spark, path, schema), name, lost) for name, path, schema, lost in sources if path and name in only]
    return reduce(DataFrame.unionByName, parts) if parts else None


def deduplicated(typed: DataFrame) -> DataFrame:
    """The rows found, without repeats, as narrow rows with their ``place`` in the order.

    Source A keeps the last value of a raw id per target, at the first place. Sources B and
    C keep the first row of a URL whether or not it is rejected: if it is, a later clean
    copy is lost with it.
    """
    narrow = typed.select("seq", "target_no", "raw_id", "id", "url", "rejected")
    found_a = last_value_first_place(narrow.where(F.col("target_no").isNotNull()), "target_no", "raw_id")
    found_ext = first_by_url(narrow.where(F.col("target_no").isNull())).withColumn("place", F.col("seq"))
    return found_a.unionByName(found_ext)


def add_offers(store: OfferStore, typed: DataFrame, as_of: datetime, writer: str, batch: int) -> tuple[int, int, DataFrame]:
    """Admit typed offers against the living ones and publish them: their version, how many are new, counters of source A.

    Everything is decided on narrow rows; the wide rows cross one shuffle, or none where
    the admitted rows are few enough to broadcast. Only source A has targets to count by.
    """
    found = stage(deduplicated(typed), "found").table
    candidates = with_url(found.where(~F.col("rejected")))
    admitted: list[Staged] = []

    def choose(keys_for: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        admission = admit(candidates, keys_for(candidates.select("id", "url")), order="place")
        admitted.append(stage(admission.offers.select("seq", "target_no"), "new"))
        if not admission.count:
            return None
        rows = typed.join(admitted[-1].table.select("seq"), "seq", "left_semi")
        return rows.select(*OFFER_TEXTS, moment(as_of).alias("collected_at"))

    version = store.insert(writer, batch, choose)
    new, of_target = admitted[-1], F.col("target_no").isNotNull()
    return version, new.rows, target_counters(found.where(of_target), new.table.where(of_target), "target_no")


def score_waiting(
    store: OfferStore,
    config: Config,
    make_scorer: Callable[[], Callable[[list[str]], list[str]]],
    as_of: datetime,
    batch: int,
    retry_failed: bool = False,
    partitions: int = V.SCORING_TASKS,
    limit: int | None = None,
    writer: str = "score",
) -> DataFrame:
    """Score the offers that wait, or the newest ``limit`` of them; the write calls the model once per offer.

    A batch that runs again finds the scores it published and asks the model nothing.
    """
    version = store.version_of(writer, batch)
    if version is None:
        waiting = to_score(store.current(), retry_failed)
        if limit is not None:
            waiting = scoring_queue(waiting, limit)
        scores = score_offers(waiting, config.profile, make_scorer, partitions)
        version = store.commit(writer, batch, scores=score_rows(scores, moment(as_of)))
    return store.read("scores", only=version)


def run_batch(
    spark: SparkSession,
    landing: Landing,
    store: OfferStore,
    config: Config,
    make_scorer: Callable[[], Callable[[list[str]], list[str]]],
    as_of: datetime,
    batch: int,
    out: str,
    writer: str = "run",
) -> RunResult:
    """Collect, admit, score if anything is new, then report.

    The store publishes the run's offers, its scores and its summary once each, by (writer, batch): a run that is repeated
    with its number finds what it published, does the rest, and writes its reports again from the state as of then.
    """
    with staging_scope(spark):
        typed, got = collect(spark, landing, config)
        new, counters = 0, None
        if typed is None:
            version = store.insert(writer, batch, lambda keys_for: None)
        else:
            version, new, counters = add_offers(store, typed, as_of, writer, batch)
            rows = counters.collect()  # a row per target and one for all
            counters = spark.createDataFrame(rows, counters.schema)
        scoring = version
        if new > 0:
            score_waiting(store, config, make_scorer, as_of, batch, writer=f"{writer}/scores")
            scoring = store.version_of(f"{writer}/scores", batch)
        offers = stage(scored(store.current(before=scoring + 1)).select(*REPORT_COLUMNS), "scored").table
        report = write_report(offers, f"{out}/{report_name(as_of)}", as_of)
        export = write_export(offers, f"{out}/offres")
        broken = [name for name, lines in got.broken.items() if lines]
        broken_path = f"{out}/broken" if broken else None
        if broken:
            broken_records(spark, landing, broken).write.mode("overwrite").json(broken_path)
        inserted, scores = store.read("offers", only=version), store.read("scores", only=scoring)
        told = store.commit(f"{writer}/summary", batch, runs=run_summary(inserted, scores, version, moment(as_of), report, export))
        summary = store.read("runs", only=told).first()
        return RunResult(version, new, summary["scored_offers"], report, export, got.failed, got.broken, broken_path, counters)
