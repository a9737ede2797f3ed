"""Queries: whole runs over landed files that Spark writes from the given tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.catalog.models import echo_generator
from vacantia.catalog.registry import Tables, query
from vacantia.config import Config
from vacantia.operators import documents
from vacantia.plans import run as runs
from vacantia.plans.requests import plan_run
from vacantia.plans.store import OfferStore
from vacantia.schemas import OFFER_TEXTS
from vacantia.sources.landing import open_landing
from vacantia.staging import new_path

AS_OF = datetime(2024, 3, 5, 14, 7)
_WANTED = 40
_PROFILE = {"candidat": {"poste_cible": "Ingénieur IA"}, "deal_breakers": ["éauç"], "criteres": {"distance_km": 25, "salaire_min_annuel": 45000}}
CONFIG = Config(
    _PROFILE,
    {
        "adzuna": {"search_params": {"max_results_par_cible": _WANTED}},
        "apec": {"location": "Île-de-France", "search_terms": ["ingénieur IA", "data"]},
        "indeed": {"hours_old": 72, "results_wanted": 5, "location": "Lyon"},
    },
)


def _write(rows: DataFrame, label: str) -> str:
    path = new_path(rows.sparkSession, label)
    rows.write.json(path)
    return path


def _landing(t: Tables) -> runs.Landing:
    """Every document is an offer of one source. Two of seven rows of B and C have no place, two of three of C have no date."""
    d = t["documents"]
    request, position = F.col("doc_id") % 5, F.floor(F.col("doc_id") / 5)
    placed = F.col("doc_id") % 7 > 1
    key = F.col("doc_id").cast("string")
    offer = F.struct(key.alias("id"), F.concat("lang", F.lit(" "), "source").alias("title"), F.col("text").alias("description"), F.concat(F.lit("https://adzuna.fr/"), key).alias("redirect_url"))
    pages = (
        d.where(F.col("doc_id") % 3 == 0)
        .select(offer.alias("offer"), F.floor(F.col("doc_id") / (3 * 20)).alias("request_no"))
        .groupBy("request_no")
        .agg(F.collect_list("offer").alias("results"))  # at most 20 offers of a page
        .select("request_no", F.lit(0).alias("target_no"), F.lit("fr").alias("pays"), F.lit(1).alias("page"), F.lit(200).alias("status"), "results")
    )
    item = F.to_json(F.struct(key.alias("id"), F.concat("lang", F.lit(" "), "source").alias("intitule"), F.col("text").alias("texteOffre")))
    items = d.where(F.col("doc_id") % 3 == 1).select(
        F.when(placed, request).alias("request_no"), F.when(placed, position).alias("position"), item.alias("item")
    )
    rows = d.where(F.col("doc_id") % 3 == 2).select(
        F.when(placed, request).alias("request_no"), F.when(placed, position).alias("position"),
        F.concat(F.lit("https://indeed.com/"), key).alias("job_url"), F.concat("lang", F.lit(" "), "source").alias("title"), F.col("text").alias("description"),
        F.when(F.col("doc_id") % 9 == 2, F.lit("2020-01-01T00:00:00")).alias("posted_at"),
    )
    return runs.Landing(_write(pages, "pages"), _write(items, "items"), _write(rows, "rows"))


_LANDED = """landed as (select doc_id, text, lang || ' ' || source as title, case doc_id % 3
  when 0 then 'https://adzuna.fr/' || doc_id when 1 then 'https://www.apec.fr/candidat/recherche-emploi.html/emploi/' || doc_id else 'https://indeed.com/' || doc_id end as url from documents),
offers as (select *, contains(lower(title || ' ' || text), 'éauç') as rejected,
  case doc_id % 3 when 0 then 'adzuna_fr_' || doc_id when 1 then 'apec_' || left(md5(url), 12) else 'indeed_' || left(md5(url), 12) end as id from landed)"""


@query("collect_run", f"with {_LANDED} select id, url, title as intitule, text as description, rejected from offers")
def collect_run(t: Tables) -> DataFrame:
    """Nothing that is landed gets lost: neither beyond a request's limit, nor undated, nor without a place."""
    typed, got = runs.collect(t.spark, _landing(t), CONFIG)
    if got.failed:
        raise RuntimeError(str(got.failed))
    return typed.select("id", "url", "intitule", "description", "rejected")


def _answers() -> Callable[[list[str]], list[str]]:
    return lambda asked: [json.dumps({"score": 61, "explication": "é", "points_forts": []}) for _ in asked]


_ONCE = f"with {_LANDED} select id, url, 61 as score, 'À postuler' as statut from offers where not rejected"


def _run(t: Tables, times: int) -> DataFrame:
    landing = _landing(t)
    state = OfferStore(t.spark, new_path(t.spark, "run-store"))
    for _ in range(times):
        runs.run_batch(t.spark, landing, state, CONFIG, _answers, AS_OF, 1, new_path(t.spark, "run-out"))
    return state.current().select("id", "url", "score", "statut")


@query("run_once", _ONCE)
def run_once(t: Tables) -> DataFrame:
    return _run(t, 1)


@query("run_replayed", _ONCE)
def run_replayed(t: Tables) -> DataFrame:
    """The same batch twice gives what it gave once, scores included."""
    return _run(t, 2)


def _twice(t: Tables) -> runs.Landing:
    """Two landings in one folder, both with the same requests and positions; a third of the second one is new."""
    folder = new_path(t.spark, "rows-twice")
    again = F.col("doc_id") % 3 == 0
    for name, key, title in (
        ("first", F.col("doc_id"), F.lit("first")),
        ("again", F.when(again, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")), F.concat(F.lit("again "), "source")),
    ):
        rows = t["documents"].select(
            (F.col("doc_id") % 5).alias("request_no"), F.floor(F.col("doc_id") / 5).alias("position"),
            F.concat(F.lit("https://indeed.com/"), key.cast("string")).alias("job_url"), title.alias("title"), F.col("text").alias("description"),
        )
        rows.write.json(open_landing(t.spark, folder))
    return runs.Landing(rows_c=folder)


@query(
    "collect_twice",
    """with clean as (select * from documents where not contains(lower(text), 'éauç')),
rows as (select 'https://indeed.com/' || doc_id as url, 'first' as intitule from clean
  union all select 'https://indeed.com/' || (doc_id + 1000000000), 'again ' || source from clean where doc_id % 3 = 0)
select 'indeed_' || left(md5(url), 12) as id, url, intitule from rows""",
)
def collect_twice(t: Tables) -> DataFrame:
    """Equal places of two landings are no conflict: the first landing counts first, what is new in the second is added."""
    state = OfferStore(t.spark, new_path(t.spark, "twice-store"))
    result = runs.run_batch(t.spark, _twice(t), state, CONFIG, _answers, AS_OF, 1, new_path(t.spark, "twice-out"))
    if result.failed_sources:
        raise RuntimeError(str(result.failed_sources))
    return state.current().select("id", "url", "intitule")


@query(
    "score_newest",
    """select id, 61 as score from (select 'd' || doc_id as id, doc_id % 977 as age from documents) order by age desc, id limit 20""",
)
def score_newest(t: Tables) -> DataFrame:
    """A report of the newest twenty: of all waiting offers only these are scored."""
    state = OfferStore(t.spark, new_path(t.spark, "score-store"))
    key = F.concat(F.lit("d"), F.col("doc_id"))
    values = {"id": key, "url": key, "description": F.col("text")}
    rows = t["documents"].select(
        *[values.get(c, F.lit("x")).alias(c) for c in OFFER_TEXTS],
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 977).alias("collected_at"),
    )
    state.insert("offers", 1, lambda keys_for: rows)
    runs.score_waiting(state, CONFIG, _answers, AS_OF, 1, limit=20)
    return state.current().where(F.col("score").isNotNull()).select("id", "score")


@query(
    "adapt_by_id",
    """with base as (select html from pages order by page_id limit 1),
made as (select 'd' || doc_id as id, doc_id, length('## OFFRE D''EMPLOI CIBLE' || chr(10) || 'Titre : ' || source || chr(10) || 'Entreprise : Non précisée' || chr(10)
  || 'Lieu : ' || lang || chr(10) || 'Contrat : Non précisé' || chr(10) || 'Salaire : Non précisé' || chr(10) || chr(10) || '### Description complète' || chr(10)
  || left(coalesce(nullif(text, ''), 'Aucune description'), 3000) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## CV HTML À ADAPTER' || chr(10)
  || (select html from base) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Adapte ce CV HTML pour cette offre en respectant toutes les règles.' || chr(10)
  || 'Retourne le HTML complet adapté.') as n from documents where doc_id in (select doc_id from labels))
select id, case when n % 13 > 0 then '<p>' || n || '</p>' end as html from made""",
)
def adapt_by_id(t: Tables) -> DataFrame:
    """The first page is the base document; the labelled documents are the offers asked for."""
    text = F.lit(None).cast("string")
    offers = t["documents"].select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("source").alias("intitule"), F.col("text").alias("description"),
        text.alias("entreprise_nom"), F.col("lang").alias("lieu_travail"), text.alias("type_contrat"), text.alias("salaire_libelle"),
    )
    asked = t["labels"].select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"))
    base = t["pages"].orderBy("page_id").limit(1).select("html")
    return documents.adapt_offers(offers, asked, base, echo_generator).select("id", "html")


@query(
    "run_requests",
    """with plan as (select c_custkey as target_no, lower(left(c_mktsegment, 2)) as pays, c_mktsegment as place, unnest(case when c_custkey % 2 = 0 then [c_name, c_mktsegment] else ['Ingénieur IA'] end) as what,
  unnest(case when c_custkey % 2 = 0 then [0, 1] else [0] end) as keyword_no from customer)
select cast('adzuna' as varchar) as source, row_number() over (order by target_no, keyword_no) - 1 as request_no, pays, what, place, 40 as results_wanted, 25.0::double as distance, 45000.0::double as salary_min, null::int as hours_old, null as url from plan
union all select 'apec', n, null, term, 'Île-de-France', null, null, null, null, 'https://www.apec.fr/candidat/recherche-emploi.html/emploi?motsCles=' || url_encode(term)
  || '&typesConvention=143684&typesConvention=143685&typesConvention=143686&typesConvention=143687&lieu=%C3%8Ele-de-France' from (values (0, 'ingénieur IA'), (1, 'data')) b(n, term)
union all select 'indeed', 0, null, 'Ingénieur IA', 'Lyon', 5, null, null, 72, null""",
)
def run_requests(t: Tables) -> DataFrame:
    """Targets of all customers, and the configured terms of the other sources."""
    words = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.array("c_name", "c_mktsegment")))
    targets = t["customer"].select(
        F.col("c_custkey").alias("target_no"), F.lower(F.substring("c_mktsegment", 1, 2)).alias("pays"),
        F.col("c_mktsegment").alias("localisation"), words.alias("mots_cles"),
    )
    asked = plan_run(targets, CONFIG)
    return asked.select("source", "request_no", "pays", "what", F.col("where").alias("place"), "results_wanted", "distance", "salary_min", "hours_old", "url")
