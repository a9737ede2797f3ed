"""Queries: de-duplication, admission, state, metrics and reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.catalog.fixture import (
    DUCK_CLEAN,
    SPARK_OFFERS,
    TERMS,
    duck_admit,
    offers,
    stored_offers,
    with_offers,
)
from vacantia.catalog.registry import Tables, query
from vacantia.functions import ids, labels
from vacantia.operators import admission, dedup, filters, metrics, ranking
from vacantia.plans import exports, store
from vacantia.schemas import OFFER_TEXTS
from vacantia.staging import new_path, stage
from vacantia.streaming.ingest import ingest_stream
from vacantia.streaming.stateful import catch_up, ingest_stateful

# --- flagship --------------------------------------------------------------------------------


@query(
    "priority_by_source",
    with_offers(f"""select priorite, origin, count(*) as offers, avg(score) as mean_score, count(*) filter (salaire_libelle <> '') as with_salary from (
  select score, salaire_libelle, case when score >= 85 then '★★★ PRIORITAIRE' when score >= 60 then '★★ À CONSIDÉRER' else '★ FAIBLE' end as priorite,
    case when url ilike '%adzuna%' then 'Adzuna' when url ilike '%apec%' then 'APEC' when url ilike '%indeed%' then 'Indeed' else 'N/A' end as origin
  from stored_fx where score >= 0 and {DUCK_CLEAN}) group by all"""),
)
def priority_by_source(t: Tables) -> DataFrame:
    fitting = filters.without_forbidden_terms(filters.scored(stored_offers(t)), TERMS)
    return (
        fitting.groupBy(
            labels.priority_dashboard(F.col("score")).alias("priorite"),
            labels.source_dashboard(F.col("url")).alias("origin"),
        )
        .agg(
            F.count(F.lit(1)).alias("offers"),
            F.avg("score").alias("mean_score"),
            F.count_if(F.col("salaire_libelle") != "").alias("with_salary"),
        )
    )


# --- de-duplication ----------------------------------------------------------------------------

# Raw ids of a target repeat across its keywords; a third of them is missing.
_REPEATS = """select event_id as seq, event_type as target, case when user_id % 3 = 0 then null else cast(user_id as string) end as id, value from {events}"""
_DUCK_REPEATS = """r as (select event_id as seq, event_type as target, case when user_id % 3 > 0 then user_id::varchar end as id, value from events)"""


@query(
    "dedup_last_wins",
    f"""with {_DUCK_REPEATS} select seq, target, id, value, place from (
  select *, min(seq) over (partition by target, coalesce(id, '')) as place,
         row_number() over (partition by target, coalesce(id, '') order by seq desc) as rn from r) where rn = 1""",
)
def dedup_last_wins(t: Tables) -> DataFrame:
    return dedup.last_value_first_place(t.sql(_REPEATS, events=t["events"]))


@query(
    "dedup_first_url",
    with_offers(f"""select seq, url, {DUCK_CLEAN} as clean from (
  select *, row_number() over (partition by url order by seq) as rn from offers_fx where url <> '') where rn = 1"""),
)
def dedup_first_url(t: Tables) -> DataFrame:
    first = dedup.first_by_url(offers(t))
    clean = ~filters.has_forbidden_term(F.col("intitule"), F.col("description"), TERMS)
    return first.select("seq", "url", clean.alias("clean"))


@query(
    "keep_first_url",
    with_offers("select min(seq) as seq, url from (select seq, case when seq % 10 = 0 then null else url end as url from offers_fx) group by url"),
)
def keep_first_url(t: Tables) -> DataFrame:
    o = offers(t).select("seq", F.when(F.col("seq") % 10 != 0, F.col("url")).alias("url"))
    return dedup.keep_lowest_by_url(o).select("seq", "url")


@query(
    "anti_known_urls",
    with_offers("""select seq, url from offers_fx where seq % 3 > 0 and url <> ''
  and not exists (select 1 from offers_fx s where s.seq % 3 = 0 and s.url = offers_fx.url)"""),
)
def anti_known_urls(t: Tables) -> DataFrame:
    o = offers(t).select("seq", "url")
    return admission.without_known_urls(o.where(F.col("seq") % 3 > 0), o.where(F.col("seq") % 3 == 0))


@query(
    "insert_or_ignore",
    with_offers(
        f", {duck_admit('select seq, id, url from offers_fx where length(url) > 0')} select seq, id, url from kept join offers_fx using (seq)",
        recursive=True,
    ),
)
def insert_or_ignore(t: Tables) -> DataFrame:
    return admission.admit(filters.with_url(offers(t))).offers.select("seq", "id", "url")


def _clean_candidates(t: Tables) -> DataFrame:
    return filters.without_forbidden_terms(filters.with_url(offers(t)), TERMS)


_CLEAN_KEPT = duck_admit(f"select seq, id, url from offers_fx where url <> '' and {DUCK_CLEAN}")


_CHAIN = """select doc_id as seq, 'i' || cast((doc_id + 1) // 2 as varchar) as id,
  case when doc_id % 10 = 9 then 'hot' else 'u' || cast(doc_id // 2 as varchar) end as url from documents"""


@query("admit_chain", f"with recursive {duck_admit(_CHAIN).lstrip()} select seq from kept")
def admit_chain(t: Tables) -> DataFrame:
    """Every row conflicts with the one before, by id and by url in turn; a tenth of all rows share one URL."""
    chain = t["documents"].select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("i"), F.floor((F.col("doc_id") + 1) / 2)).alias("id"),
        F.when(F.col("doc_id") % 10 == 9, "hot").otherwise(F.concat(F.lit("u"), F.floor(F.col("doc_id") / 2))).alias("url"),
    )
    return admission.admit(chain).offers.select("seq")


def _as_stored(o: DataFrame) -> DataFrame:
    """Derived offers with all stored columns."""
    texts = [F.col(c) if c in o.columns else F.lit("").alias(c) for c in OFFER_TEXTS]
    return o.select("seq", *texts, F.col("collected_at").cast("timestamp").alias("collected_at"))


_LATER = 1_000_000_000_000


@query(
    "admit_two_writers",
    with_offers(
        f""", {duck_admit(f'select seq + case when seq % 2 = 0 then {_LATER} else 0 end as seq, id, url from offers_fx where length(url) > 0')}
  select o.id, o.url, o.intitule from kept k join offers_fx o on o.seq = k.seq % {_LATER}""",
        recursive=True,
    ),
)
def admit_two_writers(t: Tables) -> DataFrame:
    """Two writers with common ids and URLs; the second one publishes while the first, which has chosen already, has not."""
    root = new_path(t.spark, "writers-store")
    rows = _as_stored(filters.with_url(offers(t)))

    def add(writer: str, part: DataFrame, before_publishing: Callable[[], None] = lambda: None) -> None:
        def choose(keys_for: Callable[[DataFrame], DataFrame]) -> DataFrame:
            admitted = admission.admit(part.select("seq", "id", "url"), keys_for(part.select("id", "url")))
            before_publishing()
            return part.join(admitted.kept, "seq", "left_semi")

        store.OfferStore(t.spark, root).insert(writer, 1, choose)

    add("even", rows.where(F.col("seq") % 2 == 0), lambda: add("odd", rows.where(F.col("seq") % 2 == 1)))
    return store.OfferStore(t.spark, root).current().select("id", "url", "intitule")


@query(
    "current_from_snapshot",
    with_offers(
        f""", {_CLEAN_KEPT} select o.id, case when o.seq % 4 = 1 then 50 end as score,
  case when o.seq % 5 = 2 then 'Refusé' else 'À postuler' end as statut from kept join offers_fx o using (seq) where o.seq % 3 <> 0""",
        recursive=True,
    ),
)
def current_from_snapshot(t: Tables) -> DataFrame:
    """A third of the offers is deleted after a snapshot, others are scored before or moved after it."""
    state = store.OfferStore(t.spark, new_path(t.spark, "snapshot-store"))
    kept = stage(admission.admit(_clean_candidates(t)).offers, "snapshot-kept").table
    state.insert("offers", 1, lambda keys_for: _as_stored(kept))
    texts = [F.lit("x").alias(c) for c in ("score_explication", "score_points_forts", "score_points_faibles")]
    scores = kept.where(F.col("seq") % 4 == 1).select("id", F.lit(50).alias("score"), *texts, F.lit(None).alias("score_date"))
    state.commit("scores", 1, scores=scores)
    state.snapshot()
    state.delete(kept.where(F.col("seq") % 3 == 0), 1)
    state.set_status(kept.where(F.col("seq") % 5 == 2).select("id", F.lit("Refusé").alias("statut")), 1)
    return state.current().select("id", "score", "statut")


@query(
    "new_by_source",
    with_offers(f", {_CLEAN_KEPT} select split_part(id, '_', 1) as source, count(*) as inserted from kept join offers_fx using (seq) group by 1", recursive=True),
)
def new_by_source(t: Tables) -> DataFrame:
    new = admission.admit(_clean_candidates(t)).offers
    return metrics.count_by(new.withColumn("source", F.substring_index("id", "_", 1)), "source", "inserted")


@query(
    "target_counters",
    with_offers(
        f""", {_CLEAN_KEPT} select pays as target, count(*) as found, count(*) filter (not ({DUCK_CLEAN})) as rejected, count(kept.seq) as inserted
  from offers_fx left join kept using (seq) group by rollup (pays)""",
        recursive=True,
    ),
)
def target_counters(t: Tables) -> DataFrame:
    o = offers(t)
    found = o.select(
        F.col("pays").alias("target"),
        filters.has_forbidden_term(o.intitule, o.description, TERMS).alias("rejected"),
    )
    inserted = admission.admit(_clean_candidates(t)).offers.select(F.col("pays").alias("target"))
    return metrics.target_counters(found, inserted)


@query(
    "run_gate",
    with_offers(f", {_CLEAN_KEPT} select count(*) as new_offers, count(*) > 0 as score from kept", recursive=True),
)
def run_gate(t: Tables) -> DataFrame:
    """The count that decides whether a run scores, as the admission reports it."""
    new = admission.admit(_clean_candidates(t))
    counted = new.offers.agg(F.count(F.lit(1)).alias("new_offers"))
    return counted.withColumn("score", F.lit(new.count > 0))


@query(
    "run_summary",
    with_offers(
        f""", {_CLEAN_KEPT} select cast(7 as bigint) as version, '2024-03-05 14:07:00' as run_at, (select count(*) from kept) as new_offers,
  (select count(*) from offers_fx where score >= 0) as scored_offers, 'offres_20240305_1407.txt' as report_path, 'offres' as export_path""",
        recursive=True,
    ),
)
def run_summary(t: Tables) -> DataFrame:
    as_of = datetime(2024, 3, 5, 14, 7)
    new = admission.admit(_clean_candidates(t)).offers
    return exports.run_summary(
        new, offers(t).select("score"), 7, F.lit(f"{as_of:%Y-%m-%d %H:%M:%S}"), exports.report_name(as_of), "offres"
    )


# --- state ------------------------------------------------------------------------------------

# Orders are offers; urgent ones were deleted at version 15, and those still open were
# collected again at 20. Line items are scores and status changes of all versions.
_DUCK_STATE = """inserted as (
  select 'adzuna_fr_' || o_orderkey as id, o_orderpriority as intitule, 10 as version from orders
  union all select 'adzuna_fr_' || o_orderkey, o_orderpriority, 20 from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'O'),
dropped as (select 'adzuna_fr_' || o_orderkey as id, 15 as version from orders where o_orderpriority = '1-URGENT'),
scored as (select 'adzuna_fr_' || l_orderkey as id, max(l_quantity)::int * 2 - 1 as score, 9 + l_linenumber * 2 as version from lineitem group by l_orderkey, l_linenumber),
moved as (select 'adzuna_fr_' || l_orderkey as id, case max(l_returnflag) when 'R' then 'Refusé' when 'N' then 'Entretien' else 'Postulé' end as statut, 8 + l_linenumber * 2 as version
  from lineitem group by l_orderkey, l_linenumber)"""


def _state(t: Tables) -> DataFrame:
    key = F.concat(F.lit("adzuna_fr_"), F.col("o_orderkey").cast("string"))
    line_key = F.concat(F.lit("adzuna_fr_"), F.col("l_orderkey").cast("string"))
    orders = t["orders"].select(key.alias("id"), F.col("o_orderpriority").alias("intitule"), "o_orderstatus")
    urgent = orders.where(F.col("intitule") == "1-URGENT")
    again = urgent.where(F.col("o_orderstatus") == "O")
    inserted = orders.withColumn("version", F.lit(10)).unionByName(again.withColumn("version", F.lit(20)))
    lines = t["lineitem"]
    scores = lines.groupBy(line_key.alias("id"), "l_linenumber").agg(F.max("l_quantity").alias("q")).select(
        "id",
        (F.col("q").cast("int") * 2 - 1).alias("score"),
        F.lit("x").alias("score_explication"),
        F.lit("[]").alias("score_points_forts"),
        F.lit("[]").alias("score_points_faibles"),
        F.lit(None).cast("timestamp").alias("score_date"),
        (F.col("l_linenumber") * 2 + 9).alias("version"),
    )
    moves = (
        lines.groupBy(line_key.alias("id"), "l_linenumber")
        .agg(F.max("l_returnflag").alias("flag"))
        .select(
            "id",
            F.when(F.col("flag") == "R", "Refusé").when(F.col("flag") == "N", "Entretien").otherwise("Postulé").alias("statut"),
            (F.col("l_linenumber") * 2 + 8).alias("version"),
        )
    )
    tombstones = urgent.select("id", F.lit(15).alias("version"))
    return store.current_offers(inserted.drop("o_orderstatus"), scores, moves, tombstones)


@query(
    "current_offers",
    f"""with {_DUCK_STATE},
living as (select i.* from inserted i where not exists (select 1 from dropped d where d.id = i.id and d.version >= i.version))
select l.id, l.intitule, l.version,
  (select arg_max(s.score, s.version) from scored s where s.id = l.id and s.version > l.version) as score,
  coalesce((select arg_max(m.statut, m.version) from moved m where m.id = l.id and m.version > l.version), 'À postuler') as statut
from living l""",
)
def current_offers(t: Tables) -> DataFrame:
    return _state(t).select("id", "intitule", "version", "score", "statut")


@query(
    "schema_evolve",
    """select c_custkey as id, c_name as intitule, case when c_acctbal < 2000 or c_custkey % 5 = 0 then 'À postuler' else c_mktsegment end as statut from customer""",
)
def schema_evolve(t: Tables) -> DataFrame:
    """Rows of two generations: the older ones have no status column at all."""
    c = t["customer"].select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("intitule"), "c_acctbal",
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("statut"),
    )
    old = c.where(F.col("c_acctbal") < 2000).drop("statut", "c_acctbal")
    new = c.where(F.col("c_acctbal") >= 2000).drop("c_acctbal")
    return store.with_status_column(new.unionByName(old, allowMissingColumns=True))


# --- metrics -------------------------------------------------------------------------------------


@query(
    "dash_metrics",
    with_offers("""select count(*) as total, sum(case when score >= 85 then 1 else 0 end)::bigint as prioritaires,
  sum(case when statut = 'Postulé' then 1 else 0 end)::bigint as postulees, sum(score)::double / count(*) as score_moyen from offers_fx where score >= 0"""),
)
def dash_metrics(t: Tables) -> DataFrame:
    return metrics.dashboard_metrics(offers(t))


@query("table_count", with_offers("select count(*) as total from offers_fx"))
def table_count(t: Tables) -> DataFrame:
    return metrics.row_count(offers(t))


@query("score_outcome", with_offers("select count(*) filter (score >= 0) as ok, count(*) filter (score = -1) as failed from offers_fx"))
def score_outcome(t: Tables) -> DataFrame:
    return metrics.score_outcome(offers(t))


@query(
    "slug_collisions",
    """with o as (select distinct 'indeed_' || left(md5('https://indeed/' || l_orderkey || '/' || l_partkey), 12) as id from lineitem)
select left(id, 12) as slug, count(*) as offers from o group by 1 having count(*) > 1""",
)
def slug_collisions(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://indeed/"), F.col("l_orderkey"), F.lit("/"), F.col("l_partkey"))
    o = t["lineitem"].select(ids.id_from_url(F.lit("indeed"), url).alias("id")).distinct()
    return metrics.slug_collisions(o)


# --- order ---------------------------------------------------------------------------------------


@query(
    "score_rank",
    """with o as (select l_orderkey || '-' || l_linenumber as id, max(l_quantity)::int * 2 as score from lineitem group by l_orderkey, l_linenumber)
select id, score, row_number() over (order by score desc, id) as rank from o""",
)
def score_rank(t: Tables) -> DataFrame:
    offer_id = F.concat("l_orderkey", F.lit("-"), "l_linenumber")
    o = t["lineitem"].groupBy(offer_id.alias("id")).agg((F.max("l_quantity").cast("int") * 2).alias("score"))
    return ranking.rank_by_score(o)


@query(
    "score_queue",
    with_offers("select seq, id, cast(collected_at as varchar) as collected_at from offers_fx where score is null order by offers_fx.collected_at desc, id limit 20"),
)
def score_queue(t: Tables) -> DataFrame:
    queue = ranking.scoring_queue(filters.to_score(offers(t)).select("seq", "id", "collected_at"))
    return queue.withColumn("collected_at", F.col("collected_at").cast("string"))


@query(
    "report_blocks",
    with_offers("""select rank, repeat('─', 70) || chr(10) || '  #' || rank || '  [' || score || '/100] '
  || case when score >= 80 then '★★★  PRIORITAIRE' when score >= 60 then '★★☆  À CONSIDÉRER' else '★☆☆  FAIBLE' end || chr(10) || repeat('─', 70) || chr(10)
  || '  ID         : ' || key || chr(10) || '  Poste      : ' || coalesce(nullif(intitule, ''), 'N/A') || chr(10)
  || '  Entreprise : ' || coalesce(nullif(entreprise_nom, ''), 'N/A') || chr(10) || '  Lieu       : ' || coalesce(nullif(lieu_travail, ''), 'N/A') || chr(10)
  || '  Contrat    : ' || coalesce(nullif(type_contrat, ''), 'N/A') || chr(10) || '  Salaire    : ' || coalesce(nullif(salaire_libelle, ''), 'Non précisé') || chr(10)
  || '  Lien       : ' || coalesce(nullif(url, ''), 'N/A') || chr(10) || chr(10)
  || case when seq % 4 > 1 then '  ANALYSE :' || chr(10) || '  Analyse ' || entreprise_nom || chr(10) || chr(10) else '' end
  || case when seq % 5 = 3 then '  POINTS FORTS :' || chr(10) || '    + ' || lieu_travail || chr(10) || '    + ' || entreprise_nom || ' é' || chr(10) || chr(10) else '' end
  || case when seq % 3 = 0 then '  POINTS FAIBLES :' || chr(10) || '    - ' || entreprise_nom || chr(10) || chr(10) else '' end as block
  from (select *, row_number() over (order by score desc, key) as rank from (select *, id || '_' || lpad(seq::varchar, 12, '0') as key from stored_fx where score >= 0))"""),
)
def report_blocks(t: Tables) -> DataFrame:
    # Ids of the derived offers repeat on purpose; a report has one row per id.
    unique = F.concat("id", F.lit("_"), F.lpad(F.col("seq").cast("string"), 12, "0"))
    return exports.report_blocks(stored_offers(t).withColumn("id", unique))


# --- streaming -------------------------------------------------------------------------------------


@query(
    "stream_ingest",
    with_offers(f", {_CLEAN_KEPT} select id, url, intitule, statut from (select o.id, o.url, o.intitule, 'À postuler' as statut from kept join offers_fx o using (seq))", recursive=True),
)
def stream_ingest(t: Tables) -> DataFrame:
    """The documents as a file stream, through the stream's own store, to its current offers."""
    # A file stream reads folders; as a pattern, the name stands for a table of one file as well as for a folder of many.
    landed = t.spark.readStream.schema(t["documents"].schema).parquet(f"{t.folder}/documents.parque[t]")

    def to_candidates(batch: DataFrame) -> DataFrame:
        return _as_stored(batch.sparkSession.sql(SPARK_OFFERS, documents=batch))

    state = store.OfferStore(t.spark, new_path(t.spark, "stream-store"))
    ingest_stream(landed, to_candidates, state, TERMS, new_path(t.spark, "stream-progress"), "documents").awaitTermination()
    return state.current().select("id", "url", "intitule", "statut")


_PARTS = 4


@query(
    "stream_stateful",
    with_offers(
        f""", {duck_admit(f"select seq + (seq % {_PARTS}) * {_LATER} as seq, id, url from offers_fx where url <> '' and {DUCK_CLEAN}")}
  select o.id, o.url, o.intitule, 'À postuler' as statut from kept k join offers_fx o on o.seq = k.seq % {_LATER}""",
        recursive=True,
    ),
)
def stream_stateful(t: Tables) -> DataFrame:
    """The documents in four parts of many files, each collected as one batch by a query that starts where the last one stopped."""
    folder = new_path(t.spark, "stream-parts")
    state = store.OfferStore(t.spark, new_path(t.spark, "stateful-store"))
    progress = new_path(t.spark, "stateful-progress")
    schema = t["documents"].schema

    def landed() -> DataFrame:
        return t.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)

    def to_candidates(rows: DataFrame) -> DataFrame:
        return _as_stored(rows.sparkSession.sql(SPARK_OFFERS, documents=rows))

    for part in range(_PARTS):
        t["documents"].where(F.col("doc_id") % _PARTS == part).write.parquet(f"{folder}/part{part}")
        catch_up(ingest_stateful(landed(), to_candidates, state, TERMS, progress, "documents"))
    return state.current().select("id", "url", "intitule", "statut")
