"""Queries: derived columns and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.catalog.fixture import DUCK_CLEAN, TERMS, duck_salary, offers, stored_offers, with_offers
from vacantia.catalog.registry import Tables, query
from vacantia.functions import ids, labels, markup, text
from vacantia.operators import filters, ranking, views

# --- filters ------------------------------------------------------------------------------


@query("deal_breakers", with_offers(f"select seq, id from offers_fx where {DUCK_CLEAN}"))
def deal_breakers(t: Tables) -> DataFrame:
    return filters.without_forbidden_terms(offers(t), TERMS).select("seq", "id")


@query("nonempty_url", with_offers("select seq, url from offers_fx where length(url) > 0"))
def nonempty_url(t: Tables) -> DataFrame:
    return filters.with_url(offers(t)).select("seq", "url")


@query("scored_only", with_offers("select seq, score from offers_fx where score is not null and score >= 0"))
def scored_only(t: Tables) -> DataFrame:
    return filters.scored(offers(t)).select("seq", "score")


@query("to_score", with_offers("select seq, left(intitule, 50) as short_title from offers_fx where score is null"))
def to_score(t: Tables) -> DataFrame:
    return filters.to_score(offers(t)).select("seq", F.substring("intitule", 1, 50).alias("short_title"))


@query("to_rescore", with_offers("select seq, score from offers_fx where score is null or score = -1"))
def to_rescore(t: Tables) -> DataFrame:
    return filters.to_score(offers(t), retry_failed=True).select("seq", "score")


_DASH = """
select seq, id, score from (
  select *, case when lower(url) like '%adzuna%' then 'Adzuna' when lower(url) like '%apec%' then 'APEC'
                 when lower(url) like '%indeed%' then 'Indeed' else 'N/A' end as origin,
         case when type_contrat is null or trim(type_contrat) = '' then 'N/A' else trim(type_contrat) end as contract
  from offers_fx where score >= 0)
where score >= 60 and origin in ('Adzuna', 'Indeed', 'APEC') and contract in ('CDI', 'CDD', 'Freelance', 'N/A')
  and coalesce(statut, 'À postuler') in ('À postuler', 'Postulé', 'Refusé', 'Entretien')
"""


@query("dash_filter", with_offers(_DASH))
def dash_filter(t: Tables) -> DataFrame:
    return filters.dashboard_filter(offers(t)).select("seq", "id", "score")


@query("dash_filter_count", with_offers(f"select count(*) as results from ({_DASH})"))
def dash_filter_count(t: Tables) -> DataFrame:
    return filters.dashboard_filter(offers(t)).agg(F.count(F.lit(1)).alias("results"))


@query("offer_by_id", with_offers("select seq, id, intitule, url from offers_fx where id = 'apec_5'"))
def offer_by_id(t: Tables) -> DataFrame:
    return filters.by_id(offers(t), "apec_5").select("seq", "id", "intitule", "url")


@query("scan_offers", with_offers("select * replace (cast(collected_at as varchar) as collected_at) from stored_fx"))
def scan_offers(t: Tables) -> DataFrame:
    return stored_offers(t).withColumn("collected_at", F.col("collected_at").cast("string"))


# --- derived columns -----------------------------------------------------------------------


@query(
    "salary_label",
    f"""with s as (
  select o_orderkey as seq, case o_orderkey % 4 when 0 then null when 1 then 0.0 else o_totalprice end as low,
         case o_custkey % 3 when 0 then null when 1 then 0.0 else o_totalprice * 1.37 end as high,
         case when o_orderstatus = 'O' then 'gb' else 'fr' end as pays from orders)
select seq, {duck_salary('low', 'high')} as label from s""",
)
def salary_label(t: Tables) -> DataFrame:
    s = t.sql(
        """select o_orderkey as seq, case o_orderkey % 4 when 0 then null when 1 then 0.0D else o_totalprice end as low,
         case o_custkey % 3 when 0 then null when 1 then 0.0D else o_totalprice * 1.37D end as high,
         case when o_orderstatus = 'O' then 'gb' else 'fr' end as pays from {orders}""",
        orders=t["orders"],
    )
    return s.select("seq", labels.salary_label(s.low, s.high, s.pays).alias("label"))


@query(
    "contract_type",
    with_offers("""select seq, case contract_type when 'permanent' then (case pays when 'fr' then 'CDI' else 'Permanent' end)
  when 'contract' then 'CDD/Contrat' else coalesce(case contract_time when 'full_time' then 'Temps plein'
  when 'part_time' then 'Temps partiel' end, '') end as contrat from offers_fx"""),
)
def contract_type(t: Tables) -> DataFrame:
    o = offers(t)
    return o.select("seq", labels.contract_label(o.contract_time, o.contract_type, o.pays).alias("contrat"))


@query("offer_id_a", with_offers("select seq, 'adzuna_' || pays || '_' || seq as offer_id from offers_fx"))
def offer_id_a(t: Tables) -> DataFrame:
    o = offers(t)
    return o.select("seq", ids.id_from_raw(o.pays, o.seq.cast("string")).alias("offer_id"))


@query("offer_id_md5", with_offers("select seq, lieu_travail || '_' || left(md5(description), 12) as offer_id from offers_fx"))
def offer_id_md5(t: Tables) -> DataFrame:
    """The id rule on whole texts in place of URLs, so that non-ASCII input is covered."""
    o = offers(t)
    return o.select("seq", ids.id_from_url(o.lieu_travail, o.description).alias("offer_id"))


@query("source_dash", with_offers("""select seq, case when url ilike '%adzuna%' then 'Adzuna' when url ilike '%apec%' then 'APEC'
  when url ilike '%indeed%' then 'Indeed' else 'N/A' end as origin from offers_fx"""))
def source_dash(t: Tables) -> DataFrame:
    o = offers(t)
    return o.select("seq", labels.source_dashboard(o.url).alias("origin"))


@query("source_export", with_offers("""select seq, case when url like '%adzuna%' then 'Adzuna' when url like '%apec%' then 'APEC'
  when url like '%indeed%' then 'Indeed' else '—' end as origin from offers_fx"""))
def source_export(t: Tables) -> DataFrame:
    o = offers(t)
    return o.select("seq", labels.source_export(o.url).alias("origin"))


def _by_score(alias: str, high: int, names: tuple[str, str, str]) -> str:
    top, middle, low = names
    return with_offers(
        f"select seq, case when score >= {high} then '{top}' when score >= 60 then '{middle}' else '{low}' end as {alias} "
        "from offers_fx where score >= 0"
    )


@query("priority_dash", _by_score("priorite", 85, ("★★★ PRIORITAIRE", "★★ À CONSIDÉRER", "★ FAIBLE")))
def priority_dash(t: Tables) -> DataFrame:
    o = filters.scored(offers(t))
    return o.select("seq", labels.priority_dashboard(o.score).alias("priorite"))


@query("priority_export", _by_score("priorite", 85, ("★★★ PRIORITAIRE", "★★☆ À CONSIDÉRER", "★☆☆ FAIBLE")))
def priority_export(t: Tables) -> DataFrame:
    o = filters.scored(offers(t))
    return o.select("seq", labels.priority_export(o.score).alias("priorite"))


@query("priority_report", _by_score("priorite", 80, ("★★★  PRIORITAIRE", "★★☆  À CONSIDÉRER", "★☆☆  FAIBLE")))
def priority_report(t: Tables) -> DataFrame:
    o = filters.scored(offers(t))
    return o.select("seq", labels.priority_report(o.score).alias("priorite"))


@query("color_class", _by_score("couleur", 85, ("color: #1a6b3a", "color: #7a4f00", "color: #666666")))
def color_class(t: Tables) -> DataFrame:
    o = filters.scored(offers(t))
    return o.select("seq", labels.text_colour(o.score).alias("couleur"))


@query("band5", with_offers("""select seq, case when score < 30 then '0-29' when score < 50 then '30-49' when score < 70 then '50-69'
  when score < 90 then '70-89' else '90-100' end as band from offers_fx where score >= 0"""))
def band5(t: Tables) -> DataFrame:
    o = filters.scored(offers(t))
    return o.select("seq", labels.band(o.score).alias("band"))


_PADDED = "case cast(seq%3 as int) when 0 then ' ' || type_contrat || chr(160) when 1 then type_contrat else chr(9) || type_contrat || chr(10) end"


@query(
    "contract_norm",
    with_offers(f"select seq, coalesce(nullif(trim({_PADDED}, ' ' || chr(160) || chr(9) || chr(10)), ''), 'N/A') as contrat from offers_fx"),
)
def contract_norm(t: Tables) -> DataFrame:
    o = offers(t)
    pad = F.when(o.seq % 3 == 0, F.concat(F.lit(" "), o.type_contrat, F.lit(" "))).when(o.seq % 3 == 1, o.type_contrat)
    padded = F.coalesce(pad, F.when(o.seq % 3 == 2, F.concat(F.lit("\t"), o.type_contrat, F.lit("\n"))))
    return o.select("seq", labels.contract_filter_value(padded).alias("contrat"))


@query(
    "status_default",
    with_offers("""select seq, coalesce(statut, 'À postuler') as statut,
  case when x in ('Postulé', 'Refusé', 'Entretien') then x else 'À postuler' end as shown
  from (select seq, statut, case when seq % 11 = 0 then 'Archivé' else statut end as x from offers_fx)"""),
)
def status_default(t: Tables) -> DataFrame:
    o = offers(t)
    stored = F.when(o.seq % 11 == 0, "Archivé").otherwise(o.statut)
    return o.select("seq", labels.status_or_default(o.statut).alias("statut"), labels.status_in_detail(stored).alias("shown"))


@query(
    "dash_table",
    with_offers("""select score as "Score", case when score >= 85 then '★★★ PRIORITAIRE' when score >= 60 then '★★ À CONSIDÉRER' else '★ FAIBLE' end as "Priorité",
  intitule as "Poste", entreprise_nom as "Entreprise", lieu_travail as "Lieu", type_contrat as "Contrat", salaire_libelle as "Salaire",
  case when url ilike '%adzuna%' then 'Adzuna' when url ilike '%apec%' then 'APEC' when url ilike '%indeed%' then 'Indeed' else 'N/A' end as "Source",
  coalesce(statut, 'À postuler') as "Statut", url as "URL",
  case when score >= 85 then 'color: #1a6b3a' when score >= 60 then 'color: #7a4f00' else 'color: #666666' end as couleur
  from stored_fx where score >= 0"""),
)
def dash_table(t: Tables) -> DataFrame:
    return views.dashboard_table(filters.scored(stored_offers(t)))


@query(
    "export_table",
    with_offers("""select score as "Score", case when score >= 85 then '★★★ PRIORITAIRE' when score >= 60 then '★★☆ À CONSIDÉRER' else '★☆☆ FAIBLE' end as "Priorité",
  intitule as "Poste", entreprise_nom as "Entreprise", lieu_travail as "Lieu", coalesce(type_contrat, '') as "Contrat", salaire_libelle as "Salaire",
  case when url like '%adzuna%' then 'Adzuna' when url like '%apec%' then 'APEC' when url like '%indeed%' then 'Indeed' else '—' end as "Source",
  coalesce(score_explication, '') as "Analyse", coalesce(score_points_forts, '') as "Points forts", coalesce(score_points_faibles, '') as "Points faibles",
  url as "URL", case when score >= 85 then 'C6EFCE' when score >= 60 then 'FFEB9C' else 'F2F2F2' end as remplissage
  from stored_fx where score >= 0"""),
)
def export_table(t: Tables) -> DataFrame:
    return views.export_table(ranking.best_first(filters.scored(stored_offers(t))))


@query(
    "points_rows",
    with_offers("""select id, seq, 'fort' as kind, n as point_no, p as point from
    (select id, seq, unnest([lieu_travail, entreprise_nom || ' é']) as p, unnest([0, 1]) as n from offers_fx where seq % 5 = 3)
  union all select id, seq, 'faible', 0, entreprise_nom from offers_fx where seq % 3 = 0"""),
)
def points_rows(t: Tables) -> DataFrame:
    o = offers(t).withColumn("seq_id", F.concat_ws("|", "seq", "id"))
    rows = views.point_rows(o.withColumn("id", o.seq_id))
    parts = F.split("id", r"\|")
    return rows.select(parts[1].alias("id"), parts[0].cast("bigint").alias("seq"), "kind", "point_no", "point")


# --- texts ----------------------------------------------------------------------------------


@query("doc_lines", "select page_id, len(string_split(html, chr(10))) as lines from pages")
def doc_lines(t: Tables) -> DataFrame:
    p = t["pages"]
    return p.select("page_id", text.line_count(p.html).cast("bigint").alias("lines"))


_FENCED_DUCK = """case cast(page_id % 6 as int) when 0 then html when 1 then '```html' || chr(10) || html || chr(10) || '```'
  when 2 then '```' || chr(10) || html || '```  ' when 3 then '  ```html   ' || html || chr(10) || '``` ' || chr(10)
  when 4 then 'Voici : ```html' || chr(10) || html when 5 then '```HTML' || chr(10) || html || chr(10) || '```' end"""


@query(
    "strip_fence",
    f"""with a as (select page_id, trim({_FENCED_DUCK}, ' ' || chr(9) || chr(10) || chr(13)) as x from pages),
b as (select page_id, trim(case when starts_with(x, '```html') then x[8:] when starts_with(x, '```') then x[4:] else x end, ' ' || chr(9) || chr(10) || chr(13)) as x from a),
c as (select page_id, case when ends_with(x, '```') then x[:len(x)-3] else x end as x from b)
select page_id, trim(x, ' ' || chr(9) || chr(10) || chr(13)) as html from c""",
)
def strip_fence(t: Tables) -> DataFrame:
    p = t["pages"]
    rest = p.page_id % 6
    fenced = (
        F.when(rest == 0, p.html)
        .when(rest == 1, F.concat(F.lit("```html\n"), p.html, F.lit("\n```")))
        .when(rest == 2, F.concat(F.lit("```\n"), p.html, F.lit("```  ")))
        .when(rest == 3, F.concat(F.lit("  ```html   "), p.html, F.lit("\n``` \n")))
        .when(rest == 4, F.concat(F.lit("Voici : ```html\n"), p.html))
        .otherwise(F.concat(F.lit("```HTML\n"), p.html, F.lit("\n```")))
    )
    return p.select("page_id", markup.strip_fence(fenced).alias("html"))


@query(
    "artifact_slug",
    with_offers("""select seq, left(case when x like 'adzuna_%' then substr(x, 8) else x end, 12) as slug from
  (select seq, case when seq % 2 = 0 then 'adzuna_' || pays || '_' || (seq * 7919) else lieu_travail || '_' || left(md5(description), 12) end as x from offers_fx)"""),
)
def artifact_slug(t: Tables) -> DataFrame:
    o = offers(t)
    offer_id = F.when(o.seq % 2 == 0, ids.id_from_raw(o.pays, (o.seq * 7919).cast("string"))).otherwise(
        ids.id_from_url(o.lieu_travail, o.description)
    )
    return o.select("seq", ids.artifact_slug(offer_id).alias("slug"))
