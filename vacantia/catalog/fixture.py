"""Offers derived from the ``documents`` table, in both SQL dialects.

They hold id conflicts, URL conflicts and chains of both, empty URLs, null, failed and real
scores, null statuses and upper-case hosts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from vacantia.catalog.registry import Tables
from vacantia.functions.labels import salary_label

# Forbidden terms: the first occurs in the English prose, the second in the French.
TERMS = ["reti", "éauç"]

_COLUMNS = """
  doc_id as seq,
  concat(case cast(doc_id%4 as int) when 0 then 'adzuna' when 1 then 'apec' when 2 then 'indeed' else 'other' end,
         '_', cast(doc_id - doc_id%24 + doc_id%12 as string)) as id,
  text as intitule, text as description, source as entreprise_nom, lang as lieu_travail,
  case lang when 'en' then 'gb' else lang end as pays,
  case cast(doc_id%5 as int) when 0 then 'CDI' when 1 then 'CDD/Contrat' when 2 then '' when 3 then 'Temps plein' else null end as type_contrat,
  case cast(doc_id%3 as int) when 0 then 'full_time' when 1 then 'part_time' else null end as contract_time,
  case cast(doc_id%5 as int) when 0 then 'permanent' when 1 then 'contract' else null end as contract_type,
  case when doc_id%3=0 then null else cast(n_chars as double)*10.5 end as salary_min,
  case when doc_id%2=0 then null else cast(n_chars as double)*14.25 end as salary_max,
  case when doc_id%50=49 then '' else concat('https://www.',
       case cast(doc_id%4 as int) when 0 then 'Adzuna.fr' when 1 then 'apec.fr' when 2 then 'indeed.com' else 'x.org' end,
       '/j/', cast(doc_id - doc_id%8 + doc_id%4 as string)) end as url,
  case when doc_id%6=0 then null when doc_id%17=0 then -1 else cast((doc_id*37)%101 as int) end as score,
  case cast(doc_id%7 as int) when 0 then 'Postulé' when 1 then 'Refusé' when 2 then 'Entretien' when 3 then null else 'À postuler' end as statut,
  case cast(doc_id%4 as int) when 0 then null when 1 then '' else concat('Analyse ', source) end as score_explication,
  case cast(doc_id%5 as int) when 0 then null when 1 then '' when 2 then '[]'
       when 3 then concat('["', lang, '","', source, ' é"]') else 'pas du json' end as score_points_forts,
  case when doc_id%3=0 then concat('["', source, '"]') else null end as score_points_faibles,
"""

SPARK_OFFERS = (
    "select"
    + _COLUMNS
    + "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0,0,0,doc_id%977) as collected_at from {documents}"
)
DUCK_OFFERS = (
    "offers_fx as (select"
    + _COLUMNS
    + "timestamp '2024-01-01 00:00:00' + to_seconds(doc_id%977) as collected_at from documents)"
)


def duck_salary(low: str = "salary_min", high: str = "salary_max", country: str = "pays") -> str:
    def grouped(value: str) -> str:
        return f"replace(format('{{:,}}', cast(trunc({value}) as bigint)), ',', ' ')"

    unit = f"case when {country} = 'gb' then ' £/an' else ' €/an' end"
    return (
        f"case when coalesce({low}, 0) = 0 then '' "
        f"when coalesce({high}, 0) = 0 then 'À partir de ' || {grouped(low)} || {unit} "
        f"else {grouped(low)} || ' – ' || {grouped(high)} || {unit} end"
    )


def with_offers(body: str, recursive: bool = False) -> str:
    """DuckDB text: the derived offers, with their salary label, before ``body``."""
    stored = f"stored_fx as (select *, {duck_salary()} as salaire_libelle from offers_fx)"
    return f"with {'recursive ' if recursive else ''}{DUCK_OFFERS}, {stored} {body}"


def offers(t: Tables) -> DataFrame:
    return t.sql(SPARK_OFFERS, documents=t["documents"])


def stored_offers(t: Tables) -> DataFrame:
    df = offers(t)
    return df.withColumn("salaire_libelle", salary_label(df["salary_min"], df["salary_max"], df["pays"]))


def duck_admit(source: str, name: str = "kept") -> str:
    """DuckDB text of CTEs that walk ``source`` (seq, id, url) row by row.

    This is the insert-or-ignore rule itself, carried as two lists by a recursive query,
    and shares nothing with the rounds of the operator.
    """
    return f"""
ordered_{name} as materialized (select row_number() over (order by seq) as rn, seq, id, url from ({source})),
walk_{name} as (
  select cast(0 as bigint) as rn, cast([] as varchar[]) as ids, cast([] as varchar[]) as urls, cast(null as bigint) as seq
  union all
  select x.rn, case when x.ok then list_append(x.ids, x.id) else x.ids end,
         case when x.ok then list_append(x.urls, x.url) else x.urls end, case when x.ok then x.seq end
  from (select o.rn, o.seq, o.id, o.url, g.ids, g.urls,
               not list_contains(g.ids, o.id) and not list_contains(g.urls, o.url) as ok
        from walk_{name} g join ordered_{name} o on o.rn = g.rn + 1) x
),
{name} as (select seq from walk_{name} where seq is not null)"""


DUCK_CLEAN = "not contains(lower(intitule || ' ' || description), 'reti') and not contains(lower(intitule || ' ' || description), 'éauç')"
