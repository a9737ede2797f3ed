"""Queries: search plans and source readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.catalog.fixture import duck_salary
from vacantia.catalog.registry import Tables, query
from vacantia.operators import metrics
from vacantia.schemas import RAW_A
from vacantia.sources import pages, readers, requests

# --- search plans -------------------------------------------------------------------------

_TARGETS = """select c_custkey as target_no, lower(substring(c_mktsegment, 1, 2)) as pays, c_mktsegment as localisation,
  case cast(c_custkey % 6 as int) when 0 then null when 1 then concat('"', c_name, '"')
    when 2 then concat('["', c_name, '", "', c_mktsegment, ' é"]') when 3 then '[]' when 4 then '""'
    else concat('["', c_mktsegment, '"]') end as mots_cles"""
_DUCK_PLAN = """plan as (
  select c_custkey as target_no, lower(left(c_mktsegment, 2)) as pays, c_mktsegment as localisation,
    unnest(case when c_custkey % 6 = 1 then [c_name] when c_custkey % 6 = 2 then [c_name, c_mktsegment || ' é']
      when c_custkey % 6 = 5 then [c_mktsegment] else ['Ingénieur IA'] end) as mot_cle,
    unnest(case when c_custkey % 6 = 2 then [0, 1] else [0] end) as keyword_no, c_acctbal
  from customer)"""


def _plan(t: Tables, extra: str = "") -> DataFrame:
    targets = t.sql(f"{_TARGETS}{extra} from {{customer}}", customer=t["customer"])
    return requests.search_plan(targets, "Ingénieur IA")


@query("search_plan", f"with {_DUCK_PLAN} select target_no, pays, localisation, mot_cle, keyword_no from plan")
def search_plan(t: Tables) -> DataFrame:
    return _plan(t)


@query(
    "request_plan",
    f"""with {_DUCK_PLAN}
select target_no, pays, keyword_no, mot_cle as what, localisation as "where",
  case when target_no % 120 > 50 then 50 else target_no % 120 end as results_per_page,
  case when target_no % 3 = 2 then 25.0::double end as distance, case when c_acctbal <> 0 and target_no % 4 > 0 then c_acctbal end as salary_min
from plan where target_no % 120 > 0""",
)
def request_plan(t: Tables) -> DataFrame:
    plan = _plan(t, ", c_acctbal")
    number = F.col("target_no")
    asked = requests.request_plan(
        plan,
        number % 120,
        F.when(number % 3 == 1, 0.0).when(number % 3 == 2, 25.0),
        F.when(number % 4 > 0, F.col("c_acctbal")).otherwise(0.0),
    )
    return asked.select("target_no", "pays", "keyword_no", "what", "where", "results_per_page", "distance", "salary_min")


@query(
    "apec_urls",
    """select doc_id, 'https://www.apec.fr/candidat/recherche-emploi.html/emploi?motsCles=' || replace(url_encode(text), '%2F', '/')
  || '&typesConvention=143684&typesConvention=143685&typesConvention=143686&typesConvention=143687'
  || case cast(doc_id % 5 as int) when 3 then '&lieu=%C3%8Ele-de-France%20/%2075%2B%2A~' when 4 then '&lieu=' || url_encode(source) else '' end as url
from documents""",
)
def apec_urls(t: Tables) -> DataFrame:
    d = t["documents"]
    place = (
        F.when(d.doc_id % 5 == 0, "").when(d.doc_id % 5 == 1, "France").when(d.doc_id % 5 == 3, "Île-de-France / 75+*~")
        .when(d.doc_id % 5 == 4, d.source)
    )
    return d.select("doc_id", requests.apec_search_url(d.text, place).alias("url"))


# --- source A -------------------------------------------------------------------------------

_MAX = 60
_DUCK_PAGES = """pages_in as (
  select l_orderkey as request_no, row_number() over (partition by l_orderkey order by l_linenumber) as page, cast(max(l_quantity) as int) as quantity,
         max(l_discount) as discount, max(l_tax) as tax from lineitem group by l_orderkey, l_linenumber),
sized as (select request_no, page, case when tax >= 0.08 and quantity % 2 = 0 then 500 else 200 end as status,
  case when discount <= 0.0 then 0 when quantity >= 15 then 50 else quantity end as size from pages_in),
first_bad as (select request_no, min(page) as page from sized where status <> 200 or size = 0 group by 1),
first_short as (select request_no, min(page) as page from sized where size < 50 group by 1),
accepted as (select s.* from sized s left join first_bad b using (request_no) left join first_short f using (request_no)
  where s.page < coalesce(b.page, 99) and s.page <= coalesce(f.page, 99) and (s.request_no % 5 > 0 or s.page < 2)),
items as (select request_no, page, unnest(range(1, size + 1)) as n from accepted),
placed as (select request_no, page, n, row_number() over (partition by request_no order by page, n) as place from items)"""


def _pages(t: Tables) -> DataFrame:
    """Landed pages: every fifth request lacks its second page, and of every third some pages are landed twice or three times,
    as a failed copy, as a short one and as they are."""
    first = _landed_once(t)
    gap = F.when((F.col("request_no") % 5 == 0) & (F.col("page") >= 2), F.col("page") + 1).otherwise(F.col("page"))
    first = first.withColumn("page", gap)
    copies = F.when(F.col("request_no") % 3 != 0, F.array(F.lit("first"))).when(F.col("page") % 2 == 1, F.array(*map(F.lit, ("first", "failed", "again"))))
    copied = first.withColumn("copy", F.explode(F.coalesce(copies, F.array(*map(F.lit, ("first", "failed"))))))
    failed = F.col("copy") == "failed"
    return copied.withColumns(
        {"status": F.when(failed, 500).otherwise(F.col("status")), "results": F.when(failed, F.slice("results", 1, 1)).otherwise(F.col("results"))}
    ).drop("copy")


def _landed_once(t: Tables) -> DataFrame:
    return t.sql(
        """select request_no, page, case when tax >= 0.08D and quantity % 2 = 0 then 500 else 200 end as status,
  case when discount <= 0.0D then array() else transform(sequence(1, case when quantity >= 15 then 50 else quantity end),
    n -> named_struct('id', concat(request_no, '-', page, '-', n))) end as results
from (select l_orderkey as request_no, row_number() over (partition by l_orderkey order by l_linenumber) as page,
             cast(max(l_quantity) as int) as quantity, max(l_discount) as discount, max(l_tax) as tax
      from {lineitem} group by l_orderkey, l_linenumber)""",
        lineitem=t["lineitem"],
    )


@query(
    "page_ingest",
    f"""with {_DUCK_PAGES} select request_no, page, status_ok, place - 1 as position, request_no || '-' || page || '-' || n as offer_id
from (select *, true as status_ok from placed) where place <= {_MAX}""",
)
def page_ingest(t: Tables) -> DataFrame:
    kept = pages.ingest_pages(_pages(t), _MAX)
    return kept.select(
        "request_no", "page", (F.col("status") == 200).alias("status_ok"),
        F.col("position").cast("bigint").alias("position"), F.col("offer.id").alias("offer_id"),
    )


# JSON of source A offers, with missing and null objects.
_RAW_A = """select doc_id as seq, case lang when 'en' then 'gb' else lang end as pays, to_json(named_struct(
  'id', cast(doc_id as string), 'title', case when doc_id % 9 = 0 then null else concat(source, ' ', lang) end, 'description', text,
  'company', case when doc_id % 4 = 0 then null else named_struct('display_name', case when doc_id % 4 = 1 then null else source end) end,
  'location', case when doc_id % 3 = 0 then null else named_struct('display_name', lang) end,
  'contract_time', case cast(doc_id % 3 as int) when 0 then 'full_time' when 1 then 'part_time' end,
  'contract_type', case cast(doc_id % 5 as int) when 0 then 'permanent' when 1 then 'contract' end,
  'salary_min', case when doc_id % 3 = 0 then null else cast(n_chars as double) * 10.5D end,
  'salary_max', case when doc_id % 2 = 0 then null else cast(n_chars as double) * 14.25D end, 'latitude', doc_id / 8, 'category', array(lang, source),
  'created', '2024-01-01T00:00:00Z', 'redirect_url', case when doc_id % 50 = 49 then null else concat('https://x/', doc_id) end)) as record
from {documents}"""
# A salary may come as text, which is a number all the same, or as an object, which is none.
_MISTYPED = """select seq, pays, case when seq % 7 = 2 then regexp_replace(record, '"salary_min":([0-9.]+)', '"salary_min":"$1"')
  when seq % 7 = 3 then regexp_replace(record, '"salary_min":([0-9.]+)', '"salary_min":{{"bas":$1}}') else record end as record from {landed}"""
_DUCK_A = """a as (select doc_id as seq, case lang when 'en' then 'gb' else lang end as pays,
  case when doc_id % 9 > 0 then source || ' ' || lang end as title, text as description,
  case when doc_id % 4 > 1 then source end as company, case when doc_id % 3 > 0 then lang end as place,
  case when doc_id % 3 > 0 and doc_id % 7 <> 3 then n_chars * 10.5::double end as salary_min, case when doc_id % 2 > 0 then n_chars * 14.25::double end as salary_max,
  case when doc_id % 50 < 49 then 'https://x/' || doc_id end as url, doc_id / 8 as latitude, lang || '|' || source as category from documents)"""


def _raw_a(t: Tables) -> DataFrame:
    landed = t.sql(_MISTYPED, landed=t.sql(_RAW_A, documents=t["documents"]))
    return readers.read_a(landed.withColumn("offer", F.try_parse_json("record")).drop("record"))


@query(
    "read_a",
    f"""with {_DUCK_A} select seq, cast(seq as varchar) as id, title, description, company, place, salary_min, salary_max, url from a""",
)
def read_a(t: Tables) -> DataFrame:
    return _raw_a(t).select(
        "seq", "id", "title", "description", F.col("company.display_name").alias("company"),
        F.col("location.display_name").alias("place"), "salary_min", "salary_max", F.col("redirect_url").alias("url"),
    )


@query(
    "normalize_a",
    f"""with {_DUCK_A} select seq, 'adzuna_' || pays || '_' || seq as id, coalesce(title, '') as intitule, description,
  coalesce(company, '') as entreprise_nom, coalesce(place, '') as lieu_travail,
  case when seq % 5 = 0 then (case pays when 'fr' then 'CDI' else 'Permanent' end) when seq % 5 = 1 then 'CDD/Contrat'
       when seq % 3 = 0 then 'Temps plein' when seq % 3 = 1 then 'Temps partiel' else '' end as type_contrat,
  {duck_salary()} as salaire_libelle, '2024-01-01T00:00:00Z' as date_creation, coalesce(url, '') as url, salary_min, salary_max from a""",
)
def normalize_a(t: Tables) -> DataFrame:
    return readers.normalise_a(_raw_a(t), keep=("seq",)).drop("raw_json")


@query(
    "raw_json",
    f"""with {_DUCK_A} select seq, title as title, description, company, salary_min, url, latitude, category from a""",
)
def raw_json(t: Tables) -> DataFrame:
    """The kept JSON holds all landed values, known or not; they are compared after parsing it again."""
    stored = readers.normalise_a(_raw_a(t), keep=("seq",)).select("seq", F.parse_json("raw_json").alias("offer"))
    again = readers.read_a(stored.withColumn("whole", F.col("offer")))
    return again.select(
        "seq", "title", "description", F.col("company.display_name").alias("company"), "salary_min",
        F.col("redirect_url").alias("url"), F.variant_get("whole", "$.latitude", "double").alias("latitude"),
        F.array_join(F.variant_get("whole", "$.category", "array<string>"), "|").alias("category"),
    )


# --- sources B and C ---------------------------------------------------------------------------

_ITEMS_B = """select doc_id as seq, case when doc_id % 13 = 0 then concat('{{ "id": ', text)
  else concat('{{', case cast(doc_id % 7 as int) when 0 then '' when 1 then '"id": 0, ' when 2 then '"id": "", ' when 3 then '"id": null, '
       when 4 then concat('"id": ', doc_id + 1, ', ') else concat('"id": "', doc_id, 'W", ') end,
     case cast(doc_id % 5 as int) when 0 then concat('"entreprise": {{"nom": "', source, '"}}, ') when 1 then concat('"entreprise": "', source, ' SA", ')
       when 2 then '"entreprise": null, ' when 3 then '"entreprise": {{"autre": 1}}, ' else '' end,
     '"intitule": "', lang, ' é", ', substring(to_json(named_struct('texteOffre', text)), 2)) end as item from {documents}"""
_DUCK_B = """b as (select doc_id as seq, lang || ' é' as titre, case when doc_id % 5 = 0 then source when doc_id % 5 = 1 then source || ' SA' else '' end as entreprise,
  '' as localisation, text as description,
  'https://www.apec.fr/candidat/recherche-emploi.html/emploi/' || case when doc_id % 7 = 4 then cast(doc_id + 1 as varchar) else doc_id || 'W' end as url,
  'apec' as source, '' as date_publication, '' as salaire, '' as type_contrat from documents where doc_id % 13 > 0 and doc_id % 7 > 3)"""


def _items_b(t: Tables) -> DataFrame:
    return readers.read_b(t.sql(_ITEMS_B, documents=t["documents"]))


@query("read_b", f"with {_DUCK_B} select * from b")
def read_b(t: Tables) -> DataFrame:
    return _items_b(t)


_ROWS_C = """select doc_id as seq, case cast(doc_id % 4 as int) when 0 then null when 1 then '' else concat('https://indeed/', doc_id) end as job_url,
  case when doc_id % 8 < 4 then concat('https://alt/', doc_id) end as url, concat(lang, ' ', source) as title,
  case when doc_id % 5 > 0 then source end as company, lang as location, case when doc_id % 3 > 0 then text end as description,
  case when doc_id % 6 > 0 then upper(lang) end as job_description, case when doc_id % 2 = 0 then '2024-01-02' end as date_posted,
  timestamp '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 200 as int)) as posted_at from {documents}"""
_DUCK_C = """c as (select seq, titre, entreprise, localisation, description, case when direct <> '' then direct else alt end as url, 'indeed' as source, date_publication, age from (
  select doc_id as seq, lang || ' ' || source as titre, case when doc_id % 5 > 0 then source else '' end as entreprise, lang as localisation,
    case when doc_id % 3 > 0 and text <> '' then text when doc_id % 6 > 0 then upper(lang) else '' end as description,
    case when doc_id % 4 > 1 then 'https://indeed/' || doc_id else '' end as direct, case when doc_id % 8 < 4 then 'https://alt/' || doc_id else '' end as alt,
    case when doc_id % 2 = 0 then '2024-01-02' else '' end as date_publication, doc_id % 200 as age from documents)
  where direct <> '' or alt <> '')"""


def _rows_c(t: Tables) -> DataFrame:
    return t.sql(_ROWS_C, documents=t["documents"])


@query("read_c", f"with {_DUCK_C} select * exclude (age) from c")
def read_c(t: Tables) -> DataFrame:
    return readers.read_c(_rows_c(t), keep=("seq",))


@query(
    "newest_c",
    """select seq, age from (select *, row_number() over (partition by request_no order by age desc, seq) as n
  from (select doc_id as seq, doc_id % 200 as age, doc_id % 4 as request_no from documents where doc_id % 11 > 0) where age >= 199 - 72) where n <= 10
union all select doc_id, null from documents where doc_id % 11 = 0""",
)
def newest_c(t: Tables) -> DataFrame:
    """Four requests of ten rows each; undated rows are kept."""
    as_of = F.lit("2024-01-09 07:00:00").cast("timestamp")
    dated = F.when(F.col("seq") % 11 > 0, F.col("posted_at"))
    rows = _rows_c(t).withColumns({"posted_at": dated, "request_no": F.col("seq") % 4})
    kept = readers.newest_c(rows, as_of, 72, 10)
    return kept.select("seq", F.when(F.col("posted_at").isNotNull(), F.col("seq") % 200).alias("age"))


_DUCK_BOTH = f"""{_DUCK_B}, {_DUCK_C}, both_sources as (select * from b union all
  select seq, titre, entreprise, localisation, description, url, source, date_publication, '' as salaire, '' as type_contrat from c)"""


def external(t: Tables) -> DataFrame:
    return readers.union_external(_items_b(t), readers.read_c(_rows_c(t), keep=("seq",)))


@query("union_sources", f"with {_DUCK_BOTH} select * from both_sources")
def union_sources(t: Tables) -> DataFrame:
    return external(t)


@query("fetched_by_source", f"with {_DUCK_BOTH} select source, count(*) as fetched from both_sources group by source")
def fetched_by_source(t: Tables) -> DataFrame:
    return metrics.count_by(external(t), "source", "fetched")


_PROPS = T.StructType([T.StructField("k", T.LongType())])


@query(
    "quarantine",
    """select event_type as source, count(*) as landed, count(*) filter (event_id % 7 = 0) as corrupt,
  sum(case when event_id % 7 > 0 then cast(json_extract(props, '$.k') as bigint) end)::bigint as k_total from events group by 1""",
)
def quarantine(t: Tables) -> DataFrame:
    """Every seventh record loses its last brace; the others are read."""
    landed = t["events"].select(
        F.col("event_type").alias("source"),
        F.when(F.col("event_id") % 7 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props")).alias("record"),
    )
    read = readers.parse_json(landed, "record", _PROPS)
    return read.groupBy("source").agg(
        F.count(F.lit(1)).alias("landed"),
        F.count_if(F.col(readers.CORRUPT).isNotNull()).alias("corrupt"),
        F.sum("k").alias("k_total"),
    )
