"""Queries: prompts, answers, scoring and documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.catalog.fixture import offers, stored_offers, with_offers
from vacantia.catalog.registry import Tables, query
from vacantia.functions import answers, prompts
from vacantia.operators import documents, filters, scoring
from vacantia.schemas import PROFILE

PROFILE_EXAMPLE = {
    "candidat": {"poste_cible": "the"},
    "competences": {"techniques": ["is", "Éau", "xyzzy"], "soft_skills": []},
    "experience": {"annees_totales": 2},
    "criteres": {
        "types_contrat": ["CDI"],
        "salaire_min_annuel": 45000,
        "teletravail_souhaite": True,
        "localisations_acceptees": ["fr", "en"],
    },
}
_PROFILE_LINES = [
    "## PROFIL CANDIDAT", "Poste cible : the", "Expérience : 2 ans", "Compétences techniques : is, Éau, xyzzy", "Soft skills : ", "",
    "## CRITÈRES", "Types de contrat acceptés : CDI", "Salaire minimum : 45000 €/an brut", "Télétravail souhaité : Oui",
    "Localisation acceptée : fr, en", "Secteurs préférés : ", "", "## PRÉFÉRENCES ENTREPRISE", "Taille : Indifférent", "Culture : ",
]


def _duck_text(lines: list[str]) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in lines)


_DUCK_OFFER = """'## OFFRE D''EMPLOI' || chr(10) || 'Titre : ' || coalesce(nullif(intitule, ''), 'Non précisé') || chr(10) || 'Entreprise : ' || coalesce(nullif(entreprise_nom, ''), 'Non précisée')
  || chr(10) || 'Lieu : ' || coalesce(nullif(lieu_travail, ''), 'Non précisé') || chr(10) || 'Type de contrat : ' || coalesce(nullif(type_contrat, ''), 'Non précisé')
  || chr(10) || 'Salaire : ' || coalesce(nullif(salaire_libelle, ''), 'Non précisé') || chr(10) || chr(10) || '### Description de l''offre' || chr(10)
  || left(coalesce(nullif(description, ''), 'Aucune description'), 3000)"""
_DUCK_PROMPT = f"{_duck_text(_PROFILE_LINES)} || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {_DUCK_OFFER}"


# --- prompts ----------------------------------------------------------------------------------


@query(
    "profile_text",
    """select c_custkey, '## PROFIL CANDIDAT' || chr(10) || 'Poste cible : ' || case when c_custkey % 4 = 0 then 'Non précisé' else c_mktsegment end || chr(10)
  || 'Expérience : ' || case when c_custkey % 5 = 0 then '?' else cast(c_nationkey as varchar) end || ' ans' || chr(10)
  || 'Compétences techniques : ' || case when c_custkey % 3 = 0 then '' else c_name || ', ' || c_mktsegment end || chr(10) || 'Soft skills : ' || chr(10) || chr(10)
  || '## CRITÈRES' || chr(10) || 'Types de contrat acceptés : CDI, CDD' || chr(10) || 'Salaire minimum : ' || case when c_custkey % 7 = 0 then 'Non précisé' else cast(c_custkey as varchar) end || ' €/an brut' || chr(10)
  || 'Télétravail souhaité : ' || case when c_custkey % 2 = 1 then 'Oui' else 'Non' end || chr(10)
  || 'Localisation acceptée : ' || case when c_custkey % 6 = 0 then 'Paris / Île-de-France' else c_mktsegment end || chr(10) || 'Secteurs préférés : ' || chr(10) || chr(10)
  || '## PRÉFÉRENCES ENTREPRISE' || chr(10) || 'Taille : ' || case when c_custkey % 8 = 0 then 'PME' else 'Indifférent' end || chr(10) || 'Culture : ' || case when c_custkey % 9 = 0 then 'calme, ' || c_name else '' end as profil
from customer""",
)
def profile_text(t: Tables) -> DataFrame:
    """One profile per customer, read from JSON with missing keys."""
    landed = t.sql(
        """select c_custkey, concat('{{"candidat": {{', case when c_custkey % 4 = 0 then '' else concat('"poste_cible": "', c_mktsegment, '"') end, '}}, ',
  case when c_custkey % 5 = 0 then '' else concat('"experience": {{"annees_totales": ', c_nationkey, '}}, ') end,
  '"competences": {{"techniques": ', case when c_custkey % 3 = 0 then '[]' else concat('["', c_name, '", "', c_mktsegment, '"]') end, '}}, ',
  '"criteres": {{"types_contrat": ["CDI", "CDD"]', case when c_custkey % 7 = 0 then '' else concat(', "salaire_min_annuel": ', c_custkey) end,
  case when c_custkey % 2 = 1 then ', "teletravail_souhaite": true' when c_custkey % 4 = 0 then ', "teletravail_souhaite": false' else '' end,
  case when c_custkey % 6 = 0 then '' else concat(', "localisations_acceptees": ["', c_mktsegment, '"]') end, '}}, "preferences_entreprise": {{',
  case when c_custkey % 8 = 0 then '"taille_preferee": "PME"' else '"x": 1' end,
  case when c_custkey % 9 = 0 then concat(', "culture": ["calme", "', c_name, '"]') else '' end, '}}}}') as profil from {customer}""",
        customer=t["customer"],
    )
    return landed.select("c_custkey", prompts.profile_text(F.from_json("profil", PROFILE)).alias("profil"))


@query("offer_text", with_offers(f"select seq, {_DUCK_OFFER} as offre from stored_fx"))
def offer_text(t: Tables) -> DataFrame:
    return stored_offers(t).select("seq", prompts.offer_text().alias("offre"))


@query("score_prompt", with_offers(f"select seq, {_DUCK_PROMPT} as prompt from stored_fx where score is null"))
def score_prompt(t: Tables) -> DataFrame:
    waiting = filters.to_score(stored_offers(t))
    return waiting.select("seq", prompts.score_prompt(prompts.profile_literal(PROFILE_EXAMPLE)).alias("prompt"))


CV_EXAMPLE = "<!DOCTYPE html>\n<html><body><div class=\"cv-name\">A. Exemple</div></body></html>"
_DUCK_CV = f"""'## OFFRE D''EMPLOI CIBLE' || chr(10) || 'Titre : ' || coalesce(nullif(intitule, ''), 'Non précisé') || chr(10) || 'Entreprise : ' || coalesce(nullif(entreprise_nom, ''), 'Non précisée')
  || chr(10) || 'Lieu : ' || coalesce(nullif(lieu_travail, ''), 'Non précisé') || chr(10) || 'Contrat : ' || coalesce(nullif(type_contrat, ''), 'Non précisé')
  || chr(10) || 'Salaire : ' || coalesce(nullif(salaire_libelle, ''), 'Non précisé') || chr(10) || chr(10) || '### Description complète' || chr(10)
  || left(coalesce(nullif(description, ''), 'Aucune description'), 3000) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## CV HTML À ADAPTER' || chr(10)
  || {_duck_text(CV_EXAMPLE.splitlines())} || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || 'Adapte ce CV HTML pour cette offre en respectant toutes les règles.' || chr(10) || 'Retourne le HTML complet adapté.'"""


@query("cv_prompt", with_offers(f"select seq, {_DUCK_CV} as prompt from stored_fx"))
def cv_prompt(t: Tables) -> DataFrame:
    return stored_offers(t).select("seq", prompts.cv_prompt(F.lit(CV_EXAMPLE)).alias("prompt"))


# --- answers and scoring ------------------------------------------------------------------------

# How a model might write the score, and the whole score it stands for, if any.
_SCORES = [
    ("85", 85), ('"85"', 85), ('" 85 "', 85), ('"85.0"', 85), ("85.0", 85), ("85.5", None), ("true", 1), ("101", None),
    ("-1", None), ("null", None), ('"8_5"', 85), ('"1e2"', None), ("1e2", 100), ('"85."', None), ("0", 0), ("[85]", None),
]
_LISTS = [('["a", "é"]', "a|é"), ("[]", ""), ("null", None), ("[1]", None), ('"a"', None)]


def _cases(number: str, values: list) -> str:
    return f"case cast({number} as int) " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def _quoted(value) -> str:
    return "null" if value is None else "'" + str(value) + "'"


_N_SCORES, _N_LISTS = len(_SCORES), len(_LISTS)
_GOOD_SCORE = _cases(f"doc_id % {_N_SCORES}", ["null" if v is None else v for _, v in _SCORES])
_GOOD_LIST = _cases(f"(doc_id // {_N_SCORES}) % {_N_LISTS}", [_quoted(v) for _, v in _LISTS])


@query(
    "validate_answers",
    f"""select doc_id, case when ok then s end as score, case when ok then text end as explication, case when ok then forts end as forts, case when ok then '' end as faibles
from (select doc_id, text, {_GOOD_SCORE} as s, {_GOOD_LIST} as forts, s is not null and forts is not null and doc_id % 9 > 1 as ok from documents)""",
)
def validate_answers(t: Tables) -> DataFrame:
    score = _cases(f"doc_id % {_N_SCORES}", [_quoted(text) for text, _ in _SCORES])
    items = _cases(f"(doc_id div {_N_SCORES}) % {_N_LISTS}", [_quoted(text) for text, _ in _LISTS])
    landed = t.sql(
        f"""select doc_id, concat('{{{{"autre": 1, "score": ', {score}, ', "points_forts": ', {items}, ', ',
  case when doc_id % 9 = 0 then '"explication": 3}}}}' when doc_id % 9 = 1 then '"points_faibles": []}}}}'
       else substring(to_json(named_struct('explication', text)), 2) end) as answer from {{documents}}""",
        documents=t["documents"],
    )
    checked = landed.select("doc_id", answers.validated_answer(F.col("answer")).alias("r"))
    return checked.select(
        "doc_id", "r.score", "r.explication", F.array_join("r.points_forts", "|").alias("forts"),
        F.array_join("r.points_faibles", "|").alias("faibles"),
    )


_OVERLAP = """cast(floor(40.0 * (contains(t, 'the'))::int + 30.0 * (contains(t, 'is')::int + contains(t, 'éau')::int + contains(t, 'xyzzy')::int) / 3.0
  + 15.0 * contains(lower(coalesce(type_contrat, '')), 'cdi')::int + 5.0 * (contains(lower(lieu_travail), 'fr')::int + contains(lower(lieu_travail), 'en')::int) / 2.0) as int)"""


def overlap_score(profile: dict) -> Column:
    """Stand-in score for tests and dry runs; not what a model would answer.

    It follows the order of the scoring criteria: job title 40, skills 30, contract 15,
    sector 10, place 5. A list counts by the share of its entries found in the offer.
    """
    text = F.lower(F.concat_ws(" ", "intitule", "description"))
    criteria = profile.get("criteres") or {}

    def share(values: list[str] | None, within: Column) -> Column:
        wanted = [v for v in values or [] if v]
        if not wanted:
            return F.lit(0.0)
        hits = [F.contains(within, F.lower(F.lit(v))).cast("int") for v in wanted]
        return sum(hits[1:], hits[0]) / F.lit(float(len(wanted)))

    parts = [
        (40, share([(profile.get("candidat") or {}).get("poste_cible")], text)),
        (30, share((profile.get("competences") or {}).get("techniques"), text)),
        (15, share(criteria.get("types_contrat"), F.lower(F.coalesce("type_contrat", F.lit(""))))),
        (10, share(criteria.get("secteurs_preferes"), text)),
        (5, share(criteria.get("localisations_acceptees"), F.lower(F.coalesce("lieu_travail", F.lit(""))))),
    ]
    weighted = [F.coalesce(part, F.lit(0.0)) * weight for weight, part in parts]
    return F.floor(sum(weighted[1:], weighted[0])).cast("int")


@query("stub_score", with_offers(f"select seq, {_OVERLAP} as score from (select *, lower(intitule || ' ' || description) as t from offers_fx)"))
def stub_score(t: Tables) -> DataFrame:
    return offers(t).select("seq", overlap_score(PROFILE_EXAMPLE).alias("score"))


def length_scorer() -> Callable[[list[str]], list[str | Exception]]:
    """Deterministic stand-in for a model: the prompt's length decides."""

    def score(prompt: str) -> str | Exception:
        size = len(prompt)
        if size % 13 == 0:
            return RuntimeError("indisponible")
        answer = {"score": size % 127, "explication": f"{size} caractères", "points_forts": [str(size), "é"]}
        return json.dumps(answer, ensure_ascii=False)

    return lambda asked: [score(prompt) for prompt in asked]


@query(
    "score_batch",
    with_offers(f"""select id, case when ok then n % 127 else -1 end as score,
  case when ok then n || ' caractères' when n % 13 = 0 then 'Erreur : indisponible' else 'Erreur : réponse invalide' end as score_explication,
  case when ok then '["' || n || '", "é"]' else '[]' end as score_points_forts, '[]' as score_points_faibles
from (select cast(seq as varchar) as id, length({_DUCK_PROMPT}) as n, n % 13 > 0 and n % 127 <= 100 as ok from stored_fx where score is null)"""),
)
def score_batch(t: Tables) -> DataFrame:
    waiting = filters.to_score(stored_offers(t)).withColumn("id", F.col("seq").cast("string"))
    scores = scoring.score_offers(waiting, PROFILE_EXAMPLE, length_scorer, partitions=8)
    return scoring.score_rows(scores, F.lit(None)).drop("score_date")


# --- documents --------------------------------------------------------------------------------------


@query(
    "assemble_chunks",
    """select conv_id as key, trim(string_agg(text, '' order by turn), ' ' || chr(9) || chr(10) || chr(13)) as text from conversations group by conv_id""",
)
def assemble_chunks(t: Tables) -> DataFrame:
    """Whole conversations as chunks, with an empty and a missing chunk after each turn."""
    c = t["conversations"]
    pieces = F.posexplode(F.array("text", F.lit(""), F.lit(None).cast("string"))).alias("_at", "text")
    chunks = c.select(F.col("conv_id").alias("key"), "turn", pieces).select("key", (F.col("turn") * 3 + F.col("_at")).alias("chunk_no"), "text")
    return documents.assemble_chunks(chunks)


def echo_generator() -> Callable[[str], Iterable[str]]:
    """Deterministic stand-in for a model that answers in chunks, with a fence around."""

    def generate(prompt: str) -> Iterable[str]:
        if len(prompt) % 13 == 0:
            raise RuntimeError("indisponible")
        yield "```html\n"
        yield ""
        yield f"<p>{len(prompt)}</p>"
        yield "\n```\n"

    return generate


@query(
    "adapt_batch",
    with_offers(f"""select id, left(id, 12) as slug, case when n % 13 > 0 then '<p>' || n || '</p>' end as html, case when n % 13 = 0 then 'indisponible' end as error
from (select 'd' || seq as id, length({_DUCK_CV}) as n from stored_fx)"""),
)
def adapt_batch(t: Tables) -> DataFrame:
    chosen = stored_offers(t).withColumn("id", F.concat(F.lit("d"), F.col("seq")))
    return documents.adapt_documents(chosen, CV_EXAMPLE, echo_generator)
