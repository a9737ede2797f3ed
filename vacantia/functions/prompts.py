"""Texts handed to a model."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.text import or_default
from vacantia.schemas import PROFILE


def _listed(values: Column) -> Column:
    return F.coalesce(F.array_join(values, ", "), F.lit(""))


def _lines(*lines: Column | str) -> Column:
    return F.concat_ws("\n", *[line if isinstance(line, Column) else F.lit(line) for line in lines])


def _line(label: str, value: Column, end: str = "") -> Column:
    return F.concat(F.lit(label), value, F.lit(end))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def profile_text(profile: Column) -> Column:
    """Profile (struct of ``schemas.PROFILE``) as text; missing keys take their defaults."""
    criteria = profile["criteres"]
    company = profile["preferences_entreprise"]
    remote = F.lower(criteria["teletravail_souhaite"])
    wants_remote = F.coalesce(~remote.isin("", "false", "0", "0.0"), F.lit(False))
    places = F.coalesce(criteria["localisations_acceptees"], F.array(F.lit(V.PROFILE_DEFAULT_PLACE)))
    return _lines(
        V.PROFILE_TITLE,
        _line(V.PROFILE_JOB, _or(profile["candidat"]["poste_cible"], V.UNKNOWN_M)),
        _line(V.PROFILE_YEARS[0], _or(profile["experience"]["annees_totales"], "?"), V.PROFILE_YEARS[1]),
        _line(V.PROFILE_SKILLS, _listed(profile["competences"]["techniques"])),
        _line(V.PROFILE_SOFT_SKILLS, _listed(profile["competences"]["soft_skills"])),
        "",
        V.PROFILE_CRITERIA,
        _line(V.PROFILE_CONTRACTS, _listed(criteria["types_contrat"])),
        _line(V.PROFILE_SALARY[0], _or(criteria["salaire_min_annuel"], V.UNKNOWN_M), V.PROFILE_SALARY[1]),
        _line(V.PROFILE_REMOTE, F.when(wants_remote, "Oui").otherwise("Non")),
        _line(V.PROFILE_PLACES, _listed(places)),
        _line(V.PROFILE_SECTORS, _listed(criteria["secteurs_preferes"])),
        "",
        V.PROFILE_COMPANY,
        _line(V.PROFILE_SIZE, _or(company["taille_preferee"], V.PROFILE_DEFAULT_SIZE)),
        _line(V.PROFILE_CULTURE, _listed(company["culture"])),
    )


def profile_literal(profile: dict) -> Column:
    """A loaded profile as one constant struct, so that meeting many offers needs no join."""
    return F.from_json(F.lit(json.dumps(profile, ensure_ascii=False, default=str)), PROFILE)


def _description() -> Column:
    return F.substring(or_default(F.col("description"), V.NO_DESCRIPTION), 1, V.DESCRIPTION_LIMIT)


def offer_text() -> Column:
    """Stored offer as text. The 3,000 characters of description are the layout's own limit."""
    return _lines(
        V.OFFER_TITLE,
        _line(V.OFFER_JOB, or_default(F.col("intitule"), V.UNKNOWN_M)),
        _line(V.OFFER_COMPANY, or_default(F.col("entreprise_nom"), V.UNKNOWN_F)),
        _line(V.OFFER_PLACE, or_default(F.col("lieu_travail"), V.UNKNOWN_M)),
        _line(V.OFFER_CONTRACT, or_default(F.col("type_contrat"), V.UNKNOWN_M)),
        _line(V.OFFER_SALARY, or_default(F.col("salaire_libelle"), V.UNKNOWN_M)),
        "",
        V.OFFER_DESCRIPTION,
        _description(),
    )


def score_prompt(profile: Column) -> Column:
    return F.concat(profile_text(profile), F.lit(V.PROMPT_SEPARATOR), offer_text())


def cv_prompt(cv_html: Column) -> Column:
    return _lines(
        V.CV_OFFER_TITLE,
        _line(V.OFFER_JOB, or_default(F.col("intitule"), V.UNKNOWN_M)),
        _line(V.OFFER_COMPANY, or_default(F.col("entreprise_nom"), V.UNKNOWN_F)),
        _line(V.OFFER_PLACE, or_default(F.col("lieu_travail"), V.UNKNOWN_M)),
        _line(V.CV_CONTRACT, or_default(F.col("type_contrat"), V.UNKNOWN_M)),
        _line(V.OFFER_SALARY, or_default(F.col("salaire_libelle"), V.UNKNOWN_M)),
        "",
        V.CV_DESCRIPTION,
        _description(),
        "",
        V.CV_RULE,
        "",
        V.CV_BODY,
        cv_html,
        "",
        V.CV_RULE,
        "",
        V.CV_REQUEST,
    )
