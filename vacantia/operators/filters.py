"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.labels import contract_filter_value, source_dashboard, status_or_default
from vacantia.functions.text import or_empty

def has_forbidden_term(title: Column, description: Column, terms: list[str | None]) -> Column:
    """True where a term occurs anywhere in title and description, whatever its case.

    Terms are plain text and match inside words. Null terms are ignored; an empty term
    occurs in every text.

    The lower-cased text is bound as the one element of an array: a filter would otherwise
    build it again for each term, which dominates the cost on long texts.
    """
    wanted = [F.lower(F.lit(t)) for t in dict.fromkeys(terms) if t is not None]
    if not wanted:
        return F.lit(False)

    def any_in(text: Column) -> Column:
        return F.exists(F.array(*wanted), lambda term: F.contains(text, term))

    text = F.lower(F.concat(or_empty(title), F.lit(" "), or_empty(description)))
    return F.exists(F.array(text), any_in)


def without_forbidden_terms(
    offers: DataFrame, terms: list[str | None], title: str = "intitule", description: str = "description"
) -> DataFrame:
    return offers.where(~has_forbidden_term(F.col(title), F.col(description), terms))


def with_url(offers: DataFrame) -> DataFrame:
    return offers.where(F.col("url") != "")


def scored(offers: DataFrame) -> DataFrame:
    return offers.where(F.col("score") >= 0)


def to_score(offers: DataFrame, retry_failed: bool = False) -> DataFrame:
    waiting = F.col("score").isNull()
    return offers.where(waiting | (F.col("score") == -1) if retry_failed else waiting)


def by_id(offers: DataFrame, offer_id: str) -> DataFrame:
    return offers.where(F.col("id") == offer_id)


def dashboard_filter(
    offers: DataFrame,
    min_score: int = V.DASHBOARD_MIN_SCORE,
    sources: list[str] = V.DASHBOARD_SOURCES,
    contracts: list[str] = V.DASHBOARD_CONTRACTS,
    statuses: list[str] = V.STATUSES,
    contract_groups: dict[str, str] | None = None,
) -> DataFrame:
    """Scored offers that pass the dashboard's four filters.

    Contracts are compared as stored, so values such as ``Permanent`` match no offered
    choice. ``contract_groups`` (stored value -> choice) is an optional way out.
    """
    contract = contract_filter_value(F.col("type_contrat"))
    if contract_groups:
        pairs = [F.lit(x) for pair in contract_groups.items() for x in pair]
        contract = F.coalesce(F.try_element_at(F.create_map(*pairs), contract), contract)
    return scored(offers).where(
        (F.col("score") >= min_score)
        & source_dashboard(F.col("url")).isin(sources)
        & status_or_default(F.col("statut")).isin(statuses)
        & contract.isin(contracts)
    )
