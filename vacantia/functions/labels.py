"""Labels derived from stored columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.text import grouped_thousands, is_set, or_default, strip


def _by_score(score: Column, classes: list[tuple[int | None, str]]) -> Column:
    *limits, (_, rest) = classes
    (first, label), *others = limits
    chosen = reduce(
        lambda case, step: case.when(score >= step[0], step[1]), others, F.when(score >= first, label)
    )
    return chosen.otherwise(rest)


def priority_dashboard(score: Column) -> Column:
    return _by_score(score, V.PRIORITY_DASHBOARD)


def priority_export(score: Column) -> Column:
    return _by_score(score, V.PRIORITY_EXPORT)


def priority_report(score: Column) -> Column:
    return _by_score(score, V.PRIORITY_REPORT)


def fill_colour(score: Column) -> Column:
    return _by_score(score, V.FILL_EXPORT)


def text_colour(score: Column) -> Column:
    return _by_score(score, V.TEXT_COLOUR)


def band(score: Column) -> Column:
    return _by_score(score, V.BANDS)


def _by_url(url: Column, rest: str) -> Column:
    (first, label), *others = V.URL_SOURCES
    chosen = reduce(
        lambda case, step: case.when(F.contains(url, F.lit(step[0])), step[1]),
        others,
        F.when(F.contains(url, F.lit(first)), label),
    )
    return chosen.otherwise(rest)


def source_dashboard(url: Column) -> Column:
    """Source name from the URL, whatever its case."""
    return _by_url(F.lower(url), "N/A")


def source_export(url: Column) -> Column:
    """Source name from the URL as written: an upper-case host is not recognised."""
    return _by_url(url, "—")


def salary_label(low: Column, high: Column, country: Column) -> Column:
    unit = F.when(country == "gb", V.SALARY_POUNDS).otherwise(V.SALARY_EUROS)
    return (
        F.when(
            is_set(low) & is_set(high),
            F.concat(grouped_thousands(low), F.lit(V.SALARY_BETWEEN), grouped_thousands(high), unit),
        )
        .when(is_set(low), F.concat(F.lit(V.SALARY_FROM), grouped_thousands(low), unit))
        .otherwise("")
    )


def contract_label(contract_time: Column, contract_type: Column, country: Column) -> Column:
    """The contract type decides; the working time only speaks when the type says nothing."""
    permanent = F.when(country == "fr", V.CONTRACT_PERMANENT_FR).otherwise(V.CONTRACT_PERMANENT)
    label = F.when(contract_type == "permanent", permanent).when(
        contract_type == "contract", V.CONTRACT_FIXED_TERM
    )
    for code, text in V.CONTRACT_TIME.items():
        label = label.when(contract_time == code, text)
    return label.otherwise("")


def contract_filter_value(contract: Column) -> Column:
    """Contract as the dashboard filters it."""
    return or_default(strip(contract), V.NO_CONTRACT)


def status_or_default(status: Column) -> Column:
    return F.coalesce(status, F.lit(V.DEFAULT_STATUS))


def status_in_detail(status: Column) -> Column:
    """Status preselected in the detail view: unknown values show the default."""
    return F.when(status.isin(V.STATUSES), status).otherwise(V.DEFAULT_STATUS)
