"""Offer ids and the order in which offers compete."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.text import or_empty


def id_from_raw(country: Column, raw_id: Column) -> Column:
    """Source A: the country keeps equal ids of two countries apart."""
    return F.concat(F.lit("adzuna_"), country, F.lit("_"), or_empty(raw_id))


def id_from_url(source: Column, url: Column) -> Column:
    """Sources B and C: source and the first 12 hex digits of the URL's MD5."""
    return F.concat(source, F.lit("_"), F.substring(F.md5(url), 1, 12))


def artifact_slug(offer_id: Column) -> Column:
    """Short name of a written document. Not unique, see ``slug_collisions``."""
    return F.substring(F.replace(offer_id, F.lit("adzuna_"), F.lit("")), 1, 12)


# Requests below this number are given by a plan; this one holds rows that came without a place.
UNPLACED_REQUEST = (1 << 30) - 1


def arrival_order(source_rank: Column, request_no: Column, position: Column) -> Column:
    """One sortable number from (source, request, position).

    A single bigint keeps ``min`` and ``max`` inside hash aggregation; a struct would fall
    back to sorting. The source must be below 4, the request below 2**30, the position below 2**31; a value outside its
    limits raises an error, since two rows would share one number. Null gives null.
    """
    fits = source_rank.between(0, 3) & request_no.between(0, UNPLACED_REQUEST) & position.between(0, (1 << 31) - 1)
    number = (
        F.shiftleft(source_rank.cast("bigint"), 61)
        .bitwiseOR(F.shiftleft(request_no.cast("bigint"), 31))
        .bitwiseOR(position.cast("bigint"))
    )
    outside = F.raise_error(F.concat(F.lit("no order for request "), request_no.cast("string"), F.lit(", position "), position.cast("string")))
    return F.when(~fits, outside.cast("bigint")).otherwise(number)
