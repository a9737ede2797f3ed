"""First and last row per key.

Each rule aggregates the key and one bigint order column, which combines before the
shuffle: a key that owns a third of the rows reaches its reducer as one row per map task.
The chosen rows are then picked by the order column, which is unique and hence even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import or_empty


def _pick(rows: DataFrame, keys: list[Column], chosen: Column, order: str) -> DataFrame:
    winners = rows.groupBy(*keys).agg(chosen.alias(order)).select(order)
    return rows.join(winners, order, "left_semi")


def last_value_first_place(
    rows: DataFrame, target: str = "target", raw_id: str = "id", order: str = "seq", place: str = "place"
) -> DataFrame:
    """Per target and raw id, the last row, at the place where the id first occurred.

    Missing ids of one target count as one id.
    """
    winners = (
        rows.groupBy(F.col(target).alias("_target"), or_empty(F.col(raw_id)).alias("_id"))
        .agg(F.max(order).alias(order), F.min(order).alias(place))
        .select(order, place)
    )
    return rows.join(winners, order)


def first_by_url(rows: DataFrame, order: str = "seq", url: str = "url") -> DataFrame:
    """The first row of every non-empty URL."""
    return _pick(rows.where(F.col(url) != ""), [F.col(url)], F.min(order), order)


def keep_lowest_by_url(rows: DataFrame, order: str = "seq", url: str = "url") -> DataFrame:
    """The first row of every URL; null and '' each form one group."""
    return _pick(rows, [F.col(url)], F.min(order), order)
