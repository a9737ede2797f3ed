"""Admission of new offers under two unique keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators.components import components
from vacantia.operators.ranking import rank_rows
from vacantia.staging import Staged, stage

# Chains of conflicts that are longer than this are walked component by component.
ROUNDS = 4
# No task walks more rows of one component than this; a larger component is decided block after block of its order.
BLOCK_ROWS = 500_000


def without_known_urls(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates with a URL that no stored offer has.

    One join of two scans, planned lazily: Spark picks broadcast or shuffle, and splits the candidates of a
    URL that very many share. Stored rows without a URL match nothing and are left out.
    """
    known = stored.where(F.col("url") != "").select("url")
    return candidates.where(F.col("url") != "").join(known, "url", "left_anti")


@dataclass(frozen=True)
class Admission:
    """Kept rows, their values of the order column, how many there are, rounds taken."""

    offers: DataFrame
    kept: DataFrame
    count: int
    rounds: int


def admit(
    candidates: DataFrame, stored: DataFrame | None = None, order: str = "seq", most_rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS
) -> Admission:
    """Keep, in ``order``, each row whose id and url no kept or stored row holds.

    A null key never conflicts, nor does a stored empty URL. Two chained de-duplications would be wrong, because a row
    refused for its url must not block others by its id. Instead, rounds: a row that comes
    first both in its id group and in its url group is kept; rows sharing a key with it
    fall out; the rest goes on. What is open after a fixed number of rounds hangs together in
    long chains; rows are then labelled by connected component, dealt by component and walked in order, so the
    number of jobs does not grow with a chain. A component of more than ``block_rows`` rows is cut by order into blocks of at most
    that many: a block's rows that share a key with a row kept earlier fall out in a join, and the others are walked.

    The rounds carry (order, id, url) only. Groups are reduced to their first row by aggregation, the group
    tables meet on the unique order column, and every table that meets the rows is written first, so that adaptive
    execution can split the rows of a hot key. ``count`` comes from those writes.

    ``order`` must be neither null nor repeated; either raises an error.
    """
    unplaced = F.count_if(F.col("_unplaced"))
    # Of several rows with the same two keys only the first can ever be kept.
    undecided = stage(
        candidates.groupBy(_marked("id", order).alias("id"), _marked("url", order).alias("url")).agg(
            F.min(order).alias(order), F.bool_or(F.col(order).isNull()).alias("_unplaced")
        ),
        "admit-open",
        unplaced=unplaced,
    )
    repeated = undecided.table.groupBy(order).count().where(F.col("count") > 1)
    if undecided.seen["unplaced"] or not repeated.isEmpty():
        raise ValueError(f"{order} must be set and unique to say which row comes first")
    undecided = Staged(undecided.table.drop("_unplaced"), undecided.rows, undecided.path)
    if stored is not None and undecided.rows:
        held = stage(stored.select("id", "url"), "admit-held").table
        rest = undecided.table
        for key in ("id", "url"):
            known = held.where(F.col(key).isNotNull() & ((F.col(key) != "") | F.lit(key == "id")))
            rest = rest.join(known.select(F.concat(F.lit("="), F.col(key)).alias(key)), key, "left_anti")
        undecided = stage(rest.select(order, "id", "url"), "admit-open")
    kept: list[Staged] = []
    rounds = 0
    while undecided.rows:
        rounds += 1
        if rounds > most_rounds:
            kept += _decided(undecided.table, order, block_rows)
            break
        winners = stage(_first_in_both(undecided.table, order), "admit-kept")
        kept.append(winners)
        if winners.rows == undecided.rows:
            break
        rest = undecided.table
        for key in ("id", "url"):
            rest = rest.join(winners.table.select(key), key, "left_anti")
        undecided = stage(rest.select(order, "id", "url"), "admit-open")

    if not kept:
        return Admission(candidates.limit(0), candidates.select(order).limit(0), 0, rounds)
    chosen = reduce(DataFrame.unionByName, [part.table.select(order) for part in kept])
    count = sum(part.rows for part in kept)
    return Admission(candidates.join(chosen, order, "left_semi"), chosen, count, rounds)


def _marked(key: str, order: str) -> Column:
    """The key with a mark, or a value no other row has where the key is null."""
    return F.when(F.col(key).isNotNull(), F.concat(F.lit("="), F.col(key))).otherwise(
        F.concat(F.lit("#"), F.coalesce(F.col(order).cast("string"), F.lit("?")))
    )


def _first_in_both(undecided: DataFrame, order: str) -> DataFrame:
    first_of_id = undecided.groupBy("id").agg(F.min(order).alias(order))
    first_of_url = undecided.groupBy("url").agg(F.min(order).alias(order))
    first_of_both = first_of_id.join(first_of_url, order)
    return first_of_both.select(order, "id", "url")


def _decided(undecided: DataFrame, order: str, block_rows: int) -> list[Staged]:
    """What is kept of rows in long chains: small components at once, the blocks of large ones one after the other."""
    keyed = undecided.withColumns({"_i": F.concat(F.lit("i"), "id"), "_u": F.concat(F.lit("u"), "url")})
    found = stage(components(keyed, "_i", "_u"), "admit-components").table
    labelled = stage(keyed.join(found.withColumnRenamed("node", "_i"), "_i").select("component", order, "id", "url"), "admit-labelled").table
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    large = stage(sizes.select("component"), "admit-large")
    if not large.rows:
        return [stage(_walked(labelled, order), "admit-walked")]
    kept = [stage(_walked(labelled.join(large.table, "component", "left_anti"), order), "admit-walked")]
    # Blocks are ranges of the order over all large components, so that a block of one component is no larger either.
    ranked = rank_rows(labelled.join(large.table, "component", "left_semi"), order, rank="_rank")
    blocks = stage(ranked.withColumn("_block", F.floor((F.col("_rank") - 1) / block_rows)).drop("_rank"), "admit-blocks", last=F.max("_block"))
    rest = blocks
    for number in range(blocks.seen["last"] + 1):
        winners = stage(_walked(rest.table.where(F.col("_block") == number).drop("_block"), order), "admit-walked")
        kept.append(winners)
        if winners.rows and number < blocks.seen["last"]:
            later = rest.table.where(F.col("_block") > number)
            for key in ("id", "url"):
                later = later.join(winners.table.select(key), key, "left_anti")
            rest = stage(later.select(*blocks.table.columns), "admit-blocks")
    return kept


def _walked(rows: DataFrame, order: str) -> DataFrame:
    """The rows of each component one after the other, many components at a time."""

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, urls = None, set(), set()
        for batch in batches:
            keep = []
            for component, offer_id, url in zip(batch["component"], batch["id"], batch["url"]):
                if component != now:
                    now, ids, urls = component, set(), set()
                free = offer_id not in ids and url not in urls
                if free:
                    ids.add(offer_id)
                    urls.add(url)
                keep.append(free)
            yield batch.loc[keep, [order, "id", "url"]]

    dealt = rows.select("component", order, "id", "url").repartition("component").sortWithinPartitions("component", order)
    return dealt.mapInPandas(in_order, rows.select(order, "id", "url").schema)
