"""Incremental collection with the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vacantia.operators.admission import admit
from vacantia.operators.filters import with_url, without_forbidden_terms
from vacantia.plans.store import OfferStore
from vacantia.schemas import OFFER_TEXTS
from vacantia.staging import stage, staging_scope


def ingest_stream(
    rows: DataFrame,
    to_candidates: Callable[[DataFrame], DataFrame],
    store: OfferStore,
    forbidden_terms: list[str],
    checkpoint: str,
    writer: str,
) -> StreamingQuery:
    """Feed a stream of landed rows into the store, one micro-batch after the other.

    ``to_candidates`` turns landed rows into stored offers with ``seq`` and
    ``collected_at``. A batch is written once as offers, admitted against the living keys it may meet, and published under
    (``writer``, batch), so a replay after a failure finds what it published, and other streams and runs may write to the store
    meanwhile: the store has the batch admitted again if one of them was first with a key. Admission sees narrow rows; the admitted
    ones are then picked from the written batch. The trigger takes all data there is, then stops.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        with staging_scope(batch.sparkSession):
            candidates = without_forbidden_terms(with_url(to_candidates(batch)), forbidden_terms)
            staged = stage(candidates.select("seq", *OFFER_TEXTS, "collected_at"), "stream")
            narrow = staged.table.select("seq", "id", "url")

            def choose(keys_for: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
                if not staged.rows:
                    return None
                admission = admit(narrow, keys_for(narrow))
                return staged.table.join(admission.kept, "seq", "left_semi") if admission.count else None

            store.insert(writer, batch_id, choose)

    return (
        rows.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
