"""Incremental collection that remembers the living keys in stream state.

Three streams meet in one stateful operator, keyed by id and by URL: candidates, and the two changelogs of the store, keys that
versions added and keys they took away. The operator lets a candidate's key pass if it is not alive. So a batch costs its
candidates and the changes since the last batch; the keys of all offers are never read again, and a restart finds them
in the checkpoint. What passes under both keys is admitted within the batch and published by the store, which compares it
only with the versions that the state may not hold yet: those since the batch before the last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vacantia.operators.admission import admit
from vacantia.operators.filters import with_url, without_forbidden_terms
from vacantia.plans.commits import Folder
from vacantia.plans.store import OfferStore
from vacantia.schemas import OFFER, OFFER_TEXTS
from vacantia.session import ship_package
from vacantia.staging import stage, staging_scope

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# Candidates of one key that wait in memory.
IN_MEMORY = 1000
_PAYLOAD = [f for f in OFFER.fields if f.name in (*OFFER_TEXTS, "collected_at")]
_PASSED = T.StructType([T.StructField("seq", T.LongType()), T.StructField("keys", T.IntegerType()), *_PAYLOAD])
_EVENT = T.StructType([T.StructField("key", T.StringType()), T.StructField("added", T.LongType()), T.StructField("taken", T.LongType()), *_PASSED.fields])


class LivingKeys(StatefulProcessor):
    """Per key the last versions that added it and took it away; it is alive if it was added later.

    The changes of a batch count before its candidates, in whatever order its rows come. Candidates wait for that in memory, up to
    ``in_memory`` of one key, and beyond that in the state store, which lets go of them at the end of the batch.
    """

    def __init__(self, in_memory: int) -> None:
        self._in_memory = in_memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._at = handle.getValueState("at", "added long, taken long")
        self._waiting = handle.getListState("waiting", _PASSED)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        added, taken = before = self._at.get() if self._at.exists() else (0, 0)
        names = _PASSED.fieldNames()
        held: list[tuple] = []
        spilled = False
        for row in rows:
            if row["seq"] is None:
                added, taken = max(added, row["added"] or 0), max(taken, row["taken"] or 0)
                continue
            held.append(tuple(row[name] for name in names))
            if len(held) >= self._in_memory:
                self._waiting.appendList(held)
                held, spilled = [], True
        if (added, taken) != tuple(before):
            self._at.update((added, taken))
        if added <= taken:
            for values in held:
                yield Row(**dict(zip(names, values)))
            for values in self._waiting.get() if spilled else ():
                yield Row(**dict(zip(names, values)))
        if spilled:
            self._waiting.clear()

    def close(self) -> None:
        pass


def _events(rows: DataFrame, **columns) -> DataFrame:
    return rows.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _EVENT.fields])


def _changes(spark: SparkSession, store: OfferStore, table: str, column: str) -> DataFrame:
    """A changelog of the store as events of both keys."""
    path = f"{store.root}/{table}"
    folder = Folder(spark, path)
    folder.ensure()
    log = spark.readStream.schema("id string, url string, batch_id long").parquet(path)
    keys = F.array(F.concat(F.lit("i"), "id"), F.when(F.col("url") != "", F.concat(F.lit("u"), "url")))
    rows = log.select(F.explode(F.array_compact(keys)).alias("key"), "batch_id")
    return _events(rows, key=F.col("key"), **{column: F.col("batch_id")})


def _candidates(offers: DataFrame) -> DataFrame:
    """A candidate as an event of its URL, which carries the offer, and one of its id."""
    values = {f.name: F.col(f.name) for f in _PAYLOAD}
    number = F.when(F.col("id").isNull(), 1).otherwise(2)
    by_url = _events(offers, key=F.concat(F.lit("u"), "url"), seq=F.col("seq"), keys=number, **values)
    by_id = _events(offers.where(F.col("id").isNotNull()), key=F.concat(F.lit("i"), "id"), seq=F.col("seq"), keys=number)
    return by_url.unionByName(by_id)


def ingest_stateful(
    rows: DataFrame,
    to_candidates: Callable[[DataFrame], DataFrame],
    store: OfferStore,
    forbidden_terms: list[str],
    checkpoint: str,
    writer: str,
    trigger: str = "0 seconds",
) -> StreamingQuery:
    """Feed a stream of landed rows into the store; the query runs until it is stopped.

    ``to_candidates`` turns the stream of landed rows into stored offers with a unique ``seq`` and ``collected_at``, row by row. Other
    writers may add and delete meanwhile: the store compares what the state could not know yet. A batch without
    candidates publishes nothing; a batch that runs again finds what it published.
    """
    spark = rows.sparkSession
    ship_package(spark)
    offers = without_forbidden_terms(with_url(to_candidates(rows)), forbidden_terms)
    events = _candidates(offers).unionByName(_changes(spark, store, "keys", "added")).unionByName(_changes(spark, store, "gone", "taken"))
    passed = events.groupBy("key").transformWithState(LivingKeys(IN_MEMORY), _PASSED, "Append", "none")

    def add(batch: DataFrame, batch_id: int) -> None:
        with staging_scope(batch.sparkSession):
            staged = stage(batch, "stream-passed")
            if not staged.rows:
                return
            counted = staged.table.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.max("keys").alias("keys"))
            free = stage(counted.where(F.col("n") == F.col("keys")).select("seq"), "stream-free").table
            wide = staged.table.where(F.col("url").isNotNull()).join(free, "seq", "left_semi")
            narrow = wide.select("seq", "id", "url")

            def choose(keys_for: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
                admission = admit(narrow, keys_for(narrow))
                return wide.join(admission.kept, "seq", "left_semi") if admission.count else None

            store.insert(writer, batch_id, choose, judged_at=_known_before(store, writer, batch_id))

    kept = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        return (
            passed.writeStream.foreachBatch(add)
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(processingTime=trigger)
            .start()
        )
    finally:  # the query has its own copy of the settings
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _known_before(store: OfferStore, writer: str, batch_id: int) -> int:
    """A version whose changes, and all earlier ones, the state held before this batch began.

    What batch n published was there when batch n + 1 listed the changelogs, and so is in the state when batch n + 2 begins.
    """
    return store.latest_of(writer, batch_id - 2)


def catch_up(query: StreamingQuery) -> None:
    """Process all there is, the changes that this causes included, then stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
