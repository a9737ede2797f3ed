"""Append-only state: offers, scores, status changes, deletions, runs.

Plain Parquet has no row updates, so a change is a new row with a version, and the current
table is a view. A version is an entry of the commit log: what a batch writes lies in folders that no reader looks into until the
batch is published, by one exclusive rename, as the next version. Versions therefore follow the order of publishing. A
(writer, batch) is published once; running it again finds its version and writes nothing.

Offers have two unique keys. ``insert`` chooses rows by the state it saw, and publishes them only as the version right behind
that state. If another writer was first, the keys published since are compared: rows that share none go behind
them, otherwise the rows are chosen again. So the keys hold against any number of writers, and no writer waits for another.

``snapshot`` writes the state as of a version, bucketed by id, and an index of its keys. From then on the current
state is that snapshot with the later versions laid over it, and earlier history is not read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia import schemas
from vacantia.functions.labels import status_or_default
from vacantia.plans.commits import CommitLog
from vacantia.plans.index import BUCKETS, KeyIndex, read_bucketed, write_bucketed
from vacantia.staging import CODEC

_KEYS = T.StructType([T.StructField("id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("version", T.LongType())])
# ``keys`` and ``gone`` are the changes of the set of living keys: what each version added, and what it took away.
TABLES: dict[str, T.StructType] = {
    "offers": schemas.OFFER,
    "keys": _KEYS,
    "gone": _KEYS,
    "scores": schemas.SCORE,
    "status_changes": schemas.STATUS_CHANGE,
    "tombstones": schemas.TOMBSTONE,
    "runs": schemas.RUN,
}
_BATCH = "batch_id"
# A run's row names the version of the offers it added; everywhere else the version is that of the folder.
_OWN_VERSION = ("runs",)
SCORE_COLUMNS = [c for c in schemas.SCORE.fieldNames() if c not in ("id", "version")]
STATE = T.StructType([*schemas.OFFER.fields, *[f for f in schemas.SCORE.fields if f.name in SCORE_COLUMNS], T.StructField("statut", T.StringType())])


def latest_change(changes: DataFrame, *columns: str) -> DataFrame:
    """The change with the highest version of each id.

    Only (id, version) is aggregated; the wide columns then meet the one version that counts. A batch holds
    one change per id, see ``OfferStore.set_status``.
    """
    newest = changes.groupBy("id").agg(F.max("version").alias("version"))
    latest = changes.select("id", "version", *columns).join(newest, ["id", "version"])
    return latest.select("id", F.col("version").alias("_changed_at"), *columns)


def current_offers(
    offers: DataFrame, scores: DataFrame, status_changes: DataFrame, tombstones: DataFrame
) -> DataFrame:
    """Living offers with their latest score and status.

    An offer lives if it was inserted after its last deletion, and only changes later than
    that insertion apply, so an offer that returns starts afresh. Admission keeps living
    ids unique, hence the wide offers need no aggregation: they meet the reduced changes
    on one key, and cross one shuffle at most.

    ``offers`` may also hold the score and status of an earlier state (a snapshot); a later change replaces them.
    """
    deleted = tombstones.groupBy("id").agg(F.max("version").alias("_deleted_at"))
    alive = offers.join(deleted, "id", "left").where(
        F.col("_deleted_at").isNull() | (F.col("version") > F.col("_deleted_at"))
    )
    score = latest_change(scores, *SCORE_COLUMNS).withColumnRenamed("_changed_at", "_scored_at")
    status = latest_change(status_changes, "statut").withColumnRenamed("_changed_at", "_moved_at")
    for column in (*SCORE_COLUMNS, "statut"):
        if column in offers.columns:
            alive = alive.withColumnRenamed(column, f"_{column}")

    def applied(column: str, changed_at: str) -> Column:
        earlier = F.col(f"_{column}") if column in offers.columns else F.lit(None)
        return F.when(F.col(changed_at) > F.col("version"), F.col(column)).otherwise(earlier).alias(column)

    return (
        alive.join(score, "id", "left")
        .join(status, "id", "left")
        .select(
            *[c for c in offers.columns if c not in (*SCORE_COLUMNS, "statut")],
            *[applied(c, "_scored_at") for c in SCORE_COLUMNS],
            status_or_default(applied("statut", "_moved_at")).alias("statut"),
        )
    )


def with_status_column(offers: DataFrame) -> DataFrame:
    """Rows written before the status column existed take the default."""
    status = F.col("statut") if "statut" in offers.columns else F.lit(None).cast("string")
    return offers.withColumn("statut", status_or_default(status))


def _living(keys: DataFrame, tombstones: DataFrame) -> DataFrame:
    deleted = tombstones.groupBy("id").agg(F.max("version").alias("_deleted_at"))
    alive = F.col("_deleted_at").isNull() | (F.col("version") > F.col("_deleted_at"))
    return keys.join(deleted, "id", "left").where(alive).select("id", "url")


class OfferStore:
    """The state tables under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._log = CommitLog(spark, f"{self.root}/_commits")
        self._snapshots = CommitLog(spark, f"{self.root}/_snapshots/log")

    # --- versions ---------------------------------------------------------------------------

    def last(self) -> int:
        """The last version; what it and earlier ones wrote is where readers look for it."""
        for version in self._log.refresh():
            self._settle(version)
        return self._log.last()

    def version_of(self, writer: str, batch: int) -> int | None:
        """The version of a writer's batch, if it is published."""
        self.last()
        return self._log.find(writer, batch)

    def latest_of(self, writer: str, batch: int) -> int:
        """The last version that a writer published for a batch up to ``batch``; 0 if there is none."""
        self.last()
        return self._log.latest(writer, batch)

    def _path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/{_BATCH}={version}"

    def _settle(self, version: int) -> None:
        """Move what a published version wrote to its place; any reader may do it, if the writer died before."""
        for table, folder in self._log.entry(version)["tables"].items():
            self._log.folder.move(f"{self.root}/{table}/{folder}", self._path(table, version))

    def _write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Write rows where no reader looks; the folders by table."""
        folders = {}
        for table, rows in tables.items():
            fields = [f for f in TABLES[table] if f.name != "version" or table in _OWN_VERSION]
            folder = f"_new-{uuid.uuid4().hex}"
            out = rows.select(*[F.col(f.name).cast(f.dataType) for f in fields])
            out.write.option("compression", CODEC).parquet(f"{self.root}/{table}/{folder}")
            folders[table] = folder
        return folders

    def _publish(self, writer: str, batch: int, after: int, folders: dict[str, str]) -> int | None:
        version = self._log.publish(writer, batch, after, tables=folders)
        if version is not None:
            self._settle(version)
        return version

    def commit(self, writer: str, batch: int, **tables: DataFrame) -> int:
        """Publish rows that no unique key binds: scores, status changes, deletions, runs."""
        done = self.version_of(writer, batch)
        if done is not None:
            return done
        if "offers" in tables:
            raise ValueError("offers are added with insert()")
        return self._behind(writer, batch, self._write(tables))

    def _behind(self, writer: str, batch: int, folders: dict[str, str]) -> int:
        while True:
            version = self._publish(writer, batch, self.last(), folders)
            if version is not None:
                return version
            done = self.version_of(writer, batch)  # the same batch, run twice at a time
            if done is not None:
                self._remove(folders)
                return done

    def insert(
        self, writer: str, batch: int, choose: Callable[[Callable[[DataFrame], DataFrame]], DataFrame | None], judged_at: int | None = None
    ) -> int:
        """Add the offers that ``choose`` picks and publish them as one version, which keeps both keys unique.

        ``choose`` gets a function from candidates (id, url) to the living keys they may meet, and returns offers of which
        no two and no living one share a key, or None for none. It is called again when another writer was first with a
        key. For a batch that is published already it is called once with the state before that version, and nothing is written.

        Candidates that were already held against the state of a version, ``judged_at``, meet no key at first.
        """
        done = self.version_of(writer, batch)
        if done is not None:
            choose(lambda candidates: self.keys_for(candidates, before=done))
            return done
        while True:
            if judged_at is None:
                seen = self.last()
                rows = choose(lambda candidates, seen=seen: self.keys_for(candidates, before=seen + 1))
            else:
                seen, judged_at = judged_at, None
                rows = choose(lambda candidates: candidates.select("id", "url").limit(0))
            folders = {}
            if rows is not None:
                folders = self._write({"offers": rows})
                written = self.spark.read.schema(schemas.OFFER).parquet(f"{self.root}/offers/{folders['offers']}")
                folders |= self._write({"keys": written.select("id", "url")})
            while True:
                newest = self.last()
                if newest > seen and folders and self._collides(folders["keys"], seen, newest):
                    break
                seen = newest
                version = self._publish(writer, batch, seen, folders)
                if version is not None:
                    return version
                done = self.version_of(writer, batch)  # the same batch, run twice at a time
                if done is not None:
                    self._remove(folders)
                    return done
            self._remove(folders)

    def _remove(self, folders: dict[str, str]) -> None:
        for table, folder in folders.items():
            self._log.folder.delete(f"{self.root}/{table}/{folder}")

    def _collides(self, folder: str, after: int, upto: int) -> bool:
        """Does a version published since hold a key of the rows in ``folder``?"""
        mine = self.spark.read.schema("id string, url string").parquet(f"{self.root}/keys/{folder}")
        theirs = self.read("keys", before=upto + 1, after=after)
        ids = theirs.select("id").join(mine.select("id"), "id", "left_semi")
        urls = theirs.where(F.col("url") != "").select("url").join(mine.select("url"), "url", "left_semi")
        return not ids.select(F.lit(1).alias("one")).unionAll(urls.select(F.lit(1).alias("one"))).isEmpty()

    # --- reading ----------------------------------------------------------------------------

    def read(self, table: str, before: int | None = None, only: int | None = None, after: int | None = None, drop_joins: bool = True) -> DataFrame:
        """A table, what it held before a version, what came after one, or one version; only these folders are opened.

        Joins with a table without a folder leave the plan if they may; this also gives up the buckets that the other side lies in.
        """
        self.last()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            if not drop_joins:
                return self.spark.createDataFrame([], TABLES[table])
            # Known to be empty when a join is planned, so that nothing is shuffled to meet it.
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])
        fields = [f for f in TABLES[table] if f.name != "version" or table in _OWN_VERSION]
        rows = self.spark.read.schema(T.StructType([*fields, T.StructField(_BATCH, T.LongType())])).parquet(f"{self.root}/{table}")
        for limit, at in ((F.col(_BATCH) < before, before), (F.col(_BATCH) == only, only), (F.col(_BATCH) > after, after)):
            if at is not None:
                rows = rows.where(limit)
        if table not in _OWN_VERSION:
            rows = rows.withColumn("version", F.col(_BATCH))
        return rows.select(*TABLES[table].fieldNames())

    def _snapshot_before(self, before: int) -> dict | None:
        """The newest snapshot of a state before a version."""
        number = self._snapshots.last()
        while number and self._snapshots.entry(number)["upto"] >= before:
            number -= 1
        return self._snapshots.entry(number) if number else None

    def current(self, before: int | None = None) -> DataFrame:
        """Living offers with score and status, now or before a version: the snapshot and what came after it."""
        before = self.last() + 1 if before is None else before
        base = self._snapshot_before(before)
        after = base["upto"] if base else None
        offers, *changes = [self.read(t, before, after=after) for t in ("offers", "scores", "status_changes", "tombstones")]
        later = current_offers(offers, *changes)
        if base is None:
            return later
        kept = read_bucketed(self.spark, f"{base['folder']}/state", _ddl(STATE), "id", base["buckets"])
        # The snapshot is read by its buckets, whether there are changes or not.
        changes = [self.read(t, before, after=after, drop_joins=False) for t in ("scores", "status_changes", "tombstones")]
        return current_offers(kept, *changes).unionByName(later)

    def alive_keys(self, before: int | None = None) -> DataFrame:
        """Ids and URLs of living offers, without touching scores or wide columns."""
        before = self.last() + 1 if before is None else before
        base = self._snapshot_before(before)
        after = base["upto"] if base else None
        gone = self.read("tombstones", before, after=after)
        later = _living(self.read("keys", before, after=after), gone)
        if base is None:
            return later
        kept = read_bucketed(self.spark, f"{base['folder']}/state", _ddl(STATE), "id", base["buckets"]).select("id", "url", "version")
        return _living(kept, gone).unionByName(later)

    def keys_for(self, candidates: DataFrame, before: int | None = None) -> DataFrame:
        """The living keys that candidates (id, url) may meet: of the snapshot only from the index's hit buckets.

        A row may hold an id or a URL alone, with null for the other.
        """
        before = self.last() + 1 if before is None else before
        base = self._snapshot_before(before)
        if base is None:
            return self.alive_keys(before)
        gone = self.read("tombstones", before, after=base["upto"]).select("id").distinct()
        later = _living(self.read("keys", before, after=base["upto"]), self.read("tombstones", before, after=base["upto"]))
        index = KeyIndex(self.spark, f"{base['folder']}/keys", base["words"], base["buckets"])
        ids = index.known(candidates, "id").join(gone, "id", "left_anti").select("id", F.lit(None).cast("string").alias("url"))
        urls = index.known(candidates.where(F.col("url") != ""), "url").join(gone, "id", "left_anti").select(F.lit(None).cast("string").alias("id"), "url")
        return ids.unionByName(urls).unionByName(later)

    # --- changes ----------------------------------------------------------------------------

    def set_status(self, changes: DataFrame, batch: int, writer: str = "status") -> int:
        """Append (id, statut) changes, one per id; returns their version."""
        if not changes.groupBy("id").count().where(F.col("count") > 1).isEmpty():
            raise ValueError("one batch changes an id once")
        return self.commit(writer, batch, status_changes=changes)

    def delete(self, ids: DataFrame, batch: int, writer: str = "delete") -> int:
        """Append deletions by id; returns their version. A deleted offer may be collected again later.

        The keys that this takes away are written beside it. They are looked up again if another version came first.
        """
        while (done := self.version_of(writer, batch)) is None:
            seen = self.last()
            gone = ids.select("id").distinct()
            folders = self._write({"tombstones": gone, "gone": self.alive_keys(before=seen + 1).join(gone, "id", "left_semi")})
            version = self._publish(writer, batch, seen, folders)
            if version is not None:
                return version
            self._remove(folders)
        return done

    # --- snapshots --------------------------------------------------------------------------

    def snapshot(self, buckets: int = BUCKETS) -> int:
        """Write the state as of the last version and the index of its keys; returns that version.

        Versions up to it never change, so nothing has to be held still meanwhile. Readers use it once it is published, and a
        snapshot that is not finished is never looked at. Of two at a time, the one of the later version counts.
        """
        upto = self.last()
        folder = f"{self.root}/_snapshots/{uuid.uuid4().hex}"
        write_bucketed(self.current(before=upto + 1).select(*STATE.fieldNames()), f"{folder}/state", "id", buckets)
        kept = self.spark.read.schema(STATE).parquet(f"{folder}/state")
        index = KeyIndex.write(kept.select("id", "url"), f"{folder}/keys", buckets)
        while True:
            last = self._snapshots.last()
            if last and self._snapshots.entry(last)["upto"] >= upto:
                self._log.folder.delete(folder)
                return upto
            if self._snapshots.publish("snapshot", upto, last, upto=upto, folder=folder, words=index.words, buckets=buckets):
                return upto

    def compact(self, new_root: str) -> OfferStore:
        """Write the current state into a new, empty folder; the old one stays as it is.

        The copy's offers are one version, and all changes to them a later one, so that these still follow the offers they belong to.
        """
        fresh = OfferStore(self.spark, new_root)
        if fresh.last():
            raise ValueError("compact into an empty folder")
        current = self.current()
        fresh.insert("compact", 0, lambda keys_for: current)
        scored = current.where(F.col("score").isNotNull())
        fresh.commit("compact", 1, scores=scored, status_changes=current.select("id", "statut"), runs=self.read("runs"))
        return fresh


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
