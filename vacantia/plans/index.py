"""An index of the keys of living offers, as of one version.

Ids and URLs are two tables, each hashed into ``BUCKETS`` files by Spark's own bucketing, with a Bloom filter beside them that is
itself a small table: one 64-bit word per (bucket, word). A batch of candidates first meets the words, which are a small part of
the keys' size; only buckets in which some candidate may be known are opened after that. Where most buckets are hit, the bucketed table
is joined as it lies, without an exchange on its side.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.staging import stage

BUCKETS = 64
# Bits per key are about 64 * WORDS * BUCKETS / keys; the words are chosen by the number of keys when an index is written.
KEYS_PER_WORD = 6
_PROBES = 3
KINDS = ("id", "url")
_SCHEMAS = {"id": "id string", "url": "url string, id string"}


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    """The number that Spark's bucketing gives a key."""
    return F.expr(f"pmod(hash({key}), {buckets})")


def write_bucketed(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Files by bucket, one per bucket, sorted by key. The table name is only needed while writing."""
    name = f"vacantia_{hashlib.md5(path.encode()).hexdigest()}_writing"
    writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet")
    writer.saveAsTable(name)
    rows.sparkSession.sql(f"drop table {name}")


def read_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """The files as a bucketed table, so that a join by key leaves them where they are."""
    name = f"vacantia_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"create table if not exists {name} ({schema}) using parquet clustered by ({key}) sorted by ({key}) into {buckets} buckets location '{path}'"
        )
    return spark.table(name)


def read_buckets(spark: SparkSession, path: str, schema: str, numbers: list[int]) -> DataFrame:
    """The files of some buckets only; Spark puts the bucket's number into the file's name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    marks = tuple(f"_{number:05d}.c" for number in numbers)
    wanted = [str(f.getPath()) for f in files if any(mark in f.getPath().getName() for mark in marks)]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*wanted)


def _word(key: str, words: int) -> Column:
    return F.expr(f"cast(pmod(xxhash64({key}), {words}) as int)")


def _bits(key: str) -> Column:
    """The bits of a key in its word."""
    out = F.lit(0).cast("long")
    for probe in range(_PROBES):
        out = out.bitwiseOR(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}, {probe}), 64) as int))"))
    return out


@dataclass(frozen=True)
class KeyIndex:
    """An index written under ``path``; ``words`` per bucket by kind of key."""

    spark: SparkSession
    path: str
    words: dict[str, int]
    buckets: int = BUCKETS

    @staticmethod
    def write(living: DataFrame, path: str, buckets: int = BUCKETS) -> KeyIndex:
        """Index (id, url) of living offers; offers without a URL have no URL key."""
        words = {}
        for kind in KINDS:
            rows = living.select("id") if kind == "id" else living.where(F.col("url") != "").select("url", "id")
            write_bucketed(rows, f"{path}/{kind}", kind, buckets)
            table = living.sparkSession.read.schema(_SCHEMAS[kind]).parquet(f"{path}/{kind}")
            words[kind] = max(1, -(-table.count() // (KEYS_PER_WORD * buckets)))
            filled = table.groupBy(bucket_of(kind, buckets).alias("bucket"), _word(kind, words[kind]).alias("word"))
            filled.agg(F.bit_or(_bits(kind)).alias("bits")).write.parquet(f"{path}/{kind}-bloom")
        return KeyIndex(living.sparkSession, path, words, buckets)

    def bloom(self, kind: str) -> DataFrame:
        return self.spark.read.schema("bucket int, word int, bits long").parquet(f"{self.path}/{kind}-bloom")

    def suspected(self, keys: DataFrame, kind: str) -> DataFrame:
        """(key, bucket) of the distinct ``keys`` (one column named after its kind) that the index may hold."""
        probes = keys.where(F.col(kind).isNotNull()).select(
            kind, bucket_of(kind, self.buckets).alias("bucket"), _word(kind, self.words[kind]).alias("word"), _bits(kind).alias("_bits")
        )
        met = probes.join(self.bloom(kind), ["bucket", "word"])
        return met.where(F.col("_bits").bitwiseAND(F.col("bits")) == F.col("_bits")).select(kind, "bucket")

    def known(self, candidates: DataFrame, kind: str) -> DataFrame:
        """The index's rows with a key of ``candidates``: (id) or (url, id)."""
        asked = stage(self.suspected(candidates.select(kind).distinct(), kind), f"index-{kind}").table
        hit = sorted(row["bucket"] for row in asked.select("bucket").distinct().collect())  # at most the number of buckets
        if 2 * len(hit) > self.buckets:
            rows = read_bucketed(self.spark, f"{self.path}/{kind}", _SCHEMAS[kind], kind, self.buckets)
        else:
            rows = read_buckets(self.spark, f"{self.path}/{kind}", _SCHEMAS[kind], hit)
        return rows.join(asked.select(kind), kind, "left_semi")
