"""Session settings that suit the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Batches that go to Python are cut by bytes: cut by rows alone, long texts make batches of any size.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SETTINGS = {
    _BATCH_BYTES: "8m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(name: str = "vacantia", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; a cluster submit supplies master and sizes."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, and bound the batches they get.

    A cluster submit may pass the package with ``--py-files`` instead. A bound that the session has set stays.
    """
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, SETTINGS[_BATCH_BYTES])
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="vacantia-package-"), "vacantia.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)
