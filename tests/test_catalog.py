"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import glob

import oracle
import pytest

import __spark_entry__ as contract
from vacantia.catalog import registry, sources
from vacantia.staging import shared_folder

# Queries of other folders have tests of their own.
QUERIES = {name: run for name, run in contract.queries().items() if name in registry.QUERIES}
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return oracle.duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    frame = QUERIES[name](spark, small)
    if name in ORACLES:
        assert oracle.compare(frame, duck, ORACLES[name]) is None
    else:
        assert not frame.isEmpty()


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_stream_reads_a_table_of_many_files(spark, small, duck, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert oracle.compare(QUERIES["stream_ingest"](spark, str(tmp_path)), duck, ORACLES["stream_ingest"]) is None


def test_stateful_stream_lands_no_part_through_one_task(spark, small, duck, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    pattern = f"{shared_folder(spark)}/vacantia/stream-parts-*"
    before = set(glob.glob(pattern))
    assert oracle.compare(QUERIES["stream_stateful"](spark, str(tmp_path)), duck, ORACLES["stream_stateful"]) is None
    (landed,) = set(glob.glob(pattern)) - before
    assert all(len(glob.glob(f"{landed}/part{part}/*.parquet")) == 3 for part in range(4))


def test_pages_are_derived_in_one_pass(spark, small):
    """The copies of a page come from the page, not from further passes over the line items; which copies there are stays the same."""
    tables = registry.Tables(spark, small)
    pages = sources._pages(tables)
    assert pages._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    first = sources._landed_once(tables)
    first = first.withColumn("page", first.page + ((first.request_no % 5 == 0) & (first.page >= 2)).cast("int"))
    again = first.where("request_no % 3 = 0")
    expected = first.unionByName(again.selectExpr("request_no", "page", "500 as status", "slice(results, 1, 1) as results"))
    expected = expected.unionByName(again.where("page % 2 = 1"))
    got = pages.select(expected.columns)
    assert got.count() == expected.count() and got.exceptAll(expected).isEmpty()
