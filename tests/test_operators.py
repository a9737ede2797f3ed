"""Operators against small brute-force versions, and their plans."""

from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from vacantia.functions.ids import arrival_order
from vacantia.operators import admission, components, dedup, documents, filters, metrics, ranking
from vacantia.sources import landing, pages, readers, requests


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )


# --- admission ----------------------------------------------------------------------------


def sqlite_kept(rows, stored=()):
    base = sqlite3.connect(":memory:")
    base.execute("create table o (seq integer, id text primary key, url text unique)")
    base.executemany("insert or ignore into o values (?, ?, ?)", [(-1 - i, *s) for i, s in enumerate(stored)])
    for row in sorted(rows):
        base.execute("insert or ignore into o values (?, ?, ?)", row)
    return [r[0] for r in base.execute("select seq from o where seq >= 0 order by seq")]


def kept(admitted):
    assert admitted.count == admitted.kept.count()
    return [r.seq for r in admitted.offers.select("seq").orderBy("seq").collect()]


def conflicting_rows(seed, size=150):
    rng = random.Random(seed)
    return [
        (i, f"i{rng.randint(0, size // 3)}", rng.choice([None, "", *[f"u{k}" for k in range(size // 3)]])) for i in range(size)
    ]


SCHEMA = "seq bigint, id string, url string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_admission_equals_sqlite(spark, seed):
    rows = conflicting_rows(seed)
    random.Random(seed).shuffle(rows)
    stored = [("i1", "u2"), ("i3", "u4"), ("x", None), ("y", "u5")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert kept(admission.admit(frame)) == sqlite_kept(rows)
    held = spark.createDataFrame(stored, "id string, url string")
    assert kept(admission.admit(frame, held)) == sqlite_kept(rows, stored)


def test_admission_of_a_hot_url_and_a_hot_id(spark):
    rows = [(i, f"i{i}", "hot") for i in range(60)] + [(100 + i, "hot", f"u{i}") for i in range(60)]
    rows += [(200 + i, f"i{i % 40}", f"u{i % 50}") for i in range(80)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert kept(admission.admit(frame)) == sqlite_kept(rows)


def jobs_of(spark, run):
    """Jobs that ``run`` starts."""
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")


def chain(length, start=0):
    """Each row conflicts with the one before, by id and by url in turn."""
    return [(start + i, f"i{start}-{(i + 1) // 2}", f"u{start}-{i // 2}") for i in range(length)]


def test_long_chains_are_walked_by_component(spark):
    rows = chain(60) + chain(31, 1000) + [(5000 + i, f"h{i}", "hot") for i in range(40)]
    got = admission.admit(spark.createDataFrame(rows, SCHEMA), most_rounds=2)
    assert got.rounds == 3
    assert kept(got) == sqlite_kept(rows)


def test_jobs_do_not_grow_with_the_chain(spark):
    def jobs(length):
        frame = spark.createDataFrame(chain(length), SCHEMA)
        return jobs_of(spark, lambda: admission.admit(frame, most_rounds=1))

    # Components take a few more rounds for a longer path: its logarithm, not its length.
    assert jobs(400) <= jobs(50) + 60


@pytest.mark.parametrize("rows", [[(1, "a", "u"), (1, "b", "u")], [(None, "a", "u"), (2, "b", "v")]])
def test_order_must_be_set_and_unique(spark, rows):
    with pytest.raises(ValueError):
        admission.admit(spark.createDataFrame(rows, SCHEMA))


def test_stored_rows_without_url_block_nothing_by_it(spark):
    held = spark.createDataFrame([("x", "")] * 3 + [("y", None)], "id string, url string")
    got = admission.admit(spark.createDataFrame([(1, "a", ""), (2, "x", "u")], SCHEMA), held)
    assert kept(got) == [1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, 300 + i) for i in range(1, 30)]
    parent = {n: n for pair in pairs for n in pair}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    in_pair = {n for a, b in pairs if a != b for n in (a, b)}
    frame = spark.createDataFrame([*pairs, (None, 1)], "a int, b int")
    got = [(r.node, r.component) for r in components.components(frame).collect()]
    assert sorted(got) == sorted((n, root(n)) for n in in_pair)


def test_admission_of_nothing(spark):
    empty = admission.admit(spark.createDataFrame([], SCHEMA))
    assert empty.count == 0 and empty.offers.isEmpty()
    same = spark.createDataFrame([(1, "a", "u")], SCHEMA)
    again = admission.admit(same, same.select("id", "url"))
    assert again.count == 0 and again.offers.isEmpty()


def test_admission_does_not_depend_on_partitions(spark):
    frame = spark.createDataFrame(conflicting_rows(9), SCHEMA)
    assert kept(admission.admit(frame.repartition(1))) == kept(admission.admit(frame.repartition(13)))


# --- anti joins -----------------------------------------------------------------------------


def test_known_urls_are_planned_without_a_job(spark):
    rows = spark.range(300).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("url"))
    stored = spark.createDataFrame([("hot",), ("k3",), ("",), ("k3",)], "url string")
    built = []
    assert jobs_of(spark, lambda: built.append(admission.without_known_urls(rows, stored))) == 0
    assert {r.seq for r in built[0].collect()} == {i for i in range(0, 300, 3) if i != 3}


def test_known_urls(spark):
    candidates = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b"), (5, "a")], "seq int, url string")
    stored = spark.createDataFrame([("a",), (None,), ("c",)], "url string")
    kept_rows = admission.without_known_urls(candidates, stored)
    assert [r.seq for r in kept_rows.collect()] == [4]
    assert "LeftAnti" in plan_of(kept_rows) and "Cartesian" not in plan_of(kept_rows)


# --- de-duplication ----------------------------------------------------------------------------


def test_last_value_keeps_first_place(spark):
    rows = [(1, "fr", "a", "x"), (2, "fr", None, "y"), (3, "fr", "a", "z"), (4, "fr", "", "w"), (5, "gb", "a", "v")]
    frame = spark.createDataFrame(rows, "seq bigint, target string, id string, value string")
    got = {(r.target, r.value, r.place) for r in dedup.last_value_first_place(frame).collect()}
    assert got == {("fr", "z", 1), ("fr", "w", 2), ("gb", "v", 5)}


def test_first_and_lowest_by_url_differ_in_empty_urls(spark):
    rows = [(1, "a"), (2, None), (3, "a"), (4, ""), (5, None), (6, "")]
    frame = spark.createDataFrame(rows, "seq bigint, url string")
    assert sorted(r.seq for r in dedup.first_by_url(frame).collect()) == [1]
    # Null and '' are one group each; null never equals itself in a join, so rows are picked by seq.
    assert sorted(r.seq for r in dedup.keep_lowest_by_url(frame).collect()) == [1, 2, 4]


def test_deduplication_combines_before_the_shuffle(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("url")
    )
    plan = plan_of(dedup.first_by_url(orders))
    assert "partial_min" in plan and "Window" not in plan and "SortAggregate" not in plan


def test_arrival_order(spark):
    rows = [(0, 0, 5), (0, 1, 0), (0, 1, 2**31 - 1), (0, 2**30 - 1, 0), (1, 0, 0), (2, 0, 0), (3, 2**30 - 1, 2**31 - 1)]
    frame = spark.createDataFrame(rows, "s int, r bigint, p bigint")
    order = [r[0] for r in frame.select(arrival_order(F.col("s"), F.col("r"), F.col("p"))).collect()]
    assert order == sorted(order) and len(set(order)) == len(order) and order[0] >= 0


# --- sources --------------------------------------------------------------------------------------


def test_page_prefix(spark):
    rows = [
        ("a", 1, 200, 50), ("a", 2, 200, 50), ("a", 3, 200, 10), ("a", 4, 200, 50), ("b", 1, 500, 0), ("b", 2, 200, 50),
        ("c", 1, 200, 0), ("c", 2, 200, 50), ("d", 1, 200, 50), ("d", 2, 500, 50), ("d", 3, 200, 50), ("e", 1, None, 50),
    ]
    frame = spark.createDataFrame(rows, "request_no string, page int, status int, n int").select(
        "request_no", "page", "status", F.when(F.col("n") > 0, F.sequence(F.lit(1), "n")).alias("results")
    )
    kept_pages = pages.ingest_pages(frame, 1000).groupBy("request_no").agg(
        F.sort_array(F.collect_set("page")).alias("pages"), F.max("position").alias("last")
    )
    assert {r.request_no: (r.pages, r.last) for r in kept_pages.collect()} == {"a": ([1, 2, 3], 109), "d": ([1], 49)}
    capped = pages.ingest_pages(frame.where("request_no = 'a'"), 60)
    assert capped.count() == 60 and capped.agg(F.max("page")).first()[0] == 2
    assert pages.ingest_pages(frame, 0).isEmpty()
    # With 25 results wanted, 25 are asked for per page: a page of 50 ends nothing and is cut.
    assert pages.ingest_pages(frame.where("request_no = 'a'"), 25).count() == 25


def test_search_plan(spark):
    rows = [(1, '["a", "b"]'), (2, '"c"'), (3, "[]"), (4, '""'), (5, "null"), (6, None)]
    plan = requests.search_plan(spark.createDataFrame(rows, "target_no int, mots_cles string"), "défaut")
    got = [(r.target_no, r.keyword_no, r.mot_cle) for r in plan.orderBy("target_no", "keyword_no").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "défaut"), (4, 0, "défaut"), (5, 0, "défaut"), (6, 0, "défaut")]


def test_source_b_company_and_id(spark):
    items = [
        '{"id": "1", "entreprise": {"nom": "A"}, "intitule": "x"}', '{"id": 2, "entreprise": "B"}', '{"id": "3", "entreprise": null}',
        '{"id": "4"}', "pas du json", '{"entreprise": "C"}', '{"id": 0}', '{"id": ""}', '{"id": null}', '{"id": "0"}',
        '{"id": "5", "entreprise": {}}', '{"id": "6", "entreprise": "{\\"nom\\": 1}"}',
    ]
    got = readers.read_b(spark.createDataFrame([(i,) for i in items], "item string")).collect()
    assert [(r.url.rsplit("/", 1)[1], r.entreprise) for r in got] == [
        ("1", "A"), ("2", "B"), ("3", ""), ("4", ""), ("0", ""), ("5", ""), ("6", '{"nom": 1}'),
    ]
    assert got[0].titre == "x" and got[1].titre == "" and got[0].source == "apec"


def test_source_c(spark):
    rows = [("j", "u", None, "d2"), (None, "u", "d", "d2"), ("", None, "d", None), (None, "", "d", None), ("", "u2", "", None)]
    frame = spark.createDataFrame(rows, "job_url string, url string, description string, job_description string").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("title", "company", "location", "date_posted")]
    )
    got = [(r.url, r.description, r.titre) for r in readers.read_c(frame).collect()]
    assert got == [("j", "d2", ""), ("u", "d", ""), ("u2", "", "")]


def test_union_fills_missing_columns(spark):
    b = spark.createDataFrame([("t", "u", "apec", "10 k", None)], "titre string, url string, source string, salaire string, type_contrat string")
    c = spark.createDataFrame([("t2", "u2", "indeed")], "titre string, url string, source string")
    got = {r.titre: (r.salaire, r.type_contrat, r.description) for r in readers.union_external(b, c).collect()}
    assert got == {"t": ("10 k", "", ""), "t2": ("", "", "")}


def test_rejected_first_copy_takes_the_clean_one_with_it(spark):
    rows = [(1, "commercial", "u"), (2, "dev", "u"), (3, "dev", "v")]
    first = dedup.first_by_url(spark.createDataFrame(rows, "seq bigint, intitule string, url string").withColumn("description", F.lit("")))
    assert [r.seq for r in filters.without_forbidden_terms(first, ["Commercial"]).collect()] == [3]


# --- ranks, metrics, documents ------------------------------------------------------------------------


def test_rank_of_a_hot_score(spark):
    rows = spark.range(3000).select(
        F.concat(F.lit("i"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"),
        F.when(F.col("id") % 3 == 0, 50).otherwise((F.col("id") * 37 % 101).cast("int")).alias("score"),
    )
    expected = [r.id for r in sorted(rows.collect(), key=lambda r: (-r.score, r.id))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ranking.rank_by_score(rows).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.id for r in sorted(ranked, key=lambda r: r.rank)] == expected
    assert sorted(r.rank for r in ranked) == list(range(1, 3001))


def test_queue_is_newest_first_with_ties_by_id(spark):
    rows = [("b", 1), ("a", 1), ("c", 2)]
    frame = spark.createDataFrame(rows, "id string, collected_at int")
    assert [r.id for r in ranking.scoring_queue(frame, 2).collect()] == ["c", "a"]
    assert [r.id for r in ranking.scoring_queue(frame, None).collect()] == ["c", "a", "b"]


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([(None, None)], "score int, statut string")
    row = metrics.dashboard_metrics(empty).first()
    assert tuple(row) == (0, 0, 0, None)


def test_chunks_over_several_blocks(spark):
    rows = [(k, i, ["", " é", "x\n", None][i % 4]) for k in ("a", "b") for i in range(3000)] + [("c", 0, ""), ("c", 1, " \n")]
    random.Random(1).shuffle(rows)
    got = {r.key: r.text for r in documents.assemble_chunks(spark.createDataFrame(rows, "key string, chunk_no int, text string")).collect()}
    whole = "".join(["", " é", "x\n", ""][i % 4] for i in range(3000)).strip()
    assert got == {"a": whole, "b": whole, "c": ""}


def test_contract_groups_are_optional(spark):
    rows = [("a", 90, "https://apec", None, "CDD/Contrat"), ("b", 90, "https://apec", None, "CDI"), ("c", 90, "https://apec", "Refusé", " ")]
    frame = spark.createDataFrame(rows, "id string, score int, url string, statut string, type_contrat string")
    assert [r.id for r in filters.dashboard_filter(frame).collect()] == ["b", "c"]
    grouped = filters.dashboard_filter(frame, contract_groups={"CDD/Contrat": "CDD"})
    assert [r.id for r in grouped.collect()] == ["a", "b", "c"]
    assert [r.id for r in filters.dashboard_filter(frame, contracts=["N/A"]).collect()] == ["c"]


def test_giant_component_is_decided_block_by_block(spark, monkeypatch):
    """One component of 6,000 rows, blocks of 700: no task walks more, and the result is that of one walk."""
    import random

    rng = random.Random(4)
    rows = [(i, f"i{(i + 1) // 2}", "hot" if i % 10 == 9 else f"u{i // 2}") for i in range(4000)]
    rows += [(i, f"i{rng.randrange(2000)}", f"u{rng.randrange(2000)}") for i in range(4000, 6000)] + [(9000 + i, f"x{i % 2}", f"y{i}") for i in range(5)]
    rng.shuffle(rows)
    ids, urls, expected = set(), set(), []
    for seq, offer_id, url in sorted(rows):
        if offer_id not in ids and url not in urls:
            ids.add(offer_id)
            urls.add(url)
            expected.append(seq)
    walked = []
    walk = admission._walked

    def watched(part, order):
        walked.append(part.groupBy("component").count().agg({"count": "max"}).first()[0] or 0)
        return walk(part, order)

    monkeypatch.setattr(admission, "_walked", watched)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = admission.admit(frame, most_rounds=1, block_rows=700)
    assert sorted(r.seq for r in got.offers.collect()) == expected and got.count == len(expected)
    assert max(walked) <= 700 and len(walked) > 5


@pytest.mark.parametrize("block_rows", [1, 3])
def test_admission_does_not_depend_on_blocks(spark, block_rows):
    rows = [(i, f"i{i * 7 % 13}", f"u{i * 5 % 11}") for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(r.seq for r in admission.admit(frame, most_rounds=1).offers.collect())
    assert sorted(r.seq for r in admission.admit(frame, most_rounds=1, block_rows=block_rows).offers.collect()) == whole


def test_rank_by_long_texts_cuts_ranges_by_short_ones(spark, monkeypatch):
    """Only what cuts the ranges is sampled for the driver; rows that agree in it are still in the order of all their content."""
    long = "x" * 1000
    rows = spark.createDataFrame([(0, None, None, f"{'a' if i % 2 else ''}{long}{i * 7 % 40:02d}", i) for i in range(40)], "epoch long, request_no long, position long, item string, _row long")
    cuts = []

    def spy(behind, *order, cut_by, **named):
        cuts.append(behind.select(*[F.length(c.cast("string")).alias(f"c{i}") for i, c in enumerate(cut_by)]).agg(F.max(f"c{len(cut_by) - 1}")).first()[0])
        return ranking.rank_rows(behind, *order, cut_by=cut_by, **named)

    monkeypatch.setattr(landing, "rank_rows", spy)
    got = [r["item"] for r in landing.one_per_place(rows).orderBy("position").collect()]
    assert got == sorted(r["item"] for r in rows.collect()) and max(cuts) <= 256
