"""The store against other writers, its log, its snapshots and key index; staging in several threads; repeated landings."""

from __future__ import annotations

import glob
import json
import os
import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vacantia.catalog.models import length_scorer
from vacantia.config import Config
from vacantia.operators.admission import admit
from vacantia.plans import commits, index
from vacantia.plans.run import Landing, collect, run_batch
from vacantia.plans.store import OfferStore
from vacantia.schemas import OFFER_TEXTS
from vacantia.sources.landing import open_landing
from vacantia.streaming import stateful as stateful_module
from vacantia.staging import new_path, shared_folder, stage, staging_scope
from vacantia.streaming.ingest import ingest_stream
from vacantia.streaming.stateful import catch_up, ingest_stateful

AS_OF = datetime(2024, 3, 5, 14, 7)
CONFIG = Config({"deal_breakers": []}, {"adzuna": {"search_params": {"max_results_par_cible": 25}}})


def offer_rows(spark, rows):
    frame = spark.createDataFrame(rows, "seq long, id string, url string")
    texts = [F.col(c) if c in ("id", "url") else F.lit("x").alias(c) for c in OFFER_TEXTS]
    return frame.select("seq", *texts, F.lit("2024-01-01").cast("timestamp").alias("collected_at"))


def add(store, writer, batch, rows, between=lambda: None):
    """Admit (seq, id, url) rows as a writer does; ``between`` runs after admission and before publishing."""
    frame = offer_rows(store.spark, rows)

    def choose(keys_for):
        chosen = admit(frame, keys_for(frame.select("id", "url")))
        between()
        return frame.join(chosen.kept, "seq", "left_semi") if chosen.count else None

    return store.insert(writer, batch, choose)


def living_any(store):
    return [(r.id, r.url) for r in store.alive_keys().collect()]


def living(store):
    return sorted(((r.id, r.url) for r in store.current().collect()), key=str)


def once(action):
    """Run ``action`` the first time only."""
    done = []

    def run():
        if not done:
            done.append(1)
            action()

    return run


@pytest.mark.parametrize("shared, same_object", [("id", True), ("url", False)])
def test_two_writers_cannot_both_add_a_key(spark, tmp_path, shared, same_object):
    """b publishes between a's admission and a's publishing: a is admitted again and loses the shared key only."""
    left = OfferStore(spark, str(tmp_path / "s"))
    right = left if same_object else OfferStore(spark, str(tmp_path / "s"))
    of_a = [(1, "x", "u"), (2, "a", "v")]
    of_b = [(1, "x", "w")] if shared == "id" else [(1, "y", "u")]
    asked = []
    run_b = once(lambda: add(right, "b", 1, of_b))
    version = add(left, "a", 1, of_a, lambda: (asked.append(1), run_b()))
    assert living(left) == living(right) == sorted([("a", "v"), of_b[0][1:]])
    assert len(asked) == 2 and version == 2 and right.version_of("b", 1) == 1
    # What the refused attempt wrote is gone.
    assert not glob.glob(str(tmp_path / "s" / "*" / "_new-*"))


def test_writers_without_a_common_key_go_one_behind_the_other(spark, tmp_path):
    store, asked = OfferStore(spark, str(tmp_path / "s")), []
    run_b = once(lambda: add(OfferStore(spark, store.root), "b", 1, [(1, "y", "w")]))
    add(store, "a", 1, [(1, "x", "u")], lambda: (asked.append(1), run_b()))
    assert living(store) == [("x", "u"), ("y", "w")] and len(asked) == 1


def test_a_refused_row_frees_another(spark, tmp_path):
    """Row 1 falls to the other writer, so row 2, which row 1 had blocked by its id, gets in."""
    store = OfferStore(spark, str(tmp_path / "s"))
    run_b = once(lambda: add(OfferStore(spark, store.root), "b", 1, [(1, "other", "u")]))
    add(store, "a", 1, [(1, "x", "u"), (2, "x", "v")], run_b)
    assert living(store) == [("other", "u"), ("x", "v")]


def test_many_writers_at_once(spark, tmp_path):
    root, errors = str(tmp_path / "s"), []

    def write(name):
        try:
            add(OfferStore(spark, root), name, 1, [(i, f"i{i}", f"u{i}") for i in range(3)] + [(9, name, name)])
        except Exception as problem:
            errors.append(problem)

    threads = [threading.Thread(target=write, args=(f"w{i}",)) for i in range(4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert errors == []
    store = OfferStore(spark, root)
    assert living(store) == sorted([(f"i{i}", f"u{i}") for i in range(3)] + [(f"w{i}", f"w{i}") for i in range(4)])
    assert store.last() == 4


def test_a_writer_that_died_after_publishing_is_finished_by_a_reader(spark, tmp_path, monkeypatch):
    store = OfferStore(spark, str(tmp_path / "s"))
    add(store, "a", 1, [(1, "x", "u")])
    with monkeypatch.context() as patch:
        patch.setattr(OfferStore, "_settle", lambda self, version: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            add(store, "a", 2, [(1, "y", "v")])
    fresh = OfferStore(spark, store.root)
    assert living(fresh) == [("x", "u"), ("y", "v")] and fresh.version_of("a", 2) == 2
    # One that died before publishing left nothing.
    with monkeypatch.context() as patch:
        patch.setattr(OfferStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            add(fresh, "a", 3, [(1, "z", "w")])
    assert living(OfferStore(spark, store.root)) == [("x", "u"), ("y", "v")]
    assert add(fresh, "a", 3, [(1, "z", "w")]) == 3 and len(living(fresh)) == 3


# --- the log ---------------------------------------------------------------------------------


def test_a_long_log_opens_with_few_reads(spark, tmp_path, monkeypatch):
    folder = tmp_path / "log"
    folder.mkdir()
    entries = [json.dumps({"writer": "w", "batch": n, "tables": {}}) for n in range(1, 10_001)]
    for n, text in enumerate(entries, 1):
        (folder / f"{n:012d}").write_text(text)
    (folder / "_upto-000000009984").write_text("\n".join(entries[:9984]))
    (folder / "_latest").write_text("9984")
    reads = []
    read = commits.Folder.read
    monkeypatch.setattr(commits.Folder, "read", lambda self, name: (reads.append(name), read(self, name))[1])
    log = commits.CommitLog(spark, str(folder))
    assert log.last() == 10_000 and len(reads) <= 20 and log.find("w", 77) == 77
    # A broken, missing or old hint costs a look at the names, or more reads, and no entry.
    for hint in ("nonsense", "12", None):
        (folder / "_latest").unlink() if hint is None else (folder / "_latest").write_text(hint)
        assert commits.CommitLog(spark, str(folder)).last() == 10_000


def test_log_compacts_itself_and_keeps_numbers_exclusive(spark, tmp_path):
    log, other = (commits.CommitLog(spark, str(tmp_path / "log")) for _ in range(2))
    for n in range(1, 70):
        assert (log if n % 2 else other).publish("w", n, n - 1, n=n) == n
        assert (other if n % 2 else log).publish("x", n, n - 1) is None
    names = os.listdir(tmp_path / "log")
    assert "_latest" in names and sum(name.startswith("_upto-") for name in names) <= 3 and not any("_tmp-" in name for name in names)
    fresh = commits.CommitLog(spark, str(tmp_path / "log"))
    assert fresh.last() == 69 and fresh.entry(40)["n"] == 40 and fresh.find("w", 69) == 69
    # A temporary file of a writer that died half-way is no entry.
    (tmp_path / "log" / "_tmp-dead").write_text('{"writer": ')
    assert commits.CommitLog(spark, str(tmp_path / "log")).last() == 69


def test_files_are_created_once_by_rename_too(spark, tmp_path):
    folder = commits.Folder(spark, str(tmp_path / "f"))
    folder._local = False  # as on a file system whose renames are exclusive
    assert folder.create("a", "one") and not folder.create("a", "two") and folder.read("a") == "one"
    folder.replace("a", "three")
    assert folder.read("a") == "three" and folder.read("b") is None and folder.names() == ["a"]


# --- snapshots and the key index ----------------------------------------------------------------


def scored(store, rows, batch):
    frame = store.spark.createDataFrame(rows, "id string, score int").select(
        "id", "score", F.lit("e").alias("score_explication"), F.lit("[]").alias("score_points_forts"),
        F.lit("[]").alias("score_points_faibles"), F.lit(None).alias("score_date"),
    )
    store.commit("scores", batch, scores=frame)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def statuses(spark, **moves):
    return spark.createDataFrame(list(moves.items()), "id string, statut string")


def state(store, before=None):
    return sorted(tuple(r) for r in store.current(before).drop("collected_at").collect())


def test_snapshots_change_no_state(spark, tmp_path):
    """The same changes on a store with snapshots and on one without, compared after every step and for every version."""
    plain, other = OfferStore(spark, str(tmp_path / "plain")), OfferStore(spark, str(tmp_path / "snap"))
    steps = [
        lambda s: add(s, "o", 1, [(i, f"i{i}", f"u{i}" if i % 3 else "") for i in range(8)]),
        lambda s: scored(s, [("i1", 5), ("i2", 6), ("i3", 7)], 1),
        lambda s: s.set_status(statuses(spark, i1="Refusé", i4="Postulé"), 1),
        lambda s: s.delete(ids(spark, "i2", "i5"), 1),
        lambda s: add(s, "o", 2, [(1, "i2", "u9"), (2, "new", "u5"), (3, "no", "u1"), (4, "i1", "z")]),
        lambda s: scored(s, [("i1", 50), ("i2", 60)], 2),
        lambda s: s.set_status(statuses(spark, i4="Entretien", new="Refusé"), 2),
        lambda s: s.delete(ids(spark, "i1", "new"), 2),
        lambda s: add(s, "o", 3, [(1, "i1", "u1"), (2, "m", "u5"), (3, "m2", "u4")]),
    ]
    for number, step in enumerate(steps):
        for store in (plain, other):
            step(store)
        if number in (2, 4, 7):
            assert other.snapshot(buckets=4) == number + 1
    assert sorted(map(str, other.alive_keys().collect())) == sorted(map(str, plain.alive_keys().collect()))
    for version in range(3, plain.last() + 2):
        assert state(other, version) == state(plain, version)
    # Another reader sees the same, from the same folder.
    assert state(OfferStore(spark, other.root)) == state(plain)


def plan_of(spark, build):
    """The plan of what ``build`` returns, as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_current_state_opens_the_snapshot_and_later_versions(spark, tmp_path):
    store = OfferStore(spark, str(tmp_path / "s"))
    for batch in range(1, 4):
        add(store, "o", batch, [(1, f"i{batch}", f"u{batch}")])
    store.snapshot(buckets=4)
    add(store, "o", 4, [(1, "i4", "u4")])
    plan = plan_of(spark, store.current)
    # Every scan of a history table is cut to the versions behind the snapshot, which itself lies bucketed.
    history = [line for line in plan.splitlines() if "FileScan" in line and "batch_id" in line]
    assert history and all("batch_id#" in line and "> 3)" in line for line in history)
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert living(store) == [(f"i{n}", f"u{n}") for n in range(1, 5)]


def test_key_index_opens_hit_buckets_only(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("u"), "id").alias("url"))
    keys = index.KeyIndex.write(rows, str(tmp_path / "k"), buckets=16)
    asked = spark.createDataFrame([("i7", "u7"), ("none", "nothing"), ("x", None)], "id string, url string")
    found = keys.known(asked, "url")
    assert [tuple(r) for r in found.collect()] == [("u7", "i7")]
    assert len(found.inputFiles()) < 8 + 4
    opened = [f for f in found.inputFiles() if "/url/" in f]
    assert 1 <= len(opened) <= 3
    assert sorted(r.id for r in keys.known(rows.select("id", "url"), "id").collect()) == sorted(f"i{i}" for i in range(5000))
    # A filter of this size lets few strangers pass.
    strangers = spark.range(5000).select(F.concat(F.lit("s"), "id").alias("id"))
    assert keys.suspected(strangers, "id").count() < 500
    # Many candidates: the bucketed table is joined as it lies.
    plan = plan_of(spark, lambda: keys.known(rows.select("id", "url"), "url"))
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_admission_of_a_small_batch_reads_no_wide_offers(spark, tmp_path):
    store = OfferStore(spark, str(tmp_path / "s"))
    add(store, "o", 1, [(i, f"i{i}", f"u{i}") for i in range(200)])
    store.snapshot(buckets=32)
    candidates = spark.createDataFrame([("i3", "zz"), ("q", "u9"), ("p", "pp")], "id string, url string")
    keys = store.keys_for(candidates)
    files = keys.inputFiles()
    assert not any("/offers/" in f or "/state/" in f for f in files)
    assert sum("/keys/id/" in f or "/keys/url/" in f for f in files) <= 6
    assert sorted(map(tuple, keys.collect()), key=str) == sorted([("i3", None), (None, "u9")], key=str)
    add(store, "o", 2, [(1, "i3", "zz"), (2, "q", "u9"), (3, "p", "pp")])
    assert len(living(store)) == 201


# --- staging in several threads -------------------------------------------------------------------


def test_scopes_of_threads_are_their_own(spark):
    inner_open, inner_done, errors, tables = threading.Event(), threading.Event(), [], []

    def other():
        with staging_scope(spark):
            inner_open.set()
            inner_done.wait(30)

    thread = threading.Thread(target=other)
    with staging_scope(spark):
        thread.start()
        inner_open.wait(30)
        tables.append(stage(spark.range(5).toDF("n"), "mine"))
        inner_done.set()
        thread.join()
        assert tables[0].table.count() == 5 and os.path.exists(tables[0].path)
    assert errors == [] and not os.path.exists(tables[0].path)


def test_nested_scope_and_what_outlives_it(spark):
    with staging_scope(spark):
        with staging_scope(spark):
            inner, outer = new_path(spark, "a"), stage(spark.range(2).toDF("n"), "b", outlives=True)
        assert not os.path.exists(inner) and outer.table.count() == 2
    assert not os.path.exists(outer.path)


def write_lines(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
        out.write("\n".join(json.dumps(r) for r in rows))


def stream(spark, folder, store, progress, writer):
    landed = spark.readStream.schema("seq long, id string, url string, intitule string").option("maxFilesPerTrigger", 1).json(folder)

    def to_candidates(batch):
        texts = [F.col(c) if c in batch.columns else F.lit("").alias(c) for c in OFFER_TEXTS]
        return batch.select("seq", *texts, F.lit("2024-01-01").cast("timestamp").alias("collected_at"))

    return ingest_stream(landed, to_candidates, store, [], progress, writer)


def test_two_streams_and_a_run_at_once(spark, tmp_path):
    """They share URLs; whoever is first has them, nobody has one twice, and no staged table is left."""
    before = set(glob.glob(f"{shared_folder(spark)}/vacantia/*"))
    for name in ("left", "right"):
        for part in range(2):
            rows = [{"seq": i, "id": f"{name}{part}-{i}", "url": f"https://x/{part}-{i}" if i % 2 else f"https://{name}/{part}-{i}", "intitule": "t"} for i in range(6)]
            write_lines(str(tmp_path / name), f"{part}.json", rows)
    write_lines(str(tmp_path / "c"), "0.json", [{"request_no": 0, "position": i, "job_url": f"https://x/0-{i}", "title": "t"} for i in range(6)])
    store = OfferStore(spark, str(tmp_path / "s"))
    queries = [stream(spark, str(tmp_path / n), OfferStore(spark, store.root), str(tmp_path / f"p-{n}"), n) for n in ("left", "right")]
    result = run_batch(spark, Landing(rows_c=str(tmp_path / "c")), store, CONFIG, length_scorer, AS_OF, 1, str(tmp_path / "out"))
    for query in queries:
        query.awaitTermination()
        assert query.exception() is None
    got = living(store)
    urls = [url for _, url in got]
    expected = {f"https://x/{p}-{i}" for p in range(2) for i in (1, 3, 5)} | {f"https://x/0-{i}" for i in (0, 2, 4)}
    expected |= {f"https://{n}/{p}-{i}" for n in ("left", "right") for p in range(2) for i in (0, 2, 4)}
    assert set(urls) == expected and len(urls) == len(set(urls)) == len({i for i, _ in got})
    assert result.failed_sources == {}
    assert set(glob.glob(f"{shared_folder(spark)}/vacantia/*")) == before


def stateful(spark, folder, store, progress):
    schema = "seq long, id string, url string, intitule string"
    landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)

    def to_candidates(rows):
        texts = [F.col(c) if c in ("id", "url", "intitule") else F.lit("").alias(c) for c in OFFER_TEXTS]
        return rows.select("seq", *texts, F.lit("2024-01-01").cast("timestamp").alias("collected_at"))

    catch_up(ingest_stateful(landed, to_candidates, store, ["non"], progress, "stream"))


@pytest.mark.parametrize("in_memory", [1000, 1])
def test_stateful_stream(spark, tmp_path, monkeypatch, in_memory):
    """Batches, a restart, another writer's offers and a deletion: the state knows them all and no key table is read."""
    monkeypatch.setattr(stateful_module, "IN_MEMORY", in_memory)
    folder, store = str(tmp_path / "landed"), OfferStore(spark, str(tmp_path / "s"))

    def row(seq, offer_id, url, title="t"):
        return {"seq": seq, "id": offer_id, "url": url, "intitule": title}

    asked = []
    keys_for = OfferStore.keys_for
    monkeypatch.setattr(OfferStore, "keys_for", lambda self, *a, **k: (asked.append(1), keys_for(self, *a, **k))[1])
    write_lines(folder, "0.json", [row(0, "a", "u"), row(1, "a", "v"), row(2, "b", "u"), row(3, "c", "w"), row(4, "d", ""), row(5, "e", "x", "NON"), row(6, None, "n")])
    stateful(spark, folder, store, str(tmp_path / "p"))
    assert sorted(living_any(store), key=str) == sorted([("a", "u"), ("c", "w"), (None, "n")], key=str) and asked == []

    add(store, "other", 1, [(1, "f", "y")])
    store.delete(ids(spark, "a"), 1)
    asked.clear()
    write_lines(folder, "1.json", [row(10, "g", "y"), row(11, "f", "z"), row(12, "h", "w"), row(13, "a", "q"), row(14, "k", "u"), row(15, "k2", "k2")])
    stateful(spark, folder, store, str(tmp_path / "p"))
    expected = sorted([("c", "w"), (None, "n"), ("f", "y"), ("a", "q"), ("k", "u"), ("k2", "k2")], key=str)
    assert sorted(living_any(store), key=str) == expected and asked == []
    stateful(spark, folder, store, str(tmp_path / "p"))
    assert sorted(living_any(store), key=str) == expected


# --- landing again and again ------------------------------------------------------------------------


def titles(spark, landing):
    typed, got = collect(spark, landing, CONFIG)
    assert got.failed == {}
    return [(r.url, r.intitule) for r in typed.orderBy("seq").collect()]


def row_c(request, position, url, title):
    return {"request_no": request, "position": position, "job_url": url, "title": title}


def test_a_taken_place_stops_nothing(spark, tmp_path):
    """Two files of one folder hold the same place, one of them twice: all rows stay, none twice, in a fixed order."""
    folder = str(tmp_path / "c")
    write_lines(folder, "0.json", [row_c(0, 0, "https://a", "one"), row_c(0, 1, "https://b", "two")])
    write_lines(folder, "1.json", [row_c(0, 0, "https://c", "three"), row_c(0, 1, "https://b", "two"), row_c(None, 3, "https://d", "four"), row_c(None, 3, "https://d", "four")])
    got = titles(spark, Landing(rows_c=folder))
    assert sorted(got) == [("https://a", "one"), ("https://b", "two"), ("https://c", "three"), ("https://d", "four")]
    assert got[-1] == ("https://d", "four") and titles(spark, Landing(rows_c=folder)) == got
    result = run_batch(spark, Landing(rows_c=folder), OfferStore(spark, str(tmp_path / "s")), CONFIG, length_scorer, AS_OF, 1, str(tmp_path / "out"))
    assert result.new_offers == 4


def test_landings_count_in_the_order_of_their_epochs(spark, tmp_path):
    folder = str(tmp_path / "c")
    first, second = open_landing(spark, folder), open_landing(spark, folder)
    assert first.endswith("epoch=1") and second.endswith("epoch=2")
    write_lines(second, "0.json", [row_c(0, 0, "https://b", "later"), row_c(0, 1, "https://a", "later")])
    write_lines(first, "0.json", [row_c(0, 0, "https://a", "first"), row_c(7, 5, "https://z", "first"), row_c(0, None, "https://q", "first")])
    write_lines(folder, "old.json", [row_c(3, 0, "https://o", "before epochs")])
    assert titles(spark, Landing(rows_c=folder)) == [
        ("https://o", "before epochs"), ("https://a", "first"), ("https://z", "first"), ("https://b", "later"), ("https://a", "later"), ("https://q", "first"),
    ]
    store = OfferStore(spark, str(tmp_path / "s"))
    run_batch(spark, Landing(rows_c=folder), store, CONFIG, length_scorer, AS_OF, 1, str(tmp_path / "out"))
    assert {(r.url, r.intitule) for r in store.current().collect()} == {
        ("https://o", "before epochs"), ("https://a", "first"), ("https://z", "first"), ("https://b", "later"), ("https://q", "first"),
    }


def test_requests_of_two_epochs_are_two_requests_of_source_a(spark, tmp_path):
    folder = str(tmp_path / "a")
    page = {"target_no": 0, "request_no": 0, "pays": "fr", "page": 1, "status": 200}
    for epoch in (1, 2):
        write_lines(open_landing(spark, folder), "0.json", [{**page, "results": [{"id": str(epoch), "title": "t", "redirect_url": f"https://a/{epoch}"}]}])
    assert titles(spark, Landing(pages_a=folder)) == [("https://a/1", "t"), ("https://a/2", "t")]


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, asked = files(), dict(spark.conf.getAll).get(setting)
    kept = spark.range(3000).groupBy((F.col("id") % 7).alias("k")).count()  # its plan stays referenced, so no garbage collection can help
    assert stage(kept, "shuffled").rows == 7
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert dict(spark.conf.getAll).get(setting) == asked
    spark.conf.set(setting, "false")
    try:
        assert stage(kept, "shuffled").rows == 7
        assert spark.conf.get(setting) == "false" and files() - before
    finally:
        spark.conf.unset(setting)
