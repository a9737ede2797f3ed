"""Stored state, full runs, exports, streams."""

from __future__ import annotations

import glob
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vacantia.catalog.models import length_scorer
from vacantia.config import Config, load_config, search_targets
from vacantia.operators import scoring
from vacantia.operators.admission import admit
from vacantia.operators.ranking import sort_ranges
from vacantia.plans import exports
from vacantia.plans.run import Landing, broken_records, collect, run_batch, score_waiting
from vacantia.plans.sinks import DocumentSink
from vacantia.plans.store import OfferStore, with_status_column
from vacantia.schemas import OFFER_TEXTS, PAGE_A
from vacantia.sources import readers
from vacantia.staging import shared_folder, stage
from vacantia.streaming.ingest import ingest_stream

AS_OF = datetime(2024, 3, 5, 14, 7)
PROFILE = {"candidat": {"poste_cible": "Ingénieur IA"}, "deal_breakers": ["Commercial", "call center"]}


def offer_rows(spark, rows):
    """(id, url) pairs as offers to append."""
    frame = spark.createDataFrame(rows, "id string, url string")
    texts = [F.col(c) if c in ("id", "url") else F.lit("x").alias(c) for c in OFFER_TEXTS]
    return frame.select(*texts, F.lit("2024-01-01").cast("timestamp").alias("collected_at"))


def put(store, rows, batch, writer="offers"):
    return store.insert(writer, batch, lambda keys_for: offer_rows(store.spark, rows))


def score(store, offer_id, value, batch):
    row = store.spark.createDataFrame([(offer_id, value)], "id string, score int").select(
        "id", "score", F.lit("e").alias("score_explication"), F.lit("[]").alias("score_points_forts"),
        F.lit("[]").alias("score_points_faibles"), F.lit(None).alias("score_date"),
    )
    store.commit("scores", batch, scores=row)


def state(store):
    return {r.id: (r.score, r.statut) for r in store.current().collect()}


def test_change_delete_and_return(spark, tmp_path):
    store = OfferStore(spark, str(tmp_path / "s"))
    assert state(store) == {}
    put(store, [("a", "u"), ("b", "v")], 1)
    score(store, "a", -1, 2)
    score(store, "a", 70, 3)
    store.set_status(spark.createDataFrame([("a", "Postulé")], "id string, statut string"), 4)
    assert state(store) == {"a": (70, "Postulé"), "b": (None, "À postuler")}
    store.delete(spark.createDataFrame([("a",)], "id string"), 5)
    assert state(store) == {"b": (None, "À postuler")}
    assert [r.id for r in store.alive_keys().collect()] == ["b"]
    score(store, "a", 99, 6)  # a change to a deleted offer changes nothing, now or later
    put(store, [("a", "u")], 7)
    assert state(store) == {"a": (None, "À postuler"), "b": (None, "À postuler")}
    assert [r.id for r in store.alive_keys(before=7).collect()] == ["b"]
    score(store, "a", 42, 8)
    compact = store.compact(str(tmp_path / "t"))
    put(compact, [("c", "w")], 10)
    assert state(store) == {"a": (42, "À postuler"), "b": (None, "À postuler")}
    # Changes are kept as such, so the compacted store carries on from the same state.
    assert state(compact) == {**state(store), "c": (None, "À postuler")}


def test_opening_again_and_replaying_change_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    put(OfferStore(spark, root), [("a", "u")], 1)
    again = OfferStore(spark, root)
    put(again, [("a", "u")], 1)
    assert again.read("offers").count() == 1
    with pytest.raises(ValueError):
        again.commit("offers", 9, offers=offer_rows(spark, [("b", "v")]))


def test_writers_do_not_erase_each_other(spark, tmp_path):
    store = OfferStore(spark, str(tmp_path / "s"))
    other = OfferStore(spark, str(tmp_path / "s"))
    assert put(store, [("a", "u"), ("b", "v")], 1, "one") != put(other, [("c", "w")], 1, "two")
    assert store.version_of("one", 1) == other.version_of("one", 1) is not None
    one = spark.createDataFrame([("a", "Refusé")], "id string, statut string")
    two = spark.createDataFrame([("b", "Postulé")], "id string, statut string")
    assert store.set_status(one, 7, "left") != other.set_status(two, 7, "right")
    assert state(store) == {"a": (None, "Refusé"), "b": (None, "Postulé"), "c": (None, "À postuler")}
    with pytest.raises(ValueError):
        store.set_status(one.unionByName(one), 8)
    with pytest.raises(ValueError):
        OfferStore(spark, str(tmp_path / "s")).compact(str(tmp_path / "s"))


def test_state_reads_only_the_folders_it_needs(spark, tmp_path):
    store = OfferStore(spark, str(tmp_path / "s"))
    for batch in range(1, 4):
        put(store, [(f"i{batch}", f"u{batch}")], batch)
    score(store, "i1", 5, 1)
    store.set_status(spark.createDataFrame([("i1", "Refusé")], "id string, statut string"), 1)

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    assert "PartitionFilters: [isnotnull(batch_id" in plan(store.read("offers", only=2))
    assert "PartitionFilters: [isnotnull(batch_id" in plan(store.current(before=3))
    assert "SortAggregate" not in plan(store.current())


def test_older_generation_without_status(spark, tmp_path):
    path = str(tmp_path / "g")
    spark.createDataFrame([("a",)], "id string").write.parquet(path + "/g=1")
    spark.createDataFrame([("b", "Refusé"), ("c", None)], "id string, statut string").write.parquet(path + "/g=2")
    both = with_status_column(spark.read.option("mergeSchema", True).parquet(path))
    assert {r.id: r.statut for r in both.collect()} == {"a": "À postuler", "b": "Refusé", "c": "À postuler"}
    old = with_status_column(spark.createDataFrame([("a",)], "id string"))
    assert old.first().statut == "À postuler"


# --- full runs --------------------------------------------------------------------------------


def landed(tmp_path, name, rows, broken=0):
    folder = tmp_path / name
    folder.mkdir()
    text = "\n".join([json.dumps(r, ensure_ascii=False) for r in rows] + ['{"oops": '] * broken)
    (folder / "part.json").write_text(text, encoding="utf-8")
    return str(folder)


def offer_a(number, title="Ingénieur IA", **more):
    return {"id": str(number), "title": title, "description": "d", "redirect_url": f"https://adzuna.fr/{number}", **more}


@pytest.fixture
def landing(tmp_path):
    pages_a = [
        {"target_no": 0, "request_no": 0, "pays": "fr", "page": 1, "status": 200,
         "results": [offer_a(1), offer_a(2, "Commercial"), offer_a(1, "Ingénieur IA bis", salary_min="45000", latitude=48.5)]},
        {"target_no": 0, "request_no": 1, "pays": "fr", "page": 1, "status": 500, "results": [offer_a(9)]},
        {"target_no": 1, "request_no": 2, "pays": "gb", "page": 1, "status": 200, "results": [offer_a(1), offer_a(3, redirect_url=None)]},
        {"target_no": 1, "request_no": None, "pays": "gb", "page": 1, "status": 200, "results": [offer_a(4)]},
    ]

    def item(position, **fields):
        return {"request_no": 0, "position": position, "item": json.dumps(fields, ensure_ascii=False)}

    items_b = [
        item(0, id="10W", intitule="Commercial", entreprise={"nom": "A"}), item(1, id="10W", intitule="Data", entreprise="B"),
        item(2, id="11W", intitule="Data é", entreprise="C", typeContrat="CDI"), item(3, intitule="sans id"),
    ]
    rows_c = [
        {"request_no": 0, "position": i, "job_url": url, "title": "Dev", "posted_at": at}
        for i, (url, at) in enumerate([
            ("https://adzuna.fr/1", "2024-03-05T10:00:00"), ("https://indeed.com/5", "2024-03-04T10:00:00"),
            ("https://indeed.com/6", "2024-01-01T10:00:00"), (None, "2024-03-05T11:00:00"),
        ])
    ]
    # Undated, without a place, and landed twice.
    rows_c += [{"request_no": 0, "position": 9, "job_url": "https://indeed.com/7", "title": "Dev"}] * 2
    rows_c += [{"job_url": "https://indeed.com/8", "title": "Dev"}]
    return Landing(landed(tmp_path, "a", pages_a, broken=1), landed(tmp_path, "b", items_b), landed(tmp_path, "c", rows_c))


CONFIG = Config(PROFILE, {"adzuna": {"search_params": {"max_results_par_cible": 25}}, "indeed": {"hours_old": 72}})


def staged_folders(spark):
    """Staged tables there are; earlier tests leave theirs, so these are told apart by name."""
    return [p for p in glob.glob(f"{shared_folder(spark)}/vacantia/*") if p not in _EARLIER]


_EARLIER: set[str] = set()


def test_full_run_twice(spark, tmp_path, landing):
    _EARLIER.update(staged_folders(spark))
    store = OfferStore(spark, str(tmp_path / "s"))
    out = str(tmp_path / "out")
    first = run_batch(spark, landing, store, CONFIG, length_scorer, AS_OF, 1, out)
    offers = {r.id: r for r in store.current().collect()}
    by_url = {r.url: r for r in offers.values()}
    # The later value of raw id 1 won; its URL then blocked the copies of target 1 and source C.
    assert by_url["https://adzuna.fr/1"].id == "adzuna_fr_1"
    assert by_url["https://adzuna.fr/1"].intitule == "Ingénieur IA bis"
    assert by_url["https://adzuna.fr/1"].salaire_libelle == "À partir de 45 000 €/an"
    assert json.loads(by_url["https://adzuna.fr/1"].raw_json)["title"] == "Ingénieur IA bis"
    assert sorted(by_url) == [
        "https://adzuna.fr/1", "https://indeed.com/5", "https://indeed.com/6", "https://indeed.com/7", "https://indeed.com/8",
        "https://www.apec.fr/candidat/recherche-emploi.html/emploi/11W",
    ]
    # The whole record is kept, fields that are not read included.
    assert json.loads(by_url["https://adzuna.fr/1"].raw_json)["latitude"] == 48.5
    assert first.new_offers == 6 and first.failed_sources == {}
    assert first.broken_lines == {"adzuna": 2, "apec": 0, "indeed": 0}
    assert spark.read.json(first.broken_path).count() == 2
    assert all(r.score is not None for r in offers.values())
    assert first.scored_offers == sum(r.score >= 0 for r in offers.values())
    assert {(r.target_no, r.found, r.rejected, r.inserted) for r in first.counters.collect()} == {
        (0, 2, 1, 1), (1, 2, 0, 0), (None, 4, 1, 1),
    }
    run = store.read("runs").first()
    assert (run.new_offers, run.scored_offers, run.report_path) == (6, first.scored_offers, first.report_path)
    before = sorted(map(str, store.current().collect()))

    # The same run again, as after a failure.
    again = run_batch(spark, landing, store, CONFIG, length_scorer, AS_OF, 1, out)
    assert (again.version, again.new_offers, again.scored_offers) == (first.version, 6, first.scored_offers)
    assert sorted(map(str, store.current().collect())) == before

    second = run_batch(spark, landing, store, CONFIG, length_scorer, AS_OF, 2, out)
    assert second.new_offers == 0 and second.scored_offers == 0 and second.version > first.version
    assert store.current().count() == 6 and store.read("scores").count() == 6
    # Nothing that a run stages outlives it.
    assert staged_folders(spark) == []

    # A deleted offer comes back, unscored until the run scores it.
    store.delete(spark.createDataFrame([("adzuna_fr_1",)], "id string"), 1)
    third = run_batch(spark, landing, store, CONFIG, length_scorer, AS_OF, 3, out)
    assert third.new_offers == 1 and store.current().count() == 6


def test_one_failing_source_leaves_the_others(spark, tmp_path, landing):
    broken = Landing(landing.pages_a, str(tmp_path / "nothing" / "here"), None)
    typed, got = collect(spark, broken, CONFIG)
    assert list(got.failed) == ["apec"] and typed.count() > 0
    nothing, got = collect(spark, Landing(None, str(tmp_path / "no"), None), CONFIG)
    assert nothing is None and list(got.failed) == ["apec"]


def test_broken_lines_are_set_aside(spark, landing):
    assert readers.good_rows(readers.read_json(spark, landing.pages_a, PAGE_A)).count() == 4
    aside = broken_records(spark, landing).collect()
    assert [r.source for r in aside] == ["adzuna"] * 2 and aside[0].record == '{"oops": ' and '"id":"4"' in aside[1].record


def test_failed_scores_are_retried(spark, tmp_path):
    store = OfferStore(spark, str(tmp_path / "s"))
    put(store, [("a", "u"), ("b", "v")], 1)

    def failing():
        def ask(prompts):
            raise RuntimeError("quota")

        return ask

    def good():
        return lambda prompts: ['{"score": "61", "explication": "é", "points_forts": ["p"]}' for _ in prompts]

    scores = score_waiting(store, CONFIG, failing, AS_OF, 1)
    assert {(r.score, r.score_explication) for r in scores.collect()} == {(-1, "Erreur : quota")}
    assert score_waiting(store, CONFIG, good, AS_OF, 2).count() == 0
    assert score_waiting(store, CONFIG, good, AS_OF, 3, retry_failed=True, limit=1).count() == 1
    again = score_waiting(store, CONFIG, good, AS_OF, 4, retry_failed=True).collect()
    assert [(r.score, r.score_points_forts, r.score_points_faibles) for r in again] == [(61, '["p"]', "[]")]
    assert {r.score for r in store.current().collect()} == {61}


def test_invalid_answer_gives_minus_one(spark):
    asked = spark.createDataFrame([("a", '{"score": 101, "explication": "x"}', None), ("b", None, "boum")], "id string, answer string, error string")
    got = {r.id: (r.score, r.score_explication, r.points_forts) for r in scoring.scored_answers(asked).collect()}
    assert got == {"a": (-1, "Erreur : réponse invalide", []), "b": (-1, "Erreur : boum", [])}


# --- exports -------------------------------------------------------------------------------------


def text_of(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def scored_rows(spark, rows):
    columns = "id string, score int, score_points_forts string"
    frame = spark.createDataFrame(rows, columns)
    fixed = {"intitule": "Dev", "entreprise_nom": "", "lieu_travail": "Paris", "type_contrat": None, "salaire_libelle": "",
             "url": "https://apec", "score_explication": "Bien", "score_points_faibles": None}
    return frame.withColumns({k: F.lit(v).cast("string") for k, v in fixed.items()})


def test_report_text(spark, tmp_path):
    path = exports.write_report(scored_rows(spark, [("a", 60, '["p", "q"]'), ("b", 80, "[]"), ("c", -1, None)]), str(tmp_path / "r"), AS_OF)
    rule, thin = "=" * 70, "─" * 70

    def block(rank, offer_id, score, label, points):
        return [
            thin, f"  #{rank}  [{score}/100] {label}", thin, f"  ID         : {offer_id}", "  Poste      : Dev", "  Entreprise : N/A",
            "  Lieu       : Paris", "  Contrat    : N/A", "  Salaire    : Non précisé", "  Lien       : https://apec", "",
            "  ANALYSE :", "  Bien", "", *points, "",
        ]

    expected = [
        rule, "  RAPPORT DE RECHERCHE D'EMPLOI — 05/03/2024 à 14:07", "  2 offres scorées", rule, "",
        *block(1, "b", 80, "★★★  PRIORITAIRE", []),
        *block(2, "a", 60, "★★☆  À CONSIDÉRER", ["  POINTS FORTS :", "    + p", "    + q", ""]),
        rule, "  FIN DU RAPPORT", rule, "",
    ]
    assert text_of(path).split("\n") == expected


def test_nothing_is_written_without_scores(spark, tmp_path):
    unscored = scored_rows(spark, [("c", -1, None), ("d", None, None)])
    assert exports.write_report(unscored, str(tmp_path / "r"), AS_OF) is None
    assert exports.write_export(unscored, str(tmp_path / "e")) is None
    assert not (tmp_path / "r").exists() and not (tmp_path / "e").exists()


def test_export_is_sorted_and_reads_back(spark, tmp_path):
    rows = scored_rows(spark, [("a", 60, '["p"]'), ("b", 85, None)])
    path = exports.write_export(rows, str(tmp_path / "e"))
    read = spark.read.option("header", True).option("escape", '"').csv(path)
    assert read.columns[:12] == [
        "Score", "Priorité", "Poste", "Entreprise", "Lieu", "Contrat", "Salaire", "Source", "Analyse", "Points forts", "Points faibles", "URL",
    ]
    assert [(r["Score"], r["remplissage"], r["Points forts"]) for r in read.collect()] == [("85", "C6EFCE", None), ("60", "FFEB9C", '["p"]')]


def test_documents_with_one_slug(spark, tmp_path):
    rows = [("indeed_12345abc", "<p>1</p>"), ("indeed_12345xyz", "<p>2</p>"), ("adzuna_fr_7", None)]
    made = spark.createDataFrame(rows, "id string, html string")
    with pytest.raises(ValueError):
        exports.write_documents(made, str(tmp_path / "d"))
    exports.write_documents(made, str(tmp_path / "d"), by_id=True)
    assert sorted(p.name for p in (tmp_path / "d" / "batch=1").iterdir() if p.is_dir()) == [
        "name=cv_adapte_indeed_12345abc.html", "name=cv_adapte_indeed_12345xyz.html",
    ]
    # A later call leaves them where they are, and a document of the same name counts instead of the earlier one.
    later = spark.createDataFrame([("indeed_12345xyz", "<p>new</p>"), ("apec_1", "<p>3</p>")], "id string, html string")
    exports.write_documents(later, str(tmp_path / "d"), by_id=True)
    expected = {"indeed_12345abc": "<p>1</p>\n", "indeed_12345xyz": "<p>new</p>\n", "apec_1": "<p>3</p>\n"}

    def now():
        return {r.name[10:-5]: r.html for r in DocumentSink(spark, str(tmp_path / "d")).read().collect()}

    assert now() == expected

    # A write that is killed changes nothing; one that is killed right after publishing is finished by whoever comes next.
    dying = spark.range(3).select(F.concat(F.lit("apec_"), "id").alias("id"), F.when(F.col("id") < 2, "<p>half</p>").otherwise(F.raise_error(F.lit("killed"))).alias("html"))
    with pytest.raises(Exception, match="killed"):
        exports.write_documents(dying, str(tmp_path / "d"), by_id=True)
    assert now() == expected
    sink = DocumentSink(spark, str(tmp_path / "d"))
    spark.createDataFrame([("cv_adapte_apec_1.html", "<p>4</p>")], "name string, html string").write.partitionBy("name").text(str(tmp_path / "d" / "_new-x"))
    assert sink._log.publish("x", 0, sink.last(), folder="_new-x") == 3
    assert now() == {**expected, "apec_1": "<p>4</p>\n"} == now()


def test_report_is_sorted_once(spark, tmp_path):
    rows = spark.range(3000).select(F.concat(F.lit("i"), "id").alias("id"), (F.col("id") % 3 * 40).cast("int").alias("score"), F.lit("[]").alias("score_points_forts"))
    fixed = {"intitule": "Dev", "entreprise_nom": "é", "lieu_travail": "Paris", "type_contrat": None, "salaire_libelle": "",
             "url": "https://apec", "score_explication": "Bien", "score_points_faibles": None}
    offers = rows.withColumns({k: F.lit(v).cast("string") for k, v in fixed.items()})
    ranges = sort_ranges(offers.select(*exports.REPORT_COLUMNS), F.desc("score"), "id")
    plan = exports.report_parts(ranges, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" not in plan and "Exchange hashpartitioning" not in plan
    path = exports.write_report(offers, str(tmp_path / "r"), AS_OF)
    text = text_of(path)
    blocks = exports.report_blocks(offers).orderBy("rank").collect()
    assert text.startswith(exports._head(3000, AS_OF)) and text.endswith(exports._foot() + "\n")
    assert text == exports._head(3000, AS_OF) + "".join(r.block + "\n" for r in blocks)[:-1] + exports._foot() + "\n"
    # A later report takes its place.
    exports.write_report(offers.limit(1), str(tmp_path / "r"), AS_OF)
    assert text_of(path).startswith(exports._head(1, AS_OF)) and not glob.glob(str(tmp_path / "_r*"))


def test_base_documents_are_read_whole(spark, tmp_path):
    (tmp_path / "cv.html").write_text("<p>é\n</p>\n", encoding="utf-8")
    row = readers.read_text_documents(spark, str(tmp_path / "cv.html")).first()
    assert row.html == "<p>é\n</p>\n" and row.path.endswith("cv.html")


# --- configuration ----------------------------------------------------------------------------------


def test_config_and_targets(spark, tmp_path, monkeypatch):
    (tmp_path / "p.yaml").write_text("candidat:\n  poste_cible: IA\ncriteres:\n  distance_km: 5\n", encoding="utf-8")
    (tmp_path / "s.yaml").write_text(
        "adzuna:\n  cibles:\n  - {pays: fr, localisation: Paris, mots_cles: [a, b]}\n  - {pays: gb, localisation: Leeds, mots_cles: c}\n  - {pays: be, localisation: Gand}\n",
        encoding="utf-8",
    )
    monkeypatch.setenv("PROFILE_PATH", str(tmp_path / "p.yaml"))
    monkeypatch.setenv("SOURCES_PATH", str(tmp_path / "s.yaml"))
    config = load_config()
    assert (config.default_keyword, config.max_results, config.forbidden_terms, config.criteria) == ("IA", 25, [], {"distance_km": 5})
    assert [r.mots_cles for r in search_targets(spark, config).collect()] == ['["a", "b"]', '"c"', "null"]


# --- streams ------------------------------------------------------------------------------------------


def run_stream(spark, folder, store, progress, writer="one"):
    landed_rows = spark.readStream.schema("seq bigint, id string, url string, intitule string").option("maxFilesPerTrigger", 1).json(folder)

    def to_candidates(batch):
        texts = [F.col(c) if c in batch.columns else F.lit("").alias(c) for c in OFFER_TEXTS]
        return batch.select("seq", *texts, F.lit("2024-01-01").cast("timestamp").alias("collected_at"))

    ingest_stream(landed_rows, to_candidates, store, ["non"], progress, writer).awaitTermination()


def test_stream_equals_batch_and_survives_a_replay(spark, tmp_path):
    rows = [
        {"seq": i, "id": f"i{i * 7 % 97}", "url": ["", f"u{i * 3 % 80}"][i % 9 > 0], "intitule": ["oui", "NON"][i % 11 == 0]}
        for i in range(120)
    ]
    folder = tmp_path / "landed"
    folder.mkdir()
    for part in range(3):
        lines = "\n".join(json.dumps(r) for r in rows[part * 40 : part * 40 + 40])
        (folder / f"{part}.json").write_text(lines)
        import os

        os.utime(folder / f"{part}.json", (1_700_000_000 + part, 1_700_000_000 + part))
    store = OfferStore(spark, str(tmp_path / "s"))
    run_stream(spark, str(folder), store, str(tmp_path / "p"))
    good = spark.createDataFrame([(r["seq"], r["id"], r["url"]) for r in rows if r["url"] and r["intitule"] == "oui"], "seq bigint, id string, url string")
    expected = sorted((r.id, r.url) for r in admit(good).offers.collect())
    assert sorted((r.id, r.url) for r in store.current().collect()) == expected
    assert store.read("offers").select("version").distinct().count() > 1

    # No new file: nothing changes. Lost progress: every batch is replayed into its folder.
    run_stream(spark, str(folder), store, str(tmp_path / "p"))
    run_stream(spark, str(folder), store, str(tmp_path / "p2"))
    assert store.read("offers").count() == len(expected)


def test_two_streams_share_a_store(spark, tmp_path):
    for name in ("left", "right"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.json").write_text(json.dumps({"seq": 0, "id": name, "url": f"u-{name}", "intitule": "oui"}))
    store = OfferStore(spark, str(tmp_path / "s"))
    for name in ("left", "right"):
        run_stream(spark, str(tmp_path / name), store, str(tmp_path / f"p-{name}"), name)
    assert sorted(r.id for r in store.current().collect()) == ["left", "right"]


# --- how much a run writes ---------------------------------------------------------------------


def test_record_made_from_columns_is_the_record(spark):
    row = {"title": "t é", "company": None, "location": "l", "description": "d \"q\"\n", "job_url": "https://x/1", "date_posted": "2024"}
    rows = spark.createDataFrame([{**dict.fromkeys(readers.RAW_C.fieldNames(), ""), **row}], readers.RAW_C)
    stored = readers.external_to_stored(readers.union_external(readers.read_c(rows)))
    assert readers.with_external_json(stored.drop("raw_json"), "indeed").first()["raw_json"] == stored.first()["raw_json"]
    items = spark.createDataFrame([(json.dumps({"id": "7", "intitule": "t", "entreprise": {"nom": "e"}, "salaireTexte": "s", "typeContrat": "c"}),)], "item string")
    stored = readers.external_to_stored(readers.union_external(readers.read_b(items)))
    assert readers.with_external_json(stored.drop("raw_json"), "apec").first()["raw_json"] == stored.first()["raw_json"]


def test_offers_do_not_move_to_meet_empty_tables(spark, tmp_path):
    store = OfferStore(spark, str(tmp_path))
    rows = spark.range(3).select(*[F.col("id").cast("string").alias(c) for c in OFFER_TEXTS], F.lit("2024-01-01").cast("timestamp").alias("collected_at"))
    store.insert("w", 1, lambda keys_for: rows)
    plan = store.current()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ExistingRDD" not in plan
    assert store.current().count() == 3


def test_written_tables_are_packed_tightly(spark):
    staged = stage(spark.range(1), "packed")
    assert all(path.endswith(".zstd.parquet") for path in glob.glob(f"{staged.path}/*.parquet"))
