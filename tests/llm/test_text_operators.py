"""Language, quality and benchmark operators against plain rules, on hard texts."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from vacantia.llm import decontaminate, ftrl, language, quality_classifier, quality_rules, sample

from .conftest import lower_ascii, plain_words

# --- samples and learner ------------------------------------------------------------------


def test_fold_is_crc32_of_the_text(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), sample.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    null = spark.sql("select cast(null as long) as i").select(sample.held_out(F.col("i")), sample.learnable(F.col("i"))).first()
    assert tuple(null) == (False, False)


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("kind"))
    one = sample.first_by_hash(rows, "kind", [0, 1], 20, "id")
    again = sample.first_by_hash(rows.repartition(7), "kind", [0, 1], 20, "id")
    assert sorted(one.collect()) == sorted(again.collect())
    assert {r["kind"]: r["count"] for r in one.groupBy("kind").count().collect()} == {0: 20, 1: 20}


def test_updates_follow_the_regularised_leader():
    """Against the leader found from sums of gradients, coordinate by coordinate."""
    rng, p = np.random.default_rng(1), ftrl.Penalties(0.3, 1.0, 0.05, 0.2)
    z, n = np.zeros((8, 2)), np.zeros((8, 2))
    gradients, centre = np.zeros((8, 2)), np.zeros((8, 2))
    for _ in range(60):
        at, x, label = rng.choice(8, 3, replace=False), rng.random(3), int(rng.integers(2))
        before = ftrl.weights_of(z, n, p)
        g = np.outer(x, ftrl.softmax(x @ before[at]) - np.eye(2)[label])
        rate = np.sqrt(n[at] + g * g) / p.alpha - np.sqrt(n[at]) / p.alpha
        gradients[at] += g
        centre[at] += rate * before[at]
        ftrl.learn(z, n, at, x, label, p)
    w = ftrl.weights_of(z, n, p)
    for i in range(8):
        for k in range(2):
            grid = np.linspace(-3, 3, 60001)
            loss = (gradients[i, k] - centre[i, k]) * grid + p.l1 * abs(grid) + 0.5 * ((p.beta + np.sqrt(n[i, k])) / p.alpha + p.l2) * grid**2
            assert abs(grid[loss.argmin()] - w[i, k]) < 2e-4


def test_training_separates_and_is_sparse(spark):
    rows = [(i % ftrl.SHARDS, i, i % 2, [i % 2, 2, 9], [1.0, 0.5, 1.0]) for i in range(240)]
    table = spark.createDataFrame(rows, "shard int, place long, label int, at array<int>, x array<float>")
    w = ftrl.train(table, 10, 2, ftrl.Penalties(0.5, 1.0, 0.05, 0.1))
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0]
    assert not w[3:9].any()
    assert not ftrl.train(table.limit(0), 10, 2, ftrl.Penalties()).any()


def test_temperature_is_the_grid_minimum(spark):
    logits = [(0, [4.0, 0.0])] * 7 + [(1, [4.0, 0.0])] * 3
    table = spark.createDataFrame(logits, "label int, logits array<double>")
    grid = np.geomspace(0.1, 20, 60)
    loss = [-sum(np.log(ftrl.softmax(np.array(x) / t)[y]) for y, x in logits) for t in grid]
    assert ftrl.best_temperature(table, grid) == pytest.approx(grid[int(np.argmin(loss))])
    assert ftrl.best_temperature(table.limit(0), grid) == 1.0


# --- language -----------------------------------------------------------------------------------


def test_languages_of_the_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    found = language.identify(docs).join(docs, "doc_id").where("held_out")
    right, all_ = found.where("lang = lang_pred").count(), found.count()
    assert right >= 0.97 * all_ > 0
    assert found.where("score < 0 or score > 1").isEmpty()


def test_language_of_hard_texts(documents, no_documents):
    rows = {r.doc_id: r for r in language.identify(documents).collect()}
    assert language.identify(documents).count() == documents.count()
    for doc_id, text in documents.select("doc_id", "text").collect():
        letters = any(c.isalpha() for c in text or "")
        assert (rows[doc_id].lang_pred == "und") == (not letters)
        assert 0 <= rows[doc_id].score <= 1
    assert language.identify(no_documents).collect() == []


def test_language_learns_from_text_and_lang_only(documents):
    shuffled = documents.withColumn("source", F.lit("z")).withColumn("n_chars", F.lit(1))
    held = documents.withColumn("lang", F.when(sample.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    want = sorted(map(str, language.identify(documents).collect()))
    assert sorted(map(str, language.identify(shuffled).collect())) == want
    assert sorted(map(str, language.identify(held).collect())) == want


def test_document_frequencies_by_hand(spark):
    docs = spark.createDataFrame([("ab",), ("AB!",), ("",), (None,), ("c",)], "text string")
    frequency, documents = language.document_frequencies(docs)
    at, count = language._counts("ab")
    assert documents == 3 and set(frequency[at]) <= {2, 3} and count.sum() == 4 + 3 + 2


# --- quality classifier ------------------------------------------------------------------------------


def test_quality_of_the_held_out_documents(spark, small):
    folder = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_classifier.classify(docs, labels)
    assert found.count() == docs.count()
    held = found.join(labels, "doc_id").where("held_out")
    assert held.where("predicted = quality").count() >= 0.93 * held.count() > 0
    assert held.where("predicted != int(score >= 0.7)").isEmpty()


def test_quality_of_hard_texts(spark, documents, no_documents):
    labels = spark.createDataFrame([(i * 7, i % 2, 0) for i in range(20)] + [(7, 0, 0), (14, None, 0), (21, 5, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.classify(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    unlabelled = quality_classifier.classify(documents, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert quality_classifier.classify(no_documents, labels).collect() == []


# --- quality rules ---------------------------------------------------------------------------------------


def base_rules(text: str | None) -> tuple[int, int, int, int, int]:
    words = plain_words(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    seen: set[str] = set()
    repeated = 0
    for line in (text or "").split("\n"):
        if plain_words(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_rules_of_hard_texts(documents, no_documents):
    ratio = quality_rules.fit(documents, documents.select("doc_id").limit(10))
    rows = quality_rules.judge(documents, ratio).collect()
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    assert len(rows) == documents.count()
    for r in rows:
        want = base_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(no_documents, quality_rules.fit(no_documents, no_documents)).collect() == []


def test_ratio_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c c"), (3, None)], "doc_id long, text string")
    ratio = quality_rules.fit(docs, docs.where("doc_id = 1").select("doc_id"), deviations=0.0)
    size = quality_rules.SIZE
    good, raw = {"a": 2, "b": 1, "ab": 1, "ba": 1}, {"a": 2, "b": 1, "ab": 1, "ba": 1, "c": 2, "cc": 1}

    def ln(gram):
        return np.log((good.get(gram, 0) + 1) / (5 + size)) - np.log((raw[gram] + 1) / (8 + size))

    rows = {r.doc_id: r.llr for r in quality_rules.judge(docs, ratio).collect()}
    assert rows[1] == pytest.approx(sum(map(ln, ["a", "b", "a", "ab", "ba"])) / 5)
    assert rows[2] == pytest.approx(sum(map(ln, ["c", "c", "cc"])) / 3)
    assert rows[3] == 0 and ratio.limit == pytest.approx(rows[1], abs=1e-8)


def test_every_trusted_document_counts(spark):
    docs = spark.range(12_000).selectExpr("id as doc_id", "'a b' as text")
    ratio = quality_rules.fit(docs, docs.select("doc_id"))
    assert not ratio.values.any() and ratio.limit == 0  # trusted and raw counts are the same


def test_nothing_trusted_decides_nothing(documents):
    rows = quality_rules.judge(documents, quality_rules.fit(documents, documents.select("doc_id").limit(0))).collect()
    assert all(r.kept == (not r.base_failed) for r in rows)


# --- decontamination ---------------------------------------------------------------------------------------------


def hits_by_hand(docs: list, items: list) -> dict:
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))

    windows = collections.defaultdict(set)
    for item_id, text in items:
        mine = words(text)
        size = min(13, len(mine))
        for i in range(len(mine) - size + 1 if size else 0):
            windows[tuple(mine[i : i + size])].add(item_id)
    out = {}
    for doc_id, text in docs:
        mine, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(mine) - size + 1):
                if names := windows.get(tuple(mine[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= names
        names = sorted(str(f) for f in found if f is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out[doc_id] = (len(mine), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(mine))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 7])
def test_hits_of_hard_texts(spark, documents, no_documents, block):
    texts = [r.text for r in documents.select("text").collect() if r.text]
    long = max(texts, key=len).split()
    items = [(1, " ".join(long[100:130])), (2, " ".join(long[:13])), (2, "one"), (3, None), (4, ""), (10, "Two WORDS"), (11, "1 1 1"), (None, "ñandú"), (12, "x" * 200_000), (13, " ".join(long[-13:]))]
    items += [(20, next(t for t in texts if t.endswith("and more")))] * 2
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.decontaminate(documents, table, block).collect()
    want = hits_by_hand([(r.doc_id, r.text) for r in documents.collect()], items)
    assert len(rows) == documents.count()
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]
    assert sum(r.contaminated for r in rows) >= 5
    assert decontaminate.decontaminate(no_documents, table, block).collect() == []
    assert {r.n_hit for r in decontaminate.decontaminate(documents, table.limit(0), block).collect()} == {0}


def test_rarest_word_is_the_key():
    index = decontaminate._index([("a", [5, 7, 9])], {5: 10, 7: 1, 9: 4})
    assert index.keys.tolist() == [7] and index.offset.tolist() == [1]


def test_samples_are_bounded_by_rows(spark):
    """An id of very many texts and a row that repeats very often take no more room than others; one pass for many labels."""
    rows = [(1, f"text {i}", "a") for i in range(500)] + [(2, "the same", "a")] * 500 + [(None, None, "b"), (3, "x", "b"), (3, "x", "c")]
    rows += [(10 + i, "one", f"l{i}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in sample.first_rows(table.repartition(5), "lang", 20).collect()]
    assert sorted(got, key=str) == sorted((tuple(r) for r in sample.first_rows(table, "lang", 20).collect()), key=str)
    counts = {}
    for label, place, _ in got:
        counts.setdefault(label, []).append(place)
    assert len(counts["a"]) == len(set(counts["a"])) == 20 and len(counts["b"]) == 2 and len(counts["c"]) == 1 and len(counts) == 303
    assert sum(text == "the same" for _, _, text in got) <= 1


def test_learning_from_one_id_of_many_rows(spark):
    texts = [("le chat et la souris " * 3, "fr"), ("the cat and the mouse " * 3, "en")]
    rows = [(1, f"{texts[i % 2][0]} {i}", texts[i % 2][1]) for i in range(400)] + [(5, *texts[0])] * 300
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(table, 100).collect()
    assert collections.Counter(r.lang_pred for r in found) == {"fr": 500, "en": 200}
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    assert quality_classifier.classify(table, labels, per_label=50).count() == len(rows)
