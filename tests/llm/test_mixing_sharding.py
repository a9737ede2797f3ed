"""Mixing and sharding: flows against brute force, and the laws their rows obey."""

from __future__ import annotations

import collections
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from vacantia.llm import mixing, sharding


def test_targets_are_shared_out_again():
    assert mixing.by_weight({"a": 100, "b": 100}, {"a": 1, "b": 3}) == {"a": 50.0, "b": 150.0}
    # c may take 30 at most; what it leaves goes to the others by weight.
    got = mixing.by_weight({"a": 90, "b": 100, "c": 10}, {"a": 1, "b": 1, "c": 8})
    assert got == {"c": 30.0, "a": 85.0, "b": 85.0}
    assert mixing.by_weight({}, {}) == {} and mixing.by_weight({"a": 0}, {"a": 1}) == {"a": 0.0}


def least_cost(patterns, quotas, most):
    """Best (tokens given, least cost) over all whole flows, by trying every one."""
    edges = [(i, s) for i, (members, _) in enumerate(patterns) for s in members]
    best = (0, 0)
    ranges = [range(min(most * patterns[i][1], quotas[s]) + 1) for i, s in edges]
    for flow in itertools.product(*ranges):
        out, into = collections.Counter(), collections.Counter()
        for (i, s), f in zip(edges, flow):
            out[i] += f
            into[s] += f
        if all(into[s] <= quotas[s] for s in quotas) and all(out[i] <= most * p[1] for i, p in enumerate(patterns)):
            cost = sum(max(0, out[i] - k * p[1]) for i, p in enumerate(patterns) for k in range(1, most))
            best = max(best, (sum(flow), -cost))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_the_cheapest(seed):
    rng = random.Random(seed)
    names = ["a", "b", None]
    choices = [("a",), ("b",), (None,), ("a", "b"), ("b", None)]
    patterns = [(p, rng.randint(0, 2)) for p in rng.sample(choices, 3)]
    quotas = {s: rng.randint(0, 4) for s in names}
    given = mixing.route(patterns, quotas, 2)
    cost = sum(max(0, g - size) for g, (_, size) in zip(given, patterns))
    assert (sum(given), -cost) == least_cost(patterns, quotas, 2)


def test_mix_of_hard_texts(documents, no_documents):
    rows = mixing.mix_by_source(documents).collect()
    texts = {(r.doc_id, r.text): r.source for r in documents.select("doc_id", "text", "source").collect()}
    by_id = {k[0]: k[1] for k in texts}
    sizes, of = collections.Counter(), {}
    for r in documents.select("doc_id", "text", "source").collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        of[r.doc_id] = r.source
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = mixing.by_weight({s: sizes[s] for s in ranked}, {s: i % 3 + 1 for i, s in enumerate(ranked)})
    assert len(rows) == documents.count()
    taken = collections.Counter()
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", by_id[r.doc_id] or ""))
        assert r.source_size == sizes[of[r.doc_id]] and r.target == pytest.approx(target[of[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[of[r.doc_id]] += r.taken
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_by_source(documents.repartition(7)).collect()))
    assert mixing.mix_by_source(no_documents).collect() == []


def test_targets_are_met_closely(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    got = mixing.mix_by_source(spark.createDataFrame(rows, "doc_id long, text string, source string")).join(
        spark.createDataFrame([(i, s) for i, _, s in rows], "doc_id long, source string"), "doc_id"
    )
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 0.002 * r.g + 1


def test_overlapping_sources(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", "a", "b"], 10) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, members array<string>, size long")
    mix = mixing.plan(docs, F.col("members"), F.col("size"))
    timed = mixing.with_times(docs, F.col("members"), F.col("size"), mix, "times")
    assert mix.patterns.count() == 2
    assert timed.agg(F.sum(F.col("times") * F.col("size"))).first()[0] == 3000
    targets = {r.source: r.target for r in mix.sources.collect()}
    assert targets["a"] + targets["b"] == pytest.approx(3000)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_document_is_left_that_fits(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(2000, 9000) if rng.random() < 0.3 else rng.randint(1, 400), rng.choice("abc")) for i in range(300)]
    rows += [(1000 + i // 2, 3, "a") for i in range(40)]  # two rows of one id fit together or not at all
    docs = spark.createDataFrame(rows, "doc_id long, size long, source string")
    members, size = F.array("source"), F.col("size")
    mix = mixing.plan(docs, members, size)
    targets = {r.source: round(r.target) for r in mix.sources.collect()}
    taken = collections.Counter()
    times, sizes = collections.defaultdict(dict), collections.defaultdict(collections.Counter)
    for r in mixing.with_times(docs, members, size, mix, "times").collect():
        taken[r.source] += r.times * r.size
        times[r.source][r.doc_id] = r.times
        sizes[r.source][r.doc_id] += r.size
    step = {r.pattern: (r.passes, r.step) for r in mix.patterns.collect()}
    for source, target in targets.items():
        passes, sign = step[f'["{source}"]']
        remaining = [sizes[source][i] for i, n in times[source].items() if n == passes]
        gap = sign * (target - taken[source])
        assert gap == 0 or 0 < gap < min(remaining)


def test_more_patterns_than_the_driver_holds(spark, documents, monkeypatch):
    rng = random.Random(6)
    sets = [["a"], ["b"], [None], ["a", "b"], ["c", None], ["d"], ["e", "f", "g"], ["g"], [], ["h"]]
    rows = [(i, rng.choice(sets), rng.randint(0, 40)) for i in range(400)] + [(400 + i, [f"s{i}"], i % 3) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, members array<string>, size long").repartition(3)

    def mixed():
        mix = mixing.plan(docs, F.col("members"), F.col("size"))
        timed = mixing.with_times(docs, F.col("members"), F.col("size"), mix, "times")
        targets = {r.source: (r.source_size, r.target) for r in mix.sources.collect()}
        return mix.bounded, targets, sorted(map(str, timed.select("doc_id", "times").collect()))

    whole = sorted(map(str, mixing.mix_by_source(documents).drop("target").collect()))
    bounded, want, times = mixed()
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    assert sorted(map(str, mixing.mix_by_source(documents).drop("target").collect())) == whole
    many, got, again = mixed()
    assert (bounded, many) == (True, False) and again == times and got.keys() == want.keys()
    assert all(got[s][0] == want[s][0] and got[s][1] == pytest.approx(want[s][1]) for s in want)


# --- sharding ------------------------------------------------------------------------------------


def test_schedule_is_largest_first():
    assert sharding.schedule([(3,), (9,), (5,), (4,)], 2) == [0, 0, 1, 1]
    assert sharding.schedule([], 3) == []


def check_shards(rows, texts, shards):
    assert len(rows) == len(texts)
    by_text, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    known = {}
    for doc_id, text in texts:
        known.setdefault(doc_id, text)
    for r in rows:
        data = (known[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        by_text[data].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_shards_of_hard_texts(documents, no_documents):
    texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    rows = sharding.shard_documents(documents).collect()
    check_shards(rows, texts, 24)
    assert {r.doc_id: r.shard for r in rows} == {r.doc_id: r.shard for r in sharding.shard_documents(documents.repartition(9)).collect()}
    assert sharding.shard_documents(no_documents).collect() == []


@pytest.mark.parametrize("limits", [{}, {"MOST_LARGE": 5, "BUNDLES": 600}])
def test_loads_are_even_and_plain_schedule(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(sharding, name, value)
    rng = random.Random(4)
    texts = [(i, "x" * rng.randint(0, 400) + str(i // 2)) for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    narrow = docs.select(sharding.group().alias("group"), sharding.size().alias("size"))
    # With every group a unit of its own the schedule is the plain one.
    decided = sharding.plan(narrow, 6, sharding.MOST_LARGE if limits else 10**9)
    placed = sharding.with_shard(narrow, decided, F.col("group"))
    loads = [r.load for r in placed.groupBy("shard").agg(F.sum("size").alias("load")).collect()]
    assert len(loads) == 6 and max(loads) - min(loads) <= 0.05 * max(loads)
    if not limits:
        sizes = collections.Counter()
        for r in narrow.collect():
            sizes[r.group] += r.size
        units = sorted((size, 0, group) for group, size in sizes.items())
        want = dict(zip((g for *_, g in units), sharding.schedule(units, 6)))
        assert {r.group: r.shard for r in placed.collect()} == want


@pytest.mark.parametrize("ids", ["null", "equal"])
def test_sources_of_null_or_equal_ids_meet_their_targets(spark, ids):
    """Texts differ, so their documents are told apart although their ids do not tell them apart."""
    rng = random.Random(6)
    rows = [(None if ids == "null" else 7, f"n{i} " + "w " * rng.randint(1, 30), "anonymous") for i in range(600)]
    rows += [(1000 + i, f"d{i} " + "w " * rng.randint(1, 30), source) for i in range(900) for source in ["b" if i % 3 else "c"]]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_by_source(table).collect()
    taken, target = collections.Counter(), {}
    for r in found:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert len(target) == 3
    for size, goal in target.items():
        assert abs(taken[size] - goal) <= max(r.size for r in found)


def test_slices_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 3)
    monkeypatch.setattr(sharding, "SLICES", 2)
    table = spark.createDataFrame([(i % 90, f"text {i}") for i in range(600)], "doc_id long, text string")
    got = sharding.shard_documents(table, shards=4).collect()
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
