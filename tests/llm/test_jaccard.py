"""The Jaccard join against all pairs, with small limits so that every path runs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from vacantia.llm import jaccard

from .conftest import lower_ascii, sentence


def expected(rows):
    """(size, component) by id, from the sets of all rows; a component is named by its least id."""
    sets = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        sets.append((doc_id, grams))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(i)] = root(j)
    least: dict[int, int | None] = {}
    for i, (doc_id, grams) in enumerate(sets):
        if doc_id is not None and grams:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((doc_id, len(grams), least.get(root(i)) if grams else doc_id) for i, (doc_id, grams) in enumerate(sets)), key=repr)


def got(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.group(frame).collect()), key=repr)


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [f"w{rng.random():.6f}"], [out[at], "extra"]])
    return " ".join(out)


def near_copies(seed, groups=4, copies=30):
    """Groups around the limit: some link with a few others only, some with none."""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    texts = []
    for _ in range(groups):
        base = sentence(rng, rng.randint(40, 160)).split()
        texts += [edited(rng, base, rng.randint(0, max(2, len(base) // 12))) for _ in range(copies)]
    texts += [sentence(rng, rng.randint(20, 150)) + " " + passage for _ in range(30)]
    texts += [passage, passage + " end", "the of", "the of", "THE OF", "one two three four", None, "", texts[0], texts[0]]
    rng.shuffle(texts)
    return [(i * 3 + 5, text) for i, text in enumerate(texts)]


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("seed, limits", [(1, {}), (2, {"BLOCK": 4, "LARGE": 8, "DEPTH": 2}), (3, {"BLOCK": 6, "LARGE": 5, "_FREQUENT": 2}), (4, {"BLOCK": 5, "DEPTH": 0, "MOST_FREQUENT": 10, "_FREQUENT": 2})])
def test_components_equal_all_pairs(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(seed)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)


def test_hard_texts(documents, no_documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert got(documents) == expected(rows)
    assert got(no_documents) == []


def test_repeated_ids_and_null_ids(spark):
    text, other = "a b c d e f g h", "q w e r t z u i"
    rows = [(1, text), (1, other), (2, other), (3, text), (None, text), (None, "only here and in no other place"), (9, None), (9, "")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_a_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(100 - i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(50)]
    found = got(spark.createDataFrame(rows, SCHEMA))
    assert found == expected(rows) and {c for _, _, c in found} == {51}


def test_limit_is_met_exactly(spark):
    def text(*numbers):
        return " ".join(f"w{n}" for n in numbers)

    # 20 shingles each, 3 and then 4 of them replaced by as many others at the end.
    rows = [(1, text(*range(24))), (2, text(*range(1, 24), 90)), (3, text(*range(200, 224))), (4, text(*range(203, 224), 91, 92, 93))]
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows)
    small = [(1, text(*range(8))), (2, text(*range(7)))]
    assert expected(small) == got(spark.createDataFrame(small, SCHEMA)) == [(1, 4, 1), (2, 3, 1)]


def test_traits_never_rule_out_a_link():
    """The bound on the overlap, from any prefix sizes, is at least the overlap."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        shared = rng.integers(0, 1 << 62, rng.integers(0, 80)).astype(np.uint64) * np.uint64(4)
        sets = [np.unique(np.concatenate((shared, rng.integers(0, 1 << 62, rng.integers(1, 40)).astype(np.uint64) * np.uint64(4)))) for _ in range(2)]
        prefixes = [s[: len(s) - -(-75 * len(s) // 100) + 1] for s in sets]
        met = np.intersect1d(*prefixes)
        traits = []
        for s, prefix in zip(sets, prefixes):
            low = int(np.searchsorted(s, jaccard._LOW))
            known = met[met <= jaccard._LOW]
            bits = np.zeros((1, 4), np.uint64)
            for token in known:
                bits[0, int(token) % 4] |= np.uint64(1) << np.uint64(int(token >> np.uint64(8)) % 64)
            numbers = {"size": len(s), "low": low, "known": len(known), "unknown": max(0, low - len(prefix))}
            traits.append({**{k: np.array([v]) for k, v in numbers.items()}, "bits": bits})
        common = len(np.intersect1d(*sets))
        if 100 * common >= 75 * (len(sets[0]) + len(sets[1]) - common):
            assert jaccard._may_link({**traits[0], **jaccard._IN_NUMPY}, traits[1])[0]


def test_bloom_condition_keeps_every_id(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"))
    ids = docs.where("doc_id % 7 = 0").unionByName(spark.sql("select cast(null as long) as doc_id"))
    kept = docs.unionByName(spark.sql("select cast(null as long) as doc_id"))
    kept = jaccard.maybe_in(kept, ids).collect()
    assert {r.doc_id for r in ids.collect()} <= {r.doc_id for r in kept} and len(kept) < 900


def test_documents_that_meet_by_chance_are_no_family(spark, monkeypatch):
    """Each document shares two thirds with the next: all hang together by shingles, none link, and none is compared pair by pair."""
    words = [f"w{i}" for i in range(1000)]
    rows = [(i, " ".join(words[i * 20 : i * 20 + 60])) for i in range(45)]
    compared = []

    def counted(regions, sets, blocks=jaccard._blocks):
        compared.append(regions.count())
        return blocks(regions, sets)

    monkeypatch.setattr(jaccard, "_blocks", counted)
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows)
    assert sum(compared) == 0


def test_regions_of_the_same_members_are_one():
    """Whatever shingle they meet by."""
    members = np.array([[8, 3], [9, -4], [7, 12]])
    table = np.concatenate([np.column_stack((np.full(3, region), members[:, 1], np.full((3, 9), 5))) for region in (-7, 2, 40)])
    table = np.concatenate((table, [[50, *row] for row in table[:2, 1:]]))
    out = jaccard._split(table)
    assert sorted(map(len, (out[out[:, 0] == region] for region in np.unique(out[:, 0])))) == [2, 9]
    assert set(out[:, 1]) == {3, -4, 12}


def test_sketches_never_rule_out_a_link():
    """The bound on the overlap is at least the overlap, also where a range holds more shingles than a sketch counts."""
    rng = np.random.default_rng(5)
    linked = 0
    for i in range(400):
        top = 64 if i % 2 else 55  # few ranges of many shingles, or all of them
        draw = lambda n: rng.integers(0, 1 << top, n, dtype=np.uint64)  # noqa: E731, B023
        shared = draw(rng.integers(1, 900))
        sets = [np.unique(np.concatenate((shared, draw(rng.integers(0, len(shared) // 4 + 2))))) for _ in range(2)]
        sketches = np.stack([jaccard._sketch(s) for s in sets])
        common, sizes = len(np.intersect1d(*sets)), np.array([len(s) for s in sets])
        room = jaccard._room(sizes, sketches, np.array([0]), np.array([1]))[0]
        if 100 * common >= 75 * (sizes.sum() - common):
            linked += 1
            assert room
    assert linked > 100
    apart = [np.unique(rng.integers(0, 1 << 64, 400, dtype=np.uint64)) for _ in range(2)]
    assert not jaccard._room(np.array([400, 400]), np.stack([jaccard._sketch(s) for s in apart]), np.array([0]), np.array([1]))[0]
