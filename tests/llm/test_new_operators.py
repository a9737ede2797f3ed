"""Line dedup, collocations and whitening against brute force and DuckDB, on hard tables and by random ones."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import oracle
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from vacantia.llm import bloom, collocations, line_dedup, queries, whitening

from .conftest import lower_ascii

BLANKS = " \t\n\v\f\r"


def expected_lines(rows, documents=3):
    """(n_lines, n_dropped, kept text) of each (doc_id, text), in order."""
    holders = collections.defaultdict(set)
    keys = []
    for doc_id, text in rows:
        mine = [lower_ascii(line.strip(BLANKS)) for line in (text or "").split("\n")]
        keys.append(mine)
        for key in mine:
            if len(key) >= line_dedup.FEWEST_CHARACTERS:
                holders[key].add(doc_id)
    least = lambda i: (i is not None, i or 0)
    keeper = {key: max(ids, key=least) for key, ids in holders.items() if len(ids) >= documents}
    out = []
    for (doc_id, text), mine in zip(rows, keys):
        lines = (text or "").split("\n")
        kept = [line for line, key in zip(lines, mine) if key not in keeper or keeper[key] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def found_lines(table):
    return [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.without_repeated_lines(table).collect()]


def line_rows():
    rng = random.Random(3)
    shared = ["  A line that Many documents share\t", "a LINE that many documents share", "é" * 20, "short", "x" * 19, "", " \v "]
    rows = [(i, "\n".join(rng.choice(shared + [f"a line of its own, number {i} {j}"]) for j in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, "\n".join(shared * 300)), rows[5], rows[5], (rows[6][0], "é" * 20 + "\nanother text of the same id")]
    rows += [(None, "a line that many documents share\nnull id"), (None, "é" * 20), (None, None)]
    return rows


def test_lines_of_hard_texts(spark):
    rows = line_rows()
    table = spark.createDataFrame([(i, t, "mine", 7) for i, t in rows], "doc_id long, text string, key string, lost int").repartition(5)
    order = lambda r: (r[0] is None, r[0] or 0, r[3], r[1], r[2])
    assert sorted(found_lines(table), key=order) == sorted(expected_lines(rows), key=order)


def test_lines_of_fixture_and_empty_table(documents, no_documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[3], r[2])
    assert sorted(found_lines(documents), key=order) == sorted(expected_lines(rows), key=order)
    assert found_lines(no_documents) == []
    digest = line_dedup.summary(line_dedup.without_repeated_lines(documents)).where("doc_id = 0").first()
    assert digest.kept_sha256 == hashlib.sha256(b"").hexdigest() and digest.n_lines == 1


def test_lines_with_a_full_filter(spark, monkeypatch):
    """A filter that says maybe to everything changes nothing but the shuffle."""
    rows = line_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "_filters", lambda texts: np.full(bloom.BITS // 8, 255, np.uint8))
    order = lambda r: (r[0] is None, r[0] or 0, r[3], r[1], r[2])
    assert sorted(found_lines(table), key=order) == sorted(expected_lines(rows), key=order)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ é\n\t\v", max_size=60)), max_size=8), st.integers(1, 50))
def test_line_keys(texts, limit):
    got = []
    for part in line_dedup.slices(pa.array(texts, pa.string()), limit):
        lines = line_dedup._Lines(part)
        data = lines.data.tobytes()
        assert lines.lines.tolist() == [(t or "").count("\n") + 1 for t in texts[part.first : part.first + part.rows]]
        got += [(part.first + r, n, data[a:b].decode()) for r, n, a, b in zip(lines.row, lines.number, lines.start, lines.end)]
        assert len(set(zip(lines.hashes().tolist(), [k for *_, k in got[-len(lines.row) :]]))) == len({k for *_, k in got[-len(lines.row) :]}) or not len(lines.row)
    want = []
    for i, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n")):
            key = lower_ascii(line.strip(BLANKS))
            if len(key) >= line_dedup.FEWEST_CHARACTERS:
                want.append((i, n, key))
    assert got == want


def test_seen_filters(spark):
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    shares = [hashes[:200], hashes[150:], hashes[:0]]

    def fill(batches):
        for batch in batches:
            for number in batch["id"].to_pylist():
                seen = bloom.Seen()
                seen.add(shares[number])
                yield from seen.slices()

    parts = spark.range(3).repartition(3).mapInArrow(fill, bloom.SLICES)
    twice, once = bloom.merged(parts, "twice"), bloom.merged(parts, "once")
    assert bloom.holds(once, hashes).all() and bloom.holds(twice, hashes[150:200]).all()
    assert not bloom.holds(twice, hashes[:150]).any() and not bloom.holds(once, rng.integers(0, 1 << 63, 300, dtype=np.uint64)).any()


def test_packed_filter_sets_the_same_bits():
    hashes = np.random.default_rng(3).integers(0, 1 << 63, 3000, dtype=np.uint64)
    seen, packed = bloom.Seen(), bloom.Once()
    for part in (hashes[:2000], hashes[1000:]):
        seen.add(part)
        packed.add(part)
    assert np.array_equal(np.packbits(seen.once), packed.packed)
    assert [b.to_pydict()["once"] for b in seen.slices()] == [b.to_pydict()["once"] for b in packed.slices()]


def expected_phrases(rows, support, most):
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    often = {k: f for k, f in counts.items() if f >= support}
    out = []
    for (lang, phrase), a in often.items():
        if len(phrase) < 2:
            continue
        inside = any(
            o == lang and len(q) > len(phrase) and 100 * f >= 100 * a and any(q[i : i + len(phrase)] == phrase for i in range(len(q)))
            for (o, q), f in often.items()
        )
        if inside:
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = often[lang, phrase[:k]], often[lang, phrase[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(phrase), a, left, right, total[lang], score))
    ranked = []
    for lang in total:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(mine, 1)]
    return sorted(ranked)


def found_phrases(table, support, most):
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in names) for r in collocations.collocations(table, support, most).collect())


@pytest.mark.parametrize("seed, support, most", [(0, 5, 2000), (1, 3, 7), (2, 12, 2000)])
def test_collocations_of_random_texts(spark, monkeypatch, seed, support, most):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 400)
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "ÉA", "x\x0by", "a-b", "New", "york", "", "\x1c"]
    rows = []
    for i in range(80):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), rng.choice([text, text, text, "New York of the", None])))
    rows.append(("en", "of the é " * 300))
    table = spark.createDataFrame([(lang, text, 1.0, "mine") for lang, text in rows], "lang string, text string, score double, phrase string").repartition(6)
    assert found_phrases(table, support, most) == expected_phrases(rows, support, most)


def test_collocations_of_fixture_and_empty_table(documents, no_documents):
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").collect()]
    assert found_phrases(documents, 30, 2000) == expected_phrases(rows, 30, 2000)
    assert found_phrases(no_documents, 30, 2000) == []


def rows_from_python(frame):
    """The rows that the Python step of a plan makes."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    return plan.metrics().apply("pythonNumRowsReceived").value()


def test_a_phrase_is_told_once_per_core(spark):
    rng = random.Random(4)
    words = ["the", "of", "new", "york", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(400)]
    every = np.full(bloom.BITS // 8, 255, np.uint8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = collocations.named(spark.createDataFrame([("en", text) for text in texts], "lang string, text string"))
        counts = {parts: collocations.count(rows.repartition(parts), every, 1) for parts in (8, 40)}
        made = {parts: rows_from_python(frame) for parts, frame in counts.items()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    few, many = (sorted(map(tuple, frame.collect())) for frame in counts.values())
    assert few == many
    assert max(made.values()) <= len(few) * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("held", [1, 500, 5_000, 1 << 26])
def test_counts_added_up_in_a_task(monkeypatch, held):
    monkeypatch.setattr(collocations, "HELD_BYTES", held)
    rng = random.Random(held)
    wanted, given_in = collections.Counter(), []
    for _ in range(60):
        keys = [("en", size, f"{rng.randint(0, 9) if rng.random() < 0.5 else rng.randint(0, 999)}é") for size in (0, 1, 2) for _ in range(rng.randint(0, 9))]
        counts = [rng.randint(1, 9) for _ in keys]
        for key, n in zip(keys, counts):
            wanted[key] += n
        langs, sizes, phrases = zip(*keys) if keys else ((), (), ())
        columns = [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())]
        given_in.append(pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "n"]))
    out = [row for batch in collocations.added_up(iter(given_in)) for row in zip(*batch.to_pydict().values())]
    got = collections.Counter()
    for *key, n in out:
        got[tuple(key)] += n
    assert got == wanted
    assert len(out) <= sum(batch.num_rows for batch in given_in)
    assert held < 1 << 26 or len(out) == len(wanted)
    assert list(collocations.added_up(iter([]))) == []


def test_scores_beyond_64_bits(spark):
    big = 10**13
    found = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 1)], "lang string, size int, phrase string, f long")
    words = spark.createDataFrame([("en", 4 * 10**14 + 3)], "lang string, n long")
    row = collocations.scored(found, words).first()
    assert row.score == 1000 * (big - 1) * (4 * 10**14 + 3) // (big * (big + 7))


@pytest.mark.parametrize("name", ["op11_phrase_mining", "op12_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    frame = queries.QUERIES[name](spark, folder)
    assert oracle.compare(frame, oracle.duck(folder), queries.ORACLES[name]) is None
    assert frame.count() > 10


def checked_whitening(rows, vectors, most=8):
    """Compare (vec_id, component, n, deviation, whitened, explained, identity_error) with a plain computation."""
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100000
    n, total = len(x), x.sum(axis=0)
    apart = x - total / n
    values, basis = np.linalg.eigh(apart.T @ apart / n)
    values, basis = values[::-1], basis[:, ::-1]
    keep = [i for i in range(min(most, x.shape[1])) if values[i] > 1e-12 * values.sum()]
    assert len(rows) == n * len(keep) and {r.n for r in rows} == {n}
    assert sorted(r.deviation for r in rows) == sorted(((n * x - total).astype(object) ** 2).sum(axis=1).tolist() * len(keep))
    for i in keep:
        mine = sorted((r.vec_id, r.whitened) for r in rows if r.component == i + 1)
        theirs = apart @ basis[:, i] / np.sqrt(values[i])
        got = np.array([w for _, w in mine])
        assert min(np.abs(got - theirs).max(), np.abs(got + theirs).max()) < 1e-7
        assert all(r.explained == pytest.approx(values[i] / values.sum(), rel=1e-9) for r in rows if r.component == i + 1)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whitening_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = table.orderBy("vec_id").collect()
    rows = queries.QUERIES["op13_embedding_whitening"](spark, "/root/testdata/sf0.01").collect()
    checked_whitening(rows, [r.embedding for r in data])


def test_whitening_of_hard_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, (rng.standard_normal(5) * [9, 4, 2, 1, 1e4]).tolist()) for i in range(40)]
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    schema = "vec_id long, embedding array<double>, n string, component string"
    table = spark.createDataFrame([(i, v, "mine", "too") for i, v in good + [(100 + i, v) for i, v in enumerate(bad)]], schema).repartition(4)
    checked_whitening(whitening.whiten(table).collect(), [v for _, v in good])


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, None], [[], []]])
def test_nothing_to_whiten(spark, vectors):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    frame = whitening.whiten(table)
    assert frame.collect() == [] and frame.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_directions_than_dimensions(spark):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(None, rng.standard_normal(12).tolist()) for _ in range(4)] * 2, "vec_id long, embedding array<double>")
    rows = whitening.whiten(table).collect()
    assert {r.component for r in rows} == {1, 2, 3} and len(rows) == 24 and rows[0].identity_error < 1e-9


def test_deviations_beyond_64_bits():
    centre = whitening.Centre(10**9, np.array([5, 5]), np.array([3, 4]))
    x = np.array([[5, 5], [1 << 20, 7]])
    assert centre.deviations(x) == [25, None]


@pytest.mark.parametrize("seed", range(6))
def test_components_equal_a_symmetric_solver(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 40))
    basis = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = rng.choice([0.0, 1e-6, 1.0, 1.0 + 1e-9, 2.0, 1e5], size) if seed % 2 else rng.uniform(0, 10, size)
    matrix = basis @ np.diag(values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    got, vectors = whitening.components_of(matrix, 8)
    assert np.allclose(got, np.sort(values)[::-1][:8], rtol=1e-9, atol=1e-9 * max(values.max(), 1))
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-9 * max(values.max(), 1)
