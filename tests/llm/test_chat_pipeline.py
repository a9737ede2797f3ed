"""Tool-call linking on hand-made conversations; the pipeline's stages against plain rules; the registry."""

from __future__ import annotations

import collections
import json
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from vacantia.llm import chat, queries

from .conftest import sentence
from .test_jaccard import expected
from .test_text_operators import hits_by_hand

SCHEMA = f"conv_id long, turn long, role string, text string, calls {chat.CALLS}, answers string, extra int"
TOOLS = {"add": [chat.Field("a", "integer"), chat.Field("b", "number", required=False, least=0)], "say": [chat.Field("text", "string", least=2, most=4)]}


def call(name, arguments, number="x"):
    return {"id": number, "name": name, "arguments": arguments}


def test_links_order_and_validity(spark):
    rows = [
        (1, 0, "user", "hi", [], None, 1),
        (1, 1, "tool", "early", [], "late", 1),
        (1, 2, "assistant", None, [call("add", '{"b": 2.5, "a": 1}', "late"), call("add", '{"a": "1"}', "none"), call("zap", "{}", None)], None, 1),
        (1, 3, "tool", "again", [], "late", 1),
        (1, 4, "tool", "whose", [], "nobody", 1),
        (1, 5, "assistant", "x", [call("say", '{"text": "abc"}', "late"), call("say", '{"text": "a"}', "s"), call("say", None, "t"), call("say", '{"text":"abc","more":1}', "u"), call("add", "[1]", "v")], None, 1),
        (None, 0, "user", 'quote " \n é', None, None, 1),
    ]
    got = chat.link(spark.createDataFrame(rows, SCHEMA), TOOLS).orderBy("conv_id", "position").collect()
    one = [r for r in got if r.conv_id == 1]
    assert [r.position for r in one] == list(range(14))
    told = [(r.turn, r.kind, r.status, r.valid) for r in one]
    assert told == [
        (0, "message", None, None),
        (2, "message", None, None), (2, "call", "linked", True), (2, "call", "unanswered", False), (2, "call", "unanswered", False), (1, "result", "linked", None),
        (3, "result", "repeated", None), (4, "result", "orphan", None),
        (5, "message", None, None), (5, "call", "repeated", True), (5, "call", "unanswered", False), (5, "call", "unanswered", False), (5, "call", "unanswered", False), (5, "call", "unanswered", False),
    ]
    assert one[2].record == '{"arguments":{"a":1,"b":2.5},"id":"late","name":"add","type":"call"}'
    assert one[5].record == '{"content":"early","id":"late","role":"tool","type":"result"}'
    null = [r for r in got if r.conv_id is None]
    assert len(null) == 1 and json.loads(null[0].record) == {"content": 'quote " \n é', "role": "user", "type": "message"}


def test_nothing_to_link(spark):
    assert chat.link(spark.createDataFrame([], SCHEMA), TOOLS).collect() == []


def test_reply_calls_of_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "_TURNS", 3)
    turns = [(c, t, ["system", "user", "assistant", "assistant", "user"][(t + c) % 5], f"text {t}") for c in range(4) for t in range(11)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for conv in range(4):
        asked = None
        want = {}
        for _, t, role, _ in [x for x in turns if x[0] == conv]:
            if role == "assistant":
                want[t] = f"call-{asked if asked is not None else 'none'}"
            asked = t if role == "user" else asked
        got = {r.turn: r.answers for r in chat.with_reply_calls(frame).where(F.col("conv_id") == conv).collect() if r.answers}
        assert got == want
    linked = chat.link(chat.with_reply_calls(frame), chat.REPLY).collect()
    places = collections.defaultdict(list)
    for r in linked:
        places[r.conv_id].append(r.position)
        json.loads(r.record)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "mix", "shard"]


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The documents before and after each stage."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs.toPandas()]
    for name, run in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        run(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_stages_against_plain_rules(spark, small, stages):
    docs, good, single, clean, mixed, sharded = stages
    labels = spark.read.parquet(f"{small}/labels.parquet").toPandas().set_index("doc_id").quality
    dropped = set(docs.doc_id) - set(good.doc_id)
    assert set(good.doc_id) <= set(docs.doc_id) and list(good.columns) == list(docs.columns) == list(mixed.columns)
    assert sum(labels.get(i) == 1 for i in dropped) <= 0.03 * (labels == 1).sum()
    component = {i: c for i, _, c in expected(list(zip(good.doc_id, good.text)))}
    assert sorted(single.doc_id) == sorted(i for i, c in component.items() if i == c)
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    hit = hits_by_hand(list(zip(single.doc_id, single.text)), items)
    assert sorted(clean.doc_id) == sorted(i for i in single.doc_id if not hit[i][4])
    times = mixed.doc_id.value_counts()
    assert set(times.index) <= set(clean.doc_id) and times.max() <= 3
    assert len(sharded) == len(mixed)
    assert all(sorted(s) == list(range(len(s))) for _, s in sharded.groupby("shard").slot)
    assert (sharded.groupby("text").shard.nunique() == 1).all()


def row_groups(rows):
    """Of (doc_id, text) the row numbers of each component, and of the rows without words."""
    numbered = [(i, text or "") for i, (_, text) in enumerate(rows)]
    component = {i: c for i, n, c in expected(numbered) if n}
    members = collections.defaultdict(list)
    for i, c in component.items():
        members[c].append(i)
    return list(members.values()), [i for i in range(len(rows)) if i not in component]


def test_near_duplicates_by_id_and_text(spark, documents):
    rng = random.Random(8)
    shared, other, lone, again = (sentence(rng, 30) for _ in range(4))
    more = [
        (None, shared), (500, shared),  # a null id linked to an id
        (None, lone), (None, "nulls alone"), (None, "nulls alone"), (None, None), (None, " "),
        (501, other), (502, other), (502, again), (502, None), (502, ""),  # a repeated id: in a foreign group, unique, without words
        (1, sentence(rng, 5)), (503, shared + " end"), (503, other + " end"), (504, other),
        (490, again + " x"), (490, other + " y"),  # least of one group and of another
        (505, "Same set"), (505, "same SET"),
    ]
    extra = spark.createDataFrame([(i, t, "en", "a", 1, 0.0, "mine", 1) for i, t in more], documents.schema)
    docs = documents.unionByName(extra).repartition(3).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    left = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    groups, wordless = row_groups(rows)
    assert sum(left.values()) == len(groups) + len(wordless)
    assert sum(n for (_, text), n in left.items() if not (text or "").strip()) == len(wordless)
    for group in groups:
        mine = {rows[i] for i in group}
        least = min(((i is None, i) for i, _ in mine), key=lambda x: (x[0], x[1] or 0))[1]
        stay = [row for row in mine if left[row]]
        assert len(stay) == 1 and left[stay[0]] == 1 and stay[0][0] == least


def test_shard_keeps_other_columns(spark):
    rows = [(i, f"text {i % 7}", f"g{i}", "old", "old") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group string, shard string, slot string")
    got = corpus_pipeline.shard(spark, docs, "")
    assert sorted(got.columns) == sorted(docs.columns)
    assert sorted((r.doc_id, r.group) for r in got.collect()) == [(i, f"g{i}") for i in range(40)]
    assert dict(got.dtypes)["shard"] == "int" and dict(got.dtypes)["slot"] == "bigint"


@pytest.mark.parametrize("name, run", corpus_pipeline.STAGES)
def test_stages_of_hard_and_empty_tables(spark, small, documents, no_documents, name, run):
    """Null, empty, long and repeated texts, null ids, foreign columns; and no rows at all."""
    got = run(spark, documents, small)
    columns = set(documents.columns) | ({"shard", "slot"} if name == "shard" else set())
    assert set(got.columns) == columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    known = [(r.doc_id, r.text) for r in documents.collect()]
    assert set(rows) <= set(known)
    if name in ("near_duplicates", "benchmark", "mix", "shard"):
        assert all(rows.count((i, text)) == known.count((i, text)) for i, text in known if not (text or "").strip())
    empty = run(spark, no_documents, small)
    assert set(empty.columns) == columns and empty.collect() == []


def test_run_leaves_only_the_last_stage(spark, small):
    import glob

    from vacantia.staging import shared_folder

    before = set(glob.glob(f"{shared_folder(spark)}/vacantia/*"))
    rows = corpus_pipeline.run(spark, small)
    assert rows.count() > 0
    left = {path.rpartition("/")[2].rpartition("-")[0] for path in set(glob.glob(f"{shared_folder(spark)}/vacantia/*")) - before}
    assert "pipeline-mix" in left and not left & {"pipeline-quality", "pipeline-near_duplicates", "pipeline-benchmark", "jaccard-groups", "jaccard-sets"}


def linked_by_hand(rows):
    """(conv_id, position, turn, kind, call_id, status) of (conv_id, turn, text, calls, answers) messages."""
    events = []
    for conv, turn, _, calls, answers in rows:
        events.append((conv, turn, -1, "message" if answers is None else "result", answers))
        events += [(conv, turn, i, "call", call[0]) for i, call in enumerate(calls or [])]
    first = collections.defaultdict(dict)
    for conv, turn, place, kind, name in events:
        if kind != "message" and name is not None:
            first[kind][conv, name] = min(first[kind].get((conv, name), (turn, place)), (turn, place))
    told = collections.defaultdict(list)
    for conv, turn, place, kind, name in events:
        call, result = first["call"].get((conv, name)), first["result"].get((conv, name))
        status, after = None, turn
        if kind == "call":
            status = "unanswered" if name is None else "repeated" if (turn, place) != call else "linked" if result else "unanswered"
        elif kind == "result":
            status = "orphan" if call is None else "repeated" if (turn, place) != result else "linked"
            after = max(turn, call[0]) if call else turn
        told[conv].append((after, {"call": 1, "result": 2}.get(kind, 0), turn, place, kind, name, status))
    out = []
    for conv, mine in told.items():
        for position, (_, _, turn, _, kind, name, status) in enumerate(sorted(mine, key=lambda e: e[:4])):
            out.append((conv, position, turn, kind, name, status))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_links_of_random_conversations(spark, seed):
    """Against a plain version: repeated and missing calls and results, a null conversation, one that holds most messages."""
    rng = random.Random(seed)
    rows, turns = [], collections.Counter()
    for _ in range(150):
        conv = rng.choice(["hot"] * 5 + ["a", "b", None])
        turns[conv] += 1
        calls = [(rng.choice(["c1", "c2", "c3", "c4", None]), "reply", '{"prompt": "x"}') for _ in range(rng.choice([0, 0, 0, 1, 2]))]
        rows.append((conv, turns[conv], f"text {turns[conv]}", calls or None, rng.choice([None, None, None, "c1", "c2", "c3", "c9"])))
    messages = spark.createDataFrame(rows, f"conv_id string, turn long, text string, calls {chat.CALLS}, answers string").withColumn("role", F.lit("user"))
    got = [(r.conv_id, r.position, r.turn, r.kind, r.call_id, r.status) for r in chat.link(messages.repartition(4), chat.REPLY).collect()]
    assert sorted(got, key=str) == sorted(linked_by_hand(rows), key=str)
    assert chat.link(messages.limit(0), chat.REPLY).collect() == []
