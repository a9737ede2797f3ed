"""Mixing sources to target weights by min-cost flow over membership patterns.

A document belongs to one or more sources. Documents are summed up by the set of their sources
(the pattern); patterns are the supply of a flow network and sources its demand. A pattern offers
its tokens once at no cost, a second time at cost 1 and a third time at cost 2, so the cheapest
flow repeats as little as it can. The table of patterns is all the driver sees, up to
``MOST_PATTERNS`` of them. Beyond that patterns stay on Spark: sources are ranked and share out there, a source that
shares no document with others needs no flow, sources that hang together are a flow in one task, and rows meet their pattern by a shuffle.

A pattern's flow is ``r`` whole passes plus a rest. Every document is taken ``r`` times, and
documents in seeded hash order once more until the rest is used up (or once less of ``r + 1``, if that
is the shorter way); one that does not fit is passed over and the next that do are chosen, until none fits. The runs are written down as cuts in the order
per pattern, so whether a row is taken is a plain expression on the row and no text moves.

Defined results: sources weigh by their place in code point order, null last. A null text has size 0
and is taken 0 times. Rows of equal id and text are ordered alike and taken alike; null and repeated ids of different texts are not. Without documents nothing
is taken. Other columns of the input are kept and not used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.components import components
from vacantia.operators.ranking import rank_rows
from vacantia.staging import stage

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
SEED = 17
MOST_PATTERNS = 100_000
# The order is cut first into so many ranges of the hash, then within one of them.
RANGE_BITS = 12


def words(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def by_weight(sizes: dict, weights: dict, most: int = MOST_TIMES) -> dict:
    """Share out the sum of ``sizes`` by weight; what exceeds ``most`` times a size is shared out again."""
    target: dict = {}
    left, open_ = float(sum(sizes.values())), set(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > most * sizes[s]}
        if not over:
            target.update({s: left * weights[s] / total for s in open_})
            break
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


class Network:
    """Min-cost flow by cheapest augmenting paths."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for head, tail, r, c in ((b, a, room, cost), (a, b, 0, -cost)):
            self.out[tail].append(len(self.head))
            self.head.append(head)
            self.room.append(r)
            self.cost.append(c)
        return len(self.head) - 2

    def _path(self, source: int, sink: int) -> list[int] | None:
        best: dict[int, int] = {source: 0}
        by: dict[int, int] = {}
        waiting, queued = [source], {source}
        while waiting:
            following: list[int] = []
            for a in waiting:
                queued.discard(a)
                for e in self.out[a]:
                    b, price = self.head[e], best[a] + self.cost[e]
                    if self.room[e] > 0 and price < best.get(b, 1 << 60):
                        best[b], by[b] = price, e
                        if b not in queued:
                            queued.add(b)
                            following.append(b)
            waiting = following
        if sink not in by:
            return None
        path, at = [], sink
        while at != source:
            path.append(by[at])
            at = self.head[by[at] ^ 1]
        return path

    def fill(self, source: int, sink: int) -> None:
        while path := self._path(source, sink):
            flow = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= flow
                self.room[e ^ 1] += flow


def route(patterns: list[tuple[tuple, int]], quotas: dict, most: int = MOST_TIMES) -> list[int]:
    """Tokens that each pattern gives: quotas are met as far as they can be, with the least repetition.

    Sources that share no pattern, directly or through others, do not affect each other, so each
    connected part is a network of its own.
    """
    parent: dict = {s: s for s in quotas}

    def root(s):
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for members, _ in patterns:
        for s in members[1:]:
            parent[root(s)] = root(members[0])
    parts: dict = {}
    for i, (members, _) in enumerate(patterns):
        if members:
            parts.setdefault(root(members[0]), []).append(i)
    given = [0] * len(patterns)
    for mine in parts.values():
        names = list(dict.fromkeys(s for i in mine for s in patterns[i][0]))
        place = {s: 2 + len(mine) + j for j, s in enumerate(names)}
        net = Network(2 + len(mine) + len(names))
        tiers = []
        for j, i in enumerate(mine):
            tiers.append([net.edge(0, 2 + j, patterns[i][1], times) for times in range(most)])
            for s in patterns[i][0]:
                net.edge(2 + j, place[s], most * patterns[i][1], 0)
        for s in names:
            net.edge(place[s], 1, quotas[s], 0)
        net.fill(0, 1)
        for i, edges in zip(mine, tiers):
            given[i] = sum(net.room[e ^ 1] for e in edges)
    return given


@dataclass(frozen=True)
class Mix:
    """Per source (source, source_size, target); per pattern the passes and the runs. Both may be broadcast if ``bounded``."""

    sources: DataFrame
    patterns: DataFrame
    bounded: bool = True


def _beside(table: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(table) if bounded else table  # MOST_PATTERNS rows at most


def _place(docs: DataFrame) -> Column:
    """Where a document stands in the order: by two hashes of its id and, if there is one, its text, so that null and repeated ids spread."""
    told = [F.col(c) for c in ("doc_id", "text") if c in docs.columns]
    return _at(F.xxhash64(F.lit(SEED), *told), F.xxhash64(*reversed(told), F.lit(SEED)))


def _range(order: Column) -> Column:
    """Signed hashes in order, as range numbers from the least up."""
    return F.shiftright(order, 64 - RANGE_BITS)


def _narrow(docs: DataFrame, members: Column, size: Column) -> DataFrame:
    return docs.select(
        F.array_sort(F.array_distinct(members)).alias("members"),
        size.alias("size"),
        _place(docs).alias("place"),
    ).select("members", "size", "place.*").withColumn("pattern", F.to_json("members", {"ignoreNullFields": "false"}))


def plan(docs: DataFrame, members: Column, size: Column, weights: tuple[int, ...] = WEIGHTS) -> Mix:
    """Decide the mix from (doc_id, text), members array<string> and size; texts are read once."""
    spark = docs.sparkSession
    rows = stage(_narrow(docs, members, size), "mix").table
    per_pattern = rows.groupBy("pattern", "members").agg(F.sum("size").alias("size"))
    sums = per_pattern.limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        return _plan_of_many(rows, stage(per_pattern, "mix-patterns").table, weights)
    sums.sort(key=lambda row: row["pattern"])
    sizes: dict = {}
    for row in sums:
        for source in row["members"]:
            sizes[source] = sizes.get(source, 0) + row["size"]
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    own = {s: sizes[s] for s in ranked}
    # Documents of several sources count in each; what is shared out is every token once.
    total = sum(row["size"] for row in sums)
    counted = sum(own.values())
    scale = total / counted if counted else 1.0
    target = by_weight({s: n * scale for s, n in own.items()} if scale != 1.0 else own, weight)
    given = route([(tuple(row["members"]), row["size"]) for row in sums], {s: round(t) for s, t in target.items()})
    table = [(row["pattern"], *_passes(flow, row["size"])) for row, flow in zip(sums, given)]
    passes = spark.createDataFrame(table, "pattern string, passes long, step int, rest long")
    sources = spark.createDataFrame([(s, int(own[s]), float(target[s])) for s in ranked], "source string, source_size long, target double")
    return Mix(sources, stage(_cuts(rows, passes), "mix-cuts").table)


def _share_out(sources: DataFrame, total: int, most: int = MOST_TIMES) -> Column:
    """The targets of ``by_weight`` for (own, weight), as a column; each step is one sum over all sources."""
    left, open_, capped = 0.0, 1, -1
    while True:
        share = F.lit(left) * F.col("weight") / F.lit(open_)
        over = share > most * F.col("own")
        seen = sources.agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, most * F.col("own"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("open")
        ).first()
        if seen["n"] <= capped or not seen["open"]:
            return F.when(over, most * F.col("own")).otherwise(share)
        left, open_, capped = float(total) - (seen["held"] or 0.0), seen["open"], seen["n"]


def _flows(table: pa.Table) -> pa.Table:
    """(pattern, given) of one connected part."""
    mine = sorted(table.select(["pattern", "size", "at"]).to_pylist(), key=lambda row: row["pattern"])
    quotas = {m["place"]: m["quota"] for row in mine for m in row["at"]}
    given = route([(tuple(m["place"] for m in row["at"]), row["size"]) for row in mine], quotas)
    return pa.table({"pattern": pa.array([row["pattern"] for row in mine], pa.string()), "size": pa.array([row["size"] for row in mine], pa.int64()), "given": pa.array(given, pa.int64())})


def _plan_of_many(rows: DataFrame, sums: DataFrame, weights: tuple[int, ...]) -> Mix:
    """``plan`` for any number of patterns; ``sums`` is a written table of (pattern, members, size)."""
    each = sums.select("pattern", "size", F.explode("members").alias("source"))
    ranked = rank_rows(each.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").isNull(), "source", rank="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    total = sums.agg(F.sum("size")).first()[0]
    counted = ranked.agg(F.sum("source_size")).first()[0]
    scale = total / counted if counted else 1.0
    sources = stage(ranked.select("source", "source_size", "place", weight.alias("weight"), (F.col("source_size") * F.lit(scale)).alias("own")), "mix-sources").table
    sources = stage(sources.withColumn("target", _share_out(sources, total)), "mix-targets").table
    asked = sources.select(F.col("source").alias("_source"), "place", F.bround("target", 0).cast("long").alias("quota"))
    patterns = (
        each.join(asked, F.col("source").eqNullSafe(F.col("_source")))
        .groupBy("pattern", "size")
        .agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("at"))  # the sources of one document
    )
    patterns = stage(patterns, "mix-asked").table
    first = F.col("at")[0]["place"]
    pairs = patterns.where(F.size("at") > 1).select(first.alias("a"), F.explode("at.place").alias("b"))
    tied = patterns.join(components(pairs), first == F.col("node"), "left")
    alone = tied.where(F.col("component").isNull()).select("pattern", "size", F.least(MOST_TIMES * F.col("size"), F.col("at")[0]["quota"]).alias("given"))
    together = tied.where(F.col("component").isNotNull()).select("component", "pattern", "size", "at")
    flows = alone.unionByName(together.groupBy("component").applyInArrow(_flows, "pattern string, size long, given long"))
    whole = F.expr("given div greatest(size, 1)")
    rest = F.col("given") - F.col("_whole") * F.col("size")
    less = 2 * F.col("_rest") > F.col("size")
    passes = flows.withColumn("_whole", whole).withColumn("_rest", rest).select(
        "pattern",
        (F.col("_whole") + less.cast("long")).alias("passes"),
        F.when(less, -1).otherwise(1).alias("step"),
        F.when(less, F.col("size") - F.col("_rest")).otherwise(F.col("_rest")).alias("rest"),
    )
    passes = stage(passes, "mix-passes").table
    return Mix(sources.select("source", "source_size", "target"), stage(_cuts(rows, passes, bounded=False), "mix-cuts").table, bounded=False)


def _at(order: Column, tie: Column) -> Column:
    return F.struct(order.alias("order"), tie.alias("id"))


def _passes(flow: int, size: int) -> tuple[int, int, int]:
    """Whole passes, +1 or -1 for chosen documents, and the words to choose: whichever side is smaller."""
    passes, rest = divmod(flow, size) if size else (0, 0)
    return (passes + 1, -1, size - rest) if 2 * rest > size else (passes, 1, rest)


def _from(place: Column, begin: Column, past: Column) -> Column:
    return begin.isNull() | (place > begin) | (~past & (place == begin))


def _next_run(rows: DataFrame, state: DataFrame, bounded: bool) -> DataFrame:
    """Go on in the order from ``begin`` with documents of at most ``cap`` words until one does not fit ``rest``.

    Adds ``end``, the place of the one that does not fit (null: all fit), and ``gap``, what is left then.
    """
    place = _at(F.col("order"), F.col("id"))
    open_ = rows.join(_beside(state, bounded), "pattern").where(
        (F.col("size") > 0) & (F.col("size") <= F.col("cap")) & _from(place, F.col("begin"), F.col("past"))
    )
    upto = Window.partitionBy("pattern").orderBy("range")
    ranges = (
        open_.groupBy("pattern", "rest", _range(F.col("order")).alias("range"))
        .agg(F.sum("size").alias("size"))
        .withColumn("sum", F.sum("size").over(upto))
        .groupBy("pattern", "rest")
        .agg(
            F.max("sum").alias("all"),
            F.min(F.when(F.col("sum") > F.col("rest"), F.struct("range", (F.col("rest") - F.col("sum") + F.col("size")).alias("left")))).alias("cut"),
        )
    )
    ranges = stage(ranges.select("pattern", (F.col("rest") - F.col("all")).alias("over"), "cut"), "mix-range").table
    # Rows of one place have one sum: they fit together or not at all.
    within = Window.partitionBy("pattern").orderBy("order", "id")
    edge = (
        open_.join(_beside(ranges, bounded), "pattern")
        .where(_range(F.col("order")) == F.col("cut.range"))
        .withColumn("sum", F.sum("size").over(within))
        .groupBy("pattern")
        .agg(
            F.min(F.when(F.col("sum") > F.col("cut.left"), place)).alias("end"),
            (F.first("cut.left") - F.coalesce(F.max(F.when(F.col("sum") <= F.col("cut.left"), F.col("sum"))), F.lit(0))).alias("gap"),
        )
    )
    return (
        state.join(_beside(ranges.select("pattern", "over"), bounded), "pattern", "left")
        .join(_beside(edge, bounded), "pattern", "left")
        .select("pattern", "passes", "step", "runs", "begin", "past", "cap", "end", F.coalesce("gap", "over", "rest").alias("gap"))
    )


def _cuts(rows: DataFrame, passes: DataFrame, bounded: bool = True) -> DataFrame:
    """Per pattern the passes, and the runs of the order that are taken once more.

    A run ends at the first document that does not fit; the next one begins there and passes over
    whatever is larger than what is left. Where equal rows fit one by one but not together it begins behind
    them. Every run gets further in the order, and patterns go on until nothing is left to fill or no document fits.
    """
    place = "struct<order: bigint, id: bigint>"
    run = F.array(F.struct("begin", "past", "cap", "end"))
    state = passes.select(
        "pattern", "passes", "step", "rest", F.lit(None).cast(place).alias("begin"), F.lit(False).alias("past"), F.lit((1 << 63) - 1).alias("cap"),
        F.array().cast(f"array<struct<begin: {place}, past: boolean, cap: bigint, end: {place}>>").alias("runs"),
    )
    columns = ["pattern", "passes", "step", "runs"]
    goes_on = F.col("end").isNotNull() & (F.col("gap") > 0)
    settled = []
    while True:
        done = stage(_next_run(rows, state, bounded).withColumn("runs", F.concat("runs", run)), "mix-run", open=F.count_if(goes_on))
        settled.append(done.table.where(~goes_on).select(columns))
        if not done.seen["open"]:
            return reduce(DataFrame.unionByName, settled)
        state = done.table.where(goes_on).select(
            "pattern", "passes", "step", F.col("gap").alias("rest"), F.col("end").alias("begin"),
            F.coalesce(F.col("end") == F.col("begin"), F.lit(False)).alias("past"), F.col("gap").alias("cap"), "runs",
        )


def with_times(docs: DataFrame, members: Column, size: Column, mix: Mix, into: str) -> DataFrame:
    """``docs`` with how often each row is taken; no row moves where the mix is bounded."""
    key = F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"})
    cut = mix.patterns.select(F.struct(*mix.patterns.columns).alias(f"_{into}"))
    here = _place(docs)
    c = F.col(f"_{into}")
    more = F.exists(
        c.runs,
        lambda run: (size <= run["cap"]) & _from(here, run["begin"], run["past"]) & (run["end"].isNull() | (here < run["end"])),
    )
    return (
        docs.join(_beside(cut, mix.bounded), key == c.pattern, "left")
        .withColumn(into, F.coalesce(c.passes, F.lit(0)) + F.coalesce(c.step * more.cast("int"), F.lit(0)))
        .drop(f"_{into}")
    )


def mix_by_source(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, where ``source`` is the only membership."""
    rows = docs.select("doc_id", "source", "text", words(F.col("text")).alias("size"))
    members = F.array(F.col("source"))
    decided = plan(rows, members, F.col("size"))
    sources = decided.sources.select(F.col("source").alias("_name"), "source_size", "target")
    return (
        with_times(rows, members, F.col("size"), decided, "times")
        .drop("text")
        .join(_beside(sources, decided.bounded), F.col("source").eqNullSafe(F.col("_name")), "left")
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
    )
