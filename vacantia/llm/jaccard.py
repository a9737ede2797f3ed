"""Exact Jaccard join of word shingles as a join in a metric space.

1 - Jaccard is a metric. Two documents link within ``EPSILON`` of each other. Regions are joined
recursively:

1. Single shingles are the first pivots. A document is at distance ``1 - 1 / size`` from each of its own
   shingles and at 1 from all others, so all its shingles are equally near; the rarest counts as home. A linked document
   may lack that one, but by the bound on its distance it cannot lack more than ``size - ceil(0.75 * size)`` shingles:
   the document is replicated into the regions of that many of its next rarest shingles. Any two linked
   documents therefore meet in the region of the rarest shingle they share. Regions of one document end here, and
   a member whose size and shared regions rule out every other member leaves its region.
2. Regions of the same members are one. Every region takes a document as its pivot and measures its members' distances. Members
   within ``EPSILON`` are linked to the pivot and need not be compared with each other, as they already are one component. Of members
   of different components those go on whose sketches, counts of their shingles by ``BUCKETS`` ranges of the hash, leave room for a link. What
   hangs together by such pairs is a family and counts as one region, so that a group of copies is not worked through once for each of its
   shingles, and documents that meet by chance do not grow into one family that holds a part of the corpus.
3. A large region whose members are not all one component takes several pivots and is cut into Voronoi cells. A
   member also goes into the cell of another pivot if it is at most ``2 * EPSILON`` further from it than from its own: by the
   triangle inequality no link is lost. Cells are regions again, down to ``DEPTH``.
4. What is small, or what pivots no longer cut, is compared pair by pair, block against block of ``BLOCK`` members,
   skipping pairs of one component, with exact overlaps from a matrix product. Members of the largest component only meet the others.

Exact copies are one class with one representative. Links between classes are exact: overlaps are counted on
the sets of 64-bit shingle hashes. Only links that join components are kept, never all pairs of a group.

Order by rarity: shingles that are frequent within some chunk of documents are counted and ordered by their counts,
all others before them by hash. Any order gives the same links; this one keeps common passages out of the regions.

Defined results: null texts and texts without words have no shingles and link with nothing. With fewer than ``SHINGLE``
words the whole sequence is the one shingle. Rows of one id are rows of one document if their texts are equal, and are otherwise
told apart by their sets. A null id is a row of its own set; a component of null ids only has a null component_id.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.words import PLAIN, joined, lowered, mixed, slices, split_words
from vacantia.operators.components import components
from vacantia.staging import stage, staging_scope

SHINGLE = 5
SIMILAR = 75  # per cent
EPSILON = 1 - SIMILAR / 100
BLOCK = 128
PIVOTS = 4
DEPTH = 1
LARGE = 1024
BUCKETS = 256
# A shingle that is not frequent and whose hash is among this part of all hashes is low.
_LOW_SHARE = 0.2
_LOW = np.uint64(int(_LOW_SHARE * 2**64))
# A shingle is counted as frequent where it is in this many of a chunk's documents.
_CHUNK = 1 << 20
_FREQUENT = 4
MOST_FREQUENT = 1 << 16
_BLOOM_BITS = 23


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingles of every row."""
    for texts in slices(column):
        words = split_words(texts, PLAIN, lowered(texts.data))
        whole = joined(words.hash, SHINGLE)
        # Shingles that run into the next row are left out by never slicing them.
        for i in range(texts.rows):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= SHINGLE:
                mine = np.sort(whole[a : b - SHINGLE + 1])
                keep = np.empty(len(mine), bool)
                keep[:1] = True
                np.not_equal(mine[1:], mine[:-1], out=keep[1:])
                yield texts.first + i, mine[keep]
            else:
                yield texts.first + i, joined(words.hash[a:b], int(b - a)) if b > a else words.hash[:0]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _class(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def class_of(text: Column) -> Column:
    """The class that ``group`` gives a text; null without words."""

    @F.arrow_udf("long")
    def number(column: pa.Array) -> pa.Array:
        return pa.array([_class(_digest(shingles)) if len(shingles) else None for _, shingles in _sets(column)], pa.int64())

    return number(text)


def _flush(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    token, count = np.unique(np.concatenate(held), return_counts=True)
    often = count >= _FREQUENT
    return token[often].view(np.int64), count[often]


_SCAN = "doc_id {kind}, class long, digest binary, size long, token long, count long"


def _scan(docs: DataFrame) -> DataFrame:
    """A row per document with its class, and a row per frequent shingle of a chunk with its count.

    Copies within a task count once, so a group of copies does not make its shingles frequent.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        many = 0
        for batch in batches:
            classes, digests, sizes, tokens, counts = [], [], [], [], []
            for _, shingles in _sets(batch["text"]):
                digest = _digest(shingles)
                number = _class(digest)
                classes.append(number)
                digests.append(digest)
                sizes.append(len(shingles))
                if number not in seen:
                    seen.add(number)
                    held.append(shingles)
                    many += len(shingles)
                if many >= _CHUNK:
                    token, count = _flush(held)
                    tokens.append(token)
                    counts.append(count)
                    held, many = [], 0
            ids = batch["doc_id"]
            yield _scanned(ids, classes, digests, sizes)
            for token, count in zip(tokens, counts):
                yield _frequent(ids.type, token, count)
        if held:
            yield _frequent(ids.type, *_flush(held))

    return docs.select("doc_id", "text").mapInArrow(read, _SCAN.format(kind=docs.schema["doc_id"].dataType.simpleString()))


_NAMES = ["doc_id", "class", "digest", "size", "token", "count"]


def _scanned(ids: pa.Array, classes: list, digests: list, sizes: list) -> pa.RecordBatch:
    none = pa.nulls(len(classes), pa.int64())
    columns = [ids, pa.array(classes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), none, none]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _frequent(kind: pa.DataType, token: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(token), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(token), kind), none, pa.nulls(len(token), pa.binary()), none, pa.array(token), pa.array(count)], _NAMES
    )


def _prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(region, class): each document in the regions of its rarest shingles.

    One more row per document, in a region of its own, tells in ``low`` how many of its shingles are ``_is_low``. ``frequent`` holds the frequent shingles from the rarest up; it is of bounded size and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = np.argsort(shared.value, kind="stable")
        known = shared.value[ranked]
        slot = np.zeros(1 << 20, bool)
        slot[(known >> np.uint64(44)).astype(np.int64)] = True
        seen: set[int] = set()
        for batch in batches:
            tokens, classes, lengths, lows = [], [], [], []
            for _, shingles in _sets(batch["text"]):
                size = len(shingles)
                number = _class(_digest(shingles))
                if not size or number in seen:
                    continue
                seen.add(number)
                room = size - -(-SIMILAR * size // 100) + 1
                common = slot[(shingles >> np.uint64(44)).astype(np.int64)]
                place = np.flatnonzero(common)
                if len(place) and len(known):
                    at = np.minimum(np.searchsorted(known, shingles[place]), len(known) - 1)
                    hit = known[at] == shingles[place]
                    common[place] = hit
                    order = np.argsort(ranked[at[hit]], kind="stable")
                    often = shingles[place[hit]][order]
                    shingles = shingles[~common]
                else:
                    often = shingles[:0]
                lows.append(int(np.searchsorted(shingles, _LOW)))
                tokens.append(np.concatenate((shingles, often))[:room])
                classes.append(number)
                lengths.append(room)
            if tokens:
                numbers = np.array(classes, np.int64)
                told = pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(numbers), pa.array(lows, pa.int32())], ["region", "class", "low"])
                met = [np.concatenate(tokens).view(np.int64), np.repeat(numbers, lengths)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, met), pa.nulls(len(met[0]), pa.int32())], ["region", "class", "low"])
                yield told

    return docs.select("text").mapInArrow(read, "region long, class long, low int")


_BITS = ("b0", "b1", "b2", "b3")


def _traits(met: DataFrame, told: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class what ``_may_link`` needs: size, low, ``known`` (its low regions that it shares), ``unknown`` (low shingles
    beyond its regions), ``shared`` (all its shared regions), and a 256-bit map of the low regions that it shares."""
    slot = F.pmod(F.xxhash64("region"), F.lit(256))
    is_low = F.col("region").between(0, int(_LOW))
    bit = F.expr("shiftleft(1L, int(pmod(xxhash64(region), 64)))")
    bits = [F.bit_or(F.when(is_low & (F.floor(slot / 64) == i), bit).otherwise(F.lit(0).cast("long"))).alias(b) for i, b in enumerate(_BITS)]
    sums = met.groupBy("class").agg(F.count(F.lit(1)).alias("shared"), F.count_if(is_low).alias("known"), *bits)
    room = F.col("size") - F.ceil(F.col("size") * SIMILAR / 100) + 1
    low = F.col("low").cast("long")
    return (
        sums.join(told.groupBy("class").agg(F.max("low").alias("low")), "class")
        .join(classes.select("class", "size"), "class")
        .withColumns({"low": low, "unknown": F.greatest(low - room, F.lit(0)).cast("long")})
        .select("class", "size", "low", "known", "unknown", "shared", *_BITS)
    )


def _may_link(x: dict, y: dict):
    """Can two classes of these traits reach the overlap that their sizes ask for? Columns or arrays alike.

    A low shingle that both have is in regions of both, or beyond the regions of one. The first kind is bounded by the low
    regions of either, less one for each slot of its bit map in which the other has none; all of the second kind and all
    that is not low of the smaller rest are granted.
    """
    least, most, bits_without = x["least"], x["most"], x["without"]
    met = least(x["known"] - bits_without(x, y), y["known"] - bits_without(y, x))
    overlap = met + x["unknown"] + y["unknown"] + least(x["size"] - x["low"], y["size"] - y["low"])
    sized = 100 * least(x["size"], y["size"]) >= SIMILAR * most(x["size"], y["size"])
    return sized & ((100 + SIMILAR) * overlap >= SIMILAR * (x["size"] + y["size"]))


_IN_SQL = {
    "least": F.least,
    "most": F.greatest,
    "without": lambda p, q: sum((F.bit_count(p[b].bitwiseAND(F.bitwise_not(q[b]))) for b in _BITS[1:]), F.bit_count(p[_BITS[0]].bitwiseAND(F.bitwise_not(q[_BITS[0]])))),
}
_IN_NUMPY = {
    "least": np.minimum,
    "most": np.maximum,
    "without": lambda p, q: np.bitwise_count(p["bits"] & ~q["bits"]).sum(axis=1, dtype=np.int64),
}
_NUMBERS = ("size", "low", "known", "unknown")


def _possible_pairs(pairs: DataFrame, traits: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that may link by their traits."""
    for side in ("a", "b"):
        named = [F.col("class").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in (*_NUMBERS, *_BITS))]
        pairs = pairs.join(traits.select(*named), side)
    x, y = ({c: F.col(f"{side}_{c}") for c in (*_NUMBERS, *_BITS)} for side in ("a", "b"))
    return pairs.where(_may_link({**x, **_IN_SQL}, y)).select("a", "b")


def _promising(met: DataFrame, traits: DataFrame) -> DataFrame:
    """(region, class, pivot): members of a region that may link with another member; the others leave it.

    A region falls apart into the components of its possible links. This drops documents that meet by a chance phrase or a
    common passage before any set is read, and keeps groups that meet by chance apart. The pivot is the member
    that shares most of itself, as the least edited copy of a text does. Regions of more than ``LARGE`` members stay whole, with
    the best pivot among the first of them. Regions fallen apart are numbered by their members, so those of the same members are one.
    """
    columns = ["region", "class", *_NUMBERS, *_BITS, "shared"]
    rows = met.join(traits, "class").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(columns)), np.int64)
        large = pivot = None
        for batch in batches:
            table = np.stack([batch[name].to_numpy(zero_copy_only=False) for name in columns], axis=1)
            if large is not None:
                same = table[:, 0] == large
                yield _members(table[same], pivot)
                if same.all():
                    continue
                large, table = None, table[~same]
            held = np.concatenate((held, table))
            last = int(np.searchsorted(held[:, 0], held[-1, 0])) if len(held) else 0
            yield _members(_split(held[:last]))
            held = held[last:]
            if len(held) > LARGE:
                large, pivot = held[0, 0], _pivots(held)[0]
                yield _members(held, pivot)
                held = held[:0]
        if len(held):
            yield _members(_split(held))

    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "region long, class long, pivot long").distinct()


def _pivots(table: np.ndarray) -> np.ndarray:
    """For each row of a table sorted by region, the class that stands as its region's pivot."""
    if not len(table):
        return table[:, 1]
    order = np.lexsort((table[:, 1], -table[:, -1] / table[:, 2], table[:, 0]))
    begins = np.searchsorted(table[:, 0], table[:, 0])
    return table[order, 1][begins]


def _members(table: np.ndarray, pivot: int | None = None) -> pa.RecordBatch:
    pivots = _pivots(table) if pivot is None else np.full(len(table), pivot, np.int64)
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(table[:, i])) for i in (0, 1)), pa.array(pivots)], ["region", "class", "pivot"])


def _split(table: np.ndarray) -> np.ndarray:
    """Rows (region, class, numbers, bits, shared), sorted by region, that have a possible partner in their region.

    The region becomes a number for the members of the component of possible links within it; the result is sorted by that. Should two
    components get one number, they count as one region, which loses no pair.
    """
    if not len(table):
        return table
    traits = {name: table[:, 2 + i] for i, name in enumerate(_NUMBERS)}
    traits["bits"] = np.ascontiguousarray(table[:, 2 + len(_NUMBERS) : 2 + len(_NUMBERS) + len(_BITS)]).view(np.uint64)

    def fits(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return _may_link({**{k: v[one] for k, v in traits.items()}, **_IN_NUMPY}, {k: v[other] for k, v in traits.items()})

    label, alive = _joined(table[:, 0], fits)
    named = np.zeros(len(table), np.uint64)
    np.add.at(named, label, mixed(mixed(table[:, 1].view(np.uint64)) + np.uint64(1)))
    out = table[alive].copy()
    out[:, 0] = mixed(named[label[alive]]).view(np.int64)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _joined(region: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by region: the first row that each hangs together with by the pairs within a region that ``fits`` accepts, and whether it is in such a pair."""
    end = np.searchsorted(region, region, "right")
    first, step = np.arange(len(region)), 1
    ones, others = [], []
    while len(first := first[first + step < end[first]]):
        other = first + step
        good = fits(first, other)
        ones.append(first[good])
        others.append(other[good])
        step += 1
    one, other = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ones, others))
    label = np.arange(len(region))
    while True:
        before = label.copy()
        np.minimum.at(label, one, label[other])
        np.minimum.at(label, other, label[one])
        label = label[label]
        if (label == before).all():
            break
    alive = np.zeros(len(region), bool)
    alive[one] = alive[other] = True
    return label, alive


def with_maybe(rows: DataFrame, ids: DataFrame, into: str, key: str = "doc_id") -> DataFrame:
    """``rows`` with a flag that is true for every ``key`` of ``ids`` and for few others; what it lets through still has to be joined.

    The flag comes from a table of 2 ** _BLOOM_BITS bits, whatever the number of ids, that is broadcast: no row moves, and no text goes
    to a Python worker for it.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << _BLOOM_BITS))
    bit = F.expr(f"shiftleft(1L, int(pmod(xxhash64(`{key}`), {1 << _BLOOM_BITS}) & 63))")
    words = ids.groupBy(F.shiftright(slot, 6).alias(f"{into}_word")).agg(F.bit_or(bit).alias(f"{into}_bits"))
    words = stage(words, "jaccard-bits").table  # 2 ** (_BLOOM_BITS - 6) rows at most
    met = rows.withColumn(f"{into}_at", F.shiftright(slot, 6)).join(F.broadcast(words), F.col(f"{into}_at") == F.col(f"{into}_word"), "left")
    flag = F.coalesce(F.col(f"{into}_bits").bitwiseAND(bit) != 0, F.lit(False))
    return met.withColumn(into, flag).drop(f"{into}_at", f"{into}_word", f"{into}_bits")


def maybe_in(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose ``key`` may be in ``ids``."""
    return with_maybe(rows, ids, "_maybe", key).where("_maybe").drop("_maybe")


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """How many of the shingles are in each of ``BUCKETS`` ranges of the hash, 255 at most."""
    bucket = (shingles.view(np.uint64) >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)
    return np.minimum(np.bincount(bucket.astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)


def _room(sizes: np.ndarray, sketches: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Do the sketches of rows ``one`` and ``other`` leave room for the overlap that their sizes ask for?

    What both have in a range is at most the smaller count; what the counts do not tell of a set, being cut at 255, is granted.
    """
    out = np.zeros(len(one), bool)
    x, y = sizes[one], sizes[other]
    sized = np.flatnonzero(100 * np.minimum(x, y) >= SIMILAR * np.maximum(x, y))
    for begin in range(0, len(sized), 1 << 14):
        at = sized[begin : begin + (1 << 14)]
        mine, its = sketches[one[at]], sketches[other[at]]
        untold = np.minimum(x[at] - mine.sum(axis=1, dtype=np.int64), y[at] - its.sum(axis=1, dtype=np.int64))
        overlap = np.minimum(mine, its).sum(axis=1, dtype=np.int64) + untold
        out[at] = (100 + SIMILAR) * overlap >= SIMILAR * (x[at] + y[at])
    return out


def _shingled(docs: DataFrame) -> DataFrame:
    """(class, shingles, size, sketch) per document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sets, sketches = [], [], []
            for _, shingles in _sets(batch["text"]):
                classes.append(_class(_digest(shingles)))
                sets.append(shingles.view(np.int64))
                sketches.append(_sketch(shingles).tobytes())
            columns = [pa.array(classes, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(map(len, sets), pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["class", "shingles", "size", "sketch"])

    return docs.select("text").mapInArrow(read, "class long, shingles array<long>, size long, sketch binary")


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, distance) of (a, b), exact."""
    other = sets.select(F.col("class").alias("b"), F.col("shingles").alias("_b"))
    mine = sets.select(F.col("class").alias("a"), F.col("shingles").alias("_a"))
    both = pairs.join(other, "b").join(mine, "a")
    common = F.size(F.array_intersect("_a", "_b")).cast("long")
    union = F.size("_a") + F.size("_b") - common
    return both.select("a", "b", (100 * common >= SIMILAR * union).alias("linked"), (1 - common / union).alias("distance"))


def _labelled(regions: DataFrame, joined: DataFrame) -> DataFrame:
    """Regions with their members' components so far, ``joined``; those of one component only are left out."""
    rows = regions.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("component", "class")).drop("component")
    per_region = rows.groupBy("region").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("members"))
    open_ = stage(per_region.where(F.col("_low") != F.col("_high")).select("region", "members"), "jaccard-open").table
    return rows.join(open_, "region")


def _cells(regions: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cut large regions into Voronoi cells: (links found, cells, regions that pivots do not cut)."""
    seeded = [F.min_by("class", F.struct(F.xxhash64("class", F.lit(i)), "class")).alias(f"p{i}") for i in range(PIVOTS)]
    chosen = regions.groupBy("region").agg(*seeded).select("region", F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("pivots"))
    asked = regions.join(stage(chosen, "jaccard-pivots").table, "region").select("region", "class", "members", F.explode("pivots").alias("pivot"))
    asked = stage(asked, "jaccard-asked").table
    pairs = asked.where(F.col("class") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    needed = maybe_in(sets, regions.select("class"), "class")
    known = stage(_distances(pairs, needed), "jaccard-distances").table
    measured = asked.join(known.select(F.col("a").alias("pivot"), F.col("b").alias("class"), "distance"), ["pivot", "class"], "left")
    measured = measured.withColumn("distance", F.when(F.col("class") == F.col("pivot"), 0.0).otherwise(F.col("distance")))
    per_member = measured.groupBy("region", "class", "members").agg(F.collect_list(F.struct("distance", "pivot")).alias("at"))  # PIVOTS entries
    home = F.array_min("at")
    # A link between cells shows in the window of one of them; rounding must not close it.
    window = F.filter("at", lambda p: p["distance"] <= home["distance"] + (2 * EPSILON + 1e-9))
    cells = per_member.select("region", "class", "members", F.explode(window).alias("cell")).select(
        F.xxhash64("region", F.col("cell.pivot")).alias("cell"), "region", "class", "members"
    )
    cells = stage(cells, "jaccard-cells").table
    sizes = cells.groupBy("region", "cell", "members").agg(F.count(F.lit(1)).alias("n"))
    stuck = stage(sizes.groupBy("region", "members").agg(F.max("n").alias("n")).where(10 * F.col("n") > 7 * F.col("members")).select("region"), "jaccard-stuck").table
    smaller = cells.join(stuck, "region", "left_anti").select(F.col("cell").alias("region"), "class")
    return known.where("linked").select("a", "b"), smaller, regions.join(stuck, "region", "left_semi").select("region", "class")


def _compare(rows: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links of (class, label, side, shingles) that join labels, sides 0 and 1 against each other, 2 within itself."""
    if len({label for _, label, _, _ in rows}) < 2:
        return []
    size = np.array([len(s) for *_, s in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    token, number = np.unique(np.concatenate([s for *_, s in rows]), return_inverse=True)
    often = np.bincount(number, minlength=len(token)) > 1
    column = np.cumsum(often) - 1
    keep = often[number]
    owner, number = owner[keep], column[number[keep]]
    overlap = np.zeros((len(rows), len(rows)), np.float32)
    for begin in range(0, int(often.sum()), 8192):
        part = (number >= begin) & (number < begin + 8192)
        matrix = np.zeros((len(rows), 8192), np.float32)
        matrix[owner[part], number[part] - begin] = 1
        overlap += matrix @ matrix.T
    common = overlap.astype(np.int64)
    union = size[:, None] + size[None, :] - common
    side = np.array([s for _, _, s, _ in rows])
    meet = (side[:, None] != side[None, :]) | (side[:, None] == 2)
    parent = {label: label for _, label, _, _ in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in np.argwhere(np.triu(meet & (100 * common >= SIMILAR * union), 1)):
        a, b = root(rows[i][1]), root(rows[j][1])
        if a != b:
            parent[a] = b
            out.append((rows[i][0], rows[j][0]))
    return out


def _blocks(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of regions of any size, in tasks of bounded size.

    Members of a region's largest component need not meet each other. They are dealt over blocks, and the others over blocks of their
    own: each of these meets every other block and itself. Others that fit one block meet each other along with the first.
    """
    per_label = regions.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"))
    main = F.max(F.struct("n", "label"))
    per_region = per_label.groupBy("region").agg(main.alias("main"), F.sum("n").alias("n"))
    main = stage(per_region.select("region", F.col("main.label").alias("main"), F.col("main.n").alias("_main_n"), "n"), "jaccard-main").table
    marked = regions.select("region", "class", "label").join(main, "region").withColumn("_out", F.col("label") != F.col("main"))

    def blocks(rows: Column) -> Column:
        return F.greatest(F.ceil(rows / BLOCK), F.lit(1)).cast("int")

    mains, outs = F.col("_mains"), F.col("_outs")
    placed = marked.withColumns({"_mains": blocks(F.col("_main_n")), "_outs": blocks(F.col("n") - F.col("_main_n"))})
    placed = placed.withColumn("_in", F.pmod(F.xxhash64("class"), F.when(F.col("_out"), outs).otherwise(mains)).cast("int"))
    mine = F.col("_in")

    def each(count: Column, place: Callable[[Column], tuple]) -> Column:
        named = ("kind", "x", "y", "side")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(*(F.lit(v).cast("int").alias(k) for k, v in zip(named, place(i)))))

    own_side = lambda i: F.when(mine == i, 2).when(mine < i, 0).otherwise(1)
    tasks = (
        F.when(F.col("_out") & (outs == 1), each(mains, lambda i: (0, i, 0, 2)))
        .when(~F.col("_out"), each(outs, lambda i: (0, mine, i, 0)))
        .otherwise(F.concat(each(mains, lambda i: (0, i, mine, 1)), each(outs, lambda i: (1, F.least(mine, i), F.greatest(mine, i), own_side(i)))))
    )
    met = placed.select("region", "class", "label", F.explode(tasks).alias("_at"))
    needed = maybe_in(sets.select("class", "shingles"), regions.select("class"), "class")
    task = F.xxhash64("region", "_at.kind", "_at.x", "_at.y")
    rows = met.select(task.alias("task"), "class", "label", F.col("_at.side").alias("side")).join(needed, "class")

    def run(table: pa.Table) -> pa.Table:
        held = list(zip(*(table[c].to_pylist() for c in ("class", "label", "side")), (s.values.to_numpy(zero_copy_only=False) for s in table["shingles"])))
        links = _compare(held)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def _undecided(regions: DataFrame, joined: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): for each region, stars of the members that may link with one of another component, by size and sketch.

    Regions of two are decided by their pivot. Regions of more than ``LARGE`` members are one star each.
    """
    rows = stage(_labelled(regions, joined).where(F.col("members") > 2), "jaccard-undecided").table
    columns = ["region", "class", "label", "size"]
    told = rows.where(F.col("members") <= LARGE).join(sets.select("class", "size", "sketch"), "class").select(*columns, "sketch")

    def stars(table: np.ndarray, sketches: np.ndarray) -> pa.RecordBatch:
        def fits(one: np.ndarray, other: np.ndarray) -> np.ndarray:
            good = table[one, 2] != table[other, 2]
            good[good] = _room(table[:, 3], sketches, one[good], other[good])
            return good

        label, alive = _joined(table[:, 0], fits)
        pairs = np.unique(np.stack((table[label[alive], 1], table[alive, 1]), axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sketched = np.zeros((0, len(columns)), np.int64), np.zeros((0, BUCKETS), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch[name].to_numpy(zero_copy_only=False) for name in columns], axis=1)
            held = np.concatenate((held, table))
            sketched = np.concatenate((sketched, np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint8).reshape(-1, BUCKETS)))
            last = int(np.searchsorted(held[:, 0], held[-1, 0]))
            yield stars(held[:last], sketched[:last])
            held, sketched = held[last:], sketched[last:]
        yield stars(held, sketched)

    found = told.repartition("region").sortWithinPartitions("region").mapInArrow(run, "a long, b long")
    whole = rows.where((F.col("members") > LARGE) & (F.col("class") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("class").alias("b"))
    return found.unionByName(whole)


def _families(pairs: DataFrame) -> DataFrame:
    """(region, class) to go on with: what hangs together by ``pairs`` is one region, of whatever size.

    Regions that share members overlap almost wholly where documents are copies of each other, and would repeat each
    other's work once per shingle.
    """
    return stage(components(pairs).select(F.col("node").alias("class"), F.col("component").alias("region")), "jaccard-member").table


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def link_classes(docs: DataFrame, frequent: np.ndarray, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes whose components are those of all links.

    ``classes`` is a written table of (class, doc_id, size), doc_id naming a document that holds the class.
    """
    token = Window.partitionBy("region")
    met = _prefixes(docs, frequent).withColumns({"_first": F.min("class").over(token), "_last": F.max("class").over(token)})
    met = met.where((F.col("_first") != F.col("_last")) | F.col("low").isNotNull()).select("region", "class", "low").distinct()
    met = stage(met, "jaccard-met").table
    told, met = met.where(F.col("low").isNotNull()), met.where(F.col("low").isNull()).select("region", "class")
    traits = stage(_traits(met, told, classes), "jaccard-traits").table
    regions = stage(_promising(met, traits), "jaccard-regions").table
    involved = stage(regions.select("class").distinct().join(classes.select("class", "doc_id", "size"), "class"), "jaccard-involved").table
    near = maybe_in(docs.select("doc_id", "text"), involved.select("doc_id"))
    sets = stage(_shingled(near).join(involved.select("class"), "class", "left_semi").dropDuplicates(["class"]), "jaccard-sets").table

    near_pivot = regions.where(F.col("class") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    near_pivot = stage(near_pivot, "jaccard-near").table
    pairs = stage(_possible_pairs(near_pivot, traits), "jaccard-pairs").table
    links = stage(_distances(pairs, sets).where("linked").select("a", "b"), "jaccard-links").table
    joined = components(links)
    open_ = _families(_undecided(regions, joined, sets))
    waiting = []
    for depth in range(DEPTH):
        labelled = stage(_labelled(open_, joined), "jaccard-labelled")
        if not labelled.rows and not depth:
            return _as_links(joined)
        small = F.col("members") <= BLOCK
        large = labelled.table.where(~small)
        waiting.append(labelled.table.where(small))
        open_ = None
        if large.isEmpty():
            break
        links, open_, stuck = _cells(large, sets)
        joined = components(_as_links(joined).unionByName(links))
        waiting.append(stuck)
    if len(waiting) == 1:
        left = waiting[0]
    else:
        # Links to pivots join most of what they could not cut, so labels are told anew after them.
        left = _united([each.select("region", "class") for each in (*waiting, *([] if open_ is None else [open_]))])
        left = stage(_labelled(left, joined), "jaccard-left").table
    return _as_links(joined).unionByName(stage(_blocks(left, sets), "jaccard-compared").table)


def _as_links(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("node").alias("a"), F.col("component").alias("b"))


def group(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), class, component.

    ``component`` is the least class reachable by links; it and ``class`` are null without words. The result is written; everything staged on the way is removed.
    """
    with staging_scope(docs.sparkSession):
        return stage(_grouped(docs), "jaccard-groups", outlives=True).table


def _grouped(docs: DataFrame) -> DataFrame:
    scan = stage(_scan(docs), "jaccard-scan").table
    per_token = scan.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("count").alias("n"))
    top = per_token.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()
    frequent = np.array([row["token"] for row in reversed(top)], np.int64).view(np.uint64)
    rows = scan.where(F.col("class").isNotNull())
    # Classes are told apart by 64 of the 128 bits of their digest; that these are enough is checked here.
    grouped = rows.where(F.col("size") > 0).groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.min("digest").alias("_low"), F.max("digest").alias("_high")
    )
    classes = stage(grouped, "jaccard-classes", clashes=F.count(F.when(F.col("_low") != F.col("_high"), 1)))
    if classes.seen["clashes"]:
        raise RuntimeError("two different sets share a 64-bit class number")
    links = link_classes(docs, frequent, classes.table.select("class", "doc_id", "size"))
    found = stage(components(links), "jaccard-components").table
    of_class = classes.table.select("class", "doc_id").join(found.withColumnRenamed("node", "class"), "class", "left")
    of_class = of_class.select("class", F.coalesce("component", "class").alias("component"), "doc_id")
    least = stage(of_class.groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-least").table
    named = stage(of_class.select("class", "component").join(least, "component").select("class", "component", "component_id"), "jaccard-named").table
    told = rows.join(named, "class", "left")
    return told.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("size") > 0, F.col("class")).alias("class"),
        F.when(F.col("size") > 0, F.col("component")).alias("component"),
    )
