"""Frequent word collocations, mined part by part.

A phrase of two to ``LONGEST`` words is frequent in its language if it occurs ``SUPPORT`` times. The documents are dealt over
``PARTS`` parts of equal expected size by the hash of their text. A phrase that is frequent in all has, in some part, at least the
support over the number of parts. So:

1. Each part is mined completely at that lowered support, word count by word count: a phrase is looked at only where the
   phrases without its last and without its first word were frequent in the part. Tasks hold a chunk of ``CHUNK_BYTES`` of text, add
   up hashes of its phrases and send each once with its count, so a part may be of any size.
2. The parts' frequent phrases are united. A part that does not report a phrase holds it fewer times than its lowered support,
   which bounds every phrase from above; what cannot reach the support is given up.
3. All documents are read again and the candidates that are left are counted exactly, by their words. A Bloom filter of fixed
   size keeps other phrases from the shuffle; those that slip through are not frequent and fall out.

Steps that look at few, recurring phrases (3, and 1 from three words on) are read by one task per core, which adds up the counts of its
chunks: a phrase is sent once and not once per chunk. Of more counts than ``HELD_BYTES`` hold, the rarer half is sent early.

The number of parts is fixed, so the lowered support is the same at every size.
A Bloom filter that fills up, or two phrases with one hash, only make more candidates.

Scores compare a phrase's count with those of its two parts at the worst cut, in whole numbers of up to 38 digits.

Defined results: a null text is empty, a null language is ``und`` and one with that name. Repeated rows count repeatedly. A language
without frequent phrases has no row, as an empty table has none. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm import bloom
from vacantia.llm.words import _span, byte_classes, joined, lowered, mixed, slices, split_words
from vacantia.staging import stage

SUPPORT = 100
LONGEST = 5
MOST = 2000
PARTS = 4
CHUNK_BYTES = 2 << 20
HELD_BYTES = 64 << 20
_SENT_ROWS = 1 << 16
UNKNOWN = "und"
_SALTS = 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
# The upper two bits of a marked phrase name its part, the others are its hash.
_PART = np.uint64(62)
_HASH = np.uint64((1 << 62) - 1)
_CUTS = ".,;:!?" + _span(0x0A, 0x0D)
_WORD = byte_classes(word="".join(c for c in _span(0, 255) if c not in _CUTS + "\x20\x09"))
_IS_CUT = np.isin(np.arange(256), np.frombuffer(_CUTS.encode(), np.uint8))


def named(docs: DataFrame) -> DataFrame:
    """lang, part, text without nulls."""
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("lang", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int").alias("part"), "text")


class Chunk:
    """The words of some documents."""

    def __init__(self) -> None:
        self.bytes = 0
        self.langs: dict[str, int] = {}
        self._columns: list[tuple[np.ndarray, ...]] = []
        self._pieces = 0

    def add(self, batch: pa.RecordBatch) -> None:
        """Take in rows of lang, part, text."""
        for texts in slices(batch["text"]):
            mine = batch.slice(texts.first, texts.rows)
            numbers = np.array([self.langs.setdefault(lang, len(self.langs)) for lang in mine["lang"].to_pylist()], np.uint32)
            names = list(self.langs)
            hashes = np.array([_lang_hash(names[number]) for number in numbers], np.uint64)
            data = lowered(texts.data)
            words = split_words(texts, _WORD, data)
            row = words.row
            cuts = np.concatenate(([0], np.cumsum(_IS_CUT[data])))[words.start]
            begins = np.ones(len(row), bool)
            begins[1:] = (row[1:] != row[:-1]) | (cuts[1:] != cuts[:-1])
            piece = np.cumsum(begins) + self._pieces
            self._pieces += int(begins.sum())
            self._columns.append((
                mixed(words.hash + hashes[row]),
                (words.start + self.bytes).astype(np.uint32),
                (words.end + self.bytes).astype(np.uint32),
                piece.astype(np.uint32),
                numbers[row],
                mine["part"].to_numpy(zero_copy_only=False).astype(np.uint8)[row],
                data,
            ))
            self.bytes += len(data)

    def close(self) -> None:
        columns = [list(column) for column in zip(*self._columns)] or [[np.zeros(0, np.uint64)] for _ in range(7)]
        self._columns = []
        for i, pieces in enumerate(columns):
            columns[i] = np.concatenate(pieces)
            pieces.clear()
        self.key, self.start, self.end, self.piece, self.lang, self.part, data = columns
        self.data = data.tobytes()

    def words_per_lang(self) -> list[int]:
        return np.bincount(self.lang.astype(np.int64), minlength=len(self.langs)).tolist()

    def marked(self, size: int) -> np.ndarray:
        """The hash of the phrase that begins at each word, with the number of its part in the upper bits."""
        return (joined(self.key, size) & _HASH) | (self.part[: max(0, len(self.part) - size + 1)].astype(np.uint64) << _PART)

    def part_counts(self, size: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct marked phrases of ``size`` words and their counts; ``known`` is a filter of shorter ones to build on."""
        found = self.marked(size)
        last = size - 1
        fits = self.piece[: len(found)] == self.piece[last : last + len(found)]
        if known is not None:
            shorter = bloom.holds(known, mixed(self.marked(last)))
            fits &= shorter[: len(found)] & shorter[1 : len(found) + 1]
        return np.unique(found[fits], return_counts=True)

    def grow(self, keep: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, place of an occurrence, count) of the phrases whose hash ``keep`` keeps, by size.

        A phrase is looked at if the phrases without its last and without its first word were kept. Phrases of one size are
        numbered, and a longer one is the number of its beginning with the number of its last word.
        """
        place, word, count = _grouped(self.key)
        good = keep(self._hashes(place, 1))
        yield 1, place[good].astype(np.int64), count[good]
        kinds = len(place)
        now = np.where(good[word], word, np.int32(-1))
        usable = now >= 0
        for size in range(2, LONGEST + 1):
            last = size - 1
            end = max(0, len(now) - last)
            fits = (now[:end] >= 0) & (now[1 : end + 1] >= 0) & usable[last:] & (self.piece[:end] == self.piece[last:])
            first = np.flatnonzero(fits).astype(np.uint32)
            del fits
            if not len(first):
                return
            index, number, count = _grouped(now[first].astype(np.int64) * kinds + word[first + last])
            place = first[index]
            good = keep(self._hashes(place, size))
            yield size, place[good].astype(np.int64), count[good]
            now = np.full(len(word), -1, np.int32)
            now[first] = np.where(good[number], number, np.int32(-1))

    def _hashes(self, place: np.ndarray, size: int) -> np.ndarray:
        out = self.key[place].copy()
        for step in range(1, size):
            out *= _ODD
            out += self.key[place + step]
        return mixed(out + np.uint64(size)) & _HASH

    def phrases(self, place: np.ndarray, size: int) -> list[str]:
        """The words from each place on, joined by one space."""
        out = []
        for start, end in zip(self.start[place].tolist(), self.end[place + size - 1].tolist()):
            text = self.data[start:end]
            if b"\t" in text or b"  " in text:
                text = b" ".join(text.split())
            out.append(text.decode())
        return out


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct keys in order: a place of each and its count; and the number of each place's key."""
    order = np.argsort(keys).astype(np.uint32)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    del keys
    begin = np.flatnonzero(new)
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[begin], number, np.diff(begin, append=len(order))


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk = None
    for batch in batches:
        for texts in slices(batch["text"], CHUNK_BYTES // 8):
            chunk = chunk or Chunk()
            chunk.add(batch.slice(texts.first, texts.rows))
            if chunk.bytes >= CHUNK_BYTES:
                chunk.close()
                yield chunk
                chunk = None
    if chunk is not None:
        chunk.close()
        yield chunk


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same counts in fewer rows: those that differ in ``n`` alone, the last column, become one.

    What is held may double before it is added up again. When ``HELD_BYTES`` are reached that way, the rarer half of the rows leaves: a
    phrase that is common here is likely to come again.
    """
    held, size, limit = [], 0, HELD_BYTES // 16
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            whole = _summed(held)
            if whole.nbytes > HELD_BYTES // 2:
                common = pc.greater(whole["n"], float(np.median(whole["n"])))
                yield from whole.filter(pc.invert(common)).to_batches(_SENT_ROWS)
                whole = whole.filter(common)
            held, size = whole.to_batches(), whole.nbytes
            limit = max(HELD_BYTES // 16, 2 * size)
            del whole
            pa.default_memory_pool().release_unused()
    if held:
        yield from _summed(held).to_batches(_SENT_ROWS)


def _summed(batches: list[pa.RecordBatch]) -> pa.Table:
    *keys, n = batches[0].schema.names
    sums = pa.Table.from_batches(batches).group_by(keys, use_threads=False).aggregate([(n, "sum")])
    return sums.select([*keys, f"{n}_sum"]).rename_columns([*keys, n])


def per_core(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over the rows by one task per core, its counts added up in the task: a row per core and phrase, if the counts can be held."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from added_up(run(batches))

    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(summed, schema)


def mine(rows: DataFrame, size: int, known: np.ndarray | None, least: int) -> DataFrame:
    """(key, n): the phrases of ``size`` words that occur ``least`` times in some part, as marked hashes with their counts there."""
    shared = None if known is None else rows.sparkSession.sparkContext.broadcast(known)  # bloom.BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            key, count = chunk.part_counts(size, None if shared is None else shared.value)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "n": pa.array(count)})

    # Most phrases of one or two words are rare, so holding them would save little.
    told = per_core(rows, run, "key long, n long") if size > 2 else rows.mapInArrow(run, "key long, n long")
    found = told.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = stage(found, f"phrases-{size}").table
    if shared is not None:
        shared.unpersist()
    return out


def candidates(found: DataFrame, support: int, least: int) -> DataFrame:
    """(h) of what may reach the support: what parts report, and the most that silent parts can add."""
    of_all = found.groupBy(F.col("key").bitwiseAND(F.lit(int(_HASH))).alias("h")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    return of_all.where(F.col("n") + (PARTS - F.col("parts")) * (least - 1) >= support).select("h")


def _filter(wanted: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of the column's hashes."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            seen = seen or bloom.Once()
            seen.add(mixed(batch[column].to_numpy(zero_copy_only=False).view(np.uint64)))
        if seen is not None:
            yield from seen.slices()

    parallel = wanted.sparkSession.sparkContext.defaultParallelism
    return bloom.merged(wanted.select(column).coalesce(parallel).mapInArrow(fill, bloom.SLICES), "once")


def count(rows: DataFrame, known: np.ndarray, support: int) -> DataFrame:
    """(lang, size, phrase, f) of all frequent phrases, single words too, by a full count of what the filter lets through.

    Rows of size 0 hold the number of all words of a language.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)  # bloom.BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            langs = pa.array(list(chunk.langs), pa.string())
            words = np.bincount(chunk.lang.astype(np.int64), minlength=len(langs))
            yield _counted(langs, 0, [""] * len(langs), words)
            for size, place, n in chunk.grow(lambda h: bloom.holds(shared.value, mixed(h))):
                yield _counted(langs.take(pa.array(chunk.lang[place].astype(np.int64))), size, chunk.phrases(place, size), n)

    told = per_core(rows, run, "lang string, size int, phrase string, n long")
    summed = told.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f"))
    return summed.where((F.col("f") >= support) | (F.col("size") == 0))


def _counted(langs: pa.Array, size: int, phrases: list[str], n: np.ndarray) -> pa.RecordBatch:
    sizes = pa.array(np.full(len(phrases), size, np.int32))
    return pa.RecordBatch.from_arrays([langs, sizes, pa.array(phrases, pa.string()), pa.array(n.astype(np.int64))], ["lang", "size", "phrase", "n"])


def frequent_phrases(docs: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Written tables: (lang, size, phrase, f) of all phrases with the support, and (lang, n) words per language."""
    rows = named(docs)
    least = -(-support // PARTS)
    found, known = [], None
    for size in range(1, LONGEST + 1):
        found.append(mine(rows, size, known, least))
        known = _filter(found[-1], "key")
    wanted = candidates(reduce(DataFrame.unionByName, found), support, least)
    counted = stage(count(rows, _filter(wanted, "h"), support), "phrase-counts").table
    return counted.where(F.col("size") > 0), counted.where(F.col("size") == 0).select("lang", F.col("f").alias("n"))


def _part(first, length):
    return F.array_join(F.slice("words", first, length), " ")


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two words or more, by their worst cut."""
    phrases = found.where(F.col("size") > 1).select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    first, rest = (found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    # One language may hold most phrases, so its number of words meets them in several tasks.
    of_lang = words.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    met = cuts.join(first, ["lang", "left"]).join(rest, ["lang", "right"])
    met = met.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)).cast("int")).join(of_lang, ["lang", "_salt"])
    wide, narrow = "decimal(20,0)", "decimal(18,0)"
    over = (F.lit(1000) * F.col("n")).cast(wide) * F.col("a").cast(narrow)
    met = met.withColumns({"_over": over, "_under": F.col("l").cast(narrow) * F.col("r").cast(narrow)})
    met = met.withColumn("score", F.expr("_over div _under"))
    worst = met.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return worst.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def covered(found: DataFrame) -> DataFrame:
    """(lang, phrase, most): the greatest count of a longer phrase that holds the phrase, among phrases of two words or more."""
    longer = found.where(F.col("size") > 2).select("lang", "size", "f", F.split("phrase", " ").alias("words"))
    each = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("first"))
    parts = each.select("lang", _part(F.col("first"), F.col("length")).alias("phrase"), "f")
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, support: int = SUPPORT, most: int = MOST) -> DataFrame:
    """The best ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase that a longer one holds as often as it occurs is left out.
    """
    found, words = frequent_phrases(docs, support)
    open_ = scored(found, words).join(covered(found), ["lang", "phrase"], "left")
    open_ = open_.where(F.col("most").isNull() | (100 * F.col("most") < 100 * F.col("a"))).drop("most")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = open_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with pieces as (
  select doc, lang, row_number() over () as piece, string_split_regex(part, '[ \t]+') as ws
  from (
    select doc, lang, unnest(string_split_regex(body, '[.,;:!?\n\x0B\x0C\r]')) as part
    from (
      select row_number() over () as doc, coalesce(lang, 'und') as lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body
      from documents
    )
  )
), words as (
  select lang, piece, list_filter(ws, lambda w: w <> '') as ws from pieces
), sized as (
  select lang, ws, unnest(range(1, 6)) as size from words where len(ws) > 0
), phrases as (
  select lang, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') as phrase
  from (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as i from sized where len(ws) >= size)
), counted as (
  select lang, size, phrase, count(*) as f from phrases group by all having count(*) >= 100
), total as (
  select lang, sum(len(ws)) as n from words group by lang
), cuts as (
  select lang, phrase, size, f as a, string_split(phrase, ' ') as ws, unnest(range(1, size)) as k from counted where size > 1
), met as (
  select c.lang, c.phrase, c.size, c.a, c.k, l.f as l, r.f as r, t.n,
    (1000::hugeint * c.a * t.n) // (l.f::hugeint * r.f) as score
  from cuts c
  join counted l on l.lang = c.lang and l.phrase = array_to_string(list_slice(c.ws, 1, c.k), ' ')
  join counted r on r.lang = c.lang and r.phrase = array_to_string(list_slice(c.ws, c.k + 1, c.size), ' ')
  join total t on t.lang = c.lang
), worst as (
  select * from met qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_parts as (
  select lang, f, array_to_string(list_slice(ws, i, i + length - 1), ' ') as phrase
  from (
    select lang, f, ws, length, unnest(range(1, size - length + 2)) as i
    from (select lang, size, f, string_split(phrase, ' ') as ws, unnest(range(2, size)) as length from counted where size > 2)
  )
), covered as (
  select lang, phrase, max(f) as most from inner_parts group by all
), ranked as (
  select w.lang, w.phrase, w.a, w.l, w.r, w.n, w.score,
    row_number() over (partition by w.lang order by w.score desc, w.a desc, w.phrase) as rank
  from worst w left join covered c on c.lang = w.lang and c.phrase = w.phrase
  where c.most is null or 100 * c.most < 100 * w.a
)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000
"""
