"""Secrets: fixed patterns, and a comparison of two character Markov models.

The models give the chance of a character after another one, in random strings and in ordinary
identifiers. They are trained on samples labelled by the patterns: values of confirmed secrets are
random, runs of ``ORDINARY`` letters and underscores are ordinary. The pairs of all documents are counted on
Spark and only the table of pairs, of fixed size, reaches the driver. A run of ``LONGEST_ORDINARY`` or more key
characters with a letter and a digit is a secret of kind ``random`` if its mean log-likelihood ratio is
at least ``LIMIT`` and no span of the fixed patterns touches it.

Everything is SQL functions; no Python runs on executors. Kinds, in this order: assign,
access, hex, random. A fixed pattern's match that is too short is dropped, and its text is
not searched again.

Defined results: a null text is an empty one and has no span. Without samples of one kind that model is
uniform. Rows of equal ids are searched each. Other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm import spans

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# In these two a match that is long enough is the same with or without the short ones.
PATTERNS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", "random": "[A-Za-z0-9+/_=-]{20,}"}
_NEEDS = {"access": "AKIA"}
BASE = ("assign", "access", "hex")
SHORTEST_VALUE = 8
ORDINARY = "[A-Za-z_]{12,}"
LIMIT = 0.5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_SIZE = len(ALPHABET)


def _symbol(char: Column) -> Column:
    """Place in the alphabet; one more symbol stands for all other characters."""
    at = F.instr(F.lit(ALPHABET), char)
    return F.when(at == 0, F.lit(_SIZE)).otherwise(at - 1)


def _pair(text: Column, i: Column) -> Column:
    return _symbol(F.substr(text, i, F.lit(1))) * (_SIZE + 1) + _symbol(F.substr(text, i + 1, F.lit(1)))


def _values(text: Column) -> Column:
    """Values of confirmed secrets."""
    assigned = F.filter(spans.matches(text, _ASSIGN, 2), lambda v: F.length(v) >= SHORTEST_VALUE)
    others = [spans.matches(text, PATTERNS[k], needs=_NEEDS.get(k)) for k in ("access", "hex")]
    return F.concat(assigned, *others)


def pair_counts(docs: DataFrame) -> DataFrame:
    """(secret, pair, n) over all documents."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counted(samples: Column, secret: bool) -> DataFrame:
        # Equal samples are counted once per task before they are cut up.
        each = docs.select(F.explode(samples).alias("sample")).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
        pairs = each.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: _pair(F.col("sample"), i))).alias("pair"))
        return pairs.groupBy("pair").agg(F.sum("n").alias("n")).select(F.lit(secret).alias("secret"), "pair", "n")

    return counted(_values(text), True).unionByName(counted(spans.matches(text, ORDINARY), False))


def fit(docs: DataFrame) -> list[float]:
    """Per pair of symbols ``ln p_random - ln p_ordinary``, each with one count added."""
    size = _SIZE + 1
    counts = {True: [0] * (size * size), False: [0] * (size * size)}
    for row in pair_counts(docs).collect():  # 2 * size * size rows at most
        counts[row["secret"]][row["pair"]] = row["n"]

    def logs(table: list[int]) -> list[float]:
        out = []
        for first in range(size):
            line = table[first * size : (first + 1) * size]
            total = sum(line) + size
            out += [math.log((n + 1) / total) for n in line]
        return out

    return [a - b for a, b in zip(logs(counts[True]), logs(counts[False]))]


def ratio(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's pairs."""
    values = F.split(F.lit(",".join(format(x, ".6f") for x in table)), ",").cast("array<double>")
    total = F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), lambda acc, i: acc + F.get(values, _pair(value, i)))
    return total / (F.length(value) - 1)


def find(docs: DataFrame, table: list[float]) -> DataFrame:
    """One row per document: doc_id and, per kind, array<struct<start, place, end, kind, score>> by start."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    found = {f"m_{k}": spans.matches(text, p, needs=_NEEDS.get(k)) for k, p in PATTERNS.items()}
    rows = rows.withColumns(found)
    rows = rows.select(
        "doc_id",
        *(f"m_{k}" for k in PATTERNS),
        *(spans.pieces(text, p, F.col(f"m_{k}")).alias(f"p_{k}") for k, p in PATTERNS.items()),
        F.when(F.size("m_assign") > 0, spans.matches(text, _ASSIGN, 2)).otherwise(F.array().cast("array<string>")).alias("v_assign"),
    )
    rows = rows.select("doc_id", "v_assign", *(spans.located(F.col(f"m_{k}"), F.col(f"p_{k}")).alias(k) for k in PATTERNS))

    def plain(kind: str, values: Column, score: Column | None = None) -> Column:
        place = list(PATTERNS).index(kind)
        return F.transform(
            values,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(place).alias("place"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),
                (F.lit(1.0) if score is None else s["score"]).alias("score"),
            ),
        )

    long_enough = F.filter(
        F.zip_with("assign", "v_assign", lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.length(v) >= SHORTEST_VALUE).alias("ok"))),
        lambda s: s["ok"],
    )
    rows = rows.select(
        "doc_id", plain("assign", long_enough).alias("assign"), *(plain(k, F.col(k)).alias(k) for k in ("access", "hex")), F.col("random").alias("proposed")
    )
    base = F.concat(*(F.col(k) for k in BASE))
    mixed = F.filter("proposed", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    free = F.filter(mixed, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    scored = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), ratio(s["value"], table).alias("score")))
    unlike = F.filter(scored, lambda s: s["score"] >= LIMIT)
    return rows.select("doc_id", *BASE, plain("random", unlike, F.lit(0)).alias("random"))


def scan(docs: DataFrame) -> DataFrame:
    return find(docs, fit(docs))


def summary(found: DataFrame) -> DataFrame:
    """Counts, a digest of the base spans by start and kind, and all spans as text."""
    base = F.array_sort(F.concat(*(F.col(kind) for kind in BASE)))
    every = F.array_sort(F.concat(*(F.col(kind) for kind in PATTERNS)))
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE),
        spans.digest(spans.written(base)).alias("base_sha256"),
        spans.written(every).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
