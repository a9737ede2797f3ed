"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

Everything is SQL functions over the text column; no row moves. Kinds, in this order: email, ip,
card (Luhn), phone, iban (mod 97). The patterns differ from their plain form only where a plain
form would read a long text more than once: a match can start only where a run starts, and
runs are never given back. A proposal that fails its check is dropped, and its text is not searched again.

The score of a span starts at its kind's own certainty and rises where one of the kind's words
lies within ``spans.CONTEXT`` characters. Base kinds stay whatever their score; an iban stays from
``KEEP`` up.

Defined results: a null text is an empty one and has no span. Rows of equal ids are searched each.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm import spans

_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
_NEEDS = {"email": "@", "phone": "+", "ip": "."}
BASE = ("email", "ip", "card", "phone")
CERTAINTY = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
}
RISE = 0.1
KEEP = 0.8


def _digit(text: Column, at: Column) -> Column:
    return F.ascii(F.substr(text, at, F.lit(1))) - 48


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn test?"""
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _digit(digits, size - i)
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Remainder modulo 97 of letters (A is 10) and digits, the first four moved to the end."""
    turned = F.concat(F.substr(code, F.lit(5), F.length(code)), F.left(code, F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _small(part: Column) -> Column:
    """At most 255, leading zeros or not."""
    plain = F.ltrim(part, F.lit("0"))
    return (F.length(plain) <= 3) & (F.coalesce(F.left(plain, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)


def _confirmed(kind: str, value: Column) -> Column:
    only_digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small)
    if kind == "card":
        return F.when(F.length(only_digits).between(13, 19), luhn(only_digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(only_digits).between(9, 15)
    if kind == "iban":
        compact = F.replace(value, F.lit(" "), F.lit(""))
        return F.when(F.length(compact).between(15, 34), mod97(compact) == 1).otherwise(F.lit(False))
    return F.lit(True)


def _score(kind: str, context: Column) -> Column:
    near = F.lit(False)
    for word in CONTEXT_WORDS[kind]:
        near = near | F.contains(context, F.lit(word))
    return F.lit(CERTAINTY[kind]) + F.when(near, F.lit(RISE)).otherwise(F.lit(0.0))


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and, per kind, array<struct<kind, start, end, score>> by start."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.withColumns({f"m_{k}": spans.matches(text, p, needs=_NEEDS.get(k)) for k, p in PATTERNS.items()})
    rows = rows.select(
        "doc_id", *(f"m_{k}" for k in PATTERNS), *(spans.pieces(text, p, F.col(f"m_{k}")).alias(f"p_{k}") for k, p in PATTERNS.items())
    )
    rows = rows.select("doc_id", *(spans.located(F.col(f"m_{k}"), F.col(f"p_{k}")).alias(k) for k in PATTERNS))

    def kept(kind: str) -> Column:
        good = F.filter(F.col(kind), lambda s: _confirmed(kind, s["value"]))
        scored = F.transform(
            good,
            lambda s: F.struct(
                F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(kind, s["context"]).alias("score")
            ),
        )
        return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= KEEP)

    return rows.select("doc_id", *(kept(kind).alias(kind) for kind in PATTERNS))


def summary(found: DataFrame) -> DataFrame:
    """Counts, a digest of the base spans, all spans as text, and the highest score (0 without a span)."""
    base = F.concat(*(F.col(kind) for kind in BASE))
    every = F.concat(base, F.col("iban"))
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE),
        spans.digest(spans.written(base)).alias("base_sha256"),
        spans.written(every).alias("spans"),
        F.coalesce(F.array_max(F.transform(every, lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
