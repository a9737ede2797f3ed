"""Spans of regular expressions in whole texts, with SQL functions only.

Positions count code points from 0, the end is exclusive. Matches are the leftmost
non-overlapping ones. A text is split at its matches; a match starts where the lengths of
the pieces and matches before it add up to.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Running sums copy their result with each step, so they go block by block.
_BLOCK = 256
CONTEXT = 40
_STARTS = "array<struct<start: int, end: int>>"


def _running(lengths: Column) -> Column:
    """(start, end) of each match from (length of the piece before, length of the match)."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    nothing = F.array().cast(_STARTS)

    def one(acc: Column, pair: Column) -> Column:
        start = acc["total"] + pair["gap"]
        end = start + pair["long"]
        return F.struct(end.alias("total"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    def block(acc: Column, pairs: Column) -> Column:
        begin = F.struct(acc["total"].alias("total"), nothing.alias("out"))
        return F.aggregate(
            pairs, begin, one, lambda done: F.struct(done["total"].alias("total"), F.concat(acc["out"], done["out"]).alias("out"))
        )

    return F.aggregate(blocks, F.struct(F.lit(0).alias("total"), nothing.alias("out")), block, lambda acc: acc["out"])


def matches(text: Column, pattern: str, group: int = 0, needs: str | None = None) -> Column:
    """All matches; ``needs`` is a literal that every match holds and most texts lack."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if needs is None:
        return found
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast("array<string>"))


def pieces(text: Column, pattern: str, found: Column) -> Column:
    """What lies around the matches: its length, and the characters next to a match in lower case.

    Empty where there is no match, so most texts are not split at all.
    """
    cut = F.transform(
        F.split(text, pattern, -1),
        lambda p: F.struct(
            F.length(p).alias("long"),
            F.lower(F.left(p, F.lit(CONTEXT))).alias("head"),
            F.lower(F.right(p, F.lit(CONTEXT))).alias("tail"),
        ),
    )
    empty = F.array().cast("array<struct<long: int, head: string, tail: string>>")
    return F.when(F.size(found) > 0, cut).otherwise(empty)


def located(found: Column, around: Column) -> Column:
    """array<struct<start, end, value, context>> from the columns ``matches`` and ``pieces`` made."""
    lengths = F.zip_with(
        F.slice(around, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p["long"].alias("gap"), F.length(m).alias("long"))
    )
    context = F.zip_with(
        F.slice(around, F.lit(1), F.size(found)), F.slice(around, F.lit(2), F.size(found)), lambda a, b: F.concat(a["tail"], F.lit(" "), b["head"])
    )
    whole = F.zip_with(
        F.zip_with(_running(lengths), found, lambda at, m: F.struct(at["start"].alias("start"), at["end"].alias("end"), m.alias("value"))),
        context,
        lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), c.alias("context")),
    )
    empty = F.array().cast("array<struct<start: int, end: int, value: string, context: string>>")
    return F.when(F.size(found) > 0, whole).otherwise(empty)


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
