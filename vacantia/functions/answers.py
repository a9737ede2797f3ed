"""Strict reading of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.text import strip

# A whole number written as text: sign, digits with single underscores between them, and
# at most a fraction of zeros.
_WHOLE_NUMBER = r"\A[+-]?[0-9]+(?:_[0-9]+)*(?:\.0+)?\z"
_SMALL_NUMBER = r"\A([+-]?)0*([0-9]{1,3})(?:\.0+)?\z"


def _kind(answer: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(answer, f"$.{field}", "variant"))


def _score(answer: Column) -> Column:
    """Whole score, or null. True counts as 1; text is read as a whole number."""
    kind = _kind(answer, "score")
    number = F.try_variant_get(answer, "$.score", "double")
    text = strip(F.try_variant_get(answer, "$.score", "string"))
    digits = F.replace(text, F.lit("_"), F.lit(""))
    from_text = F.concat(
        F.regexp_extract(digits, _SMALL_NUMBER, 1), F.regexp_extract(digits, _SMALL_NUMBER, 2)
    ).try_cast("int")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(answer, "$.score", "int"))
        .when(kind == "STRING", F.when(text.rlike(_WHOLE_NUMBER), from_text))
        .when(
            (kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"))
            & (number == F.floor(number))
            & number.between(0, 100),
            number.cast("int"),
        )
    )


def _list_is_fine(answer: Column, field: str) -> Column:
    kind = _kind(answer, field)
    return kind.isNull() | kind.isin("ARRAY<STRING>", "ARRAY<VOID>")


def _empty_or_strings(answer: Column, field: str) -> Column:
    """``ARRAY<VOID>`` is the kind of an empty list, but also of a list of nulls."""
    items = F.try_variant_get(answer, f"$.{field}", "array<string>")
    return F.coalesce(~F.exists(items, lambda item: item.isNull()), F.lit(True))


def _items(answer: Column, field: str) -> Column:
    return F.coalesce(F.try_variant_get(answer, f"$.{field}", "array<string>"), F.array().cast("array<string>"))


def _checked(answer: Column) -> Column:
    score = _score(answer)
    fine = score.between(0, 100) & (_kind(answer, "explication") == "STRING")
    for field in ("points_forts", "points_faibles"):
        fine = fine & _list_is_fine(answer, field) & _empty_or_strings(answer, field)
    return F.when(
        fine,
        F.struct(
            score.alias("score"),
            F.try_variant_get(answer, "$.explication", "string").alias("explication"),
            _items(answer, "points_forts").alias("points_forts"),
            _items(answer, "points_faibles").alias("points_faibles"),
        ),
    )


def validated_answer(answer_json: Column) -> Column:
    """Struct (score, explication, points_forts, points_faibles); null for a bad answer.

    Neither a plain JSON schema nor a variant cast decides alone: the first refuses
    ``"85"``, the second lets 85.5 through. So the kind of each field is tested first. The
    parsed answer is bound as the one element of an array, so that it is parsed once.
    """
    return F.transform(F.array(F.try_parse_json(answer_json)), _checked)[0]
