"""Batch scoring through a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions.answers import validated_answer
from vacantia.functions.prompts import profile_literal, score_prompt
from vacantia.functions.text import json_list_text

INVALID_ANSWER = "réponse invalide"


def score_offers(
    offers: DataFrame,
    profile: dict,
    make_scorer: Callable[[], Callable[[list[str]], list[str | Exception]]],
    partitions: int,
    prompts_per_call: int = V.DEFAULT_SCORING_LIMIT,
) -> DataFrame:
    """(id, score, explication, points_forts, points_faibles) of each offer.

    ``make_scorer`` runs once per task, so a client lives as long as its partition, and
    returns a function from up to ``prompts_per_call`` prompts to as many raw JSON answers, where an exception stands for a
    call that failed. ``partitions`` is how many tasks ask at once; what the join before left says nothing about what a
    model can bear. Only id and prompt cross to Python. A failing call and an answer that does not validate both give score -1.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            for first in range(0, len(batch), prompts_per_call):
                part = batch.iloc[first : first + prompts_per_call]
                try:
                    got = list(scorer(part["prompt"].tolist()))
                    if len(got) != len(part):
                        raise ValueError("one answer per prompt")
                except Exception as problem:  # one call must not fail the batch
                    got = [problem] * len(part)
                failed = [isinstance(answer, Exception) for answer in got]
                answers = [None if bad else answer for answer, bad in zip(got, failed)]
                errors = [str(answer) if bad else None for answer, bad in zip(got, failed)]
                yield pd.DataFrame({"id": part["id"], "answer": answers, "error": errors})

    prompts = offers.select("id", score_prompt(profile_literal(profile)).alias("prompt")).repartition(partitions)
    asked = prompts.mapInPandas(ask, "id string, answer string, error string")
    return scored_answers(asked)


def scored_answers(asked: DataFrame) -> DataFrame:
    """Validated scores from (id, answer, error) rows."""
    result = F.col("_result")
    problem = F.concat(F.lit(V.SCORING_ERROR), F.coalesce("error", F.lit(INVALID_ANSWER)))
    none = F.array().cast("array<string>")
    return asked.withColumn("_result", validated_answer(F.col("answer"))).select(
        "id",
        F.coalesce(result["score"], F.lit(-1)).alias("score"),
        F.coalesce(result["explication"], problem).alias("score_explication"),
        F.coalesce(result["points_forts"], none).alias("points_forts"),
        F.coalesce(result["points_faibles"], none).alias("points_faibles"),
    )


def score_rows(scores: DataFrame, scored_at: Column) -> DataFrame:
    """Scores in the shape of the ``scores`` table, the two lists as JSON."""
    return scores.select(
        "id",
        "score",
        "score_explication",
        json_list_text(F.col("points_forts")).alias("score_points_forts"),
        json_list_text(F.col("points_faibles")).alias("score_points_faibles"),
        scored_at.cast("timestamp").alias("score_date"),
    )
