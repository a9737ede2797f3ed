"""Generated documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.ids import artifact_slug
from vacantia.functions.markup import strip_fence
from vacantia.functions.prompts import cv_prompt
from vacantia.functions.text import strip

# Chunks put together in the first of two steps.
CHUNKS_PER_BLOCK = 1024


def assemble_chunks(chunks: DataFrame, key: str = "key", number: str = "chunk_no", text: str = "text") -> DataFrame:
    """Streamed chunks of each key joined in order, stripped; empty chunks leave no trace.

    Blocks of consecutive chunks are joined first, so the chunks of one very long answer
    are sorted and held by many tasks; only the finished blocks meet in the end.
    """
    block = F.floor(F.col(number) / CHUNKS_PER_BLOCK).alias("_block")
    blocks = (
        chunks.groupBy(key, block)
        .agg(F.expr(f"listagg(nullif(`{text}`, ''), '') within group (order by `{number}`)").alias("_text"))
    )
    whole = F.expr("listagg(_text, '') within group (order by _block)")
    return blocks.groupBy(key).agg(strip(F.coalesce(whole, F.lit(""))).alias("text"))


def adapt_documents(
    offers: DataFrame,
    cv_html: str,
    make_generator: Callable[[], Callable[[str], Iterable[str]]],
    partitions: int | None = None,
) -> DataFrame:
    """One adapted document per offer: prompt, generated chunks, clean-up.

    ``make_generator`` runs once per task and returns a function from prompt to chunks. A
    prompt it fails on yields a row with ``error`` set and no document.
    """

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make_generator()
        for batch in batches:
            documents, errors = [], []
            for prompt in batch["prompt"]:
                try:
                    documents.append("".join(chunk for chunk in generator(prompt) if chunk))
                    errors.append(None)
                except Exception as problem:  # one offer must not fail the batch
                    documents.append(None)
                    errors.append(str(problem))
            yield pd.DataFrame({"id": batch["id"], "answer": documents, "error": errors})

    prompts = offers.select("id", cv_prompt(F.lit(cv_html)).alias("prompt"))
    if partitions:
        prompts = prompts.repartition(partitions)
    answers = prompts.mapInPandas(generate, "id string, answer string, error string")
    return answers.select("id", artifact_slug(F.col("id")).alias("slug"), strip_fence(F.col("answer")).alias("html"), "error")


def adapt_offers(
    offers: DataFrame,
    ids: DataFrame,
    document: DataFrame,
    make_generator: Callable[[], Callable[[str], Iterable[str]]],
    partitions: int | None = None,
) -> DataFrame:
    """Adapt the one base document (html) of ``document`` for the offers named by ``ids``; unknown ids give no row."""
    base = document.select("html").first()
    if base is None:
        raise ValueError("no base document")
    chosen = offers.join(ids.select("id").distinct(), "id", "left_semi")
    return adapt_documents(chosen, base["html"], make_generator, partitions)
