"""Embedding what is due: targets, chunks, chunk and page vectors, new chunk and page tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph import rules
from sitegraph.functions import text
from sitegraph.functions.vectors import Encoder
from sitegraph.operators import changes, chunks as chunk_ops
from sitegraph.session import write_stage

CHUNK_STORE = "page_url string, page_id long, chunk_index int, text string, vec array<float>"


@dataclass(frozen=True)
class Embedded:
    """The tables after the run; ``new_pages`` and ``new_chunks`` hold only what was embedded now."""

    pages: DataFrame
    chunks: DataFrame
    new_pages: DataFrame
    new_chunks: DataFrame


def embed_due_pages(
    pages: DataFrame,
    chunks: DataFrame,
    now: Column | None = None,
    encoder: Encoder | None = None,
    chunker: chunk_ops.Chunker = text.token_chunks,
    max_tokens: int = rules.CHUNK_TOKENS,
) -> Embedded:
    """Embeds the pages that are due and nothing else.

    Due rows are taken out of the page table, embedded and stored; the others pass through. Neither
    the page bodies nor the vectors are shuffled, and no vector is worked out twice.
    """
    due = changes.is_due() & (text.strip(F.col("clean_text")) != "")
    embedded = write_stage(
        chunk_ops.embed_pages(pages.filter(due), encoder)
        .withColumn("embedded_at", F.current_timestamp() if now is None else now),
        "embedded-pages",
    )
    new_chunks = write_stage(
        chunk_ops.embed_chunks(chunk_ops.chunk_pages(embedded, max_tokens, chunker, ("page_id",)), encoder), "embedded-chunks"
    )
    if embedded.isEmpty():
        return Embedded(pages, chunks, embedded, new_chunks)
    return Embedded(
        pages.filter(~due).unionByName(embedded), chunk_ops.replace_chunks(chunks, new_chunks), embedded, new_chunks
    )
