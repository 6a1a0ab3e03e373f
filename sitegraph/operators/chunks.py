"""Token chunks of page texts and their vectors."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import batched, islice

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegraph import rules
from sitegraph.functions import text
from sitegraph.functions.vectors import Encoder, hash_encoder, norm, unit
from sitegraph.session import join_side

# A chunker maps a text column and a size to an array<string> column of raw chunks.
Chunker = Callable[[Column, int], Column]


def tokenizer_chunker(load: Callable[[], object]) -> Chunker:
    """Chunks by a tokenizer with ``encode`` and ``decode`` (such as a tiktoken encoding).

    ``load`` runs once per Python worker.
    """

    def chunker(column: Column, max_tokens: int) -> Column:
        @F.pandas_udf(T.ArrayType(T.StringType()))
        def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokenizer = load()
            for texts in batches:
                pieces = [list(batched(tokenizer.encode(value or ""), max_tokens)) for value in texts]
                # All pieces of the batch are decoded in one call where the tokenizer has one.
                flat = [list(piece) for page in pieces for piece in page]
                decode_all = getattr(tokenizer, "decode_batch", None)
                decoded = iter(decode_all(flat) if decode_all else map(tokenizer.decode, flat))
                yield pd.Series([list(islice(decoded, len(page))) for page in pieces])

        return split(column)

    return chunker


def rank_file_chunker(ranks: bytes, pattern: str) -> Chunker:
    """Chunks by a byte-level rank file; a chunk ends before the token that would make it longer than allowed.

    A token may be part of a character. Then the chunk ends at the last token before it that ends a character; a character of more
    tokens than a chunk may have is kept whole. So chunks put together are the text. The encoder is built once per task from the file's bytes.
    """

    def chunker(column: Column, max_tokens: int) -> Column:
        @F.pandas_udf(T.ArrayType(T.StringType()))
        def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import tiktoken

            pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
            encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})
            for texts in batches:
                yield pd.Series([whole_character_chunks(encoding.decode_tokens_bytes(encoding.encode_ordinary(value or "")), max_tokens) for value in texts])

        return split(column)

    return chunker


def whole_character_chunks(tokens: list[bytes], max_tokens: int) -> list[str]:
    """Consecutive texts of at most ``max_tokens`` tokens that end where a character ends."""
    chunks, first = [], 0
    while first < len(tokens):
        end = min(first + max_tokens, len(tokens))
        # A byte 10xxxxxx goes on with a character.
        back = end
        while back > first and back < len(tokens) and tokens[back][0] & 0xC0 == 0x80:
            back -= 1
        while back == first and end < len(tokens) and tokens[end][0] & 0xC0 == 0x80:
            end += 1
        end = end if back == first else back
        chunks.append(b"".join(tokens[first:end]).decode("utf-8", "replace"))
        first = end
    return chunks


def chunk_pages(
    pages: DataFrame,
    max_tokens: int = rules.CHUNK_TOKENS,
    chunker: Chunker = text.token_chunks,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``page_url``, the page columns in ``keep``, ``chunk_index``, ``text`` for pages with ``url`` and ``clean_text``.

    Chunks do not overlap, are trimmed, and are numbered from 0 after empty ones are dropped.
    """
    trimmed = F.transform(chunker(F.col("clean_text"), max_tokens), text.strip)
    return pages.select(
        F.col("url").alias("page_url"),
        *keep,
        F.posexplode(F.filter(trimmed, lambda chunk: chunk != "")).alias("chunk_index", "text"),
    )


def embed_chunks(chunks: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Adds the unit vector ``vec`` of every chunk; map-only."""
    return chunks.withColumn("vec", (encoder or hash_encoder())(F.col("text")).cast("array<float>"))


def embed_pages(pages: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """One unit vector per page from its whole text; map-only."""
    return pages.withColumn("page_vector", (encoder or hash_encoder())(F.col("clean_text")).cast("array<float>"))


def mean_page_vectors(chunks: DataFrame) -> DataFrame:
    """Element-wise mean of the chunk vectors of a page.

    The mean is a partial aggregate over whole vectors: a page with very many chunks sends one
    vector per task, and vectors are never exploded into rows.
    """
    return (
        chunks.groupBy("page_url")
        .agg(Summarizer.mean(array_to_vector(F.col("vec"))).alias("mean_"), F.count("*").alias("n_chunks"))
        .select("page_url", vector_to_array("mean_").alias("page_vector"), "n_chunks")
    )


def unit_vectors(vectors: DataFrame, column: str = "vec") -> DataFrame:
    """Scales vectors to length 1 and flags those that have no direction."""
    return vectors.withColumn("is_zero", norm(F.col(column)) == 0).withColumn(column, unit(F.col(column)))


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of a page that occurs in ``new`` are replaced by the new ones."""
    touched = join_side(new.select("page_url").distinct())
    return old.join(touched, "page_url", "left_anti").unionByName(new)


def attach_page_vectors(pages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sets ``page_vector`` and ``embedded_at`` on the pages that have a row in ``vectors``, the newest one per URL.

    A row without a vector sets nothing. Pages stay one row each. The vectors are one narrow row per URL, so page bodies are shuffled only
    where there are too many of them to broadcast.
    """
    newest = vectors.where(F.col("page_vector").isNotNull()).groupBy("url").agg(F.max(F.struct("embedded_at", "page_vector")).alias("new_"))
    return (
        pages.join(join_side(newest), "url", "left")
        .withColumn("page_vector", F.coalesce("new_.page_vector", "page_vector"))
        .withColumn("embedded_at", F.coalesce("new_.embedded_at", "embedded_at"))
        .drop("new_")
    )


def lookup_pages(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, page_id, found) of every distinct target; the id is null where the exact URL is not stored.

    The store has one row per URL; a URL that is asked for very often sits on the side that AQE may
    split.
    """
    known = pages.select("url", "page_id", F.lit(True).alias("found"))
    wanted = targets.select("url").distinct()
    return wanted.join(known, "url", "left").withColumn("found", F.coalesce("found", F.lit(False)))
