"""A continuous feed of captures, upserted and optionally embedded per micro-batch.

All state lives in the stored tables. A micro-batch is committed under its query and number, and one that is committed is not
applied again, however its captures are dated. An upsert ignores captures that are not newer than the stored row, so a
late capture or a repeated file changes nothing either. ``streaming.states`` keeps the state in Spark's own store instead
and only appends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sitegraph.functions import urls
from sitegraph.functions.vectors import Encoder
from sitegraph.operators import changes, pages as page_ops
from sitegraph.plans.embed import CHUNK_STORE, embed_due_pages
from sitegraph.session import stage_scope, write_stage
from sitegraph.sources import store
from sitegraph.sources.captures import load_fetches

BUCKETS = 64


def documents_of(captures: DataFrame) -> DataFrame:
    """Page rows by canonical URL, as a crawl stores them."""
    return page_ops.page_documents(load_fetches(captures).withColumn("url", urls.canonical_url(F.col("url"))))


def pages_writer(
    path: str, buckets: int = BUCKETS, to_documents: Callable[[DataFrame], DataFrame] = documents_of
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts captures into the page store at ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        query = query_of(batch)
        if store.is_committed(batch.sparkSession, path, query, batch_id):
            return
        with stage_scope(batch.sparkSession):
            documents, touched = _batch_documents(batch, buckets, to_documents)
            if touched:
                current = _stored(batch, path, changes.PAGE_STORE, touched)
                store.write_version(changes.upsert_pages(current, documents), path, "url", touched, buckets, query, batch_id)

    return write


def embeddings_writer(
    path: str,
    chunk_path: str,
    buckets: int = BUCKETS,
    to_documents: Callable[[DataFrame], DataFrame] = documents_of,
    now: Column | None = None,
    encoder: Encoder | None = None,
) -> Callable[[DataFrame, int], None]:
    """Like ``pages_writer``, and embeds the pages of the touched buckets that are due.

    Chunks are written before the pages: after a crash in between, the pages are still due and the
    replay replaces their chunks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        query = query_of(batch)
        if store.is_committed(batch.sparkSession, path, query, batch_id):
            return
        with stage_scope(batch.sparkSession):
            documents, touched = _batch_documents(batch, buckets, to_documents)
            if touched:
                current = _stored(batch, path, changes.PAGE_STORE, touched)
                untouched, refreshed = changes.upsert_parts(current, documents)
                pages = untouched.unionByName(write_stage(refreshed, "refreshed"))
                chunks = _stored(batch, chunk_path, CHUNK_STORE, touched)
                done = embed_due_pages(pages, chunks, now, encoder)
                store.write_version(done.chunks, chunk_path, "page_url", touched, buckets, query, batch_id)
                store.write_version(done.pages, path, "url", touched, buckets, query, batch_id)

    return write


def query_of(batch: DataFrame) -> str:
    """The streaming query that a micro-batch belongs to: its id, which its checkpoint keeps; empty outside of a stream."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def _batch_documents(batch, buckets, to_documents) -> tuple[DataFrame, list[int]]:
    documents = write_stage(to_documents(batch), "batch")
    return documents, store.touched_buckets(documents, "url", buckets)


def _stored(batch: DataFrame, path: str, schema: str, touched: list[int]) -> DataFrame:
    return store.read_store(batch.sparkSession, path, StructType.fromDDL(schema), touched)


def run_available(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Starts a query that drains what is there and stops."""
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_continuous(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 minute"
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )
