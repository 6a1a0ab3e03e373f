"""A continuous feed of captures with its state in Spark's own store: what is written does not depend on what is stored.

The stream keeps a narrow state per canonical URL (the page's id, the time and checksums of its newest capture, the time of its last
change), keyed by buckets of URLs, and appends one page row for each URL that a micro-batch brings something newer of. Spark's file sink commits each
micro-batch once, and the state goes back with it, so a replay gives the same rows. Readers take the newest row of a URL.
Chunks with vectors are a second stream over the appended pages.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitegraph import rules
from sitegraph.functions import text, urls
from sitegraph.functions.vectors import Encoder
from sitegraph.operators import chunks as chunk_ops, pages as page_ops
from sitegraph.operators.changes import dated_documents
from sitegraph.sources.captures import load_fetches

BODY = ["title", "clean_text", "raw_html", "markdown", "metadata", "page_type"]
# Groups of the keyed state, and rows of a bucket that are given at once.
BUCKETS, OUT_ROWS = 1 << 12, 1024
# Per URL (page_id, seen, checksum, metadata_checksum, changed), as JSON. Times are microseconds, so that no time zone has a say in them.
STATE = "urls string"
ROWS = "url string, page_id long, seen long, changed long, content_changed boolean, texts array<string>"
CHUNKS = "page_url string, page_id long, chunk_index int, text string, vec array<float>, changed timestamp"


def documents_of(captures: DataFrame) -> DataFrame:
    """Page rows by canonical URL. A capture without a time gets that of its micro-batch, which Spark keeps for a replay."""
    fetches = load_fetches(captures, ingested_at=F.current_timestamp())
    return page_ops.page_documents(fetches.withColumn("url", urls.canonical_url(F.col("url"))))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes the captures of a bucket's URLs in time order, as ``changes.upsert_pages`` does, and gives the page row of each URL that
    has a newer one.

    Of the captures narrow columns are held, and the body of the newest one of a URL only.
    """
    stored = json.loads(state.get[0]) if state.exists else {}
    narrow, newest, texts = {}, {}, {}
    for batch in batches:
        for url, page_id, seen, found in zip(batch["url"], batch["page_id"].tolist(), batch["seen"].tolist(), batch["texts"]):
            if url in stored and seen <= stored[url][1]:
                continue
            place = (seen, *found[:3])
            narrow.setdefault(url, []).append((*place[:3], page_id))
            if url not in newest or place > newest[url]:
                newest[url], texts[url] = place, found
    if not newest:
        return
    for url, rows in narrow.items():
        rows.sort()
        page_id, _, checksum, _, before = stored.get(url, (rows[0][3], None, None, None, None))
        changed = before
        for time, found, _, _ in rows:
            if found != checksum:
                checksum, changed = found, time
        seen, _, metadata_checksum, _ = newest[url]
        stored[url] = (page_id, seen, checksum, metadata_checksum, changed)
        narrow[url] = changed != before
    state.update((json.dumps(stored, ensure_ascii=False),))
    urls_ = list(newest)
    for at in range(0, len(urls_), OUT_ROWS):
        some = urls_[at : at + OUT_ROWS]
        kept = [stored[url] for url in some]
        yield pd.DataFrame({
            "url": some, "page_id": [k[0] for k in kept], "seen": [k[1] for k in kept], "changed": [k[4] for k in kept],
            "content_changed": [narrow[url] for url in some], "texts": [list(texts[url]) for url in some],
        })


def changed_pages(captures: DataFrame, to_documents: Callable[[DataFrame], DataFrame] = documents_of, buckets: int = BUCKETS) -> DataFrame:
    """A stream of page rows (those of the page store without vectors, and ``content_changed``), one per URL and micro-batch with
    a newer capture of it. Content has changed if any of those captures has another text than the one before it.

    URLs are keyed in ``buckets`` groups by hash, as a group costs far more than a row: the state of a bucket is that of its URLs. The
    number belongs to the checkpoint; another one needs a new checkpoint and table.
    """
    documents = dated_documents(to_documents(captures))
    rest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("")) for c in ("raw_html", "markdown", "title")]), 256)
    rows = documents.select(
        F.pmod(F.xxhash64("url"), F.lit(buckets)).alias("bucket"), "url", F.col("page_id").cast("long").alias("page_id"),
        F.unix_micros("fetched_at").alias("seen"), F.array("checksum", "metadata_checksum", rest, *BODY).alias("texts"),
    )
    folded = rows.groupBy("bucket").applyInPandasWithState(_fold, ROWS, STATE, "append", GroupStateTimeout.NoTimeout)
    # ``texts`` starts with the two checksums and the hash of the body.
    kept = {name: F.col("texts")[i] for name, i in zip(("checksum", "metadata_checksum", *BODY), (0, 1, *range(3, 3 + len(BODY))))}
    return folded.select(
        "page_id", "url", *[kept[c].alias(c) for c in (*BODY, "checksum", "metadata_checksum")], "content_changed",
        F.timestamp_micros("changed").alias("markdown_changed"), F.timestamp_micros("seen").alias("last_seen"),
    )


def changed_chunks(pages: DataFrame, encoder: Encoder | None = None, chunker: chunk_ops.Chunker = text.token_chunks, max_tokens: int = rules.CHUNK_TOKENS) -> DataFrame:
    """Chunks with vectors of the page rows whose content is new, from a stream or a table of page rows; map-only."""
    new = pages.where(F.col("content_changed") & (text.strip(F.col("clean_text")) != ""))
    cut = chunk_ops.chunk_pages(new, max_tokens, chunker, ("page_id", "markdown_changed"))
    made = chunk_ops.embed_chunks(cut, encoder)
    return made.select("page_url", "page_id", F.col("chunk_index").cast("int").alias("chunk_index"), "text", "vec", F.col("markdown_changed").alias("changed"))


def append(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts a query that appends to a Parquet table: drains what is there, or runs on every interval."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """The appended page rows as a stream, each committed row once."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def current_pages(appended: DataFrame) -> DataFrame:
    """The newest row of every URL. It is found on narrow columns; bodies are read for the newest rows only."""
    newest = appended.groupBy("url").agg(F.max("last_seen").alias("last_seen"))
    return appended.join(newest, ["url", "last_seen"], "left_semi")


def current_chunks(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """The chunks of the last content change of every page; ``pages`` are current rows. A page without text has none."""
    current = pages.where(text.strip(F.col("clean_text")) != "").select(F.col("url").alias("page_url"), F.col("markdown_changed").alias("changed"))
    return chunks.join(current, ["page_url", "changed"], "left_semi").drop("changed")
