"""One query per job: (spark, sf_dir) -> DataFrame over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from sitegraph.functions import html_tree
from sitegraph.operators import cells, changes, chunks, crawl, links, pages, search
from sitegraph.plans import search as search_plans
from sitegraph.plans.crawl import crawl_site
from sitegraph.plans.embed import embed_due_pages
from sitegraph.session import scratch_path, write_stage
from sitegraph.sources import captures as cap
from sitegraph.sources import store
from sitegraph.streaming import pages as streaming
from sitegraph.streaming import states


def load_fetches(spark: SparkSession, sf: str) -> DataFrame:
    return cap.load_fetches(fx.captures(spark, sf)).select(
        "page_id", "url", "status_code", "content_type", "error", "has_links", "fetched_at",
        F.md5("content").alias("content_md5"),
        F.md5("markdown").alias("markdown_md5"),
        F.array_join("links", " ").alias("links"),
        F.size("metadata").alias("n_metadata"),
    )


def failed_fetches(spark, sf):
    return cap.failures_per_host(cap.load_fetches(fx.captures(spark, sf)))


def lookup_pages(spark, sf):
    found = chunks.lookup_pages(fx.edges(spark, sf).select(F.col("dst").alias("url")), fx.page_index(spark, sf))
    return found.withColumn("page_id", F.coalesce("page_id", F.lit(-1)))


def replace_chunks(spark, sf):
    """Documents that were labelled since are chunked anew, in smaller chunks."""
    docs = fx.doc_pages(spark, sf)
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("page_id")).distinct()
    old = chunks.chunk_pages(docs)
    new = chunks.chunk_pages(docs.join(labelled, "page_id", "left_semi"), max_tokens=200)
    return chunks.replace_chunks(old, new)


def attach_page_vectors(spark, sf):
    stored = fx.doc_pages(spark, sf).select(
        "page_id", "url", F.lit(None).cast("array<float>").alias("page_vector"), F.lit(None).cast("timestamp").alias("embedded_at")
    )
    vectors = fx.stored_vectors(spark, sf).select(
        F.concat(F.lit(fx.DOCS_SITE + "/d/"), F.col("page_id").cast("string")).alias("url"),
        "page_vector",
        F.lit("2024-05-01 00:00:00").cast("timestamp").alias("embedded_at"),
    )
    return chunks.attach_page_vectors(stored, vectors).select(
        "page_id", "url", fx.micros(F.col("page_vector")).alias("vec"), "embedded_at"
    )


def canonical_urls(spark, sf):
    return links.canonical_urls(fx.captures(spark, sf).select("page_id", "url"))


def duplicate_urls(spark, sf):
    return links.duplicate_urls(fx.captures(spark, sf).select("page_id", "url"))


def html_links(spark, sf):
    return links.html_links(fx.table(spark, sf, "pages").select("url", F.col("html").alias("content")))


def page_edges(spark, sf):
    return links.page_edges(cap.load_fetches(fx.captures(spark, sf)))


def crawl_bfs(spark, sf):
    return crawl.crawl_bfs(fx.seeds(spark, sf), fx.edges(spark, sf))


def crawl_bfs_limited(spark, sf):
    """The page limit closes the large site after its second level."""
    return crawl.crawl_bfs(fx.seeds(spark, sf), fx.edges(spark, sf), max_pages=100)


def crawl_bfs_whole(spark, sf):
    """Everything that can be reached."""
    return crawl.crawl_bfs(fx.seeds(spark, sf), fx.edges(spark, sf), max_depth=None, max_pages=None)


def crawl_frontier(spark, sf):
    edges = fx.edges(spark, sf)
    state = crawl.crawl_bfs(fx.seeds(spark, sf), edges, max_depth=1)
    return crawl.crawl_frontier(state, edges, 1)


def crawl_progress(spark, sf):
    state = crawl.crawl_bfs(fx.seeds(spark, sf), fx.edges(spark, sf))
    return crawl.crawl_progress(state, cap.load_fetches(fx.captures(spark, sf)))


def page_titles(spark, sf):
    return pages.page_titles(cap.load_fetches(fx.captures(spark, sf))).select("page_id", "url", "title", "title_source")


def main_text(spark, sf):
    web = fx.table(spark, sf, "pages").select("page_id", F.col("html").alias("content"))
    return pages.main_text(web).select("page_id", "main_text", "n_lines")


def main_text_tree(spark, sf):
    """The main text of every page by the extractor that keeps open elements, inside the job that takes any extractor."""
    found = pages.main_text(fx.table(spark, sf, "pages").select("page_id", F.col("html").alias("content")), extract=html_tree.main_text_tree)
    return found.select("page_id", "main_text", "n_lines")


def quality_lines(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("[See "), "source", F.lit("](https://example.org/"), "lang", F.lit(") ![](x.png) --- "), "text").alias("text"),
    )
    return pages.quality_lines(docs).drop("text")


def markdown_to_text(spark, sf):
    """Every document inside markdown made of its own columns."""
    docs = fx.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit("# "), "source", F.lit("\r\n\r\n\r\n\n- **"), "lang", F.lit("** __"), "source", F.lit("__\n1. [link "),
            "lang", F.lit("](https://example.org/)\n> `"), "source", F.lit("` *"), "lang",
            F.lit("*\n```\ncode of "), "source", F.lit("\n```\n---\n\t"), "text",
        ).alias("markdown"),
    )
    return pages.markdown_to_text(docs).drop("markdown")


def scrub_volatile(spark, sf):
    """Every document inside content that changes between visits, made of its own columns."""
    docs = fx.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit("Last updated: 12 May 2024, 10:11:12\nWhat is 3 + 4? session_id="), "source", F.lit(" Token: "), "lang",
            F.lit("\n"), F.md5("text"), F.lit(" "), F.sha2("source", 256), F.lit("\n42\nabc\n"), F.substring(F.md5("source"), 1, 8),
            F.lit("\n"), "text",
        ).alias("text"),
    )
    return pages.scrub_volatile(docs).drop("text")


def page_documents(spark, sf):
    return pages.page_documents(cap.load_fetches(fx.captures(spark, sf))).select(
        "page_id", "url", "title", "page_type", "metadata", "checksum", "body_checksum",
        F.char_length("clean_text").alias("n_chars"), "fetched_at",
    )


def page_metadata(spark, sf):
    """Event properties as page metadata: some rows broken, empty, absent or with a page type."""
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", F.regexp_replace("props", "}$", ""))
        .when(kind == "signup", "")
        .when(kind == "purchase", None)
        .when(kind == "click", F.regexp_replace("props", r"^\{", '{"page_type": "product", '))
        .otherwise(F.col("props"))
    )
    events = fx.table(spark, sf, "events").select("event_id", raw.alias("metadata"))
    return pages.page_metadata(events, "k long, page_type string").select("event_id", F.coalesce("fields.k", F.lit(-1)).alias("k"), "page_type")


def pages_per_type(spark, sf):
    return pages.pages_per_type(page_metadata(spark, sf))


def detect_changes(spark, sf):
    documents = fx.shop_checksums(spark, sf)
    return changes.detect_changes(
        changes.latest_captures(documents.filter(fx.is_first_crawl())),
        changes.latest_captures(documents.filter(~fx.is_first_crawl())),
    )


STORE_VIEW = ["page_id", "url", "title", "clean_text", "markdown", "checksum", "metadata_checksum", "markdown_changed", "last_seen", "embedded_at"]


def upsert_pages(spark, sf):
    return fx.second_store(spark, sf).select(*STORE_VIEW)


def crawl_report(spark, sf):
    """The second crawl reaches all URLs of the feed; some were not captured by it, some several times."""
    fetches = cap.load_fetches(fx.shop_captures(spark, sf))
    return changes.crawl_report(fetches.select("url"), fetches.filter(~fx.is_first_crawl()), detect_changes(spark, sf))


def embedding_targets(spark, sf):
    return changes.embedding_targets(fx.second_store(spark, sf))


def chunk_pages(spark, sf):
    return chunks.chunk_pages(fx.doc_pages(spark, sf))


def embed_chunks(spark, sf):
    embedded = chunks.embed_chunks(chunks.chunk_pages(fx.doc_pages(spark, sf)))
    return embedded.select("page_url", "chunk_index", fx.micros(F.col("vec")).alias("vec"))


def embed_pages(spark, sf):
    return chunks.embed_pages(fx.doc_pages(spark, sf)).select("page_id", fx.micros(F.col("page_vector")).alias("vec"))


def mean_page_vectors(spark, sf):
    embedded = chunks.embed_chunks(chunks.chunk_pages(fx.doc_pages(spark, sf), max_tokens=100))
    return chunks.mean_page_vectors(embedded).select("page_url", fx.micros(F.col("page_vector")).alias("vec"), "n_chunks")


def unit_vectors(spark, sf):
    vectors = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return chunks.unit_vectors(vectors).select("vec_id", fx.micros(F.col("vec")).alias("vec"), "is_zero")


def search_pages(spark, sf):
    """Pages nearest to page 0, other than itself."""
    vectors = fx.stored_vectors(spark, sf)
    query = vectors.filter("page_id = 0").select("page_vector").first()[0]
    hits = search.search_pages(query, vectors.filter("page_id <> 0"))
    return hits.select("rank", "page_id", F.round("score", 6).alias("score"))


def search_chunks(spark, sf):
    docs = fx.doc_pages(spark, sf)
    embedded = chunks.embed_chunks(chunks.chunk_pages(docs, max_tokens=100, keep=("page_id",)))
    hits = search.search_chunks(fx.questions(spark, sf), embedded)
    return hits.select("query_id", "rank", "page_id", "chunk_index", F.round("score", 6).alias("score"))


def _batch_hits(spark, sf):
    return search.search_batch(fx.questions(spark, sf), chunks.embed_pages(fx.doc_pages(spark, sf)))


def search_batch(spark, sf):
    return _batch_hits(spark, sf).select("query_id", "rank", "page_id", F.round("score", 6).alias("score"))


def _indexed_vectors(spark, sf):
    """The vectors stored by cell: a search lists and reads only the cells near its queries."""
    vectors = fx.stored_vectors(spark, sf)
    path = scratch_path(spark, "cells")
    search.write_index(vectors, path)
    return vectors, spark.read.parquet(path)


def _self_queries(vectors):
    return vectors.select(F.col("page_id").alias("query_id"), F.col("page_vector").alias("query_vector"))


def search_approx(spark, sf):
    vectors, index = _indexed_vectors(spark, sf)
    hits = search.search_approx(_self_queries(vectors), index)
    return hits.select("query_id", "rank", "page_id", F.round("score", 6).alias("score"))


def search_recall(spark, sf):
    vectors, index = _indexed_vectors(spark, sf)
    queries = _self_queries(vectors)
    report = search.recall(search.search_approx(queries, index), search.search_batch(queries, vectors))
    return report.withColumn("recall", F.round("recall", 6))


def _cell_index(spark, sf):
    """Clustered vectors with an index of learnt cells."""
    vectors = write_stage(fx.clustered_vectors(spark, sf), "clustered")
    path = scratch_path(spark, "cell-index")
    cells.write_cell_index(vectors, path)
    return vectors, cells.read_cell_index(spark, path)


def search_cells(spark, sf):
    """Every clustered vector among the vectors of its nearest learnt cells."""
    vectors, index = _cell_index(spark, sf)
    hits = cells.search_cells(_self_queries(vectors), index)
    return hits.select("query_id", "rank", "page_id", F.round("score", 6).alias("score"))


def search_cells_recall(spark, sf):
    """Recall of the learnt cells against the exact search, and the share of all pairs that is compared for it."""
    vectors, index = _cell_index(spark, sf)
    queries = _self_queries(vectors)
    report = search.recall(cells.search_cells(queries, index), search.search_batch(queries, vectors))
    every = vectors.agg((F.count("*") * F.count("*")).alias("all_pairs"))
    report = report.crossJoin(cells.compared_pairs(queries, index)).crossJoin(every)  # one row each
    return report.select("exact_hits", "found_hits", F.round("recall", 6).alias("recall"), "compared_pairs", F.round(F.col("compared_pairs") / F.col("all_pairs"), 6).alias("pair_share"))


def format_hits(spark, sf):
    return search.format_hits(_batch_hits(spark, sf), fx.doc_pages(spark, sf))


def search_text(spark, sf):
    """Every user turn, as it was written, against the documents."""
    turns = fx.table(spark, sf, "conversations").filter(F.col("role") == "user")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return search_plans.search_text(asked, chunks.embed_pages(fx.doc_pages(spark, sf)))


def response_captures(spark, sf):
    """The event log as scrape responses: some failed, some without data, some cut off."""
    kind = F.col("event_type")
    data = F.struct(
        F.concat(F.lit("<p>"), kind, F.lit("</p>")).alias("html"), kind.alias("markdown"), F.array(F.lit("https://a.org/x")).alias("links"),
        F.create_map(F.lit("title"), F.col("props")).alias("metadata"),
    )
    whole = F.to_json(F.struct(
        (kind != "error").alias("success"), F.when(kind == "error", F.lit("timeout")).alias("error"), F.when(kind != "signup", data).alias("data"),
    ))
    text = F.when(kind == "purchase", F.substring(whole, 1, 30)).otherwise(whole)
    url = F.when(kind != "view", F.concat(F.lit("https://r.org/"), F.col("user_id").cast("string")))
    responses = fx.table(spark, sf, "events").select("event_id", url.alias("url"), text.alias("response"), F.col("ts").alias("fetched_at"))
    fetches = cap.load_fetches(cap.captures_of_responses(responses))
    return fetches.select(
        "url", "status_code", "error", F.md5("content").alias("content_md5"), "markdown", F.array_join("links", " ").alias("links"),
        F.coalesce(F.col("metadata")["title"], F.lit("")).alias("title"), "fetched_at",
    )


def crawl_rows(spark, sf):
    """The pages, vectors and chunks that ``crawl_run`` stores."""
    run = crawl_site(
        fx.captures(spark, sf), fx.seeds(spark, sf), fx.empty_store(spark), fx.empty_chunks(spark),
        max_depth=None, max_pages=None, now=F.col("markdown_changed"),
    )
    chunk_rows = run.embedded.chunks.groupBy("page_url").agg(
        F.count("*").alias("n_chunks"), F.min("page_id").alias("chunk_page_id"), F.max("chunk_index").alias("last_chunk"),
    )
    return run.embedded.pages.join(chunk_rows, F.col("url") == F.col("page_url"), "left").select(
        "page_id", "url", "title", "page_type", "checksum", fx.micros(F.col("page_vector")).alias("vec"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("last_chunk", F.lit(-1)).alias("last_chunk"),
        F.coalesce(F.col("page_id") == F.col("chunk_page_id"), F.lit(True)).alias("same_page"),
    )


def crawl_run(spark, sf):
    """Crawl, store and embed everything reachable, without limits in effect; rows per stage."""
    run = crawl_site(
        fx.captures(spark, sf), fx.seeds(spark, sf), fx.empty_store(spark), fx.empty_chunks(spark),
        max_depth=None, max_pages=None, now=F.col("markdown_changed"),
    )
    return run.stage_counts()


def embed_run(spark, sf):
    """Embeds what the second crawl made due; the pages with their vectors afterwards."""
    stored = write_stage(fx.second_store(spark, sf), "second-store")
    embedded = embed_due_pages(stored, fx.empty_chunks(spark), now=F.col("markdown_changed"))
    return embedded.pages.select("url", "embedded_at", fx.micros(F.col("page_vector")).alias("vec"))


def _drain_feed(spark, sf, write):
    """The feed arrives in two parts; each is drained by its own run over the same checkpoint."""
    feed, progress = scratch_path(spark, "feed"), scratch_path(spark, "progress")
    captures = fx.shop_captures(spark, sf)
    for part in (fx.is_first_crawl(), ~fx.is_first_crawl()):
        captures.filter(part).write.mode("append").parquet(feed)
        streaming.run_available(cap.stream_captures(spark, feed), write, progress).awaitTermination()


def stream_pages(spark, sf):
    path = scratch_path(spark, "store")
    _drain_feed(spark, sf, streaming.pages_writer(path, buckets=8))
    return store.read_store(spark, path, fx.empty_store(spark).schema).select(*STORE_VIEW)


def stream_embeddings(spark, sf):
    path, chunk_path = scratch_path(spark, "store"), scratch_path(spark, "chunks")
    _drain_feed(spark, sf, streaming.embeddings_writer(path, chunk_path, buckets=8, now=F.col("markdown_changed")))
    found = store.read_store(spark, chunk_path, fx.empty_chunks(spark).schema)
    return found.select("page_url", "chunk_index", "text", fx.micros(F.col("vec")).alias("vec"))


def _appended_feed(spark, sf):
    """The feed in two parts, each drained into the table that a stream with keyed state appends to."""
    path, feed, progress = (scratch_path(spark, name) for name in ("appended-pages", "feed", "progress"))
    captures = fx.shop_captures(spark, sf)
    for part in (fx.is_first_crawl(), ~fx.is_first_crawl()):
        captures.filter(part).write.mode("append").parquet(feed)
        states.append(states.changed_pages(cap.stream_captures(spark, feed)), path, progress).awaitTermination()
    return path


def stream_state_pages(spark, sf):
    """The page store of the feed, from appended rows and Spark's keyed state."""
    pages = states.current_pages(spark.read.parquet(_appended_feed(spark, sf)))
    return pages.withColumn("embedded_at", F.lit(None).cast("timestamp")).select(*STORE_VIEW)


def stream_state_chunks(spark, sf):
    """Chunks with vectors of the feed, by a second stream over the appended pages."""
    path = _appended_feed(spark, sf)
    chunk_path, progress = scratch_path(spark, "appended-chunks"), scratch_path(spark, "progress")
    states.append(states.changed_chunks(states.stream_pages(spark, path)), chunk_path, progress).awaitTermination()
    pages = states.current_pages(spark.read.parquet(path))
    found = states.current_chunks(spark.read.schema(states.CHUNKS).parquet(chunk_path), pages)
    return found.select("page_url", "chunk_index", "text", fx.micros(F.col("vec")).alias("vec"))


def crawl_resume(spark, sf):
    """A crawl over half of the pages' links, then resumed with the other half, as a fresh crawl over all would find it."""
    halves = fx.edges_in_halves(spark, sf)
    first, new = (halves.where(part).drop("early") for part in (F.col("early"), ~F.col("early")))
    state = write_stage(crawl.crawl_bfs(fx.seeds(spark, sf), first, max_depth=None, max_pages=None), "crawl-state")
    return crawl.resume_crawl(state, new, halves.drop("early"))


def crawl_states(spark, sf):
    """Every reached URL with its status, as a stored crawl state has it."""
    captures = fx.captures(spark, sf)
    return crawl.crawl_state(crawl.crawl_bfs(fx.seeds(spark, sf), fx.edges(spark, sf)), cap.load_fetches(captures))


def page_metadata_free(spark, sf):
    """The event log's properties under changing names, as metadata with free keys and nested values."""
    events = fx.table(spark, sf, "events")
    kind = F.col("event_type")
    nested = F.concat(F.lit('{"page_type":"'), kind, F.lit('","'), kind, F.lit('":{"of":['), F.col("user_id").cast("string"), F.lit(',"x"]},"props":'), "props", F.lit("}"))
    metadata = F.when(kind == "error", F.lit("{broken")).when(kind == "signup", F.lit("[1]")).when(kind == "view", F.col("props")).otherwise(nested)
    found = pages.page_metadata_free(events.select("event_id", kind.alias("kind"), metadata.alias("metadata")))
    inner = F.coalesce(*[F.try_variant_get("free", f"$.{name}.of[0]", "bigint") for name in ("purchase", "click")])
    return found.select(
        "event_id", "page_type", F.array_join("keys", " ").alias("keys"), inner.alias("first_of"),
        F.coalesce(F.try_variant_get("free", "$.props.k", "bigint"), F.try_variant_get("free", "$.k", "bigint")).alias("k"),
    )


def chunk_tokens(spark, sf):
    """Chunks of every document by the ranks of an installed byte-level vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        chunker = chunks.rank_file_chunker(file.read(), public_tokenizers.PATTERN)
    return chunks.chunk_pages(fx.doc_pages(spark, sf), chunker=chunker)


QUERIES = {
    f.__name__: f
    for f in [
        load_fetches, failed_fetches, lookup_pages, replace_chunks, attach_page_vectors, canonical_urls, duplicate_urls,
        html_links, page_edges, crawl_bfs, crawl_bfs_limited, crawl_bfs_whole, crawl_frontier, crawl_progress, page_titles, main_text,
        quality_lines, markdown_to_text, scrub_volatile, page_documents, page_metadata, pages_per_type, detect_changes,
        upsert_pages, crawl_report, embedding_targets, chunk_pages, embed_chunks, embed_pages, mean_page_vectors,
        unit_vectors, search_pages, search_chunks, search_batch, search_approx, search_recall, search_cells, search_cells_recall,
        format_hits, search_text,
        response_captures, crawl_run, crawl_rows,
        embed_run, stream_pages, stream_embeddings, stream_state_pages, stream_state_chunks, crawl_resume, crawl_states,
        page_metadata_free, chunk_tokens, main_text_tree,
    ]
}
