"""Crawl, store and embed in one run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph import rules
from sitegraph.functions import html, urls
from sitegraph.functions.vectors import Encoder
from sitegraph.operators import changes, crawl, links, pages as page_ops
from sitegraph.plans.embed import Embedded, embed_due_pages
from sitegraph.session import join_side, write_stage
from sitegraph.sources.captures import load_fetches


@dataclass(frozen=True)
class Crawled:
    edges: DataFrame
    reached: DataFrame
    fetches: DataFrame
    report: DataFrame
    embedded: Embedded

    def stage_counts(self) -> DataFrame:
        """One row per stage; every count reads a stored stage table."""
        stages = {
            "edges": self.edges,
            "reached": self.reached,
            "fetched": self.fetches,
            "failed": self.fetches.filter(F.col("error").isNotNull()),
            "pages": self.embedded.pages,
            "embedded": self.embedded.new_pages,
            "chunks": self.embedded.chunks,
        }
        counts = [df.agg(F.lit(name).alias("stage"), F.count("*").alias("n")) for name, df in stages.items()]
        out = counts[0]
        for part in counts[1:]:
            out = out.unionByName(part)
        return out


def crawl_site(
    captures: DataFrame,
    seeds: DataFrame,
    store: DataFrame,
    chunks: DataFrame,
    max_depth: int | None = rules.MAX_DEPTH,
    max_pages: int | None = rules.MAX_PAGES,
    now: Column | None = None,
    encoder: Encoder | None = None,
    extract: page_ops.Extractor = html.main_text,
) -> Crawled:
    """Walks the link graph of the captures from the seeds, stores what was reached, embeds what is due."""
    fetches = load_fetches(captures)
    edges = write_stage(links.page_edges(fetches), "edges")
    reached = crawl.crawl_bfs(seeds, edges, max_depth, max_pages)

    # Page bodies are read once, for the documents; everything counted later is narrow.
    visited = join_side(reached.select("url").distinct())
    crawled = fetches.withColumn("url", urls.canonical_url(F.col("url"))).join(visited, "url", "left_semi")
    outcomes = write_stage(crawled.select("url", "error"), "fetches")
    documents = write_stage(page_ops.page_documents(crawled, extract), "documents")
    checksums = documents.select("url", "checksum", "metadata_checksum", "fetched_at")
    # Stored pages that were not reached have no part in the report.
    before = store.select("url", "checksum", "metadata_checksum").join(visited, "url", "left_semi")
    status = changes.detect_changes(before, changes.latest_captures(checksums))
    report = changes.crawl_report(reached, outcomes, status)
    untouched, refreshed = changes.upsert_parts(store, documents)
    pages = untouched.unionByName(write_stage(refreshed, "refreshed"))
    return Crawled(edges, reached, outcomes, report, embed_due_pages(pages, chunks, now, encoder))
