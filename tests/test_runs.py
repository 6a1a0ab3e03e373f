"""Sources, whole runs and the wired queries."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import __spark_entry__ as driver
from checks import fixtures as fx
from checks import queries as wired
from checks import sql
from sitegraph.functions.vectors import hash_encoder
from sitegraph.operators import changes
from sitegraph.plans.crawl import crawl_site
from sitegraph.operators.chunks import embed_pages
from sitegraph.plans.embed import embed_due_pages
from sitegraph.plans.search import search_text
from sitegraph.session import shared_folder
from sitegraph.sources import captures as cap
from sitegraph.sources import store
from sitegraph.streaming import pages as streaming

SF = "/root/testdata/sf0.001"


def later():
    return F.lit("2030-01-01").cast("timestamp")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_read_captures(spark, tmp_path, fmt):
    made = fx.captures(spark, SF)
    made.write.format(fmt).save(str(tmp_path / "in"))
    read = cap.read_captures(spark, str(tmp_path / "in"), fmt)
    assert read.schema == cap.CAPTURE_SCHEMA
    columns = ["page_id", "url", "html", "markdown", "links", "error", "fetched_at", F.to_json("metadata").alias("metadata")]
    assert read.select(columns).exceptAll(made.select(columns)).isEmpty() and read.count() == made.count()


def test_json_captures_with_absent_fields(spark, tmp_path):
    lines = [{"url": "https://a.com/"}, {"url": "https://a.com/x", "error": "timeout", "html": "<p>"}]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, lines)))
    rows = {r.url: r for r in cap.load_fetches(cap.read_captures(spark, str(tmp_path / "in.json"), "json")).collect()}
    good, bad = rows["https://a.com/"], rows["https://a.com/x"]
    assert (good.content, good.markdown, good.links, good.metadata, good.status_code, good.has_links) == ("", "", [], {}, 200, False)
    assert (bad.content, bad.status_code, bad.error, bad.content_type) == ("", 500, "scrape failed: timeout", None)
    assert good.page_id != bad.page_id


def test_crawl_twice(spark):
    """The second run over the same captures finds no change and embeds nothing."""
    captures, seeds = fx.captures(spark, SF), fx.seeds(spark, SF)
    first = crawl_site(captures, seeds, fx.empty_store(spark), fx.empty_chunks(spark), now=later())
    counts = {r.stage: r.n for r in first.stage_counts().collect()}
    assert counts["pages"] > 0 and counts["embedded"] > 0 and counts["chunks"] >= counts["embedded"]
    assert {r.outcome for r in first.report.collect()} <= {"pass", "fail: fetch"}

    second = crawl_site(captures, seeds, first.embedded.pages, first.embedded.chunks, now=later())
    again = {r.stage: r.n for r in second.stage_counts().collect()}
    assert again == {**counts, "embedded": 0}
    assert {r.outcome for r in second.report.collect()} <= {"pass: no changes", "fail: fetch"}


def test_embedding_is_done_once(spark):
    pages = changes.upsert_pages(fx.empty_store(spark), fx.shop_documents(spark, SF))
    done = embed_due_pages(pages, fx.empty_chunks(spark), now=later(), encoder=hash_encoder(16), max_tokens=5)
    assert done.pages.filter("page_vector is null or size(page_vector) <> 16").isEmpty()
    assert done.pages.count() == pages.count()
    nothing = embed_due_pages(done.pages, done.chunks, now=later())
    assert nothing.new_pages.isEmpty() and nothing.chunks.count() == done.chunks.count()


def test_streamed_embeddings_survive_a_crash_between_the_two_writes(spark, tmp_path, monkeypatch):
    path, chunk_path = str(tmp_path / "pages"), str(tmp_path / "chunks")
    batch = fx.shop_captures(spark, SF)
    write = streaming.embeddings_writer(path, chunk_path, buckets=4, now=later())
    real = store.write_version

    def crash(rows, target, *rest):
        if target == path:
            raise RuntimeError("lost")
        real(rows, target, *rest)

    monkeypatch.setattr(store, "write_version", crash)
    with pytest.raises(RuntimeError):
        write(batch, 0)
    monkeypatch.setattr(store, "write_version", real)
    write(batch, 0)
    write(batch, 0)

    pages = store.read_store(spark, path, StructType.fromDDL(changes.PAGE_STORE))
    chunks = store.read_store(spark, chunk_path, fx.empty_chunks(spark).schema)
    assert pages.filter("page_vector is null").isEmpty()
    assert chunks.groupBy("page_url", "chunk_index").count().filter("count > 1").isEmpty()
    assert chunks.select("page_url").distinct().count() == pages.count()


def test_entry_and_keys(spark):
    # Token chunks are compared with a plain version in tests/test_chunks.py.
    assert set(sql.oracle()) == set(wired.QUERIES) - {"chunk_tokens"}
    assert set(driver.oracle_sql()) <= set(driver.queries())
    rows = driver.entry(spark).collect()
    assert rows and all(r.rank <= 5 for r in rows)


def test_records_that_are_no_captures(spark, tmp_path):
    lines = ['{"url": "https://a.com/"}', "{broken", '{"page_id": 5}', "[]"]
    (tmp_path / "in.json").write_text("\n".join(lines))
    fetches = cap.load_fetches(cap.read_captures(spark, str(tmp_path / "in.json"), "json"), ingested_at=later())
    rows = fetches.collect()
    assert len(rows) == 4 and all(r.fetched_at is not None for r in rows)
    assert sorted((r.status_code, r.error or "") for r in rows) == [
        (200, ""), (500, "scrape failed: broken record"), (500, "scrape failed: broken record"), (500, "scrape failed: no url")]
    assert sum(r.failures for r in cap.failures_per_host(fetches).collect()) == 3
    stored = changes.upsert_pages(fx.empty_store(spark), streaming.documents_of(cap.read_captures(spark, str(tmp_path / "in.json"), "json")))
    assert [r.url for r in stored.collect()] == ["https://a.com"]


def test_scrape_responses(spark):
    whole = {"success": True, "data": {"html": "<p>x</p>", "markdown": "x", "links": ["https://a.com/y"], "metadata": {"title": "T", "tags": ["a", {"b": 1}]}}}
    rows = [("https://a.com/1", json.dumps(whole)), ("https://a.com/2", json.dumps({"success": False, "error": "timeout"})), ("https://a.com/3", "{\"succ"),
            ("https://a.com/4", json.dumps({"success": True})), ("https://a.com/5", None)]
    responses = spark.createDataFrame([(*r, None) for r in rows], "url string, response string, fetched_at timestamp")
    got = {r.url[-1]: r for r in cap.captures_of_responses(responses).collect()}
    assert (got["1"].html, got["1"].links, got["1"].metadata) == ("<p>x</p>", ["https://a.com/y"], {"title": "T", "tags": '["a",{"b":1}]'})
    assert [got[k].error for k in "12345"] == [None, "timeout", "broken response", "no data", "broken response"]


def test_crawl_and_stream_share_a_store(spark, tmp_path):
    """Two spellings of a URL are one page, and a micro-batch leaves no stage tables behind."""
    path = str(tmp_path / "pages")
    made = [(1, "https://www.a.com/x/", None, "one", None, None, None, None), (2, "https://a.com/x#f", None, "two", None, None, None, None)]
    write = streaming.pages_writer(path, buckets=4)
    before = set(os.listdir(shared_folder(spark)))
    for number, row in enumerate(made):
        write(spark.createDataFrame([row], cap.CAPTURE_SCHEMA).withColumn("fetched_at", F.timestamp_seconds(F.lit(number + 1))), number)
    rows = store.read_store(spark, path, fx.empty_store(spark).schema).collect()
    assert [(r.url, r.page_id, r.markdown) for r in rows] == [("https://a.com/x", 1, "two")]
    assert set(os.listdir(shared_folder(spark))) == before
    with pytest.raises(ValueError, match="4 buckets"):
        streaming.pages_writer(path, buckets=8)(spark.createDataFrame([made[0]], cap.CAPTURE_SCHEMA), 9)


def test_search_by_text(spark):
    docs = [(1, "u/1", "red apple tree"), (2, "u/2", "blue sea water"), (3, "u/", "red car")]
    pages = embed_pages(spark.createDataFrame(docs, "page_id long, url string, clean_text string"))
    rows = search_text("blue water", pages, k=1).collect()
    assert [(r.rank, r.url, r.title, r.total) for r in rows] == [(1, "u/2", "2", 1)]
    asked = spark.createDataFrame([(7, "red apple"), (8, "sea")], "query_id long, text string")
    assert {(r.query_id, r.url) for r in search_text(asked, pages, k=1).collect()} == {(7, "u/1"), (8, "u/2")}
