"""Joins whose key may be hot: beyond the broadcast bounds, AQE must be able to split the hot key."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitegraph import session
from sitegraph.operators import changes, chunks, crawl

ROWS = 240_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
    before = {key: spark.conf.get(key) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def final_plan(df):
    df.toArrow()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def hot(url):
    """A third of all rows share one key."""
    return F.when(F.col("id") % 3 == 0, url).otherwise(F.concat(F.lit(url), (F.col("id") % 20000).cast("string")))


def documents(spark):
    text = F.md5(F.col("id").cast("string"))
    return session.write_stage(
        spark.range(ROWS).select(
            F.col("id").alias("page_id"), hot("https://u/").alias("url"), F.lit("t").alias("title"), text.alias("clean_text"),
            F.lit("<p>").alias("raw_html"), F.lit("{}").alias("metadata"), F.lit("other").alias("page_type"),
            F.md5((F.col("id") % 7).cast("string")).alias("checksum"), F.lit("m").alias("metadata_checksum"),
            F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("fetched_at"),
            text.alias("markdown"),
        ),
        "documents",
    )


def test_upsert_and_outcomes(spark, no_broadcast):
    docs = documents(spark)
    empty = spark.createDataFrame([], StructType.fromDDL(changes.PAGE_STORE))
    stored = session.write_stage(changes.upsert_pages(empty, docs.filter("page_id < 40000")), "store")
    assert "skew=true" in final_plan(changes.upsert_pages(stored, docs.filter("page_id >= 40000")))
    fetches = docs.withColumn("error", F.lit(None).cast("string"))
    status = changes.detect_changes(stored, changes.latest_captures(docs))
    outcomes = changes.crawl_outcomes(docs, fetches, status)  # one row per URL before any join
    assert outcomes.count() == docs.select("url").distinct().count()


def test_hub_page_in_a_crawl(spark, no_broadcast):
    edges = session.write_stage(
        spark.range(ROWS).select(hot("https://u/").alias("src"), F.md5(F.col("id").cast("string")).alias("dst")), "edges"
    )
    level = spark.range(10000).select(
        F.lit("s").alias("seed"), F.concat(F.lit("https://u/"), F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise("")).alias("url"),
        F.lit(0).alias("depth"),
    )
    step = crawl.crawl_frontier(session.write_stage(level, "level"), edges, 0)
    assert "skew=true" in final_plan(step)
    reached = edges.join(level, edges.src == level.url, "left_semi").select("dst").distinct()
    assert step.count() == reached.count()


def test_chunks_of_one_page(spark, no_broadcast):
    old = session.write_stage(
        spark.range(ROWS).select(hot("https://u/").alias("page_url"), F.col("id").cast("int").alias("chunk_index"),
                                 F.md5(F.col("id").cast("string")).alias("text")), "chunks")
    new = spark.range(1, 10000).select(F.concat(F.lit("https://u/"), F.col("id").cast("string")).alias("page_url"),
                                       F.lit(0).alias("chunk_index"), F.lit("x").alias("text"))
    replaced = chunks.replace_chunks(old, new)
    assert "skew=true" in final_plan(replaced)
    assert replaced.filter("page_url = 'https://u/'").count() == ROWS / 3
