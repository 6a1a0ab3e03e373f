"""Captures, feeds and stores that Spark derives from the given tables.

Every derivation reads whole tables; what varies between rows (errors, link lists, metadata) depends
on what the rows contain. ``checks.sql`` states the same derivations for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitegraph.functions import urls
from sitegraph.functions.vectors import hash_encoder
from sitegraph.operators import changes, links, pages as page_ops
from sitegraph.plans.embed import CHUNK_STORE
from sitegraph.session import write_stage
from sitegraph.sources.captures import CAPTURE_SCHEMA, load_fetches

DOCS_SITE = "https://www.docs.example.org"
CUTOFF = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_captures(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(field.name).cast(field.dataType) for field in CAPTURE_SCHEMA.fields])


def web_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages: HTML without markdown. A page cut off before its end is a failed capture."""
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    origin = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    listed = F.array(
        "url", F.concat(origin, F.lit("/about/?b=2&a=1&c=#top")), F.lit("/relative"), F.lit("javascript:void(0)"),
        F.lit("tel:1"), F.lit("https://elsewhere.example.com/x"), F.concat(origin, F.lit("/")),
    )
    heading = F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)
    return _as_captures(
        table(spark, sf_dir, "pages").select(
            (F.col("page_id") * 2).alias("page_id"),
            "url",
            "html",
            F.lit(None).alias("markdown"),
            F.when(lang == "en", None).when(lang == "es", F.array()).otherwise(listed).alias("links"),
            F.when(lang == "de", F.create_map(F.lit("title"), F.concat(F.lit("  "), heading, F.lit(" "))))
            .when(lang == "fr", F.create_map(F.lit("page_type"), F.lit("article")))
            .alias("metadata"),
            F.when(~F.contains("html", F.lit("</body>")), "incomplete document").alias("error"),
            F.timestamp_add("MINUTE", F.col("page_id").cast("int"), F.lit("2024-02-01").cast("timestamp")).alias("fetched_at"),
        )
    )


def docs_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as one large site: markdown without HTML, each page linking to ten others."""
    doc = F.col("doc_id")
    page_url = lambda number: F.concat(F.lit(f"{DOCS_SITE}/d/"), number.cast("string"))
    children = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda j: page_url(doc * 10 + j))
    others = F.array(F.lit(DOCS_SITE + "/"), page_url(doc), F.lit("mailto:a@b.c"), F.lit("https://elsewhere.example.com/x"))
    return _as_captures(
        table(spark, sf_dir, "documents").select(
            (doc * 2 + 1).alias("page_id"),
            F.concat(page_url(doc), F.lit("/#text")).alias("url"),
            F.lit(None).alias("html"),
            F.when(F.col("lang") == "fr", F.concat(F.lit("# "), "source", F.lit(" "), doc.cast("string"), F.lit("\n\n"), "text"))
            .otherwise(F.col("text")).alias("markdown"),
            F.concat(children, others).alias("links"),
            F.when(F.col("lang") == "de", F.create_map(F.lit("title"), F.concat("source", F.lit(" "), doc.cast("string")))).alias("metadata"),
            F.lit(None).alias("error"),
            F.timestamp_add("MINUTE", doc.cast("int"), F.lit("2024-03-01").cast("timestamp")).alias("fetched_at"),
        )
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_captures(spark, sf_dir).unionByName(docs_captures(spark, sf_dir))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seed per host: its capture with the lowest id."""
    found = captures(spark, sf_dir)
    return found.groupBy(urls.host(F.col("url"))).agg(F.min_by("url", "page_id").alias("url")).select("url")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table, stored, since a crawl reads it once per level."""
    return write_stage(links.page_edges(load_fetches(captures(spark, sf_dir))), "edges")


def edges_in_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table with ``early``, whether the page belongs to the half that a first crawl knows; stored in two parts."""
    found = links.page_edges(load_fetches(captures(spark, sf_dir)))
    return write_stage(found.withColumn("early", F.substring(F.md5("src"), 1, 1) < "8"), "edges", parted_by="early")


def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored URLs with their page id."""
    return links.duplicate_urls(captures(spark, sf_dir).select("page_id", "url")).select(
        F.col("canonical_url").alias("url"), F.col("survivor").alias("page_id")
    )


def shop_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a feed of captures: one URL per user and item, its text the event's kind."""
    item = F.get_json_object("props", "$.k")
    return _as_captures(
        table(spark, sf_dir, "events").select(
            F.col("event_id").alias("page_id"),
            F.concat(F.lit("https://shop.example.org/u/"), F.col("user_id").cast("string"), F.lit("?item="), item).alias("url"),
            F.lit(None).alias("html"),
            F.concat(F.lit("Product page of kind "), "event_type").alias("markdown"),
            F.array().alias("links"),
            F.create_map(
                F.lit("title"), F.concat(F.lit("Item "), item),
                F.lit("price"), F.floor(F.col("value") / 20).cast("string"),
            ).alias("metadata"),
            F.when(F.col("event_type") == "error", "timeout").alias("error"),
            F.col("ts").alias("fetched_at"),
        )
    )


def is_first_crawl() -> Column:
    return F.col("fetched_at") < F.lit(CUTOFF).cast("timestamp")


def shop_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, since an upsert reads its documents more than once."""
    return write_stage(page_ops.page_documents(load_fetches(shop_captures(spark, sf_dir))), "shop")


def shop_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.page_documents(load_fetches(shop_captures(spark, sf_dir))).select(
        "url", "checksum", "metadata_checksum", "fetched_at"
    )


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], StructType.fromDDL(changes.PAGE_STORE))


def empty_chunks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], StructType.fromDDL(CHUNK_STORE))


def first_store(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The store after the first crawl; sign-up pages were not embedded, the others an hour later."""
    embedded = ~F.endswith("clean_text", F.lit("signup"))
    return changes.upsert_pages(empty_store(spark), documents.filter(is_first_crawl())).withColumn(
        "embedded_at", F.when(embedded, F.timestamp_add("HOUR", F.lit(1), F.col("last_seen")))
    ).withColumn("page_vector", F.when(embedded, hash_encoder()(F.col("clean_text")).cast("array<float>")))


def second_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after both crawls."""
    documents = shop_documents(spark, sf_dir)
    first = write_stage(first_store(spark, documents), "first-store")
    return changes.upsert_pages(first, documents.filter(~is_first_crawl()))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of the conversations as a search query."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        hash_encoder()(F.col("text")).alias("query_vector"),
    )


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit(f"{DOCS_SITE}/d/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("clean_text"),
    )


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors as page vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("page_vector"))


def clustered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors moved towards a few of themselves: twice the first vector of each pattern of signs is added to its like."""
    wide = F.col("embedding").cast("array<double>")
    signs = F.transform(F.slice(wide, 1, 5), lambda x: x > 0)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), wide.alias("own"), signs.alias("signs"))
    centres = vectors.groupBy("signs").agg(F.min_by("own", "page_id").alias("centre"))
    moved = F.zip_with("own", "centre", lambda x, c: x + 2 * c)
    # There are 32 patterns of signs at most.
    return vectors.join(F.broadcast(centres), "signs").select("page_id", moved.alias("page_vector"))


def micros(vector: Column) -> Column:
    """A vector as text in millionths, for a comparison that is exact and independent of types."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), " ")
