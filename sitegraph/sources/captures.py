"""Raw page captures: reading them and giving every row the same shape."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegraph.functions import urls

CAPTURE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("markdown", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A folder of captures in Parquet, ORC or line-delimited JSON. The schema is given, not inferred.

    A JSON line that cannot be read is a failed capture without a URL.
    """
    if fmt != "json":
        return spark.read.schema(CAPTURE_SCHEMA).format(fmt).load(path)
    lines = spark.read.text(path)
    return parse_captures(lines, "value")


def parse_captures(lines: DataFrame, column: str) -> DataFrame:
    """Captures from a column of JSON objects; what is no such object gives an error."""
    schema = T.StructType([*CAPTURE_SCHEMA.fields, T.StructField("broken_", T.StringType())])
    parsed = lines.select(F.from_json(F.col(column), schema, {"columnNameOfCorruptRecord": "broken_"}).alias("c")).select("c.*")
    error = F.coalesce("error", F.when(F.col("broken_").isNotNull(), "broken record"))
    return parsed.withColumn("error", error).drop("broken_")


RESPONSE_SCHEMA = """success boolean, error string, data struct<html: string, markdown: string, links: array<string>,
  metadata: map<string, string>>, broken_ string"""


def captures_of_responses(responses: DataFrame) -> DataFrame:
    """Captures from scrape responses (url, response, fetched_at), the response being the service's JSON text.

    Free-form metadata becomes a map of texts, nested values as JSON. A response that is not a JSON object, was not
    successful or brought no data is a failed capture.
    """
    parsed = responses.withColumn("r_", F.from_json("response", RESPONSE_SCHEMA, {"columnNameOfCorruptRecord": "broken_"}))
    failure = F.when(F.col("r_.broken_").isNotNull() | F.col("r_.success").isNull(), F.lit("broken response")).when(
        ~F.col("r_.success"), F.coalesce("r_.error", F.lit("unknown error"))
    ).when(F.col("r_.data").isNull(), F.lit("no data"))
    return parsed.select(
        F.xxhash64("url").alias("page_id"), "url", *[F.col(f"r_.data.{name}").alias(name) for name in ("html", "markdown", "links", "metadata")],
        failure.alias("error"), "fetched_at",
    )


def free_metadata(responses: DataFrame) -> DataFrame:
    """Adds ``metadata``, a VARIANT with the page's metadata of a scrape response as it came: nested values and numbers keep their kind.

    Null where the response is no JSON or has no metadata.
    """
    return responses.withColumn("metadata", F.try_variant_get(F.try_parse_json("response"), "$.data.metadata", "variant"))


def stream_captures(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """The same folder as a stream of newly arrived files."""
    return (
        spark.readStream.schema(CAPTURE_SCHEMA).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def load_fetches(captures: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Fills absent fields; a good row has status 200, a bad one 500, an error text and no content.

    ``has_links`` remembers whether the capture brought its own link list, even an empty one. A capture without a
    URL is a bad one. One without a time gets ``ingested_at``, by default the time of this call.
    """
    if ingested_at is None:  # a constant, so that a plan that is run again gives the same rows
        ingested_at = F.timestamp_micros(F.lit(int(time.time() * 1_000_000)))
    reason = F.coalesce("error", F.when(F.col("url").isNull(), "no url"))
    good = reason.isNull()

    def if_good(value: Column, empty: Column) -> Column:
        return F.when(good, F.coalesce(value, empty)).otherwise(empty)

    return captures.select(
        F.coalesce("page_id", F.xxhash64("url")).alias("page_id"),
        "url",
        if_good(F.col("html"), F.lit("")).alias("content"),
        F.when(good, F.lit(200)).otherwise(F.lit(500)).alias("status_code"),
        F.when(good, F.lit("text/html")).alias("content_type"),
        F.when(~good, F.concat(F.lit("scrape failed: "), reason)).alias("error"),
        if_good(F.col("markdown"), F.lit("")).alias("markdown"),
        (good & F.col("links").isNotNull()).alias("has_links"),
        if_good(F.col("links"), F.array().cast("array<string>")).alias("links"),
        if_good(F.col("metadata"), F.create_map().cast("map<string,string>")).alias("metadata"),
        F.coalesce("fetched_at", ingested_at).alias("fetched_at"),
    )


def failed_fetches(fetches: DataFrame) -> DataFrame:
    """Rows that brought no page."""
    return fetches.filter(F.col("error").isNotNull())


def failures_per_host(fetches: DataFrame) -> DataFrame:
    return (
        failed_fetches(fetches)
        .groupBy(urls.host(F.col("url")).alias("host"), "error")
        .agg(F.count("*").alias("failures"))
    )
