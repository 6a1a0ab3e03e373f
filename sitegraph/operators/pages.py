"""From fetched captures to page documents: title, text, metadata, checksum. All map-only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph import rules
from sitegraph.functions import html, text

# Any rule from an HTML column to main text (empty or null if nothing was found) can stand in here.
Extractor = Callable[[Column], Column]


def page_titles(fetches: DataFrame) -> DataFrame:
    """``title`` and which source won: metadata, markdown heading, HTML title or the URL."""
    chain = {
        "metadata": text.strip(F.coalesce(F.col("metadata")["title"], F.lit(""))),
        "markdown": text.markdown_heading(F.col("markdown")),
        "html": html.html_title(F.col("content")),
    }
    named = [F.when(title != "", F.struct(title.alias("title"), F.lit(name).alias("source"))) for name, title in chain.items()]
    fallback = F.struct(F.col("url").alias("title"), F.lit("url").alias("source"))
    return (
        fetches.withColumn("found", F.coalesce(*named, fallback))
        .withColumn("title", F.col("found.title"))
        .withColumn("title_source", F.col("found.source"))
        .drop("found")
    )


def main_text(pages: DataFrame, extract: Extractor = html.main_text) -> DataFrame:
    """Adds ``main_text`` (one block per line) and its number of lines."""
    extracted = F.coalesce(extract(F.col("content")), F.lit(""))
    return pages.withColumn("main_text", extracted).withColumn(
        "n_lines", F.when(F.col("main_text") == "", 0).otherwise(F.size(F.split("main_text", "\n")))
    )


def quality_lines(pages: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``quality_text`` with the counts of kept and dropped lines."""
    return (
        pages.withColumn("kept_lines_", text.quality_line_array(F.col(column)))
        .withColumn("quality_text", F.array_join("kept_lines_", "\n\n"))
        .withColumn("kept", F.size("kept_lines_"))
        .withColumn("dropped", F.size(F.split(F.col(column), "\n")) - F.col("kept"))
        .drop("kept_lines_")
    )


def markdown_to_text(pages: DataFrame, column: str = "markdown") -> DataFrame:
    """Adds ``plain_text``: markdown without its markup."""
    return pages.withColumn("plain_text", text.markdown_to_text(F.col(column)))


def scrub_volatile(pages: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``stable_text`` and how many characters were removed."""
    return pages.withColumn("stable_text", text.scrub_volatile(F.col(column))).withColumn(
        "removed", F.char_length(F.col(column)) - F.char_length("stable_text")
    )


def page_documents(fetches: DataFrame, extract: Extractor = html.main_text) -> DataFrame:
    """The page row of every good capture.

    Text comes from the HTML's main content; only if that is empty, from the markdown. A non-empty
    text gets a header with URL and title, which the checksum covers; ``body_checksum`` leaves the
    header out, so equal bodies at two URLs can be found.
    """
    titled = page_titles(fetches.filter(F.col("error").isNull()))
    extracted = F.coalesce(extract(F.col("content")), F.lit(""))
    body = F.when(F.col("extracted_") != "", text.quality_text(F.col("extracted_"))).otherwise(
        text.scrub_volatile(text.markdown_to_text(F.col("markdown")))
    )
    before_url, rest = rules.PAGE_HEADER.split("{url}")
    before_title, after_title = rest.split("{title}")
    header = F.concat(F.lit(before_url), F.col("url"), F.lit(before_title), F.col("title"), F.lit(after_title))
    page_type = F.coalesce(F.col("metadata")["page_type"], F.lit(rules.DEFAULT_PAGE_TYPE))
    metadata = F.to_json(F.struct(
        "links", F.lit("capture").alias("source"), F.lit("markdown").alias("content_type"),
        "metadata", page_type.alias("page_type"),
    ))
    return (
        titled.withColumn("extracted_", extracted)
        .withColumn("body_", body)
        .withColumn("clean_text", F.when(F.col("body_") != "", F.concat(header, F.col("body_"))).otherwise(F.lit("")))
        .select(
            "page_id",
            "url",
            "title",
            "clean_text",
            F.col("content").alias("raw_html"),
            "markdown",
            metadata.alias("metadata"),
            page_type.alias("page_type"),
            F.sha2("clean_text", 256).alias("checksum"),
            F.sha2("body_", 256).alias("body_checksum"),
            F.sha2(metadata, 256).alias("metadata_checksum"),
            "fetched_at",
        )
    )


def page_metadata(pages: DataFrame, schema: str, column: str = "metadata") -> DataFrame:
    """Reads a metadata JSON column into the struct ``fields``; bad or empty JSON gives null fields.

    ``page_type`` falls back to the default type.
    """
    parsed = F.from_json(F.col(column), schema)
    return pages.withColumn("fields", parsed).withColumn(
        "page_type", F.coalesce(F.col("fields")["page_type"], F.lit(rules.DEFAULT_PAGE_TYPE))
    )


def page_metadata_free(pages: DataFrame, column: str = "metadata", type_path: str = "$.page_type") -> DataFrame:
    """Reads a metadata JSON column whole: ``free`` is a VARIANT with all its keys and nested values, null for bad or absent JSON.

    ``page_type`` is the text at ``type_path`` or the default type, ``keys`` the sorted top-level keys (empty for what is no object).
    """
    free = F.try_parse_json(F.col(column))
    kind = F.col("free").isNotNull() & F.startswith(F.schema_of_variant("free"), F.lit("OBJECT"))
    keys = F.when(kind, F.array_sort(F.map_keys(F.expr("try_cast(free AS map<string, variant>)"))))
    return pages.withColumn("free", free).withColumns({
        "page_type": F.coalesce(F.try_variant_get("free", type_path, "string"), F.lit(rules.DEFAULT_PAGE_TYPE)),
        "keys": F.coalesce(keys, F.array().cast("array<string>")),
    })


def pages_per_type(pages: DataFrame) -> DataFrame:
    return pages.groupBy("page_type").agg(F.count("*").alias("pages"))
