"""URL identity and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph import rules
from sitegraph.functions import html, urls


def canonical_urls(pages: DataFrame) -> DataFrame:
    """Adds ``canonical_url`` and ``host``; map-only."""
    return pages.withColumn("canonical_url", urls.canonical_url(F.col("url"))).withColumn(
        "host", urls.host(F.col("url"))
    )


def duplicate_urls(pages: DataFrame) -> DataFrame:
    """One row per canonical URL: the surviving (lowest) page id and the number of copies.

    ``min`` and ``count`` are combined before the shuffle, so a URL with very many copies costs one
    row per task.
    """
    return (
        canonical_urls(pages)
        .groupBy("canonical_url")
        .agg(F.min("page_id").alias("survivor"), F.count("*").alias("copies"))
    )


def _skipped(href: Column) -> Column:
    test = href == ""
    for prefix in rules.SKIPPED_HREF_PREFIXES:
        test = test | F.startswith(href, F.lit(prefix))
    return test


def _anchor_targets(content: Column) -> Column:
    """Distinct usable hrefs of a page, without fragment."""
    found = F.transform(html.hrefs(content), urls.without_fragment)
    return F.filter(F.array_distinct(found), lambda href: ~_skipped(href))


def _listed_targets(links: Column) -> Column:
    """Distinct absolute web links of a capture's own list; relative entries are dropped."""
    return F.filter(F.array_distinct(links), urls.is_crawlable)


def html_links(pages: DataFrame) -> DataFrame:
    """``src``, ``dst`` for every anchor of every page (columns ``url``, ``content``)."""
    return _edges(pages.select("url", _anchor_targets(F.col("content")).alias("targets")))


def page_edges(fetches: DataFrame) -> DataFrame:
    """Edges of all good captures: their own link list if they brought one, else their anchors."""
    targets = F.when(F.col("has_links"), _listed_targets(F.col("links"))).otherwise(
        _anchor_targets(F.col("content"))
    )
    return _edges(fetches.filter(F.col("error").isNull()).select("url", targets.alias("targets")))


def _edges(pages: DataFrame) -> DataFrame:
    """Canonical same-host edges.

    The URL rules and the host test run inside the page's array, so that each target is worked out
    once, and the page's own URL once per page, not per edge; only edges that remain become rows, and
    equal ones are combined before the shuffle.
    """
    base, host = F.col("base"), F.col("host")
    targets = F.transform("targets", lambda href: urls.canonical_target(base, href))
    # Most targets begin with the page's own site, which needs no pattern; ``urls.host`` would drop a "www." that is left.
    site = F.when(~F.startswith(host, F.lit("www.")), F.concat(F.col("base.scheme"), F.lit("//"), host, F.lit("/")))
    same_host = F.filter(
        targets, lambda target: F.when(F.startswith(target, F.col("site")), True).otherwise(urls.host(target) == host)
    )
    return (
        pages.withColumn("base", urls.base_parts(F.col("url")))
        .withColumn("host", urls.host(F.col("base.origin")))
        .select(urls.canonical_url(F.col("url")).alias("src"), "targets", "base", "host", site.alias("site"))
        .select("src", F.explode(F.array_distinct(same_host)).alias("dst"))
        .distinct()
    )
