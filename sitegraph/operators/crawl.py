"""Breadth-first crawl over an edge table, level by level."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegraph import rules
from sitegraph.functions import urls
from sitegraph.session import cut_lineage, join_side, sized_side, write_stage

STATE = ["seed", "url", "depth"]
# So many levels are united before what was seen becomes one checkpoint, so that deep walks keep small plans.
LEVELS_IN_PLAN = 20


def crawl_frontier(state: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """New URLs one step behind the level ``depth`` of ``state`` (seed, url, depth).

    A level is usually small against the edge table: then it is broadcast and the edges are not
    shuffled. Otherwise both sides are shuffled on the URL and AQE splits the partitions of hubs.
    """
    level = state.filter(F.col("depth") == depth).select("seed", F.col("url").alias("src"))
    return _step(join_side(level), edges, state, depth + 1)


def _step(level: DataFrame, edges: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    found = edges.join(level, "src").select("seed", F.col("dst").alias("url")).distinct()
    return found.join(seen.select("seed", "url"), ["seed", "url"], "left_anti").select(
        "seed", "url", F.lit(depth).alias("depth")
    )


def crawl_bfs(
    seeds: DataFrame,
    edges: DataFrame,
    max_depth: int | None = rules.MAX_DEPTH,
    max_pages: int | None = rules.MAX_PAGES,
    strict: bool = False,
) -> DataFrame:
    """All URLs reached from each seed with their least depth.

    The page limit holds per seed and is tested before a level, so the last level may exceed it;
    ``strict`` cuts that level in URL order. ``None`` is no limit: the walk ends when nothing new is
    found. Each level is checkpointed.
    ``edges`` is read once per round: pass a stored table, not a plan that parses pages.
    """
    start = seeds.select(urls.canonical_url(F.col("url")).alias("url")).distinct()
    level = seen = cut_lineage(start.select(F.col("url").alias("seed"), "url", F.lit(0).alias("depth")))
    if max_pages is not None and max_pages < 1:
        return seen.limit(0)
    total = seen.count()

    for depth in count(1):
        if max_depth is not None and depth > max_depth:
            break
        if max_pages is not None and total >= max_pages:  # else no seed can be full yet
            full = seen.groupBy("seed").count().filter(F.col("count") >= max_pages).select("seed")
            level = level.join(join_side(full), "seed", "left_anti")
        level = sized_side(level.select("seed", F.col("url").alias("src")))
        level = cut_lineage(_step(level, edges, seen, depth))
        new = level.count()
        if new == 0:
            break
        seen = seen.unionByName(level)
        if depth % LEVELS_IN_PLAN == 0:
            seen = cut_lineage(seen)
        total += new
    return _cut_at_limit(seen, max_pages) if strict and max_pages is not None else seen


def crawl_state(reached: DataFrame, fetches: DataFrame) -> DataFrame:
    """(seed, url, depth, status) to store between crawls: ``fetched`` if any capture is good, ``failed`` if all are bad, else ``pending``."""
    outcome = fetches.groupBy(urls.canonical_url(F.col("url")).alias("url")).agg(F.max(F.col("error").isNull()).alias("good"))
    status = F.when(F.col("good"), "fetched").when(~F.col("good"), "failed").otherwise("pending")
    return reached.join(outcome, "url", "left").select(*STATE, status.alias("status"))


def resume_crawl(
    state: DataFrame, new_edges: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None
) -> DataFrame:
    """The state (seed, url, depth) of a fresh crawl over ``edges``, from a stored ``state`` over all but ``new_edges``.

    New edges and seeds give URLs a lesser depth or a first one. That wave goes through the graph level by level, from its least
    depth up, so a URL is walked on once at most, at its final depth, and what keeps its depth is never walked again. There is no page
    limit; ``max_depth`` is that of the stored crawl. ``edges`` holds the new ones too and is read once per level: pass stored tables.
    """
    state = state.select(*STATE)
    first = new_edges.join(state.select("seed", F.col("url").alias("src"), "depth"), "src").select("seed", F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth"))
    if seeds is not None:
        start = seeds.select(urls.canonical_url(F.col("url")).alias("url")).distinct()
        first = first.unionByName(start.select(F.col("url").alias("seed"), "url", F.lit(0).alias("depth")))
    if max_depth is not None:
        first = first.where(F.col("depth") <= max_depth)
    waiting = cut_lineage(_improving(first.groupBy("seed", "url").agg(F.min("depth").alias("depth")), state))
    improved = level = waiting.limit(0)
    walked = False
    starts = sorted(row["depth"] for row in waiting.select("depth").distinct().collect())  # depths, not URLs
    depth = starts[0] if starts else None
    rounds = 0
    while depth is not None:
        found = waiting.where(F.col("depth") == depth).select("seed", "url")
        if walked:
            source = sized_side(level.select("seed", F.col("url").alias("src")))
            found = found.unionByName(edges.join(source, "src").select("seed", F.col("dst").alias("url")))
        # Without the depth, so that the rows stay where the joins on seed and URL need them.
        found = found.distinct().join(improved.select("seed", "url"), ["seed", "url"], "left_anti")
        level = write_stage(_improving(found.withColumn("depth", F.lit(depth)), state), "level", keep=True)
        walked = not level.isEmpty()
        if walked:
            improved = improved.unionByName(level)
        rounds += 1
        if rounds % LEVELS_IN_PLAN == 0:
            improved = cut_lineage(improved)
        later = [start for start in starts if start > depth]
        if walked:
            depth += 1
        else:
            depth = later[0] if later else None
        if depth is not None and max_depth is not None and depth > max_depth:
            depth = None
    # Every level is stored already: what improved is read from there, not written once more.
    return state.join(sized_side(improved.select("seed", "url")), ["seed", "url"], "left_anti").unionByName(improved)


def _improving(found: DataFrame, state: DataFrame) -> DataFrame:
    """Rows that reach a URL for the first time or at a lesser depth than ``state`` does."""
    known = state.select("seed", "url", F.col("depth").alias("known"))
    joined = found.join(known, ["seed", "url"], "left")
    return joined.where(F.col("known").isNull() | (F.col("depth") < F.col("known"))).select(*STATE)


def _cut_at_limit(reached: DataFrame, max_pages: int) -> DataFrame:
    """Keeps the first ``max_pages`` rows of every seed by depth and URL.

    The rank filter is applied before the shuffle too (a group limit), so no task sees more than
    ``max_pages`` rows of a seed per map task.
    """
    order = Window.partitionBy("seed").orderBy("depth", "url")
    return (
        reached.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_pages).select(*STATE)
    )


def crawl_progress(state: DataFrame, fetches: DataFrame) -> DataFrame:
    """Per depth: reached, fetched, failed (no good capture), pending (next level), processed so far."""
    outcome = (
        fetches.groupBy(urls.canonical_url(F.col("url")).alias("url"))
        .agg(F.max(F.col("error").isNull()).alias("good"))
    )
    # Counted per URL first: a URL reached from very many seeds meets its outcome as one row per depth.
    reached = state.groupBy("url", "depth").agg(F.count("*").alias("n"))
    good = F.coalesce("good", F.lit(False))
    counts = (
        reached.join(outcome, "url", "left")
        .groupBy("depth")
        .agg(
            F.sum("n").alias("reached"),
            F.sum(F.when(good, F.col("n")).otherwise(0)).alias("fetched"),
            F.sum(F.when(good, 0).otherwise(F.col("n"))).alias("failed"),
        )
    )
    # One row per depth is left here, at most max_depth + 1.
    by_depth = Window.orderBy("depth")
    return counts.select(
        "depth", "reached", "fetched", "failed",
        F.lead("reached", 1, 0).over(by_depth).alias("pending"),
        F.sum("reached").over(by_depth).alias("processed"),
    )
