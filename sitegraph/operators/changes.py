"""Change tracking between the stored pages and new captures, and what must be embedded again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.session import join_side, sized_side

# Columns of the page store, in order.
PAGE_STORE = (
    "page_id long, url string, title string, clean_text string, raw_html string, markdown string, metadata string, "
    "page_type string, checksum string, metadata_checksum string, markdown_changed timestamp, "
    "last_seen timestamp, page_vector array<float>, embedded_at timestamp"
)
STORE_COLUMNS = [part.split()[0] for part in PAGE_STORE.split(", ")]

# Captures of one URL are folded in two steps, first inside spans of this many seconds.
SPAN_SECONDS = 60


def dated_documents(documents: DataFrame) -> DataFrame:
    """Documents with a URL; one without a time counts as older than all others."""
    return documents.where(F.col("url").isNotNull()).withColumn("fetched_at", F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0))))


def latest_captures(documents: DataFrame) -> DataFrame:
    """The newest capture of every URL, for rows without page bodies.

    The rank filter becomes a group limit before the shuffle, so a URL with very many captures
    sends one row per task.
    """
    newest = Window.partitionBy("url").orderBy(F.desc("fetched_at"), F.desc("checksum"), F.desc("metadata_checksum"))
    return documents.withColumn("place_", F.row_number().over(newest)).filter("place_ = 1").drop("place_")


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status of every URL known to either side (one row per URL in each), from narrow columns only."""
    before = old.select("url", F.col("checksum").alias("c0"), F.col("metadata_checksum").alias("m0"), F.lit(True).alias("in_old"))
    after = new.select("url", F.col("checksum").alias("c1"), F.col("metadata_checksum").alias("m1"), F.lit(True).alias("in_new"))
    content_changed = F.col("in_new") & (F.col("in_old").isNull() | ~F.col("c0").eqNullSafe(F.col("c1")))
    metadata_changed = F.col("in_new") & (F.col("in_old").isNull() | ~F.col("m0").eqNullSafe(F.col("m1")))
    return (
        before.join(after, "url", "full_outer")
        .withColumn("content_changed", F.coalesce(content_changed, F.lit(False)))
        .withColumn("metadata_changed", F.coalesce(metadata_changed, F.lit(False)))
        .select(
            "url",
            "content_changed",
            "metadata_changed",
            F.when(F.col("in_new").isNull(), "not seen")
            .when(F.col("in_old").isNull(), "new")
            .when(F.col("content_changed"), "content changed")
            .when(F.col("metadata_changed"), "metadata changed")
            .otherwise("unchanged")
            .alias("status"),
        )
    )


def _last_change(captures: DataFrame) -> DataFrame:
    """Per URL the time of the last capture whose checksum differs from the one before it.

    Input: url, fetched_at, checksum, metadata_checksum, prior_checksum (of the store; null if the URL
    is new). The captures of a URL are ordered in two steps: inside short spans of time, then over one
    summary row per span. The explicit repartition by URL and span spreads a URL with very many
    captures, also behind a join that has brought the URL together.
    """
    key = F.struct("fetched_at", "checksum", "metadata_checksum")
    inside = Window.partitionBy("url", "span").orderBy("fetched_at", "checksum", "metadata_checksum")
    spans = (
        captures.withColumn("span", F.floor(F.unix_timestamp("fetched_at") / SPAN_SECONDS))
        .repartition("url", "span")
        .withColumn("before", F.lag("checksum").over(inside))
        .groupBy("url", "span")
        .agg(
            F.min(key).alias("first"),
            F.max(key).alias("last"),
            F.max(F.when(F.col("before") != F.col("checksum"), F.col("fetched_at"))).alias("changed"),
            F.min("prior_checksum").alias("prior_checksum"),
        )
    )
    over = Window.partitionBy("url").orderBy("span")
    entering = F.coalesce(F.lag("last.checksum").over(over), F.col("prior_checksum"))
    return (
        spans.withColumn("entering", entering)
        .withColumn(
            "changed",
            F.coalesce("changed", F.when(~F.col("entering").eqNullSafe(F.col("first.checksum")), F.col("first.fetched_at"))),
        )
        .groupBy("url")
        .agg(F.max("changed").alias("changed_at"))
    )


def upsert_pages(store: DataFrame, documents: DataFrame) -> DataFrame:
    """The store after all captures in ``documents`` were written in time order.

    ``last_seen`` is always set, ``markdown_changed`` only by a differing checksum, the vector
    columns stay. Captures not newer than the stored row are ignored, so replaying a batch or
    receiving an old capture late changes nothing.
    """
    untouched, refreshed = upsert_parts(store, documents)
    return untouched.unionByName(refreshed)


def upsert_parts(store: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two parts of an upsert: stored rows that stay as they are, and rows added or replaced.

    Only the second part is new data; a caller that keeps intermediate results stores that one. ``documents`` is
    read three times, twice for narrow columns only: pass a stored table. A stored row without a time is
    replaced by any capture.
    """
    documents = dated_documents(documents)
    newest = join_side(_newest_captures(documents))
    batch = newest.select("url", "newest.fetched_at")
    stays = F.col("fetched_at").isNull() | F.coalesce(F.col("fetched_at") <= F.col("last_seen"), F.lit(False))
    untouched = store.join(batch, "url", "left").filter(stays)
    return untouched.select(*STORE_COLUMNS), _refresh_rows(store, documents, newest)


def _newest_captures(documents: DataFrame) -> DataFrame:
    """(url, newest, first_id): what tells the newest capture of a URL from the others, and the id of its first one.

    Only narrow columns are shuffled, combined per task. ``newest.n`` counts captures that cannot be told apart.
    """
    key = ["fetched_at", "checksum", "metadata_checksum"]
    alike = documents.groupBy("url", *key).agg(F.count("*").alias("n"), F.min("page_id").alias("page_id"))
    return alike.groupBy("url").agg(F.max(F.struct(*key, "n")).alias("newest"), F.min(F.struct(*key, "page_id"))["page_id"].alias("first_id"))


def _newest_documents(documents: DataFrame, newest: DataFrame, add_known: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The newest document of every URL with what ``add_known`` adds to rows (url, time): older page bodies are filtered out
    before any shuffle of bodies.

    What is known of a URL meets on narrow rows first, so its body is joined, and beyond the broadcast bounds shuffled, once. Captures
    that cannot be told apart are joined by themselves: they are few, so all bodies are not shuffled for them again.
    """
    def found(side: DataFrame) -> DataFrame:
        same = [F.col(f"d.{c}").eqNullSafe(F.col(f"n.newest.{c}")) for c in ("fetched_at", "checksum", "metadata_checksum")]
        added = [F.col(f"n.{c}") for c in side.columns if c not in ("url", "newest")]
        return documents.alias("d").join(side.alias("n"), [F.col("d.url") == F.col("n.url"), *same]).select("d.*", *added)

    one = found(add_known(newest.filter("newest.n = 1"), "newest.fetched_at"))
    several = found(sized_side(newest.filter("newest.n > 1")))
    # Captures alike in time and checksums may still differ in what the checksums leave out: the largest hash of it stays.
    rest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("")) for c in ("raw_html", "markdown", "title")]), 256)
    kept = several.groupBy(F.col("url").alias("url_")).agg(F.max_by(F.struct(*several.columns), rest).alias("row_"))
    return one.unionByName(add_known(kept.select("row_.*"), "fetched_at"))


def _refresh_rows(store: DataFrame, documents: DataFrame, newest: DataFrame) -> DataFrame:
    # Only stored rows of URLs in the batch matter; their page bodies are never read.
    prior = join_side(
        store.select(
            "url",
            F.col("page_id").alias("prior_id"),
            F.col("checksum").alias("prior_checksum"),
            F.col("markdown_changed").alias("prior_changed"),
            F.col("last_seen").alias("prior_seen"),
            "page_vector",
            "embedded_at",
        ).join(newest, "url", "left_semi")
    )

    def is_newer(seen: str) -> Column:
        return F.col("prior_seen").isNull() | (F.col(seen) > F.col("prior_seen"))

    # The change times need every capture but narrow columns only; page bodies are read for the newest captures.
    narrow = documents.select("url", "fetched_at", "checksum", "metadata_checksum")
    state = prior.select("url", "prior_checksum", "prior_seen")
    changes = _last_change(narrow.join(state, "url", "left").filter(is_newer("fetched_at")))

    def add_known(rows: DataFrame, seen: str) -> DataFrame:
        return rows.join(prior.drop("prior_checksum"), "url", "left").filter(is_newer(seen)).drop("prior_seen").join(changes, "url", "left")

    return (
        _newest_documents(documents, newest, add_known)
        # A page keeps the id it was first stored with.
        .withColumn("page_id", F.coalesce("prior_id", "first_id"))
        .withColumn("markdown_changed", F.coalesce("changed_at", "prior_changed"))
        .withColumn("last_seen", F.col("fetched_at"))
        .select(*STORE_COLUMNS)
    )


def crawl_outcomes(reached: DataFrame, fetches: DataFrame, changes: DataFrame) -> DataFrame:
    """Outcome of every reached URL: failed fetch, not stored, pass, or pass without changes.

    A URL was fetched if any capture of it is good, as in the progress of a crawl; one that was never captured
    is a failed fetch. ``changes`` holds one row per URL.
    """
    good = fetches.groupBy("url").agg(F.max(F.col("error").isNull()).alias("good"))
    stored = changes.filter(F.col("status") != "not seen").select("url", "content_changed", "metadata_changed")
    urls = reached.select("url").distinct()
    return urls.join(good, "url", "left").join(stored, "url", "left").select("url", _outcome().alias("outcome"))


def _outcome() -> Column:
    return (
        F.when(~F.coalesce("good", F.lit(False)), "fail: fetch")
        .when(F.col("content_changed").isNull(), "fail: store")
        .when(F.col("content_changed") | F.col("metadata_changed"), "pass")
        .otherwise("pass: no changes")
    )


def crawl_report(reached: DataFrame, fetches: DataFrame, changes: DataFrame) -> DataFrame:
    """Reached URLs per outcome, with the total of all of them."""
    counts = crawl_outcomes(reached, fetches, changes).groupBy("outcome").agg(F.count("*").alias("pages"))
    # At most four rows reach the window.
    return counts.withColumn("total", F.sum("pages").over(Window.partitionBy()))


def is_due() -> Column:
    """Never embedded, or changed after the last embedding; with text."""
    stale = F.col("embedded_at").isNull() | (F.col("markdown_changed") > F.col("embedded_at"))
    return F.coalesce(stale & (F.col("clean_text") != ""), F.lit(False))


def embedding_targets(pages: DataFrame) -> DataFrame:
    """Pages with text that were never embedded or changed after the last embedding."""
    return pages.filter(is_due()).select("url", "clean_text", "markdown_changed", "embedded_at")
