"""URL filter lists that change over time: validity intervals and an as-of join, in column expressions only.

An entry names a key (a host, which covers its subdomains, or a host with leading path segments), a list, an action (``add``
or ``remove``) and a day. It holds from its day until the day of the next entry of the same list and key. Intervals
are cut at month borders, so the as-of join is an equality on (key, month) plus a range, and neither a hot host nor a
long-lived entry meets all of its counterparts in one place. Of the entries active when a page was fetched, the
one with the most special key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.session import sized_side, write_stage


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_keys(url: Column) -> Column:
    """Keys that can name a URL, the most special one first; empty for what is no URL."""
    host, segments = url_host(url), url_segments(url)
    labels = F.split(host, r"\.")
    counts = F.when(F.size(segments) > 0, F.sequence(F.size(segments), F.lit(1))).otherwise(F.array().cast("array<int>"))
    paths = F.transform(counts, lambda n: F.concat_ws("/", host, F.array_join(F.slice(segments, F.lit(1), n), "/")))
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.concat(paths, parents))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) of the ``add`` entries (list, key, action, day); ``valid_to`` is open where null.

    Entries of one list, key and day count as one; ``remove`` wins among them. Entries with a null in any of the four columns
    or another action are left out. Days are ordered within a month and then month by month, so a key with very many
    entries is not sorted as a whole.
    """
    known = entries.where(F.col("action").isin("add", "remove")).dropna(subset=["list", "key", "day"])
    daily = known.groupBy("list", "key", "day").agg(F.max("action").alias("action")).withColumn("month", F.trunc("day", "month"))
    daily = write_stage(daily, "daily-entries")
    months = daily.groupBy("list", "key", "month").agg(F.min("day").alias("first"))
    later = months.withColumn("_next", F.lead("first").over(Window.partitionBy("list", "key").orderBy("month"))).drop("first")
    inside = F.lead("day").over(Window.partitionBy("list", "key", "month").orderBy("day"))
    dated = daily.withColumn("_inside", inside).join(later, ["list", "key", "month"])
    return dated.where(F.col("action") == "add").select("list", "key", F.col("day").alias("valid_from"), F.coalesce("_inside", "_next").alias("valid_to"))


def judge_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``verdict`` (``block``, ``allow`` or ``none``), ``rule_key`` and ``rule_since``: one row per capture.

    The most special active key decides; ``block`` wins over ``allow`` at the same key. A capture whose URL or time is null, or
    whose URL has no host, gets ``none``. Repeated rows stay; input columns of the result names are replaced. Without
    entries all verdicts are ``none``.
    """
    results = ("verdict", "rule_key", "rule_since")
    kept = [c for c in captures.columns if c not in results]
    # Stored with a row number, as rows of captures may repeat and are taken apart and put together again.
    rows = write_stage(captures.select(*kept).withColumn("__row", F.monotonically_increasing_id()), "captures")
    day = F.to_date(F.col(fetched_at))
    keyed = rows.select("__row", day.alias("__day"), F.posexplode(url_keys(F.col(url))).alias("__rank", "__key"))
    keyed = keyed.withColumn("__month", F.trunc("__day", "month"))

    # The last month needed: one value.
    horizon = rows.agg(F.max(day).alias("d")).first()["d"]
    last = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(horizon).cast("date")), F.lit(horizon).cast("date"))
    months = F.when(last >= F.col("valid_from"), F.sequence(F.trunc("valid_from", "month"), F.trunc(last, "month"), F.expr("interval 1 month")))
    intervals = validity_intervals(entries).withColumn("__list_month", F.explode(months))
    intervals = sized_side(write_stage(intervals, "intervals"))

    active = keyed.join(
        intervals,
        (F.col("__key") == F.col("key")) & (F.col("__month") == F.col("__list_month"))
        & (F.col("__day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__day") < F.col("valid_to"))),
    )
    best = active.groupBy("__row").agg(
        F.min(F.struct("__rank", (F.col("list") == "allow").alias("later"), "list", "key", "valid_from")).alias("__best")
    )
    out = rows.join(best, "__row", "left")
    return out.select(
        *kept, F.coalesce(F.col("__best.list"), F.lit("none")).alias("verdict"),
        F.col("__best.key").alias("rule_key"), F.col("__best.valid_from").alias("rule_since"),
    )
