import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql.types import StructType

from sitegraph.operators import changes, crawl
from sitegraph.sources import store as page_store
from sitegraph.streaming import pages as streaming

START = datetime(2024, 1, 1)
DOCUMENT = (
    "page_id long, url string, title string, clean_text string, raw_html string, metadata string, page_type string, "
    "checksum string, metadata_checksum string, fetched_at timestamp, markdown string"
)


def capture(url, minute, text, meta="m"):
    return (1, url, "t", text, "<p>", "{}", "other", f"c-{text}", f"m-{meta}", START + timedelta(minutes=minute), text)


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT)


def empty(spark):
    return spark.createDataFrame([], StructType.fromDDL(changes.PAGE_STORE))


def replayed(rows, known=None):
    """One capture after the other: url -> (checksum, changed, seen)."""
    found = dict(known or {})
    for row in sorted(rows, key=lambda r: (r[9], r[7])):
        url, checksum, at = row[1], row[7], row[9]
        before = found.get(url)
        changed = at if before is None or before[0] != checksum else before[1]
        found[url] = (checksum, changed, at)
    return found


def stored(df):
    rows = df.collect()
    assert len({r.url for r in rows}) == len(rows)
    return {r.url: (r.checksum, r.markdown_changed, r.last_seen) for r in rows}


def feed(seed, hot=0):
    rng = random.Random(seed)
    minutes = rng.sample(range(4000), 300 + hot)  # no two captures at the same time
    urls = [f"u{rng.randrange(40)}" for _ in range(300)] + ["hot"] * hot
    return [capture(url, m / 3, rng.choice("AAB")) for url, m in zip(urls, minutes)]


@pytest.mark.parametrize("seed", [1, 2])
def test_upsert_replays_the_feed(spark, seed):
    rows = feed(seed, hot=150)
    assert stored(changes.upsert_pages(empty(spark), documents(spark, rows))) == replayed(rows)


def test_upsert_in_parts_equals_at_once_and_replay_changes_nothing(spark):
    rows = sorted(feed(3, hot=100), key=lambda r: r[9])
    first, second = documents(spark, rows[:200]), documents(spark, rows[200:])
    half = changes.upsert_pages(empty(spark), first).cache()
    full = changes.upsert_pages(half, second).cache()
    assert stored(full) == replayed(rows)
    assert stored(changes.upsert_pages(full, second)) == stored(full)
    assert stored(changes.upsert_pages(full, first)) == stored(full)


def test_upsert_keeps_vectors_and_other_pages(spark):
    base = changes.upsert_pages(empty(spark), documents(spark, [capture("a", 1, "A"), capture("b", 1, "B")]))
    base = base.selectExpr(*[c for c in changes.STORE_COLUMNS if c != "page_vector"], "array(float(1)) as page_vector")
    rows = {r.url: r for r in changes.upsert_pages(base, documents(spark, [capture("a", 5, "A"), capture("c", 5, "C")])).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"].markdown_changed == START + timedelta(minutes=1)
    assert rows["a"].last_seen == START + timedelta(minutes=5)
    assert rows["a"].page_vector == [1.0] and rows["c"].page_vector is None


def test_upsert_without_broadcast(spark, monkeypatch):
    rows = feed(4)
    monkeypatch.setattr(changes, "join_side", lambda df: df)
    assert stored(changes.upsert_pages(empty(spark), documents(spark, rows))) == replayed(rows)


def test_detect_changes(spark):
    old = documents(spark, [capture("same", 1, "A"), capture("text", 1, "A"), capture("meta", 1, "A"), capture("gone", 1, "A")])
    new = documents(spark, [capture("same", 2, "A"), capture("text", 2, "B"), capture("meta", 2, "A", "n"), capture("new", 2, "A")])
    rows = {r.url: (r.status, r.content_changed, r.metadata_changed) for r in changes.detect_changes(old, new).collect()}
    assert rows == {
        "same": ("unchanged", False, False),
        "text": ("content changed", True, False),
        "meta": ("metadata changed", False, True),
        "gone": ("not seen", False, False),
        "new": ("new", True, True),
    }
    fetches = spark.createDataFrame(
        [("same", None), ("text", None), ("text", "timeout"), ("lost", None), ("gone", None), ("bad", "timeout")], "url string, error string"
    )
    reached = spark.createDataFrame([(u,) for u in ("same", "text", "lost", "gone", "bad", "never captured", "same")], "url string")
    report = {r.outcome: (r.pages, r.total) for r in changes.crawl_report(reached, fetches, changes.detect_changes(old, new)).collect()}
    assert report == {"pass: no changes": (1, 6), "pass": (1, 6), "fail: fetch": (2, 6), "fail: store": (2, 6)}
    state = reached.distinct().selectExpr("'s' AS seed", "url", "1 AS depth")
    progress = crawl.crawl_progress(state, fetches).first()
    assert (progress.reached, progress.failed) == (6, 2)


def test_rows_without_time_or_url(spark):
    rows = [(7, "u", *capture("u", 0, "A")[2:9], None, "A"), (8, None, *capture("u", 0, "A")[2:9], None, "A"), (9, None, *capture("u", 0, "A")[2:], )]
    once = changes.upsert_pages(empty(spark), documents(spark, rows)).cache()
    twice = changes.upsert_pages(once, documents(spark, rows)).cache()
    assert [r.url for r in once.collect()] == ["u"] == [r.url for r in twice.collect()]
    later = changes.upsert_pages(twice, documents(spark, [capture("u", 5, "B")])).collect()
    assert [(r.url, r.page_id, r.checksum, r.markdown) for r in later] == [("u", 7, "c-B", "B")]


def test_page_id_is_that_of_the_first_capture(spark):
    rows = [(10 + i, *capture("u", minute, text)[1:]) for i, (minute, text) in enumerate([(5, "B"), (1, "A"), (9, "C"), (9, "C")])]
    got = changes.upsert_pages(empty(spark), documents(spark, rows)).collect()
    assert [(r.page_id, r.clean_text) for r in got] == [(11, "C")]
    again = changes.upsert_pages(documents_as_store(spark, got), documents(spark, [(77, *capture("u", 20, "D")[1:])])).collect()
    assert [(r.page_id, r.clean_text) for r in again] == [(11, "D")]


def documents_as_store(spark, rows):
    return spark.createDataFrame(rows, StructType.fromDDL(changes.PAGE_STORE))


def test_embedding_targets(spark):
    at = [START + timedelta(days=d) for d in range(3)]
    rows = [("never", "t", at[1], None), ("stale", "t", at[1], at[0]), ("fresh", "t", at[1], at[2]), ("blank", "", at[1], None)]
    pages = spark.createDataFrame(rows, "url string, clean_text string, markdown_changed timestamp, embedded_at timestamp")
    assert {r.url for r in changes.embedding_targets(pages).collect()} == {"never", "stale"}


def test_store_keeps_the_last_committed_version(spark, tmp_path):
    path, schema = str(tmp_path / "store"), StructType.fromDDL(changes.PAGE_STORE)
    write = streaming.pages_writer(path, buckets=4, to_documents=lambda df: df)
    rows = sorted(feed(5), key=lambda r: r[9])
    write(documents(spark, rows[:150]), 0)
    write(documents(spark, rows[150:]), 1)
    write(documents(spark, rows[150:]), 1)  # the same micro-batch once more
    assert stored(page_store.read_store(spark, path, schema)) == replayed(rows)

    # A version that was written but never committed is not read.
    before = stored(page_store.read_store(spark, path, schema))
    late = changes.upsert_pages(empty(spark), documents(spark, [capture("u1", 99999, "Z")]))
    monkey = page_store.next_version(spark, path)
    (late.withColumn("bucket", page_store.bucket_of(late.url, 4)).selectExpr("*", f"{monkey}L as version")
     .write.mode("append").partitionBy("bucket", "version").parquet(f"{path}/data"))
    assert stored(page_store.read_store(spark, path, schema)) == before


def test_stream_of_files(spark, tmp_path):
    rows = sorted(feed(6, hot=60), key=lambda r: r[9])
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    write = streaming.pages_writer(path, buckets=4, to_documents=lambda df: df)
    for part in (rows[:100], rows[100:250], rows[250:]):
        documents(spark, part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(StructType.fromDDL(DOCUMENT)).parquet(source)
        streaming.run_available(stream, write, str(tmp_path / "progress")).awaitTermination()
    assert stored(page_store.read_store(spark, path, StructType.fromDDL(changes.PAGE_STORE))) == replayed(rows)


def test_store_bucket_that_became_empty(spark, tmp_path):
    path, schema = str(tmp_path / "store"), StructType.fromDDL(changes.PAGE_STORE)
    rows = changes.upsert_pages(empty(spark), documents(spark, [capture("a", 1, "A"), capture("b", 1, "B")]))
    touched = page_store.touched_buckets(rows, "url", 4)
    page_store.write_version(rows, path, "url", touched, 4)
    assert page_store.read_store(spark, path, schema).count() == 2
    page_store.write_version(rows.filter("url = 'a'"), path, "url", touched, 4)
    assert [r.url for r in page_store.read_store(spark, path, schema).collect()] == ["a"]
    page_store.write_version(rows.filter("false"), path, "url", touched, 4)
    assert page_store.read_store(spark, path, schema).collect() == []
    assert page_store.read_store(spark, path, schema, buckets=[0]).schema == schema


def shuffled_rows(node, column):
    """Rows that the exchanges of a finished plan wrote with a column."""
    kind = node.nodeName()
    below = [node.executedPlan()] if kind == "AdaptiveSparkPlan" else [node.plan()] if kind.endswith("QueryStage") else []
    children = node.children()
    below += [children.apply(i) for i in range(children.size())]
    own = kind == "Exchange" and column in node.output().mkString(",")
    return (node.metrics().apply("shuffleRecordsWritten").value() if own else 0) + sum(shuffled_rows(child, column) for child in below)


def test_upsert_joins_page_bodies_once(spark, monkeypatch):
    """Also where nothing is small enough to be broadcast."""
    from sitegraph import session

    day = datetime(2024, 5, 1)
    docs = [(i, f"https://a.org/{i % 40}", "t", f"text {i}", "<p>", f"body {i}", "{}", "page", f"c{i}", f"m{i % 3}", day + timedelta(minutes=i)) for i in range(80)]
    docs.append((99, "https://a.org/1", "t", "text 41", "<p>", "body other", "{}", "page", "c41", "m2", day + timedelta(minutes=41)))
    names = "page_id long, url string, title string, clean_text string, raw_html string, markdown string, metadata string, page_type string, checksum string, metadata_checksum string, fetched_at timestamp"
    documents = session.write_stage(spark.createDataFrame(docs, names), "documents")
    store = spark.createDataFrame([], changes.PAGE_STORE)
    wanted = sorted(map(str, changes.upsert_pages(store, documents).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Tables of up to two rows stay small: the captures that cannot be told apart.
        monkeypatch.setattr(session, "BROADCAST_ROWS", 2)
        result = changes.upsert_pages(store, documents)
        assert sorted(map(str, result.collect())) == wanted
        rows = shuffled_rows(result._jdf.queryExecution().executedPlan(), "raw_html")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < rows <= len(docs) + 2
    assert len(wanted) == 40
