"""Replays, streams side by side, and the stream that only appends."""

import threading
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from sitegraph.operators import changes
from sitegraph.session import BROADCAST_BYTES, sized_side, stage_scope, write_stage
from sitegraph.sources import captures as cap
from sitegraph.sources import store
from sitegraph.streaming import pages as streaming
from sitegraph.streaming import states


def captures(spark, rows):
    """Rows of (url, markdown, seconds or None)."""
    made = [(i, url, None, text, None, None, None, datetime.fromtimestamp(at) if at is not None else None) for i, (url, text, at) in enumerate(rows)]
    return spark.createDataFrame(made, cap.CAPTURE_SCHEMA)


def test_a_replayed_batch_is_not_applied_again(spark, tmp_path):
    """The captures have no time, so they count as fetched when they are loaded: only the batch number tells a replay."""
    path = str(tmp_path / "pages")
    write = streaming.pages_writer(path, buckets=2)
    first, second = (captures(spark, [("https://a.com/x", text, None)]) for text in ("first text", "second text"))
    for batch, number in ((first, 0), (second, 1), (first, 0), (second, 1)):
        write(batch, number)
    rows = store.read_store(spark, path, fx.empty_store(spark).schema).collect()
    assert [r.markdown for r in rows] == ["second text"]
    assert store.commits(spark, path).select("version").distinct().count() == 2
    assert store.drop_superseded(spark, path, before=1 << 62) == 1
    assert [r.markdown for r in store.read_store(spark, path, fx.empty_store(spark).schema).collect()] == ["second text"]


def test_scopes_of_two_threads_are_apart(spark):
    started, ended, found = threading.Event(), threading.Event(), {}

    def first():
        with stage_scope(spark):
            found["before"] = write_stage(spark.range(5), "first")
            started.set()
            ended.wait(60)
            found["rows"] = found["before"].count()

    def second():
        started.wait(60)
        with stage_scope(spark):
            write_stage(spark.range(3), "second")
        ended.set()

    threads = [threading.Thread(target=work) for work in (first, second)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert found["rows"] == 5


def test_two_streams_in_one_session(spark, tmp_path):
    queries = []
    for name in ("a", "b"):
        captures(spark, [(f"https://{name}.com/{i}", f"text {i}", i) for i in range(40)]).repartition(4).write.parquet(str(tmp_path / name / "in"))
        stream = cap.stream_captures(spark, str(tmp_path / name / "in"), files_per_batch=1)
        queries.append(streaming.run_available(stream, streaming.pages_writer(str(tmp_path / name / "out"), buckets=2), str(tmp_path / name / "progress")))
    for query in queries:
        query.awaitTermination()
        assert query.exception() is None
    for name in ("a", "b"):
        assert store.read_store(spark, str(tmp_path / name / "out"), fx.empty_store(spark).schema).count() == 40


def test_kept_stages_outlive_their_scope(spark):
    with stage_scope(spark):
        with stage_scope(spark):
            kept, gone = write_stage(spark.range(4), "kept", keep=True), write_stage(spark.range(4), "gone")
        assert kept.count() == 4
        with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
            gone.count()


def test_nested_values_count_in_the_size_of_a_side(spark, monkeypatch):
    monkeypatch.setattr("sitegraph.session.BROADCAST_BYTES", 200_000)
    flat = spark.range(100).select("id", F.array_repeat(F.lit(1.0), 512).alias("v"))
    nested = {
        "struct": flat.select("id", F.struct(F.lit(1).alias("a"), "v").alias("s")), "array": flat.select("id", F.array(F.struct("v")).alias("s")),
        "map": flat.select("id", F.create_map(F.lit("k"), "v").alias("s")), "texts": spark.range(100).select("id", F.array(F.repeat(F.lit("x"), 4096)).alias("s")),
        "variant": spark.range(100).select("id", F.parse_json(F.to_json(F.array_repeat(F.lit(1234567), 512))).alias("s")),
    }
    assert BROADCAST_BYTES > 200_000

    def is_hinted(df):
        return "broadcast" in sized_side(df)._jdf.queryExecution().analyzed().toString().lower()

    assert not is_hinted(flat) and is_hinted(spark.range(100))
    assert {name: is_hinted(df) for name, df in nested.items()} == dict.fromkeys(nested, False)


def test_alike_captures_with_other_bodies_give_one_stable_row(spark):
    made = [(i, "https://a.com/x", f"<p>short {i}</p>", None, None, None, None, datetime.fromtimestamp(5)) for i in range(20)]
    frame = spark.createDataFrame(made, cap.CAPTURE_SCHEMA)
    found = set()
    for parts in (1, 4, 7):
        documents = write_stage(streaming.documents_of(frame.repartition(parts)), "documents")
        found |= {r.raw_html for r in changes.upsert_pages(fx.empty_store(spark), documents).collect()}
    assert len(found) == 1


def drain(spark, tmp_path, frame, name="feed"):
    frame.write.mode("append").parquet(str(tmp_path / name))
    stream = states.changed_pages(cap.stream_captures(spark, str(tmp_path / name)))
    states.append(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_appended_rows_are_the_store_of_upserts(spark, tmp_path):
    parts = [[("https://a.com/x", "one", 10), ("https://a.com/x#f", "two", 20), ("https://a.com/y", "only", 5), ("https://a.com/x", "two", 30)],
             [("https://a.com/x", "one", 15), ("https://a.com/y", "only", 50), ("https://a.com/z", "newly", 1)],
             [("https://www.a.com/x/", "three", 40), ("https://a.com/x", "two", 35), (None, "nowhere", 3)]]
    current = fx.empty_store(spark)
    for part in parts:
        appended = drain(spark, tmp_path, captures(spark, part))
        current = write_stage(changes.upsert_pages(current, write_stage(streaming.documents_of(captures(spark, part)), "documents")), "store")
    columns = ["url", "clean_text", "checksum", "metadata_checksum", "markdown_changed", "last_seen"]
    got, want = (sorted(map(tuple, df.select(columns).collect())) for df in (states.current_pages(appended), current))
    assert got == want and len(got) == 3
    # A late capture appends nothing: x, y; y, z; x.
    assert appended.count() == 5
    chunks = states.current_chunks(states.changed_chunks(appended), states.current_pages(appended))
    assert sorted((r.page_url, r.text[-5:].strip()) for r in chunks.collect()) == [("https://a.com/x", "three"), ("https://a.com/y", "only"), ("https://a.com/z", "newly")]


def test_what_is_written_does_not_depend_on_what_is_stored(spark, tmp_path):
    written = {}
    for size in (200, 5000):
        base = tmp_path / str(size)
        base.mkdir()
        drain(spark, base, captures(spark, [(f"https://a.com/{i}", f"text of page {i}", 1) for i in range(size)]))
        before = {p for p in Path(base / "out").glob("*.parquet")}
        appended = drain(spark, base, captures(spark, [(f"https://a.com/{i}", f"other text {i}", 2) for i in range(100)]))
        written[size] = sum(p.stat().st_size for p in Path(base / "out").glob("*.parquet") if p not in before)
        assert states.current_pages(appended).count() == size and appended.count() == size + 100
    assert written[5000] < 1.2 * written[200]


def test_state_is_kept_for_buckets_of_urls(spark, tmp_path):
    """A group of the keyed state costs far more than a row, so there are as many as buckets, not as URLs."""
    made = [(f"https://a.com/{i % 150}", f"text {i // 150} of page {i % 150}", i) for i in range(300)] + [("https://a.com/none", None, 1)]
    for half in (made[:200], made[200:]):
        captures(spark, half).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = states.changed_pages(cap.stream_captures(spark, str(tmp_path / "feed")), buckets=4)
        query = states.append(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
        query.awaitTermination()
        assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    rows = spark.read.parquet(str(tmp_path / "out"))
    current = {r.url: r for r in states.current_pages(rows).collect()}
    assert len(current) == 151 and current["https://a.com/7"].markdown == "text 1 of page 7"
    assert current["https://a.com/7"].page_id == 7 and current["https://a.com/none"].clean_text == ""
    # 150 URLs of the first part (50 of them twice), 100 of the second.
    assert rows.count() == 251
