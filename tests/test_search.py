import hashlib
import re
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from sitegraph import session
from sitegraph.functions import text, vectors
from sitegraph.operators import cells as learnt
from sitegraph.operators import chunks, search


def cosine_hits(queries, pages, k):
    """Brute force: {query: [(page, score)]}; ``pages`` is [(page_id, chunk_index, vector)]."""
    hits = {}
    for qid, q in queries:
        best = {}
        for pid, chunk, v in pages:
            score = round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 9)
            if pid not in best or (-score, chunk) < best[pid]:
                best[pid] = (-score, chunk)
        ranked = sorted((s, pid, c) for pid, (s, c) in best.items())[:k]
        hits[qid] = [(pid, c, round(-s, 6)) for s, pid, c in ranked]
    return hits


def made(n, copies=0, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, 0, rng.normal(size=8).tolist()) for i in range(n)]
    # A third of all rows are copies of one vector: ranks inside them go by id.
    return rows + [(n + i, 0, rows[0][2]) for i in range(copies)]


def as_pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, chunk_index int, vec array<double>")
    return df.withColumn("page_vector", F.col("vec")).repartition(7)


def as_queries(spark, rows):
    return spark.createDataFrame([(i, v) for i, _, v in rows], "query_id long, query_vector array<double>")


def collected(df, chunk=False):
    hits = {}
    for r in df.orderBy("query_id", "rank").collect():
        hits.setdefault(r.query_id, []).append((r.page_id, r.chunk_index if chunk else 0, round(r.score, 6)))
    return hits


@pytest.mark.parametrize("block_values", [4_000_000, 40])
def test_batch_equals_brute_force(spark, monkeypatch, block_values):
    monkeypatch.setattr(search, "BLOCK_VALUES", block_values)  # 40: several blocks of queries and of vectors
    monkeypatch.setattr(search, "BROADCAST_VALUES", min(block_values, search.BROADCAST_VALUES))
    rows = made(60, copies=30)
    found = collected(search.search_batch(as_queries(spark, rows[:12]), as_pages(spark, rows), 5))
    assert found == cosine_hits([(i, v) for i, _, v in rows[:12]], rows, 5)


def test_small_steps_equal_large_ones(spark, monkeypatch):
    monkeypatch.setattr(search, "STEP_SCORES", 30)
    rows = made(80, copies=40, seed=3)
    found = collected(search.search_batch(as_queries(spark, rows[:10]), as_pages(spark, rows), 4))
    assert found == cosine_hits([(i, v) for i, _, v in rows[:10]], rows, 4)


def test_chunks_give_each_page_once(spark):
    rng = np.random.default_rng(1)
    rows = [(0, c, rng.normal(size=8).tolist()) for c in range(50)]  # one page holds half of all chunks
    rows += [(p, c, rng.normal(size=8).tolist()) for p in range(1, 11) for c in range(5)]
    rows.append((0, 50, rows[3][2]))  # an equal chunk: the first one counts
    queries = rows[3:9]
    found = collected(search.search_chunks(as_queries(spark, [(i, 0, q[2]) for i, q in enumerate(queries)]), as_pages(spark, rows), 4), True)
    assert found == cosine_hits([(i, q[2]) for i, q in enumerate(queries)], rows, 4)


def test_null_vectors_and_no_queries(spark):
    rows = made(10)
    pages = as_pages(spark, rows).unionByName(as_pages(spark, [(99, 0, None)]))
    assert len(collected(search.search_batch(as_queries(spark, rows[:1]), pages, 50))[0]) == 10
    assert search.search_batch(as_queries(spark, rows).filter("false"), pages).collect() == []


def test_approximate_search(spark, tmp_path, capsys):
    rows = made(200)
    queries, pages = as_queries(spark, rows), as_pages(spark, rows)
    all_cells = search.Cells(bits=6, radius=6)
    assert collected(search.search_approx(queries, pages, 3, all_cells)) == collected(search.search_batch(queries, pages, 3))

    cells = search.Cells(bits=6, radius=2)
    search.write_index(pages, str(tmp_path / "index"), cells)
    index = spark.read.parquet(str(tmp_path / "index"))
    near = search.search_approx(queries, index, 3, cells)
    assert collected(near) == collected(search.search_approx(queries, pages, 3, cells))
    report = search.recall(near, search.search_batch(queries, pages, 3)).first()
    assert report.exact_hits == 600 and 0.5 < report.recall < 1
    # Only partitions of probed cells are read.
    one = search.search_approx(queries.filter("query_id = 0"), index, 3, search.Cells(bits=6, radius=0))
    one.explain()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", capsys.readouterr().out)


def test_many_queries_meet_the_vectors_in_the_tasks(spark, monkeypatch, tmp_path):
    """Beyond one block no query comes to the driver, and the plan does not grow with the number of blocks."""
    rows = made(90, copies=60, seed=4)
    queries, pages = as_queries(spark, rows[:40]), as_pages(spark, rows)
    monkeypatch.setattr(search, "BROADCAST_VALUES", 0)
    plans = []
    for block_values in (10_000, 24):
        monkeypatch.setattr(search, "BLOCK_VALUES", block_values)
        found = search.search_batch(queries, pages, 5)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        assert collected(found) == cosine_hits([(i, v) for i, _, v in rows[:40]], rows, 5)
    assert all(plan.count("FlatMapCoGroupsInArrow") == 1 and "Union" not in plan for plan in plans)
    cells = search.Cells(bits=5, radius=2)
    search.write_index(pages, str(tmp_path / "index"), cells)
    near = collected(search.search_approx(queries, spark.read.parquet(str(tmp_path / "index")), 3, cells))
    assert near == collected(search.search_approx(queries, pages, 3, cells))
    monkeypatch.setattr(search, "BROADCAST_VALUES", 1_000_000)
    assert near == collected(search.search_approx(queries, pages, 3, cells))


def test_a_stored_index_is_searched_by_blocks(spark, monkeypatch, tmp_path):
    """The cells of a stored index are read as another type than those of the queries: what is near must still meet where partitions stay apart."""
    rows = made(300, copies=10, seed=6)
    queries, pages = as_queries(spark, rows), as_pages(spark, rows)
    cells = search.Cells(bits=5, radius=2)
    search.write_index(pages, str(tmp_path / "index"), cells)
    index = spark.read.parquet(str(tmp_path / "index"))
    wanted = collected(search.search_approx(queries, index, 3, cells))
    monkeypatch.setattr(search, "BROADCAST_VALUES", 0)
    monkeypatch.setattr(search, "BLOCK_VALUES", 1200)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert collected(search.search_approx(queries, index, 3, cells)) == wanted
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hits_order_only_what_may_be_new():
    """Of equal scores at the floor only smaller pages go in, and each page counts once: as a plain search finds it."""
    rng = np.random.default_rng(5)
    block = search.unit_rows(np.vstack([rng.integers(0, 3, (40, 6)).astype(float), np.zeros((2, 6))]))
    found = search.unit_rows(rng.integers(0, 3, (900, 6)).astype(float))
    pages, parts = rng.permutation(np.arange(900) // 3), np.arange(900) % 7
    hits, taken = search._Hits(block, 4), []
    monitored = hits._take
    hits._take = lambda q, *rest: (taken.append(len(q)), monitored(q, *rest))
    for at in range(0, 900, 100):
        hits.add(np.arange(42), pages[at : at + 100], parts[at : at + 100], found[at : at + 100])
    exact = np.round(block @ found.T, search.ORDER_DIGITS)
    got = list(zip(*(c.to_pylist() for c in hits.rows(np.arange(42)))))
    for query in range(42):
        best = {}
        for page, chunk, score in zip(pages.tolist(), parts.tolist(), exact[query].tolist()):
            best[page] = min(best.get(page, (9.0, 0)), (-score, chunk))
        wanted = sorted((score, page, chunk) for page, (score, chunk) in best.items())[:4]
        assert [(-place, page, chunk) for q, page, chunk, _, place in got if q == query] == wanted
    assert sum(taken) < 42 * 900


def test_words_are_hashed_many_at_a_time(monkeypatch):
    """The buckets are those of MD5 for words of any length, and words are those of ``str.split``."""
    rng = np.random.default_rng(11)
    letters = list("abcé日z")
    words = ["".join(rng.choice(letters, n)) for n in list(range(1, 70)) * 5]
    bucket = lambda word: int.from_bytes(hashlib.md5(word.encode()).digest()[:4]) % 64
    assert vectors.word_places(pa.array(words).slice(3), 64).tolist() == [bucket(word) for word in words[3:]]
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 60, 40)] + [None, "", "".join(blanks), *(f"{b}a{b}{b}b" for b in blanks)]
    monkeypatch.setattr(vectors, "ENCODED_BYTES", 500)
    called = []
    monkeypatch.setattr(vectors.hashlib, "md5", lambda *x, md5=hashlib.md5: (called.append(1), md5(*x))[1])
    found = next(iter(vectors.hash_encoder().func(iter([pa.array(texts)])))).to_pylist()
    assert len(called) < sum(len(word.encode()) > 55 for text in texts for word in (text or "").split()) + 1
    for text, got in zip(texts, found):
        counts = np.bincount([bucket(word) for word in (text or "").split()], minlength=64)
        assert got is None if text is None else np.allclose(got, counts / max(1e-9, np.linalg.norm(counts)))


def test_candidates_wait_for_each_other():
    """The best are ordered again once a query has some candidates on the mean, not after every step of a task."""
    rng = np.random.default_rng(8)
    block, found = (search.unit_rows(rng.normal(size=(n, 8))) for n in (200, 6000))
    pages, calls = rng.permutation(6000) // 2, []
    hits = search._Hits(block, 5)
    monitored, whole = hits._take, search.STEP_SCORES
    hits._take = lambda *rows: (calls.append(1), monitored(*rows))
    search.STEP_SCORES = 4000  # 20 vectors and 200 queries
    try:
        hits.add(np.arange(200), pages, np.arange(6000) % 2, found)
    finally:
        search.STEP_SCORES = whole
    got = hits.rows(np.arange(200))
    exact = np.round(block @ found.T, search.ORDER_DIGITS)
    for query in range(200):
        best = {}
        for page, score in zip(pages.tolist(), exact[query].tolist()):
            best[page] = max(best.get(page, -9.0), score)
        wanted = sorted((-score, page) for page, score in best.items())[:5]
        assert [(-place, page) for q, page, _, _, place in zip(*(c.to_pylist() for c in got)) if q == query] == wanted
    assert len(calls) < 50  # of 300 steps


def test_vectors_are_written_once_for_a_large_block_of_queries(spark, monkeypatch):
    """Each side is written once for every block of the other: vectors in single precision are cut into a fourth of the blocks."""
    rows, stages, written = made(500, copies=100, seed=9), {}, search.write_stage
    monkeypatch.setattr(search, "write_stage", lambda df, name, *rest: stages.setdefault(name, written(df, name, *rest)))
    vectors = as_pages(spark, rows).selectExpr("page_id", "0L AS chunk_index", "CAST(page_vector AS array<float>) AS v", "0 AS cell")
    queries = as_queries(spark, rows[:100]).selectExpr("query_id", "query_vector", "0 AS cell")
    dim = len(rows[0][2])
    found = search.rank_hits(search.block_search(queries, vectors, 4, block_values=50 * dim), 4)
    sizes = stages["cell-sizes"].first()
    n = vectors.count()
    assert sizes.q_blocks == 2 and sizes.v_blocks == -(-n // 200)
    wanted = cosine_hits([(i, v) for i, _, v in rows[:100]], [(p, c, np.float32(v).astype(float).tolist()) for p, c, v in rows], 4)
    pages_of = lambda hits: {query: [page for page, _, _ in ranked] for query, ranked in hits.items()}
    assert pages_of(collected(found)) == pages_of(wanted)


def test_report_rows_shuffle_no_whole_texts(spark, monkeypatch):
    """Where the hits are too many to broadcast, texts are cut before the join."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame([(i, f"https://a.org/{i}", f"{i} " * 2000) for i in range(20)], "page_id long, url string, clean_text string")
    hits = spark.createDataFrame([(7, 1, 3, 0.5), (7, 2, 4, 0.25), (8, 1, 3, 0.75)], "query_id long, rank int, page_id long, score double")
    report = search.format_hits(hits, pages)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("substring(clean_text")
    assert sorted((r.query_id, r.rank, r.title, len(r.snippet), r.total) for r in report.collect()) == [(7, 1, "3", 300, 2), (7, 2, "4", 300, 2), (8, 1, "3", 300, 1)]


def clustered(n, centres, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 8)) * 3
    return [(i, 0, (middle[i % centres] + rng.normal(size=8)).tolist()) for i in range(n)]


def plain_cells(rows, k, rounds):
    """k-means in whole numbers over all rows, each against each centroid."""
    points = {i: np.floor(np.array(v) / np.linalg.norm(v) * learnt.SCALE).astype(int) for i, _, v in rows}
    order = sorted(points, key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i))
    centroids = [points[i] for i in order[:k]]
    for _ in range(rounds):
        groups = {}
        for p in points.values():
            groups.setdefault(int(np.argmin([((p - c) ** 2).sum() for c in centroids])), []).append(p)
        for c, members in groups.items():
            centroids[c] = np.sum(members, axis=0) // len(members)
    return np.array(centroids)


def test_learnt_cells_are_those_of_a_plain_run(spark):
    rows = clustered(150, 9)
    got = learnt.train_cells(as_pages(spark, rows), cells=12, rounds=4)
    assert (got.centroids.astype(int) == plain_cells(rows, 12, 4)).all()


def test_search_by_learnt_cells(spark, tmp_path, monkeypatch):
    rows = clustered(600, 20, seed=2)
    # A third of all rows are one vector, and some have no direction.
    rows += [(1000 + i, 0, rows[7][2]) for i in range(300)] + [(2000, 0, None), (2001, 0, [0.0] * 8), (2002, 0, [float("nan")] * 8)]
    pages, queries = as_pages(spark, rows), as_queries(spark, rows[:100])
    learnt.write_cell_index(pages, str(tmp_path / "index"))
    index = learnt.read_cell_index(spark, str(tmp_path / "index"))
    assert len(index.cells.centroids) == round(3 * 900**0.5) and index.lists.count() == 2 * 900
    usable = [r for r in rows if r[0] < 2000]
    exact = cosine_hits([(i, v) for i, _, v in rows[:100]], usable, 5)
    every = learnt.search_cells(queries, index, 5, probes=len(index.cells.centroids))
    assert collected(every) == exact
    monkeypatch.setattr(search, "BLOCK_VALUES", 160)  # the hot cell is cut into blocks of 20 vectors
    near = collected(learnt.search_cells(queries, index, 5))
    found = sum(len({h[0] for h in near.get(i, [])} & {h[0] for h in exact[i]}) for i in exact)
    assert found / (5 * len(exact)) > 0.9
    pairs = learnt.compared_pairs(queries, index).first()[0]
    assert pairs < 0.25 * 100 * 900
    none = spark.createDataFrame([(1, [0.0] * 8)], "query_id long, query_vector array<double>")
    assert learnt.search_cells(none, index, 5).collect() == []
    with pytest.raises(ValueError, match="no vector"):
        learnt.train_cells(pages.where("page_id >= 2000"))


def test_a_sample_trains_the_cells(spark, monkeypatch):
    monkeypatch.setattr(learnt, "SAMPLE_PER_CELL", 8)
    rows = clustered(2000, 10, seed=5)
    few = learnt.train_cells(as_pages(spark, rows), cells=10)
    share = 10 * 8 / 2000
    kept = [r for r in rows if int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16) / 2**32 <= share]
    assert 30 < len(kept) < 150 and (few.centroids.astype(int) == plain_cells(kept, 10, learnt.ROUNDS)).all()


def test_format_hits(spark):
    pages = spark.createDataFrame([(1, "https://a.com/x/title", "t" * 400), (2, "https://a.com/", "s")], "page_id long, url string, clean_text string")
    hits = spark.createDataFrame([(7, 1, 1, 0.98765), (7, 2, 2, 0.5)], "query_id long, rank int, page_id long, score double")
    rows = [tuple(r) for r in search.format_hits(hits, pages).orderBy("rank").collect()]
    assert rows == [(7, 1, "https://a.com/x/title", "title", "t" * 300, 0.988, 2), (7, 2, "https://a.com/", "https://a.com/", "s", 0.5, 2)]


def test_chunks_rebuild_the_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = docs.select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("clean_text"))
    parts = {}
    for r in chunks.chunk_pages(pages, 30).orderBy("page_url", "chunk_index").collect():
        assert r.chunk_index == len(parts.setdefault(r.page_url, []))
        parts[r.page_url].append(r.text)
    for r in pages.collect():
        tokens = r.clean_text.split()
        assert parts.get(r.url, []) == [" ".join(tokens[i : i + 30]) for i in range(0, len(tokens), 30)]


def byte_tokenizer():
    return tiktoken.Encoding(
        "bytes", pat_str=r"[\s\S]", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}
    )


def test_tokenizer_chunker(spark):
    df = spark.createDataFrame([("u", "ab      cd"), ("v", "é!"), ("w", ""), ("x", "     ")], "url string, clean_text string")
    rows = chunks.chunk_pages(df, 3, chunks.tokenizer_chunker(byte_tokenizer)).collect()
    assert sorted((r.page_url, r.chunk_index, r.text) for r in rows) == [
        ("u", 0, "ab"), ("u", 1, "c"), ("u", 2, "d"), ("v", 0, "é!"),
    ]


def test_encoders(spark):
    df = spark.createDataFrame([("a b a c",), ("",), ("a b a\nc",)], "t string")
    rows = [r.v for r in df.select(vectors.hash_encoder(8)(F.col("t")).alias("v")).collect()]
    assert rows[0] == rows[2] and np.isclose(np.linalg.norm(rows[0]), 1) and rows[1] == [0.0] * 8

    lengths = vectors.model_encoder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), batch_size=2)
    got = [r.v for r in df.select(lengths(F.col("t")).alias("v")).collect()]
    assert np.allclose(got, [np.array([n, 1.0]) / np.hypot(n, 1) for n in (7, 0, 7)])

    with_null = spark.createDataFrame([("ab",), (None,)], "t string").coalesce(1)
    assert [r.v is None for r in with_null.select(lengths(F.col("t")).alias("v")).collect()] == [False, True]
    assert with_null.filter("t is null").select(lengths(F.col("t")).alias("v")).first().v is None


def test_encoder_looks_each_word_up(spark):
    """One look-up per token in Arrow batches; the blanks are those of ``text.words``, and vectors those of a plain count."""
    blanks = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    texts = [None, "", blanks, blanks.join(["a", "b", "a\u200bc", "é😀", "\ufeff"]), " ".join(str(i % 97) for i in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    made = df.select("i", vectors.hash_encoder(16)(F.col("t")).alias("v"), text.words(F.col("t")).alias("words"))
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    for row in made.collect():
        if texts[row.i] is None:
            assert row.v is None
            continue
        counts = np.zeros(16)
        for word in row.words:
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
        assert row.words == texts[row.i].split() and row.v == (counts / (np.linalg.norm(counts) or 1.0)).tolist()


def test_mean_and_unit_vectors(spark):
    df = spark.createDataFrame([("p", 0, [0.1, 0.2]), ("p", 1, [0.3, 0.4]), ("p", 2, [0.5, 0.6])], "page_url string, chunk_index int, vec array<float>")
    row = chunks.mean_page_vectors(df).first()
    assert np.allclose(row.page_vector, [0.3, 0.4]) and row.n_chunks == 3
    rows = chunks.unit_vectors(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "vec array<float>")).collect()
    assert [(r.vec, r.is_zero) for r in rows] == [([0.6, 0.8], False), ([0.0, 0.0], True)]


def test_chunk_store_and_lookup(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "page_url string, chunk_index int, text string")
    new = spark.createDataFrame([("a", 0, "n"), ("c", 0, "m")], "page_url string, chunk_index int, text string")
    assert {tuple(r) for r in chunks.replace_chunks(old, new).collect()} == {("a", 0, "n"), ("b", 0, "z"), ("c", 0, "m")}
    found = chunks.lookup_pages(
        spark.createDataFrame([("a",), ("a",), ("x",)], "url string"), spark.createDataFrame([("a", 1), ("b", 2)], "url string, page_id long")
    )
    assert sorted(map(tuple, found.collect())) == [("a", 1, True), ("x", None, False)]


def test_one_vector_per_page(spark):
    pages = spark.createDataFrame([("a", [0.0], None), ("b", [1.0], None)], "url string, page_vector array<float>, embedded_at timestamp")
    day = [datetime(2024, 1, d) for d in (1, 2)]
    vectors = spark.createDataFrame([("a", [2.0], day[0]), ("a", [3.0], day[1]), ("c", [4.0], day[0])], "url string, page_vector array<float>, embedded_at timestamp")
    got = {r.url: (r.page_vector, r.embedded_at) for r in chunks.attach_page_vectors(pages, vectors).collect()}
    assert got == {"a": ([3.0], day[1]), "b": ([1.0], None)}


def test_unusable_queries_and_vectors(spark, tmp_path):
    pages = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "page_id long, page_vector array<double>")
    for rows in ([(1, None)], [(None, [1.0, 0.0])], [(1, [1.0]), (2, [1.0, 0.0])]):
        with pytest.raises(ValueError):
            search.search_batch(spark.createDataFrame(rows, "query_id long, query_vector array<double>"), pages)
    search.write_index(pages, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 1


def test_vectors_that_are_null_set_nothing(spark):
    pages = spark.createDataFrame([("u", [1.0], datetime(2024, 1, 1))], "url string, page_vector array<float>, embedded_at timestamp")
    rows = spark.createDataFrame([("u", [2.0], datetime(2024, 2, 1)), ("u", None, datetime(2024, 3, 1))], "url string, page_vector array<float>, embedded_at timestamp")
    assert [tuple(r) for r in chunks.attach_page_vectors(pages, rows).collect()] == [("u", [2.0], datetime(2024, 2, 1))]
    nothing = chunks.attach_page_vectors(pages, rows.where("page_vector IS NULL")).collect()
    assert [tuple(r) for r in nothing] == [("u", [1.0], datetime(2024, 1, 1))]
