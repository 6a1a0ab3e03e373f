import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegraph.llm import nn_descent


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(8)
    base = draw.normal(size=(700, 24))
    near = base[draw.integers(0, 700, 300)] + draw.normal(size=(300, 24)) * 0.08
    hot = draw.normal(size=24) + draw.normal(size=(400, 24)) * 0.05
    x = np.concatenate([base, near, hot, base[:20] * 3.0]).astype(np.float32)
    labels = np.concatenate([np.arange(700) % 3, draw.integers(0, 3, 300), np.zeros(400), np.arange(20) % 3]).astype(int)
    rows = [(int(i), v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, labels))]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] + [0.0] * 23]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(3000, rows[0][1], None), (3001, rows[0][1], None)]
    rows += [(4000, [1.0, 2.0], 1), (4001, [2.0, 4.0], 1), (4001, [2.0, 4.0], 1), (None, [1.0, 2.0], 1)]
    return rows


def plain(rows):
    n = len(rows)
    usable = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, _ in rows]
    links = [[] for _ in rows]
    units = [np.array(v, dtype=float) / np.linalg.norm(v) if ok else None for (_, v, _), ok in zip(rows, usable)]
    groups = {}
    for i, (_, v, label) in enumerate(rows):
        if usable[i] and label is not None:
            groups.setdefault((label, len(v)), []).append(i)
    for members in groups.values():
        x = np.stack([units[i] for i in members])
        for a, b in zip(*np.nonzero(x @ x.T >= nn_descent.COSINE)):
            if a != b:
                links[members[a]].append(members[b])
    component = list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component[i] = min(ids) if ids else None
    return sorted(((rows[i][0], len(links[i]), component[i], rows[i][0] == component[i]) for i in range(n)), key=str)


def test_links_are_those_of_all_pairs(spark, vectors):
    frame = spark.createDataFrame([(*r, 0) for r in vectors], "vec_id long, embedding array<float>, label int, n_links int").repartition(4)
    got = nn_descent.embedding_duplicates(frame).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == plain(vectors)
    assert got[0].audit_recall >= nn_descent.RECALL


def test_tables_without_links(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    assert nn_descent.embedding_duplicates(frame.where(F.lit(False))).collect() == []
    got = nn_descent.embedding_duplicates(frame.where("vec_id BETWEEN 2000 AND 3001")).collect()
    assert {(r.n_links, r.kept) for r in got} == {(0, True)} and len(got) == 8


def test_links_between_dense_clusters(spark):
    draw = np.random.default_rng(5)
    a, other = np.linalg.qr(draw.normal(size=(24, 2)))[0].T
    b = 0.985 * a + np.sqrt(1 - 0.985**2) * other
    x = np.concatenate([c + draw.normal(size=(90, 24)) * 1e-4 for c in (a, b)] + [np.tile(a, (60, 1)), np.tile(b, (60, 1)), draw.normal(size=(200, 24))])
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = nn_descent.embedding_duplicates(frame).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == plain(rows)
    assert sum(r.n_links == 299 for r in got) == 300


def units_of(x):
    return [(int(i), 7, (v / np.linalg.norm(v)).tobytes()) for i, v in enumerate(x)]


def test_audit_sees_small_groups_beside_a_hot_one(spark):
    draw = np.random.default_rng(6)
    pairs = np.repeat(draw.normal(size=(30, 24)), 2, axis=0) + draw.normal(size=(60, 24)) * 1e-3
    x = np.concatenate([draw.normal(size=24) + draw.normal(size=(300, 24)) * 1e-3, pairs])
    vectors = spark.createDataFrame(units_of(x), "row long, g long, unit binary").repartition(3)
    whole = vectors.select("row", F.when(F.col("row") < 300, 0).otherwise(F.col("row") - F.col("row") % 2).cast("long").alias("c"))
    lost = vectors.select("row", F.when(F.col("row") < 300, 0).otherwise(F.col("row")).cast("long").alias("c"))
    assert nn_descent.audited_recall(vectors, whole, nn_descent.COSINE) == 1.0
    assert nn_descent.audited_recall(vectors, lost, nn_descent.COSINE) == 0.0


def test_low_recall_fails_the_run(spark, vectors, monkeypatch):
    monkeypatch.setattr(nn_descent, "audited_recall", lambda *_: 0.5)
    monkeypatch.setattr(nn_descent, "PATIENCE", 1)
    frame = spark.createDataFrame(vectors[:40], "vec_id long, embedding array<float>, label int")
    with pytest.raises(RuntimeError, match="recall"):
        nn_descent.embedding_duplicates(frame)


@pytest.mark.parametrize("spread", [0.005, 0.014, 0.03])
def test_blocks_are_cut_by_angle(spark, monkeypatch, spread):
    """Small blocks: some are linked as a whole, some are too far apart, some are compared."""
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    draw = np.random.default_rng(3)
    line = np.linspace(0, 1.2, 300)[:, None]
    start, end = np.linalg.qr(draw.normal(size=(24, 2)))[0].T
    x = np.cos(line) * start + np.sin(line) * end + draw.normal(size=(300, 24)) * spread
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    copies = draw.integers(1, 4, 300)
    vectors = spark.createDataFrame([(*row, int(n)) for row, n in zip(units_of(x), copies)], "row long, g long, unit binary, copies long").repartition(3)
    groups = vectors.select(F.col("row").alias("node"), F.lit(0).cast("long").alias("component"))
    parts = nn_descent.exact_links(vectors, groups, nn_descent.COSINE).collect()
    linked = x @ x.T >= nn_descent.COSINE
    np.fill_diagonal(linked, False)
    got, near = np.zeros(300, dtype=int), list(range(300))

    def top(i):
        while near[i] != i:
            i = near[i]
        return i

    for part in parts:
        got[part.row] += part.n_links
        near[max(top(part.row), top(part.root))] = min(top(part.row), top(part.root))
    assert (got == linked @ copies).all()
    reach = np.linalg.matrix_power(np.eye(300) + linked > 0, 1)
    while True:
        wider = (reach.astype(float) @ reach) > 0
        if (wider == reach).all():
            break
        reach = wider
    assert [top(i) for i in range(300)] == reach.argmax(axis=1).tolist()


def test_a_dense_group_is_counted_without_comparing_all_blocks(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=24) + draw.normal(size=(20_000, 24)) * 0.01
    vectors = spark.createDataFrame([(*row, 1) for row in units_of(x)], "row long, g long, unit binary, copies long").repartition(4)
    groups = vectors.select(F.col("row").alias("node"), F.lit(0).cast("long").alias("component"))
    parts = nn_descent.exact_links(vectors, groups, nn_descent.COSINE)
    rows = parts.groupBy("row").agg(F.sum("n_links").alias("n")).agg(F.count("*"), F.min("n"), F.max("n")).first()
    assert tuple(rows) == (20_000, 19_999, 19_999)
    # One row per vector and one per pair of blocks: nothing was compared, so no vector was written again.
    assert parts.count() <= 20_000 + 21 * 21


def test_groups_without_a_fresh_member_are_not_compared_again(spark):
    rows = [(1, i, False) for i in range(5)] + [(2, i, i == 3) for i in range(6)] + [(3, i, False) for i in range(3 * nn_descent.GROUP)]
    members = spark.createDataFrame(rows, "u long, row long, fresh boolean").repartition(3)
    kept = nn_descent.salted(members).groupBy("u").agg(F.count("*").alias("n"), F.count_distinct("salt").alias("parts")).collect()
    # The third group is cut, and its parts may be others than before.
    assert sorted(tuple(r) for r in kept) == [(2, 6, 1), (3, 3 * nn_descent.GROUP, 3)]
    found = spark.createDataFrame([(1, 2, 0.5, False), (1, 3, 0.75, False)], "src long, dst long, sim double, own boolean")
    lists = nn_descent.merged_lists(spark.createDataFrame([(1, 2, 0.5, False)], found.schema), found)
    assert sorted((r.dst, r.fresh) for r in lists.collect()) == [(2, False), (3, True)]


def test_groups_are_compared_as_one_by_one(spark, monkeypatch):
    """Groups of all sizes and of rows of two lengths, over several batches: the best of each row that beat its bounds."""
    draw = np.random.default_rng(12)
    rows, number = [], 0
    for u in range(120):
        for _ in range(int(draw.integers(1, 40))):
            size = 8 if u % 9 or draw.random() < 0.5 else 12
            q = draw.integers(-127, 128, size).astype(np.int8)
            bounds = [float(x) for x in draw.choice([-2.0, 0.0, 0.4], 2)]
            rows.append((u, 0, number, int(u % 7 == 0 and draw.integers(0, 2)), q.tobytes(), int(draw.integers(0, 3)), *bounds))
            number += 1
    names = "u long, salt int, row long, g long, q binary, c long, worst_own double, worst_other double"
    monkeypatch.setattr(nn_descent, "STEP_VALUES", 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = nn_descent.best_of_groups(spark.createDataFrame(rows, names)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    got = {(r.src, r.dst, r.own): r.sim for r in found}
    wanted = {}
    for u, _, row, g, q, c, *bounds in rows:
        x = np.frombuffer(q, np.int8).astype(float)
        for own in (True, False):
            near = []
            for other in rows[:]:
                y = np.frombuffer(other[4], np.int8).astype(float)
                if other[0] == u and other[2] != row and other[3] == g and len(y) == len(x) and (other[5] == c) == own:
                    near.append((-(x @ y) / np.sqrt(x @ x) / np.sqrt(y @ y), other[2]))
            for sim, other in sorted(near)[: nn_descent.NEIGHBOURS]:
                if -sim > max(bounds[not own], -1.5):
                    wanted[row, other, own] = -sim
    assert len(found) == len(got) and got.keys() == wanted.keys()
    assert all(abs(got[key] - wanted[key]) < 1e-6 for key in wanted)
