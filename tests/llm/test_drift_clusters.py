import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegraph.llm import drift_clusters as clusters
from sitegraph.llm import queries


def plain(rows, k, rounds, dimensions, scale):
    """Every vector against every centroid in Python's own numbers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(p) for _, p in order[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(nearest(p)[1], []).append(p)
        for i, members in groups.items():
            centroids[i] = [sum(column) // len(members) for column in zip(*members)]
    found = [(i, *nearest(p)[::-1]) for i, p in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), names[c]) for i, c, d in found), key=str)


def got_rows(frame):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(9, 6)) * 2
    x = centres[draw.integers(0, 9, 900)] + draw.normal(size=(900, 6)) * 0.3
    out = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    # A third of all rows are one vector; a grid has many ties.
    out += [(2000 + i, out[5][1]) for i in range(450)] + [(3000 + i, [float(i % 3), float(i // 3 % 3), 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    return out + [(1, out[1][1]), (None, [0.5] * 6), (4000, None), (4001, []), (4002, [1.0] * 5), (4003, [None] + [1.0] * 5), (4004, [float("nan")] * 6), (4005, [float("-inf")] + [0.0] * 5)]


def test_clusters_are_those_of_all_comparisons(spark, rows):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cluster int").repartition(4)
    got = clusters.cluster_vectors(frame, k=12, rounds=5, dimensions=6)
    assert got_rows(got) == plain(rows, 12, 5, 6, 256)
    # The bounds spare most comparisons after the first round.
    assert got.agg(F.avg("n_scans")).first()[0] < 3.5


def test_few_and_no_vectors(spark, rows):
    few = [r for r in rows if r[0] in (3, 4, 2001, 2002)]
    schema = "vec_id long, embedding array<float>"
    assert got_rows(clusters.cluster_vectors(spark.createDataFrame(few, schema), k=12, dimensions=6)) == plain(few, 12, 5, 6, 256)
    assert clusters.cluster_vectors(spark.createDataFrame(rows[-4:], schema), dimensions=6).collect() == []
    one = clusters.cluster_vectors(spark.createDataFrame(few[:3], schema), k=1, dimensions=6)
    assert got_rows(one) == plain(few[:3], 1, 5, 6, 256)


def test_large_components(spark):
    draw = np.random.default_rng(2)
    values = draw.uniform(-500_000, 500_000, size=(60, 4)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(values)] + [(99, [6e5, 0.0, 0.0, 0.0]), (98, [1e300, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # Components of 2**27 / 256 or more are out of range.
    assert got_rows(clusters.cluster_vectors(frame, k=5, dimensions=4)) == plain(rows[:60], 5, 5, 4, 256)


def test_loosening_bounds_the_sphere_and_is_less_than_the_drift():
    draw = np.random.default_rng(3)
    for dimensions in (1, 2, 3, 16):
        old = draw.integers(-300, 300, size=(12, dimensions))
        new = old + draw.integers(-60, 60, size=old.shape)
        radius = draw.uniform(0, 200, 12)
        found = clusters.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        assert (found <= drift[None, :] + 1e-9).all()
        assert found.mean() < 0.8 * drift.mean()
        ways = draw.normal(size=(3000, dimensions))
        ways *= (draw.uniform(0, 1, 3000) ** 0.3 / np.sqrt((ways**2).sum(axis=1)))[:, None]
        for i in range(12):
            points = old[i] + ways * radius[i]
            before = np.sqrt(((points[:, None] - old[None]) ** 2).sum(axis=2))
            after = np.sqrt(((points[:, None] - new[None]) ** 2).sum(axis=2))
            assert ((before - after).max(axis=0) <= found[i] + 1e-9).all()


def test_query(spark):
    got = queries.op12_drift_clusters(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    source = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert got_rows(got) == plain(source, 40, 5, 64, 256)
