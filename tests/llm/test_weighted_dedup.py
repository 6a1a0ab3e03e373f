import math
import random
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from sitegraph.llm import weighted_dedup as wd


def prose(seed, n):
    draw = random.Random(seed)
    return [f"w{draw.randrange(3000)}" for _ in range(n)]


def edited(words, seed, share):
    draw = random.Random(seed)
    return [f"e{draw.randrange(10**6)}" if draw.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    texts = []
    for k in range(40):
        base = prose(k, 120 + 5 * k)
        texts += [base] + [edited(base, 100 * k + i, share) for i, share in enumerate((0.0, 0.005, 0.01, 0.02, 0.04, 0.1))]
    hot = prose(999, 300)
    texts += [edited(hot, 5000 + i, 0.004) for i in range(150)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, "three short words"), (9001, "Three, short words!"), (9002, "four other short words")]


def plain_classes(docs, threshold=wd.SIMILARITY):
    """Classes by the exact similarity of all pairs, with document frequencies per word."""
    words = {d: regex.findall(r"[\p{L}\p{M}\p{N}]+", t.lower()) for d, t in docs}
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: 1 + math.log((len(docs) + 1) / (n + 1)) / math.log(len(docs) + 2) for w, n in df.items()}
    sets = {}
    for d, ws in words.items():
        n = min(5, len(ws))
        counts = Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
        sets[d] = {s: c * sum(idf[w] for w in s) / n for s, c in counts.items()}
    parent = {d: d for d in words}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = []
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = sets[a].keys() & sets[b].keys()
            if shared:
                least = sum(min(sets[a][s], sets[b][s]) for s in shared)
                score = least / (sum(sets[a].values()) + sum(sets[b].values()) - least)
                near.append((a, b, score))
                if score >= threshold:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in words}, near


def test_classes_are_those_of_all_pairs(spark, corpus):
    frame = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in wd.near_duplicate_classes(frame).collect()}
    want, near = plain_classes(corpus)
    # Hashed frequencies may move a similarity by a hair; pairs right at the threshold are left open.
    close = {x for a, b, s in near if abs(s - wd.SIMILARITY) < 0.01 for x in (a, b)}
    parts = defaultdict(set)
    for d in want:
        parts[want[d]].add(d)
    for members in parts.values():
        if not members & close:
            assert len({got[d] for d in members}) == 1
    assert sum(got[d] != want[d] for d in want if d not in close) == 0


def test_one_of_each_class_stays(spark, corpus):
    frame = spark.createDataFrame(corpus, "doc_id long, text string")
    classes = wd.near_duplicate_classes(frame).collect()
    kept = wd.drop_near_duplicates(frame).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.class_id for r in classes})
    assert {r.doc_id for r in classes if r.kept} == {r.doc_id for r in kept}


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", 5), (2, "a b c d e f", 6), (1, "a b c d e f", 5), (None, None, 1), (None, "", 1), (7, "!!!", 1), (8, "xx yy", 2),
            (8, "xx yy", 2), (9, "XX, yy", 2), (None, "a b c d e f", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node int")
    kept = [(r.doc_id, r.text, r.node) for r in wd.drop_near_duplicates(frame).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a b c d e f", 9), (None, None, 1), (None, "", 1), (7, "!!!", 1), (8, "xx yy", 2)], key=str)
    empty = frame.where(F.lit(False))
    assert wd.drop_near_duplicates(empty).collect() == [] and wd.near_duplicate_classes(empty).collect() == []


def test_long_text(spark):
    words = prose(3, 200_000)
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-50])), (3, " ".join(words[:1000]))], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in wd.near_duplicate_classes(frame).collect()} == {1: 1, 2: 1, 3: 3}


def test_copies_with_edits_in_different_places_are_not_compared_pair_by_pair(spark, monkeypatch):
    base, docs = prose(77, 300), []
    for i in range(300):
        draw, words = random.Random(i), list(base)
        for at in draw.sample(range(300), 4):
            words[at] = f"e{draw.randrange(10**6)}"
        docs += [(2 * i, " ".join(words))] + [(2 * i + 1, " ".join(words[:-2]))] * (i % 10 == 0)
    made, write = {}, wd.write_stage

    def counted(df, name, *args, **kwargs):
        stored = write(df, name, *args, **kwargs)
        made.setdefault(name, []).append(stored.count() if name.startswith("other-") else 0)
        return stored

    monkeypatch.setattr(wd, "write_stage", counted)
    got = {r.doc_id: r.class_id for r in wd.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(made["other-pairs"]) <= 2 * sum(made["other-links"]) + 10 * len(docs)
    want, near = plain_classes(docs)
    close = {x for a, b, s in near if abs(s - wd.SIMILARITY) < 0.01 for x in (a, b)}
    assert sum(got[d] != want[d] for d in want if d not in close) == 0


def test_weights_of_parts():
    shingles = wd.mix(wd.np.arange(1, 500, dtype=wd.np.uint64))
    weights = wd.np.linspace(1, 2, len(shingles))
    at = wd.part_of(shingles)
    assert at.min() >= 0 and at.max() < wd.PARTS
    keys, nodes = wd.np.sort(shingles.view(wd.np.int64)), wd.np.zeros(len(shingles), wd.np.int64)
    rows = wd.pa.Table.from_batches(wd._rare_rows(keys, nodes, nodes, weights)).to_pylist()
    assert len({r["part"] for r in rows}) == len(rows) and all(r["a"] == 0 and r["rare"] == 0 for r in rows)
    sums = wd.np.bincount(wd.part_of(keys.view(wd.np.uint64)), weights, minlength=wd.PARTS)
    assert all(abs(r["own"] - sums[r["part"]]) < 1e-9 for r in rows)
