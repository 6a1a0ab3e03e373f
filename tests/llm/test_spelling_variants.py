import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegraph.llm import queries
from sitegraph.llm import spelling_variants as spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def got_rows(frame):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(9)
    letters = list("abcdeéß÷")
    stems = ["".join(draw.choice(letters, n)) for n in draw.integers(7, 13, 40).tolist()]
    texts = []
    for i in range(400):
        words = [stems[j] for j in (draw.pareto(0.7, 30).astype(int) % len(stems)).tolist()]
        for j in draw.integers(0, len(words), 6).tolist():
            w, at = words[j], int(draw.integers(0, len(words[j])))
            words[j] = [w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "y" + w[at + 1 :]][int(draw.integers(0, 3))]
        texts.append((i, " ".join(w.upper() if draw.random() < 0.1 and w.isascii() else w for w in words)))
    return texts + [(400, None), (401, ""), (402, "short words only"), (403, texts[0][1]), (403, texts[0][1]), (None, texts[1][1]), (404, "abcdefg1ABCDEFG_abcdefgh")]


def test_words_and_forms_are_those_of_all_pairs(spark, rows):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int").repartition(4)
    wanted = plain(plain_words(rows))
    for bucket in (64, 3):  # with small buckets, windows are cut down to single places
        assert got_rows(spelling.spelling_variants(frame, bucket=bucket)) == wanted
    assert sum(r[1] is not None for r in wanted) > 20 and max(r[4] for r in wanted) > 3


def test_pairs_of_one_hot_stem(spark):
    """A third of the words share one half; every bucket of theirs is larger than is compared."""
    hot = ["internat" + "".join(p) for p in product("abc", repeat=4)] + ["".join(p) + "ization" for p in product("abcd", repeat=3)]
    words = {w: i + 2 for i, w in enumerate([*hot, "internatx", "internataab", "aization", "internataabca"])}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    for bucket in (4, 20, 1000):
        got = sorted(tuple(sorted((r.word, r.other))) for r in spelling.near_pairs(frame, bucket).collect())
        assert got == sorted(tuple(sorted((a, b))) for a in words for b in words if a < b and one_edit(a, b))


def test_chains_of_forms(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "d")]
    got = spelling.last_forms(spark.createDataFrame(rows, "word string, form string")).collect()
    assert {(r.word, r.root) for r in got} == {("a", "d"), ("b", "d"), ("c", "d"), ("x", "d")}
    words = {"abcdefgh": 2, "abcdefgi": 30, "abcdefgijk": 9, "abcdefgij": 400, "zzzzzzzz": 5}
    texts = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items()) if zlib.crc32(f"{i}:{w}".encode()) % 31]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert got_rows(spelling.spelling_variants(frame)) == plain(plain_words(texts))


def test_very_long_words_and_empty_tables(spark):
    long = "abcdefghij" * 30_000
    texts = [(1, long + " " + long), (2, long[:150_000] + "x" + long[150_000:] + "." + long[:150_000] + "x" + long[150_000:]), (3, "lorem ipsum dolor " * 200_000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.n_near for r in spelling.spelling_variants(frame).collect()}
    assert got == {1}
    assert spelling.spelling_variants(frame.where(F.lit(False))).collect() == []
    assert spelling.spelling_variants(frame.where("doc_id = 3")).collect() == []


def test_query(spark):
    got = queries.op13_spelling_variants(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    words = plain_words([(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])
    rows = {r.word: r for r in got.collect()}
    assert {w: r.n for w, r in rows.items()} == words
    for w in sorted(words)[::20]:
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        assert rows[w].n_near == len(near) and rows[w].form == (best if best and words[best] >= 10 * words[w] else None)
