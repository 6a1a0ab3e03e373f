import random

import pytest
from pyspark.sql import functions as F

from sitegraph.llm import spaced_seeds as ss


def plain(docs, items):
    """Compares every window of every document with every window of every item."""
    out = set()
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            item = (item or "").lower().split()
            width = min(ss.WIDTH, len(item))
            if width < ss.SHORTEST:
                continue
            allowed = ss.SUBSTITUTIONS if width == ss.WIDTH else 0
            for q in range(len(item) - width + 1):
                for p in range(len(words) - width + 1):
                    if sum(x == y for x, y in zip(item[q : q + width], words[p : p + width])) >= width - allowed:
                        out.add((d, i))
    return out


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((13, 14, 20, 40, 12, 8, 5, 4, 1))] + [(90, None), (91, ""), (None, "p q r s t u")]
    docs = []
    for d in range(200):
        words = [word() for _ in range(30)]
        item = draw.choice(items[:9])[1].split()
        for _ in range(draw.randrange(5)):
            item[draw.randrange(len(item))] = "zz"
        at = draw.randrange(30)
        docs.append((d, " ".join(words[:at] + item + words[at:])))
    return docs + [(500, None), (501, ""), (502, "one"), (503, "x p Q r s t U x"), (None, items[0][1])], items


def test_leaks_are_those_of_all_windows(spark, tables):
    docs, items = tables
    got = ss.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item) for r in got.collect()} == plain(docs, items)


def test_masks_leave_no_two_substitutions_out():
    for a in range(ss.WIDTH):
        for b in range(ss.WIDTH):
            assert any(a not in mask and b not in mask for mask in ss.masks(ss.WIDTH))


def test_clean_documents_stay(spark, tables):
    docs, items = tables
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs + docs[:3]], "doc_id long, text string, item_id int, key string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    leaks = {d for d, _ in plain(docs, items)}
    kept = ss.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs + docs[:3] if d not in leaks)
    assert ss.drop_contaminated(frame, benchmark.where(F.lit(False))).count() == frame.count()
    assert ss.contaminated(frame.where(F.lit(False)), benchmark).count() == 0
