import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegraph.llm import language as lg

SOUNDS = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "eng", "ß", "ter"], "zz": ["éa", "oui", "ç", "elle"]}


def text_of(label, seed, n=60):
    draw = random.Random(f"{label}{seed}")
    return " ".join("".join(draw.choices(SOUNDS[label], k=draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, text_of(label, i), label, "s", 7.0) for i, label in enumerate(random.Random(1).choices(list(SOUNDS), k=600))]
    rows += [(1000, None, "xx", "s", None), (1001, "", "xx", "s", None), (1002, "123 !!", "yy", "s", None), (None, text_of("zz", 5), "zz", None, None),
             (1003, text_of("yy", 9, 60_000), None, "s", None), (0, rows[0][1], rows[0][2], "s", 1.0), (1004, "e", None, "s", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")


def test_held_out_accuracy_and_odd_rows(frame):
    net = lg.fit(frame)
    rows = lg.identify(frame.withColumn("held_out", lg.held_out(F.col("doc_id"))), net).collect()
    assert len(rows) == 607 and len(rows[0]) == 6
    unseen = [r for r in rows if r.held_out and r.lang and r.doc_id < 1000]
    assert np.mean([r.lang == r.lang_pred for r in unseen]) > 0.97 and len(unseen) > 80
    odd = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert odd[1000] == odd[1001] == odd[1002] == ("und", 0.0)
    assert odd[1003][0] == "yy" and odd[None][0] == "zz" and odd[1004][0] in SOUNDS
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 0}) == 1


def test_windows_cover_every_run_of_bytes():
    text = "".join(random.Random(2).choices("abcdefgh", k=3 * lg.WINDOW + 17))
    windows, owner, sizes = lg.windows_of([text, "", "ab"])
    grams = {bytes(w[i : i + 4]) for w in windows[owner == 0] for i in range(lg.WINDOW - 3)}
    assert {text[i : i + 4].encode() for i in range(len(text) - 3)} <= grams
    assert (owner == 1).sum() == (owner == 2).sum() == 1 and sizes.min() >= 1


def test_tables_give_what_filters_give():
    draw = np.random.default_rng(0)
    windows = draw.integers(1, 256, (5, lg.WINDOW)).astype(np.uint8)
    net = lg.train(windows, np.array([0, 1, 0, 1, 1]), ["a", "b"], epochs=2)
    places = [net.embedding[windows[:, p : p + lg.WINDOW - lg.SPAN]] @ net.filters[p] for p in range(4)]
    pooled = np.maximum(sum(places).max(axis=1) + net.bias, 0)
    logits = np.exp(pooled @ net.dense + net.offset)
    assert np.allclose(net.probabilities(windows, net.tables()), logits / logits.sum(axis=1, keepdims=True), atol=1e-4)


def test_nothing_to_learn_from(spark, frame):
    assert lg.fit(frame.where(F.lit(False))) is None and lg.fit(frame.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in lg.identify(frame, None).collect()} == {"und"}
    kept = lg.drop_unidentified(frame)
    assert kept.columns == frame.columns and kept.count() == frame.count() - 3
    assert lg.drop_unidentified(frame.where(F.lit(False))).count() == 0


def test_unlabelled_documents_stay(spark, frame):
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    kept = lg.drop_unidentified(unlabelled)
    assert kept.columns == frame.columns and kept.count() == lg.drop_unidentified(frame).count() == frame.count() - 3
