import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sitegraph.llm import queries
from sitegraph.llm.sql import oracle


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(2)
    item = " ".join(f"bench{i}" for i in range(30))
    rows = []
    for i in range(200):
        words = [f"{draw.choice(['der', 'die', 'und']) if i % 2 else draw.choice(['the', 'and', 'of'])}{draw.randrange(500)}" for _ in range(60)]
        rows.append((i, " ".join(words), "de" if i % 2 else "en", f"src{i % 3}", 1))
    rows += [(300, rows[0][1], "en", "s", 1), (301, rows[1][1] + " und", "de", "s", 1), (302, None, "en", "s", None), (303, "123", "en", None, 3),
             (304, rows[3][1] + " " + item, "de", "s", 1), (305, rows[4][1][:150] + " me@mail.org the end", "en", "s", 170)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert sorted(got) == [*range(200), 305]
    assert got[305].text == rows[-1][1].replace("me@mail.org", "[email]") and got[305].n_chars == len(got[305].text)
    assert all(got[i].text == rows[i][1] and got[i].lang == rows[i][2] for i in range(200))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(r.n_tokens == len(library.encode(r.text, add_special_tokens=False).ids) == len(r.token_ids) // 4 for r in got.values())


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    empty = docs.limit(0)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, empty, folder[0])
        assert result.columns == docs.columns and result.dtypes == docs.dtypes and result.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, folder[0]).columns[: len(docs.columns)] == docs.columns


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 11))
    assert set(oracle()) <= set(queries.QUERIES)
