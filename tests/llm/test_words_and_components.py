import random

import numpy as np
import regex
from pyspark.sql import functions as F

from sitegraph.llm.components import connected_components
from sitegraph.llm.words import WordHasher


def test_word_hashes_name_words():
    texts = ["One two, TWO three", None, "", "été-été Été", "!!!", "a1 b2\na1", "x" * 3_000_000 + " y", "中文 «中文»"]
    seen: dict[int, str] = {}
    for text, hashes in zip(texts, WordHasher().each(texts)):
        words = regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())
        assert len(words) == len(hashes)
        for word, value in zip(words, hashes.tolist()):
            assert seen.setdefault(value, word) == word
    assert len(set(seen.values())) == len(seen)


def test_blocks_do_not_change_hashes():
    texts = [" ".join(random.Random(i).choices(["alpha", "beta", "gamma", "ünï"], k=i)) for i in range(50)]
    together = list(WordHasher().each(texts))
    apart = [next(WordHasher().each([t])) for t in texts]
    assert all((a == b).all() for a, b in zip(together, apart))


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000 + i) for i in range(200)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(links + [(None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {x: find(x) for x in parent if any(x in link and link[0] != link[1] for link in links)}
    assert connected_components(frame.where(F.lit(False))).count() == 0
