import base64
import random

import public_tokenizers
import pytest
import tiktoken

from checks import queries as wired
from sitegraph.operators import chunks
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def encoding(ranks):
    pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})


def plain(encoding, text, size):
    """Grows a chunk token by token and remembers the last end at which its bytes are whole characters."""
    tokens = encoding.encode_ordinary(text)
    out, first = [], 0
    while first < len(tokens):
        good = None
        for end in range(first + 1, len(tokens) + 1):
            try:
                found = encoding.decode_bytes(tokens[first:end]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if good and end > first + size:
                break
            good = (end, found)
        first = good[0]
        out.append(good[1])
    return out


def test_chunks_never_cut_a_character(spark, ranks, encoding):
    draw = random.Random(3)
    pieces = ["word ", "\U0001f9ec", "日本語", "é", "\n\n", "\U0001f3f3\ufe0f", "ꙮ", "x" * 30]
    texts = ["".join(draw.choices(pieces, k=draw.randint(1, 60))) for _ in range(120)] + ["", None, "\U0001f9ec" * 400]
    frame = spark.createDataFrame(list(enumerate(texts)), "url long, clean_text string")
    for size in (1, 2, 5, 50):
        chunker = chunks.rank_file_chunker(ranks, public_tokenizers.PATTERN)
        rows = frame.select("url", chunker(F.col("clean_text"), size).alias("parts")).collect()
        assert {r.url: r.parts for r in rows} == {i: plain(encoding, t or "", size) for i, t in enumerate(texts)}
        assert all("".join(r.parts) == (texts[r.url] or "") for r in rows)


def test_query(spark, encoding):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in wired.chunk_tokens(spark, SF).orderBy("page_url", "chunk_index").collect():
        assert r.chunk_index == len(got.setdefault(int(r.page_url.rsplit("/", 1)[1]), []))
        got[int(r.page_url.rsplit("/", 1)[1])].append(r.text)
    assert got == {i: [c.strip() for c in plain(encoding, t or "", 500) if c.strip()] for i, t in texts.items() if (t or "").strip()}
