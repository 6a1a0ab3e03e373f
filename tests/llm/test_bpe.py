import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegraph.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "e", "th", "ing", " ", "é", "Σ", "İ", "<|endoftext|>", "'s", "'", "1", "²", "\x1c", "\x85", "中", "😀", "́", "ﬁ", "A", "!", "\n", "er"]


@pytest.fixture(scope="module")
def tools():
    words = bpe.Vocabulary.read(PATH)
    return Tokenizer.from_file(PATH), words, bpe.Encoder(words), bpe.Decoder(words)


def check(tools, text):
    library, _, encoder, decoder = tools
    blocks = list(encoder.feed(text))
    want = library.encode(text, add_special_tokens=False).ids
    assert [i for b in blocks for (i,) in struct.iter_unpack("<I", b)] == want
    assert "".join(decoder.feed(b) for b in blocks) + decoder.end() == library.decode(want, skip_special_tokens=False)


def test_texts(tools):
    draw = random.Random(7)
    for text in ["", " ", "it's 'sun", "x" * 5000, "ab" * 4000, "\t\r\n", "<|endoftext|><|startoftext|>"]:
        check(tools, text)
    for _ in range(500):
        check(tools, "".join(draw.choices(PIECES, k=draw.randint(0, 60))))
    for _ in range(20):  # words far longer than the window
        check(tools, "".join(draw.choices("abcdeinorst", k=draw.randint(500, 4000))))
    check(tools, " ".join("".join(draw.choices("abcdé", k=5)) for _ in range(40_000)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0x2FFF), max_size=80))
def test_any_text(tools, text):
    check(tools, text)


def test_lookahead_is_sufficient_for_every_token_pair(tools):
    """What a window emits as stable does not change with the text that follows."""
    _, words, _, _ = tools
    merges = bpe.Merges(words.pairs, words.suffix)
    draw = random.Random(9)
    names = [t for t in words.ids if not t.endswith(words.suffix) and t.isascii()]
    for _ in range(300):
        symbols = [*"".join(draw.choices(names, k=120))]
        window = symbols[: words.longest + words.lookahead]
        first, whole = merges.merge(window[:]), merges.merge(symbols[:])
        assert first[0] == whole[0]


def test_decoding_in_any_cuts(tools):
    library, words, encoder, _ = tools
    text = "naïve 中文 😀 test " * 20
    ids = b"".join(encoder.feed(text))
    for joined in (True, False):
        whole = bpe.Decoder(words, joined)
        expected = whole.feed(ids) + whole.end()
        for step in (4, 8, 20):
            decoder = bpe.Decoder(words, joined)
            parts = [decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)]
            assert "".join(parts) + decoder.end() == expected
    assert expected == text


def test_documents(spark, tools):
    library, words, _, _ = tools
    rows = [(1, "Hello world", 3), (1, "Hello world", 3), (None, None, None), (3, "", 0), (4, "word " * 50_000, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode_documents(frame, words)
    assert got.columns == ["doc_id", "text", "token_ids", "n_tokens", "decoded"]
    for r in got.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.token_ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    again = bpe.decode_documents(got.withColumnRenamed("decoded", "was"), words)
    assert again.where("decoded <> was").count() == 0
    digest = got.where("doc_id = 4").select(F.sha2("token_ids", 256)).first()[0]
    assert digest == hashlib.sha256(b"".join(struct.pack("<I", i) for i in library.encode(rows[4][1], add_special_tokens=False).ids)).hexdigest()
    assert bpe.encode_documents(frame.where(F.lit(False)), words).count() == 0
