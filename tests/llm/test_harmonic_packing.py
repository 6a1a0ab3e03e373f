import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegraph.llm import harmonic_packing as packing
from sitegraph.llm import queries


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


def pack(frame, ranks, **options):
    return packing.pack_documents(frame, ranks, public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, **options)


@given(st.integers(1, 9000), st.integers(2, 2048), st.integers(0, 64))
@settings(max_examples=300, deadline=None)
def test_cuts_are_the_document_and_fit_their_class(length, capacity, slack):
    pieces = packing.cuts(length, capacity, slack)
    assert sum(pieces) == length and all(0 < p <= capacity for p in pieces)
    for piece in pieces:
        k = packing.class_of(piece, capacity)
        assert capacity / (k + 1) < piece <= capacity / k
    assert len(pieces) <= length // capacity + capacity.bit_length()


@given(st.lists(st.integers(1, 3000), max_size=60), st.integers(2, 1100), st.integers(0, 64))
@settings(max_examples=100, deadline=None)
def test_a_worker_fills_classes_by_count(lengths, capacity, slack):
    worker = packing.Worker(3, capacity, slack)
    for i, n in enumerate(lengths):
        worker.add(i, np.full(n, i, dtype="<u4"))
    filled = len({row[5] for row in worker.rows})
    held = sum(len(p[2]) for pieces in worker.open.values() for p in pieces)
    assert held <= len(worker.open) * capacity
    sequences = defaultdict(list)
    for row in worker.rows:
        sequences[row[5]].append(row)
    for rows in sequences.values():
        # As many pieces as the class has, whatever their lengths are.
        assert len(rows) == packing.class_of(max(r[2] for r in rows), capacity)
    worker.end()
    assert sum(r[2] for r in worker.rows) == sum(lengths)
    last = defaultdict(int)
    for row in worker.rows:
        last[row[5]] += row[2]
    assert all(n == capacity or n.bit_count() == 1 for number, n in last.items() if number not in sequences) and len(sequences) == filled


def invariants(rows, wanted, capacity):
    """Every id lies in one piece, sequences are gapless and not too long; gives the share of padding."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, pieces in documents.items():
        pieces.sort(key=lambda r: r.start)
        ids = b"".join(bytes(r.token_ids) for r in pieces)
        assert ids == wanted[doc] and {r.doc_tokens for r in pieces} == {len(ids) // 4}
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert all(len(r.token_ids) == 4 * r.length > 0 for r in pieces)
    assert set(documents) == set(wanted)
    padding = total = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        n = sum(r.length for r in pieces)
        assert n <= capacity
        padding += 0 if n.bit_count() == 1 else capacity - n
        total += n
    return padding / total


def test_pieces_hold_what_the_library_gives(spark, ranks):
    draw = np.random.default_rng(4)
    words = ["token", " 'Ll it's", "\n\n  ", "é", "日本", "<|endoftext|>", "  ", "123", "...", "\U0001f600", "Straße"]
    texts = ["".join(words[i] for i in draw.integers(0, len(words), n)) for n in draw.integers(0, 900, 120).tolist()]
    texts += [None, "", "x" * 30_000, " " * 5_000, "one two three. " * 60_000, *["a copy of a text"] * 40]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(5)
    got = pack(frame, ranks).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes() for i, t in enumerate(texts)}
    assert invariants(got, wanted, packing.CAPACITY) < 0.02
    few = pack(frame.coalesce(1), ranks, capacity=100, slack=0).collect()
    assert invariants(few, wanted, 100) < 0.06
    joined = packing.sequences(pack(frame.coalesce(1), ranks)).collect()
    assert sum(r.length for r in joined) == sum(len(w) // 4 for w in wanted.values()) and all(len(r.token_ids) == 4 * r.length for r in joined)


def test_odd_tables(spark, ranks):
    frame = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id int, text string")
    got = pack(frame, ranks)
    assert got.schema["doc_id"].dataType.typeName() == "integer"
    found = got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {(r.doc_id, r.n) for r in found} == {(None, 3), (7, 6)}
    assert pack(frame.where(F.lit(False)), ranks).collect() == []


def test_query(spark):
    got = queries.op11_harmonic_packing(spark, "/root/testdata/sf0.001")
    kinds = dict(got.dtypes)
    assert list(kinds) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and set(kinds.values()) == {"bigint"}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for d, t in texts.items()}
    rows = got.collect()
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
    assert sum(r.length for r in rows) == sum(len(x) for x in ids.values())
