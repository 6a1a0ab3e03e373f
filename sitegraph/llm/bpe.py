"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its incremental decoder.

Whether a token is final can depend on symbols to its right only through a chain of merges of falling rank:
a merge may lose its right part to a neighbour, which may lose its own right part, and so on. The longest
such chain of the merge list is its *sufficient lookahead*. The transducer keeps a window of the symbols
of a word, merges inside it, emits a token as soon as the window reaches that far beyond it, and moves on, so
a word of any length needs constant memory. A text is read in blocks that end at white space.

Decoding is a state machine that keeps what a token needs from the ones before it: whether a separator is
due, or the bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sitegraph.session import map_texts

BLOCK = re.compile(r"(?s).{1,65536}[^\t-\r ]*[\t-\r ]*")
OUT_BYTES = 8 << 20
# Words and their tokens that a task remembers; beyond that it starts anew.
REMEMBERED = 300_000
NO_RANK = 1 << 60
# White space as Unicode has it; Python's own class differs in four control characters.
WHITE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file (a fixed format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The merge list with its longest token and its sufficient lookahead, both in symbols."""

    def __init__(self, pairs: list[tuple[str, str]], suffix: str) -> None:
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.suffix = suffix

    def length(self, token: str) -> int:
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0)

    def bounds(self) -> tuple[int, int]:
        """(longest token, sufficient lookahead).

        ``reach`` of a token is how far from its start a symbol may stand that has a say in whether the token
        comes about and stays whole up to a rank. A right neighbour z takes a part x away by a rule (x, z) of a rank
        below the one at which x is used; then z's own reach counts from the end of x. Rules are visited by rank, so
        all that a rule depends on is known.
        """
        inner: dict[str, int] = {}  # reach through the parts of a token
        ranks: dict[str, list[int]] = {}  # by left part: ranks of rules
        most: dict[str, list[int]] = {}  # by left part: largest reach of the right parts up to a rank

        def stolen(x: str, limit: int) -> int:
            at = bisect_left(ranks.get(x, ()), limit)
            return most[x][at - 1] if at else 0

        for rank, (a, b) in enumerate(self.rank):
            size_a, size_b = self.length(a), self.length(b)
            inner[a + b] = max(
                inner.get(a, 0), size_a + stolen(a, rank), size_a + inner.get(b, 0), size_a + size_b + stolen(b, rank)
            )
            reach = max(size_b, inner.get(b, 0), size_b + stolen(b, rank))
            ranks.setdefault(a, []).append(rank)
            seen = most.setdefault(a, [])
            seen.append(max(reach, seen[-1] if seen else 0))
        longest = ahead = 1
        for token in {a + b for a, b in self.rank} | {x for pair in self.rank for x in pair}:
            size = self.length(token)
            longest = max(longest, size)
            ahead = max(ahead, inner.get(token, 0) - size, stolen(token, NO_RANK))
        return longest, ahead

    def merge(self, symbols: list[str]) -> list[str]:
        """Tokens of a run of symbols: the lowest rank first, the leftmost first among equals."""
        get = self.rank.get
        ranks = [get(pair, NO_RANK) for pair in zip(symbols, symbols[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), NO_RANK)
        return symbols


class Vocabulary:
    """What encoding and decoding need of a vocabulary file; travels to the tasks."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.pairs = [tuple(pair) if not isinstance(pair, str) else tuple(pair.split(" ")) for pair in model["merges"]]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.longest, self.lookahead = Merges(self.pairs, self.suffix).bounds()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            return cls(file.read())


class Encoder(dict):
    """Word -> its tokens as little-endian 32-bit ids; a word is worked out when it is first asked for."""

    PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
    ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.merges = Merges(vocabulary.pairs, vocabulary.suffix)
        self.symbols = {i: s for i, s in byte_symbols().items()}
        self.window = 4 * (vocabulary.longest + vocabulary.lookahead)
        self.packed = {token: struct.pack("<I", i) for token, i in vocabulary.ids.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = b"".join([self.packed[token] for token in self.tokens(word)])
        if len(word) <= 64:
            self[word] = found
        return found

    def tokens(self, word: str) -> Iterator[str]:
        """Tokens of a word, emitted as soon as they are stable."""
        symbols = [*word] if word.isascii() and word.isprintable() else [*word.encode("utf-8", "replace").decode("latin-1").translate(self.symbols)]
        symbols[-1] += self.vocabulary.suffix
        ahead, at = self.vocabulary.lookahead, 0
        while at + self.window < len(symbols):
            seen = 0
            for token in self.merges.merge(symbols[at : at + self.window]):
                size = self.merges.length(token)
                if seen + size + ahead > self.window:
                    break
                yield token
                seen += size
            at += seen
        yield from self.merges.merge(symbols[at:])

    def feed(self, text: str) -> Iterator[bytes]:
        """Ids of a text, block by block."""
        for block in BLOCK.findall(text):
            for i, part in enumerate(self.cuts.split(block) if self.cuts else [block]):
                if i % 2:
                    yield struct.pack("<I", self.vocabulary.special[part])
                elif part.isascii():
                    yield b"".join(map(self.__getitem__, self.ASCII_PIECES.findall(part.lower())))
                else:
                    # Lower case character by character, as the library has it: no final sigma.
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                    yield b"".join(map(self.__getitem__, self.PIECES.findall(part)))


class Decoder:
    """Ids to text, in any cuts. ``joined``: the tokens as they are written, a blank between them, which is what the
    library gives for a file without a decoder; else the text itself, a blank after each end of a word."""

    def __init__(self, vocabulary: Vocabulary, joined: bool = True) -> None:
        names = {i: t for t, i in vocabulary.ids.items()} | {i: t for t, i in vocabulary.special.items()}
        self.joined, self.started = joined, False
        if joined:
            self.names = names
            return
        back = {s: b for b, s in byte_symbols().items()}
        end, special = vocabulary.suffix, set(vocabulary.special.values())

        def raw(i: int, token: str) -> bytes:
            if i in special:
                return token.encode() + b" "
            stem = token.removesuffix(end) if end else token
            return bytes(back[s] for s in stem) + (b" " if stem != token else b"")

        self.raw = {i: raw(i, t) for i, t in names.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        if not self.joined:
            return self.state.decode(b"".join(map(self.raw.__getitem__, numbers)))
        text = " ".join(map(self.names.__getitem__, numbers))
        if self.started and numbers:
            text = " " + text
        self.started |= bool(numbers)
        return text

    def end(self) -> str:
        """What is left at the end of a text; the decoder can take the next one then."""
        self.started = False
        if self.joined:
            return ""
        rest = self.state.decode(b"", True)
        self.state.reset()
        return rest


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", joined: bool = True) -> DataFrame:
    """``docs`` with ``token_ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and ``decoded``.

    ``decoded`` is made from the ids. A null text counts as empty: no tokens, empty decoded text. Texts are read whole;
    equal texts get equal results; columns of the result names are replaced; lone surrogates become ``?``.
    """
    kept = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "decoded")]
    place = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value, joined)
        for batch in batches:
            schema = pa.schema([*batch.schema, pa.field("token_ids", pa.binary()), pa.field("n_tokens", pa.int64()), pa.field("decoded", pa.string())])
            texts = batch.column(place)
            first, size, ids, decoded = 0, 0, [], []
            for i in range(len(texts)):
                blocks = list(encoder.feed(texts[i].as_py() or ""))
                ids.append(b"".join(blocks))
                decoded.append("".join([decoder.feed(block) for block in blocks]) + decoder.end())
                size += len(ids[-1]) + len(decoded[-1])
                if size >= OUT_BYTES or i == len(texts) - 1:
                    part = batch.slice(first, i + 1 - first)
                    counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), counts, pa.array(decoded, pa.string())], schema=schema)
                    first, size, ids, decoded = i + 1, 0, [], []

    schema = docs.select(*kept).schema.add("token_ids", "binary").add("n_tokens", "long").add("decoded", "string")
    return map_texts(docs.select(*kept), encode, schema)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", joined: bool = True) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids (null: empty); a column of this name is replaced."""
    kept = [c for c in encoded.columns if c != "decoded"]
    place = kept.index(ids)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value, joined)
        for batch in batches:
            texts = [decoder.feed(x.as_py() or b"") + decoder.end() for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=pa.schema([*batch.schema, pa.field("decoded", pa.string())]))

    return map_texts(encoded.select(*kept), decode, encoded.select(*kept).schema.add("decoded", "string"))
