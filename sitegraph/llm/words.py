"""Words of a batch of texts as 64-bit hashes, worked out on whole byte buffers instead of word by word.

A word is a run of letters, marks and digits of the lower-case NFC text. All functions are pure helpers that
run inside tasks; the tables they build depend on the block size alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

# Multipliers of the word hash and of the mixing steps (odd, otherwise of no meaning).
BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
BLOCK_BYTES = 1 << 20

NON_WORD = regex.compile(r"[^\x00-\x7f\p{L}\p{M}\p{N}]+")
ASCII_WORD = re.compile(r"[a-z0-9]")


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    out = values ^ (values >> np.uint64(33))
    out *= np.uint64(MIX_A)
    out ^= out >> np.uint64(33)
    out *= np.uint64(MIX_B)
    out ^= out >> np.uint64(33)
    return out


def plain(text: str | None) -> str:
    """Lower-case NFC text in which every character that is not ASCII belongs to a word."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    text = text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return NON_WORD.sub(" ", text)


class WordHasher:
    """Keeps the powers of the base, which grow with the longest block seen."""

    def __init__(self) -> None:
        self.size = 0
        self.in_word = np.zeros(256, dtype=bool)
        self.in_word[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]] = True
        self.in_word[128:] = True

    def _grow(self, size: int) -> None:
        if size > self.size:
            self.size = max(size, BLOCK_BYTES)
            self.powers = np.cumprod(np.full(self.size, BASE, dtype=np.uint64))
            inverse = pow(BASE, -1, 1 << 64)
            self.inverses = np.cumprod(np.full(self.size, inverse, dtype=np.uint64))

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts in a row, and the number of words of each text."""
        parts = [plain(t).encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
        self._grow(len(data) + 1)
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[1:] = self.in_word[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.inverses[starts])
        bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
        counts = np.diff(np.searchsorted(starts, bounds))
        return hashes, counts

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, hashes, counts) for runs of texts of about a block in size."""
        first, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= BLOCK_BYTES or i == len(texts) - 1:
                yield (first, *self.block(texts[first : i + 1]))
                first, size = i + 1, 0

    def each(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The word hashes of each text."""
        for _, hashes, counts in self.blocks(texts):
            at = 0
            for n in counts.tolist():
                yield hashes[at : at + n]
                at += n


def sequence_hash(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hash of every run of ``len(factors)`` values; zero factors leave a position out."""
    width = len(factors)
    total = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for k in np.flatnonzero(factors):
        total += hashes[k : k + len(total)] * factors[k]
    return mix(total)


def position_factors(width: int, seed: int = 1) -> np.ndarray:
    """Odd multipliers, one per position."""
    return mix(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
