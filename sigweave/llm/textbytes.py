"""Vectorised word splitting and hashing over batches of UTF-8 texts (numpy).

A batch is joined into one byte buffer, a newline behind each text.  Words are
maximal runs of bytes that a 256-entry table marks.  Word hashes are 64-bit sums
of random byte values times powers of an odd number, then mixed; k-gram hashes
combine k word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
PIECE_BYTES = 1 << 18
_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_COMBINE = _RNG.randint(1, 2**63 - 1, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)


def _word_table(is_word) -> bytes:
    return bytes(1 if is_word(b) else 0 for b in range(256))


#: Bytes of words that white space separates.
SPACED = _word_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of lower-cased words of ASCII letters, digits and all non-ASCII characters.
ALNUM = _word_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = max(n, 1024)
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(more, _BASE, np.uint64)]), dtype=np.uint64)
    return _POWERS


class Words:
    """Words of some texts: byte spans, hashes, and the first word of each text."""

    def __init__(self, texts: list[bytes], table: bytes, lower: bool):
        joined = b"\n".join(texts) + b"\n"
        self.joined = joined.translate(LOWER) if lower else joined
        self.data = np.frombuffer(self.joined, np.uint8)
        self.text_start = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.text_start[1:])
        inside = np.frombuffer(self.joined.translate(table), np.int8)
        edge = np.diff(inside, prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.inside = inside
        self.first = np.searchsorted(self.start, self.text_start)
        self.n_texts = len(texts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)

    def hashes(self) -> np.ndarray:
        """A hash per word, made in pieces of about PIECE_BYTES, so that a long text needs little more than its hashes."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            j = max(int(np.searchsorted(self.end, self.start[i] + PIECE_BYTES, "right")), i + 1)
            if j == i + 1 and self.end[i] - self.start[i] > PIECE_BYTES:
                out[i] = self._long_word(int(self.start[i]), int(self.end[i]))
            else:
                out[i:j] = self._piece(i, j)
            i = j
        return mix(out + (self.end - self.start).astype(np.uint64))

    def _piece(self, i: int, j: int) -> np.ndarray:
        lo, hi = self.start[i], self.end[j - 1]
        start = self.start[i:j] - lo
        value = _BYTE[self.data[lo:hi]]
        value *= self.inside[lo:hi].astype(np.uint64)
        length = np.diff(np.append(start, hi - lo))
        place = np.arange(hi - lo) - np.repeat(start, length)
        value *= powers(int(length.max()) + 1)[place]
        return np.add.reduceat(value, start)

    def _long_word(self, lo: int, hi: int) -> np.uint64:
        total, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
        step = powers(PIECE_BYTES + 1)
        for at in range(lo, hi, PIECE_BYTES):
            part = _BYTE[self.data[at : min(hi, at + PIECE_BYTES)]]
            total += (part * step[: len(part)]).sum(dtype=np.uint64) * scale
            scale *= step[PIECE_BYTES]
        return total[0]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k-gram that starts at each word but the last k - 1, across text borders too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _COMBINE[0]
    for j in range(1, k):
        out += hashes[j : j + n] * _COMBINE[j]
    return mix(out)


def whole(text_of_word: np.ndarray, k: int) -> np.ndarray:
    """True for the k-grams that lie in one text."""
    n = len(text_of_word) - k + 1
    return text_of_word[:n] == text_of_word[k - 1 : k - 1 + n] if n > 0 else np.zeros(0, bool)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives an empty text."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, a longer text alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
