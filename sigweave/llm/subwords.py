"""Hashed character n-grams of words, as features of bag-of-subwords models (numpy).

A word gives its byte n-grams between border marks, and itself as a whole.  Linear
models over these features fold into one value per bucket, so a text is scored from its
distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textbytes import _BYTE, _COMBINE, ALNUM, Words, mix

BITS = 17


#: Bytes of distinct words whose features are held at once.
BLOCK = 1 << 20


class Bag:
    """Distinct words of some texts with their features, which are made in blocks.

    ``word``: distinct word of every word in the texts; ``size``: features per distinct word.
    """

    def __init__(self, texts: list[bytes], sizes=(3, 4, 5), bits: int = BITS):
        words = Words(texts, ALNUM, lower=True)
        self.first, self.sizes, self.shift = words.first, sizes, np.uint64(64 - bits)
        self.keys, at, self.word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.word = self.word.astype(np.int32)
        self.n, self.data = len(self.keys), words.data
        self.start, self.end = words.start[at], words.end[at]
        length = self.end - self.start + 2
        self.size = 1 + sum(np.maximum(length - n + 1, 0) for n in sizes) if self.n else np.zeros(0)

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of distinct words of about BLOCK bytes together; a longer word alone."""
        upto = np.cumsum(self.end - self.start + 2)
        lo = 0
        while lo < self.n:
            before = upto[lo - 1] if lo else 0
            hi = max(int(np.searchsorted(upto, before + BLOCK, "right")), lo + 1)
            yield lo, hi
            lo = hi

    def features(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, distinct word) of the features of some distinct words: each whole, then its n-grams by size."""
        start, end = self.start[lo:hi], self.end[lo:hi]
        length = end - start + 2
        border = np.cumsum(length) - length
        place = np.arange(length.sum()) - np.repeat(border, length)
        source = np.repeat(start, length) + place - 1
        value = _BYTE[self.data[np.clip(source, 0, len(self.data) - 1)]]
        value[border], value[border + length - 1] = _BYTE[1], _BYTE[2]
        left = np.repeat(length, length) - place  # bytes from here to the word's end
        owner = np.repeat(np.arange(lo, hi, dtype=np.int32), length)
        buckets, owners = [self._whole(lo, hi)], [np.arange(lo, hi, dtype=np.int32)]
        for n in self.sizes:
            if len(value) >= n:
                ok = left[: len(value) - n + 1] >= n
                buckets.append(self._grams(value, n)[ok])
                owners.append(owner[: len(ok)][ok])
        return np.concatenate(buckets), np.concatenate(owners)

    def _whole(self, lo: int, hi: int) -> np.ndarray:
        return (mix(self.keys[lo:hi] ^ _COMBINE[9]) >> self.shift).astype(np.int32)

    def _grams(self, value: np.ndarray, n: int) -> np.ndarray:
        m = len(value) - n + 1
        g = value[:m] * _COMBINE[n + 10]
        for j in range(1, n):
            g += value[j : j + m] * _COMBINE[n + 10 + 5 * j]
        return (mix(g) >> self.shift).astype(np.int32)

    def _long_word(self, i: int, table: np.ndarray) -> float:
        """Sum over the features of a word longer than a block, by overlapping pieces."""
        start, end = int(self.start[i]), int(self.end[i])
        total, reach = float(table[self._whole(i, i + 1)[0]]), max(self.sizes) - 1
        for lo in range(start - 1, end + 1, BLOCK):
            hi = min(lo + BLOCK + reach, end + 1)
            value = _BYTE[self.data[np.clip(np.arange(lo, hi), 0, len(self.data) - 1)]]
            if lo == start - 1:
                value[0] = _BYTE[1]
            if hi == end + 1:
                value[-1] = _BYTE[2]
            for n in self.sizes:
                own = min(BLOCK, len(value) - n + 1)  # n-grams that start in this piece
                if own > 0:
                    total += float(table[self._grams(value[: own + n - 1], n)].sum())
        return total

    def word_values(self, table: np.ndarray) -> np.ndarray:
        """Mean over its features of each distinct word; ``table`` has a value per bucket, or a row of them."""
        return self.several_values(table[None])[0]

    def several_values(self, tables: np.ndarray) -> np.ndarray:
        """The same for the rows of ``tables``, whose features are made once."""
        out = np.zeros((len(tables), self.n))
        for lo, hi in self.blocks():
            if hi == lo + 1 and self.end[lo] - self.start[lo] > BLOCK:
                out[:, lo] = [self._long_word(lo, t) for t in tables]
                continue
            bucket, owner = self.features(lo, hi)
            for k, table in enumerate(tables):
                out[k, lo:hi] = np.bincount(owner - lo, table[bucket], hi - lo)
        return out / np.maximum(self.size, 1)

    def text_means(self, values: np.ndarray) -> np.ndarray:
        """Mean over its words of each text, 0 for none."""
        total = np.concatenate([[0.0], np.cumsum(values[self.word])])
        count = np.diff(self.first)
        return (total[self.first[1:]] - total[self.first[:-1]]) / np.maximum(count, 1)

    def vectors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, weight) of the sparse mean vectors; for training texts, which are bounded."""
        count = np.diff(self.first)
        text = np.repeat(np.arange(len(count)), count)
        pair, many = np.unique(text.astype(np.int64) * max(self.n, 1) + self.word, return_counts=True)
        text, word = pair // max(self.n, 1), pair % max(self.n, 1)
        weight = many / count[text] / self.size[word]
        bucket, owner = self.features(0, self.n)
        order = np.argsort(owner, kind="stable")
        bucket, first = bucket[order].astype(np.int64), np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        n = self.size[word]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[word], n)
        return np.repeat(text, n), bucket[at], np.repeat(weight, n)


def lowered(column: pa.Array) -> list[bytes]:
    """Lower-cased UTF-8 bytes of each text; null gives an empty text."""
    return [t.lower().encode() if t else b"" for t in column.to_pylist()]
