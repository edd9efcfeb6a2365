"""Operator 13: periodic runs of words, by Lyndon roots.

A run is a stretch of words with smallest period q, at least two periods long, that no
neighbouring word extends.  The roots of runs are Lyndon words: for one of the two orders
(any order of the words, and its reverse) some place in the run starts a longest Lyndon word
of length q.  ``lyndon_array`` finds the length of the longest Lyndon word at every place by
the first phase of Baier's suffix sorter: groups of suffixes with equal prefix are taken from
the highest down; each place of a group hangs its prefix on the nearest place to its left that
is in a lower group, and places that got equally many of them move to a new group just above
their old one.  When a group is taken, its prefix is the longest Lyndon word of its places.
Both orders are sorted so, directly.  ``runs`` then extends roots to both sides by
longest common extensions; equal periods inside a run found already are skipped.

``periodic`` keeps runs of at least ``LEAST`` words and ``TIMES`` periods.  In such a run, every
stretch of 8 words occurs again in the run, so only stretches of the text whose 8-grams all
recur in it are sorted (``stretches``, an exact filter by hashes: false hits only cost time).

Scale.  A narrow Arrow stage over whole texts without any shuffle.  Words are vectorised per
text, the sorter works in compact arrays (about 60 bytes a word of the stretches), in O(n) steps but for
path compression; extensions compare words directly and take O(n log n) in all.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a null
doc_id is never rewritten; repeated rows are judged each; extra columns pass through if named
in ``keep``, and made columns get underscores behind their names if they clash.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .session import arrow_batches, fresh
from .textbytes import SPACED, Words, grams, slices, text_bytes, whole

#: A kept run has at least so many words and so many periods.
LEAST, TIMES = 24, 3
#: Words of a gram that recurs inside every kept run: LEAST and TIMES give room for a period on one side.
GRAM = 8


def lyndon_array(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place, under the order of ``rank`` (the end is lowest).

    Groups are linked from low to high; ``nearest`` skips places that are taken, halving paths.
    """
    n = len(rank)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(rank, kind="stable")
    values = rank[order]
    edges = np.append(np.flatnonzero(np.diff(values, prepend=-1)), n).tolist()
    members: list = [array("q", order[lo:hi].tolist()) for lo, hi in zip(edges, edges[1:], strict=False)]
    group = np.empty(n, np.int64)
    group[order] = np.repeat(np.arange(len(members)), np.diff(edges))
    group = array("q", group.tolist())
    length = array("q", [1]) * len(members)
    below, above = array("q", range(-1, len(members) - 1)), array("q", range(1, len(members) + 1))
    above[-1] = -1
    nearest = array("q", range(n))  # the place itself while it isn't taken, else somewhere left of it; -1 is before the start
    out = np.empty(n, np.int64)
    now = len(members) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        members[now] = None
        if own:
            size = length[now]
            out[own] = size
            for i in own:
                nearest[i] = i - 1
            hung: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and nearest[j] != j:
                    k = nearest[j]
                    if k >= 0:
                        nearest[j] = nearest[k]
                    j = k
                if j >= 0:
                    hung[j] = hung.get(j, 0) + 1
            if hung:
                moves: dict[tuple[int, int], list[int]] = {}
                for j, times in hung.items():
                    moves.setdefault((times, group[j]), []).append(j)
                for times, old in sorted(moves, reverse=True):  # more copies end up higher
                    new, moved = len(members), moves[times, old]
                    members.append(array("q", moved))
                    length.append(length[old] + times * size)
                    for j in moved:
                        group[j] = new
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new
        now = below[now]
    return out


def _common(x: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words from a on equal those from b on, at most ``most``; in blocks that double."""
    got, step = 0, 16
    while got < most:
        step = min(step, most - got)
        same = x[a + got : a + got + step] == x[b + got : b + got + step]
        if not same.all():
            return got + int(np.argmin(same))
        got, step = got + step, step * 2
    return got


def runs(ids: np.ndarray, least: int = 0, times: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``times`` (2 or more) periods, in order."""
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)
    back = rank[::-1]
    found = set()
    for own in (rank, rank.max(initial=0) - rank):
        root = lyndon_array(own)
        at = np.arange(n)
        right = at + root
        fits = right < n
        near = fits & (own == own[np.minimum(right, n - 1)])  # so it is for the first root of a run
        reach: dict[int, int] = {}  # period: end of the last run with it
        for i in np.flatnonzero(near).tolist():
            p = int(root[i])
            if i + 2 * p <= reach.get(p, 0):
                continue
            ahead = _common(own, i, i + p, n - i - p)
            if times > 2 and ahead < (times - 2) * p + 1:
                continue  # not the first whole root of a run of so many periods
            behind = _common(back, n - i, n - i - p, i)
            if behind + p + ahead >= 2 * p:
                reach[p] = i + p + ahead
                found.add((i - behind, behind + p + ahead, p))
    return sorted((s, length, p) for s, length, p in found if length >= max(least, times * p))


def stretches(hashes: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words, each in one text, in which every gram occurs twice or more in that text."""
    if len(hashes) < GRAM:
        return []
    key = grams(hashes, GRAM) + text[: len(hashes) - GRAM + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    inside = np.flatnonzero(whole(text, GRAM))
    own = key[inside]
    order = np.argsort(own, kind="stable")
    sorted_ = own[order]
    equal = sorted_[1:] == sorted_[:-1]
    twice = np.zeros(len(key) + 1, np.int8)
    twice[inside[order[1:][equal]]] = 1
    twice[inside[order[:-1][equal]]] = 1
    edge = np.diff(twice, prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Neighbouring stretches of two texts are apart: the last grams of a text are never whole.
    keep = end - start + GRAM - 1 >= LEAST
    return list(zip(start[keep].tolist(), (end[keep] + GRAM - 1).tolist(), strict=True))


def periodic(words: Words, order: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, length, period) of the kept runs; ``order`` has the word at each place, ``text`` its text."""
    out = []
    for lo, hi in stretches(words.hashes()[order] if len(order) else np.zeros(0, np.uint64), text):
        own = order[lo:hi]
        distinct, inverse = np.unique(own, return_inverse=True)
        names: dict[bytes, int] = {}
        start, end = words.start[distinct].tolist(), words.end[distinct].tolist()
        ids = np.array([names.setdefault(words.joined[a:b], len(names)) for a, b in zip(start, end, strict=True)])
        out += [(lo + s, n, p) for s, n, p in runs(ids[inverse], LEAST, TIMES)]
    return out


def rewritten(words: Words, seeds: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word at each place after the planted repeats of texts whose seed (an unsigned CRC-32) ends in 0, and its text."""
    order, first = np.arange(len(words.start)), words.first
    for i, seed in enumerate(seeds):
        lo, n = int(first[i]), int(first[i + 1] - first[i])
        if seed is None or seed % 10 or not n:
            continue
        g = seed // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        order[lo + a : lo + n] = lo + a + np.arange(n - a) % p
    return order, words.text_of_word()


def _joined(words: Words, chosen: np.ndarray, piece: int = 1 << 16) -> Iterator[bytes]:
    """The chosen words with one space between them, in pieces."""
    data = words.data
    for lo in range(0, len(chosen), piece):
        own = chosen[lo : lo + piece]
        size = words.end[own] - words.start[own] + 1
        stop = np.cumsum(size)
        at = np.arange(stop[-1]) + np.repeat(words.start[own] - (stop - size), size)
        out = data[at]
        out[stop - 1] = 0x20
        yield out[: -1 if lo + piece >= len(chosen) else None].tobytes()


def _longest(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Greatest exact length / period; ties: smallest start, then period."""
    best = found[0]
    for own in found[1:]:
        if own[1] * best[2] > best[1] * own[2]:
            best = own
    return best


_KINDS = {"n_runs": LongType(), "start": LongType(), "length": LongType(), "period": LongType(), "exponent_milli": LongType(), "runs_sha256": StringType(), "collapsed_sha256": StringType()}


def _over_texts(docs: DataFrame, keep, text: str, seed: Column, made: dict, judge: Callable) -> DataFrame:
    arrow_batches(docs.sparkSession)
    kept = docs.select(*keep)
    names = fresh(keep, *made)
    schema = StructType([*kept.schema, *(StructField(n, t) for n, t in zip(names, made.values(), strict=True))])
    n = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            texts, seeds = text_bytes(batch.column(n)), batch.column(n + 1).to_pylist()
            for lo, hi in slices(texts):
                rows = judge(texts[lo:hi], seeds[lo:hi])
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(n)]
                columns += [pa.array(c, arrow.field(n + i).type) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    a, b = fresh(keep, "_text", "_seed")
    return docs.select(*keep, F.col(text).alias(a), seed.cast("long").alias(b)).mapInArrow(run, schema)


def _runs_by_text(texts: list[bytes], seeds: list) -> tuple[Words, np.ndarray, np.ndarray, list[list[tuple[int, int, int]]]]:
    words = Words(texts, SPACED, lower=False)
    order, text = rewritten(words, seeds)
    by_text: list = [[] for _ in texts]
    keep = np.ones(len(order), np.int64)
    cover = np.zeros(len(order) + 1, np.int64)
    for start, length, period in periodic(words, order, text):
        i = int(text[start])
        by_text[i].append((start - int(words.first[i]), length, period))
        cover[start + period] += 1
        cover[start + length] -= 1
    keep = np.cumsum(cover[:-1]) == 0
    return words, order, keep, [sorted(f, key=lambda r: (r[0], r[2])) for f in by_text]


def find(docs: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``runs`` (start, length, period of each kept run) and ``collapsed``: the text without the words behind the first period of a run."""

    def judge(texts, seeds):
        words, order, kept, found = _runs_by_text(texts, seeds)
        for i, own in enumerate(found):
            lo, hi = int(words.first[i]), int(words.first[i + 1])
            chosen = order[lo:hi][kept[lo:hi]]
            yield [list(r) for r in own], b"".join(_joined(words, chosen)).decode("utf-8", "replace")

    return _over_texts(docs, keep, text, F.lit(None), {"runs": ArrayType(ArrayType(LongType())), "collapsed": StringType()}, judge)


def summarised(docs: DataFrame, keep=("doc_id",), text: str = "text", seed: Column | None = None) -> DataFrame:
    """``keep`` columns, the number of runs, the run of the greatest exponent, and digests of all runs and of the collapsed text.

    ``seed``: where it ends in 0, repeats are planted first (a test of the finder in its own data).
    """

    def judge(texts, seeds):
        words, order, kept, found = _runs_by_text(texts, seeds)
        for i, own in enumerate(found):
            lo, hi = int(words.first[i]), int(words.first[i + 1])
            digest = hashlib.sha256()
            for piece in _joined(words, order[lo:hi][kept[lo:hi]]):
                digest.update(piece)
            start, length, period = _longest(own) if own else (None, None, None)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in own)
            milli = 1000 * length // period if own else None
            yield len(own), start, length, period, milli, hashlib.sha256(listed.encode()).hexdigest(), digest.hexdigest()

    return _over_texts(docs, keep, text, F.lit(None) if seed is None else seed, _KINDS, judge)


def digests(docs: DataFrame) -> DataFrame:
    return summarised(docs, seed=F.crc32(F.col("doc_id").cast("string").cast("binary")))
