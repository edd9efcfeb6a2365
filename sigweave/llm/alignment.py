"""Operator 11: alignment of two tokenizers, scored by how often their ids meet in the corpus.

Both tokenizers cut the same bytes (a space and the text): A by byte-level pairs, B by
SentencePiece.  Places where a token of A and one of B both end cut a text into groups;
between two neighbouring ends of either side exactly one A token overlaps one B token, a
link.  A pair of ids counts the documents that have it linked.

Counting is external and spills.  A task encodes documents in blocks; a block's
(pair, document, times) records are sorted by pair, dealt by a radix of the A id, and each
part becomes one zstd-compressed run (``_run``), a row that Spark stores and shuffles.  One task per part
merges the runs' pairs by a k-way heap (``_merged``), at most ``FAN_IN`` at a time, which
counts each pair.  Pairs come in the order of their A id, so the largest count of each A id is
one pass over them, and each run is then read once more; what its documents get is sent back to
their block, compressed too, and added up there.

Scale.  A run holds a pair once with all documents of its block, so a pair that every document
has is one entry for each block, not one row for each document: no part grows with a hot pair.
A part's task holds its compressed runs and one level of decompressed pairs; the number of
parts follows the session's shuffle partitions.  A block takes ``RECORDS`` records at most
and the longest document more.  Nothing passes through the driver.

Defined cases: a null or empty text, and one whose tokens do not spell a space and the text
(B's mark inside a text turns into a space), has no tokens and zeros; repeated rows are
documents each; a null doc_id is kept.  Strings of special tokens are plain text.  Extra columns
pass through if named in ``keep``; made columns get underscores behind their names if they clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from . import pieces, tokens
from .session import arrow_batches, fresh, written
from .textbytes import slices

VOCABULARY_A = "byte_bpe_50k.tiktoken"
VOCABULARY_B = pieces.MODEL
#: Records of a block, which are sorted in memory.
RECORDS = 1 << 21
#: Documents of a block; their numbers take 16 bits of a record.
DOCUMENTS = 1 << 16
#: Pairs and parts take 31 and 16 bits of a record.
_PAIR_BITS, _DOC_BITS = 31, 16
#: Runs that one heap merges.
FAN_IN = 256
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups")
#: At least so many parts, so that small sessions hold small ones too; at most so many fit beside pair and document in a record.
LEAST_PARTS, MOST_PARTS = 64, 1 << 15
#: Longer texts are aligned by parts.
LONG = 1 << 20


class Tokenizers:
    """Both encoders, and the bytes and the printed form of each id."""

    def __init__(self, a: str, b: str):
        self.a_path = a if "/" in a else pieces.model_path(a)
        self.b = pieces.load(b if "/" in b else pieces.model_path(b))
        ranks = tokens.encoder(self.a_path)._mergeable_ranks
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            self.a_bytes[number] = token
        self.b_bytes = [
            bytes([int(p[1:-1], 16)]) if k == pieces.BYTE else p.replace(pieces.MARK, " ").encode()
            for p, k in zip(self.b.pieces, self.b.kinds.tolist(), strict=True)
        ]
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        if self.n_a * self.n_b >= 1 << _PAIR_BITS:
            raise ValueError("pairs of these vocabularies do not fit in 31 bits")
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        # An id with the separator behind it: "," inside a side, "|" between the sides, ";" between groups.
        printed = [f"{i}{s}".encode() for i in range(self.n_a) for s in ",|"] + [f"{i}{s}".encode() for i in range(self.n_b) for s in ",;"]
        self.printed = np.array(printed, object)

    def encoded(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None if there are no tokens or they don't spell a space and the text."""
        if not text:
            return None
        want = b" " + text
        a = tokens.encode(want.decode(), self.a_path)
        b = self.b.ids(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != want:
            return None
        return np.array(a, np.int64), b.astype(np.int64)


    def parts(self, text: bytes) -> Iterator[bytes]:
        """A long text cut at spaces between letters, which neither side's tokens cross; the space is the one that goes before each part."""
        if len(text) <= LONG:
            yield text
            return
        whole, lo = text.decode(), 0
        while len(whole) - lo > LONG:
            cut = lo + LONG
            while cut < len(whole) and not (whole[cut] == " " and whole[cut - 1].isalpha() and whole[cut + 1 : cut + 2].isalpha() and not self.b._inseparable(whole[cut - 1], pieces.MARK)):
                cut += 1
            yield whole[lo:cut].encode()
            lo = cut + 1
        if lo <= len(whole):
            yield whole[lo:].encode()


@dataclass
class Aligned:
    """Figures of some texts, and the (text, pair) with how often each is linked."""

    n: dict[str, np.ndarray]
    groups: list
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def of_rows(texts: list[bytes], own: Tokenizers, digest: bool) -> Aligned:
    """Figures of whole texts, long ones by parts; groups printed or digested."""
    parts, row = [], []
    for i, t in enumerate(texts):
        for part in own.parts(t):
            parts.append(part)
            row.append(i)
    row = np.array(row, np.int64)
    n = {c: np.zeros(len(texts), np.int64) for c in COLUMNS[:4]}
    bad = np.zeros(len(texts), bool)
    printed: list = [None] * len(texts)
    records = [(np.zeros(0, np.int64),) * 3]
    for lo, hi in slices(parts):
        got = aligned(parts[lo:hi], own)
        for c, x in got.n.items():
            np.add.at(n[c], row[lo:hi], x)
        bad[row[lo:hi][[not g and bool(t) for g, t in zip(got.groups, parts[lo:hi], strict=True)]]] = True
        records.append((row[lo:hi][got.text], got.pair, got.times))
        for i, g in zip(row[lo:hi].tolist(), got.groups, strict=True):
            if g:
                g = g if printed[i] is None else b";" + g
                if digest:
                    printed[i] = printed[i] or hashlib.sha256()
                    printed[i].update(g)
                else:
                    printed[i] = (printed[i] or b"") + g
    text, pair, times = map(np.concatenate, zip(*records, strict=True))
    ok = ~bad[text]
    for x in n.values():
        x[bad] = 0
    groups = ["" if p is None or b else p.hexdigest() if digest else p.decode() for p, b in zip(printed, bad.tolist(), strict=True)]
    return Aligned(n, groups, text[ok], pair[ok], times[ok])


def aligned(texts: list[bytes], own: Tokenizers) -> Aligned:
    """Figures of some texts at once; those without tokens have no groups."""
    none = (np.zeros(0, np.int64),) * 2
    both = [own.encoded(t) or none for t in texts]
    n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in both]) for k in (0, 1))
    # Both sides of a text spell the same bytes, so ends may run on from text to text.
    end_a, end_b = np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b])
    meets_a, meets_b = _member(end_a, end_b), _member(end_b, end_a)
    first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    n_groups = np.diff(np.concatenate([[0], np.cumsum(meets_a)])[first_a])
    # Printed groups: A tokens come behind the B tokens of earlier groups, B tokens behind the A tokens of their own.
    upto_a, upto_b = np.flatnonzero(meets_a) + 1, np.flatnonzero(meets_b) + 1
    group_a, group_b = np.cumsum(meets_a) - meets_a, np.cumsum(meets_b) - meets_b
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]] = 2 * a + meets_a
    code[np.arange(len(b)) + upto_a[group_b]] = 2 * own.n_a + 2 * b + meets_b
    first = first_a + first_b
    groups = [b"".join(own.printed[code[lo:hi]].tolist())[:-1] for lo, hi in zip(first.tolist(), first[1:].tolist(), strict=False)]
    # Links: one between neighbouring ends of either side.
    ends = np.sort(np.concatenate([end_a, end_b[~meets_b]]), kind="stable")
    pair = a[np.searchsorted(end_a, ends)] * own.n_b + b[np.searchsorted(end_b, ends)]
    n_links = n_a + n_b - n_groups
    key = np.sort(pair << _DOC_BITS | np.repeat(np.arange(len(texts)), n_links))
    at = np.flatnonzero(np.diff(key, prepend=-1))
    n = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links}
    return Aligned(n, groups, key[at] & ((1 << _DOC_BITS) - 1), key[at] >> _DOC_BITS, np.diff(np.append(at, len(key))))


def _member(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the rising x are in the rising y."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def _run(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Records in the order of (pair, doc) as one compressed run: distinct pairs, documents of each, numbers, times."""
    import zstandard

    first = np.flatnonzero(np.diff(pair, prepend=-1))
    count = np.diff(np.append(first, len(pair)))
    step = np.diff(doc, prepend=0)
    step[first] = doc[first]
    wide = "<u4" if times.max() > 0xFFFF else "<u2"
    head = np.array([len(first), len(pair), int(wide == "<u4")], "<u4")
    parts = [head, np.diff(pair[first], prepend=0).astype("<u4"), count.astype("<u4"), step.astype("<u2"), times.astype(wide)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def _read_run(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, documents of each, document numbers, times."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(run)
    n, m, wide = np.frombuffer(data, "<u4", 3).tolist()
    pair = np.cumsum(np.frombuffer(data, "<u4", n, 12).astype(np.int64))
    count = np.frombuffer(data, "<u4", n, 12 + 4 * n).astype(np.int64)
    step = np.frombuffer(data, "<u2", m, 12 + 8 * n).astype(np.int64)
    times = np.frombuffer(data, "<u4" if wide else "<u2", m, 12 + 8 * n + 2 * m).astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(count) - count
    return pair, count, total - np.repeat(total[first] - step[first], count), times


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order with their sums, by a heap over the heads of the sorted runs."""
    if len(runs) == 1:
        return runs[0]
    lists = [(pair << 32 | count).tolist() for pair, count in runs]
    own = np.fromiter(heapq.merge(*lists), np.int64, sum(map(len, lists)))
    pair = own >> 32
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[first], np.add.reduceat(own & 0xFFFFFFFF, first)


@dataclass
class _Block:
    """Records of the documents since the last runs were written."""

    own: Tokenizers
    parts: int
    number: int
    records: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    docs: int = 0
    size: int = 0

    def add(self, got: Aligned, n: int) -> None:
        part = got.pair // self.own.n_b % self.parts
        self.records.append(part << (_PAIR_BITS + _DOC_BITS) | got.pair << _DOC_BITS | (got.text + self.docs))
        self.times.append(got.times)
        self.docs += n
        self.size += len(got.pair)

    def runs(self) -> Iterator[tuple[int, bytes]]:
        if not self.size:
            return
        records, times = np.concatenate(self.records), np.concatenate(self.times)
        order = np.argsort(records, kind="stable")  # merges what is sorted already
        records, times = records[order], times[order]
        first = np.flatnonzero(np.diff(records, prepend=-1))
        records, times = records[first], np.add.reduceat(times, first)  # parts of a long text share pairs
        part = records >> (_PAIR_BITS + _DOC_BITS)
        edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        for lo, hi in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            pair = records[lo:hi] >> _DOC_BITS & ((1 << _PAIR_BITS) - 1)
            yield int(part[lo]), _run(pair, records[lo:hi] & ((1 << _DOC_BITS) - 1), times[lo:hi])


def _encoded(docs: DataFrame, keep, text: str, a: str, b: str, parts: int, digest: bool) -> DataFrame:
    """Two kinds of rows, stored: a document's figures with its block and number, and the runs of a block."""
    kept = docs.select(*keep)
    made = fresh(keep, *COLUMNS, "_block", "_number", "_part", "_run")
    kinds = [LongType()] * 4 + [StringType(), LongType(), IntegerType(), IntegerType(), BinaryType()]
    schema = StructType([*(StructField(f.name, f.dataType) for f in kept.schema), *(StructField(n, t) for n, t in zip(made, kinds, strict=True))])
    n = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tokenizers(a, b)
        task, made_blocks = TaskContext.get().partitionId(), 0
        block = _Block(own, parts, task << 24)
        arrow = None

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal block, made_blocks
            rows, number = [], block.number
            for part, data in block.runs():
                rows.append((part, data))
                if len(rows) == 64:
                    yield out_runs(rows, number)
                    rows = []
            if rows:
                yield out_runs(rows, number)
            made_blocks += 1
            block = _Block(own, parts, task << 24 | made_blocks)

        def out_runs(rows: list[tuple[int, bytes]], number: int) -> pa.RecordBatch:
            m = len(rows)
            columns = [pa.nulls(m, arrow.field(i).type) for i in range(n + 5)]
            columns += [pa.array([number] * m, pa.int64()), pa.nulls(m, pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            if arrow is None:
                fields = [pa.field(f.name, f.type) for f in list(batch.schema)[:n]]
                arrow = pa.schema([*fields, *(pa.field(c, k) for c, k in zip(made, [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True))])
            m = batch.num_rows
            if block.size >= RECORDS or block.docs + m > DOCUMENTS:
                yield from flushed()
            got = of_rows(pieces.valid(batch.column(n)), own, digest)
            columns = batch.columns[:n]
            columns += [*(pa.array(got.n[c]) for c in COLUMNS[:4]), pa.array(got.groups, pa.string()), pa.array([block.number] * m, pa.int64())]
            columns += [pa.array(np.arange(block.docs, block.docs + m, dtype=np.int32)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            block.add(got, m)
        if arrow is not None:
            yield from flushed()

    return written(docs.select(*keep, F.col(text).alias(fresh(keep, "_text")[0])).mapInArrow(run, schema), "alignment")


def _shares(runs: DataFrame, n_b: int) -> DataFrame:
    """(block, share) of each run: what its documents get from its pairs.  ``runs`` has part, block, run in the order of part."""
    import zstandard

    def counted(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        level: list[tuple[np.ndarray, np.ndarray]] = []
        for _, data in held:
            level.append(_read_run(data)[:2])
            if len(level) == FAN_IN:
                level = [_merged(level)]
        pair, count = _merged(level)
        side = pair // n_b
        first = np.flatnonzero(np.diff(side, prepend=-1))
        most = np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, len(side))))
        is_best = count == most
        pack = zstandard.ZstdCompressor(level=1)
        for block, data in held:
            own, docs, number, times = _read_run(data)
            rows = np.repeat(np.searchsorted(pair, own), docs)
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            best = np.add.reduceat((times * is_best[rows])[order], starts)
            total = np.add.reduceat((times * count[rows])[order], starts)
            share = np.array([len(starts)], "<u4").tobytes() + b"".join(_planes(x) for x in (np.diff(number[order][starts], prepend=0), best, total))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pack.compress(share)], pa.binary())], names=["block", "share"])

    return runs.mapInArrow(_by_key(counted), "block long, share binary")


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, so that the many zeros lie together."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _by_key(made) -> Callable:
    """A stage over rows (key, number, bytes) in the order of the key, which gives ``made`` the rows of one key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for key, number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and key != now:
                    yield from made(held)
                    held = []
                now = key
                held.append((number, data))
        if held:
            yield from made(held)

    return run


def _summed(shares: DataFrame) -> DataFrame:
    """(block, number, best, count) of every document that has tokens; ``shares`` has block twice and share, in the order of block."""
    import zstandard

    def added(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, DOCUMENTS), np.int64)
        for _, data in held:
            plain = zstandard.ZstdDecompressor().decompress(data)
            n = int.from_bytes(plain[:4], "little")
            parts = np.frombuffer(plain, np.uint8, 24 * n, 4).reshape(3, 8, n)
            number, best, total = (np.ascontiguousarray(p.T).view("<i8")[:, 0] for p in parts)
            at = np.cumsum(number)  # each document once
            sums[0][at] += 1
            sums[1][at] += best
            sums[2][at] += total
        at = np.flatnonzero(sums[0])
        block = pa.array(np.full(len(at), held[0][0]))
        yield pa.RecordBatch.from_arrays([block, pa.array(at.astype(np.int32)), pa.array(sums[1][at]), pa.array(sums[2][at])], names=["block", "number", "best", "count"])

    return shares.mapInArrow(_by_key(added), "block long, number int, best long, count long")


def align(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, keep=("doc_id",), text: str = "text", digest: bool = True, parts: int | None = None) -> DataFrame:
    """``keep`` columns and, of every whole text, n_a, n_b, n_groups, n_links, groups (printed as
    ``a1,a2|b1;a3|b2``, or their SHA-256 with ``digest``), n_best (links whose pair has the most documents
    of its A id) and count_sum (documents of the pair, over all links)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    own = Tokenizers(a, b)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(parts or max(LEAST_PARTS, shuffles), MOST_PARTS)
    rows = _encoded(docs, tuple(keep), text, a, b, parts, digest)
    made = rows.columns[len(docs.select(*keep).columns) :]
    block, number, part, data = made[5:]
    runs = rows.filter(F.col(part).isNotNull()).select(F.col(part).alias("part"), F.col(block).alias("block"), F.col(data).alias("run"))
    dealt = runs.repartition(max(shuffles, parts), "part").sortWithinPartitions("part")
    back = _shares(dealt, own.n_b).select("block", F.col("block").alias("_block"), "share").repartition(shuffles, "block").sortWithinPartitions("block")
    best, count = fresh(rows.columns, "n_best", "count_sum")
    sums = _summed(back).toDF(block, number, best, count)
    out = rows.filter(F.col(part).isNull()).join(sums, [block, number], "left").fillna(0, [best, count])
    return out.drop(block, number, part, data)


def digests(docs: DataFrame) -> DataFrame:
    return align(docs).withColumnRenamed("groups", "groups_sha256")
