"""Operator 9: n-gram Jaccard join with Bayesian candidate pruning.

Words are what white space separates; a text's set holds its 5-word shingles (a shorter
text is one shingle).  Texts with the same words are one class of copies, with one
representative.  Representatives get 16-bit MinHash values in ``BANDS`` bands of ``ROWS``
(at Jaccard 0.8 a pair misses all bands with probability (1 - 0.8^4)^30 = 1.4e-7).  Pairs
that meet in a band are compared step by step on their MinHash values; a pair is dropped
once the posterior probability (uniform prior) that its similarity reaches the threshold
falls below ``TOLERANCE``.  Survivors are verified exactly on their shingle sets.

Scale.  Pairs are never rows.  A band bucket is cut into tiles of at most about ``TILE``
texts and ``TILE_SHINGLES`` shingles, and every pair of tiles is one group of rows, so no
task holds an unbounded bucket; a pair counts in its first common band only.  Pruning
returns the texts that still need a check in a group.  A bitmap of fixed size over their
digests thins the documents before one representative of each text is joined exactly and
turned into shingles; the plan is the same at every size.  Verification returns, per text,
its number of links and a root of the group's spanning forest.  Components of these edges
are the classes.  Exact copies never multiply: they are grouped before any comparison.

Defined cases: a null text or a null doc_id is a class of its own, without links and
copies (class_id is the doc_id); texts without words are copies of each other and have
no links; repeated rows are copies; rows that share a doc_id but not their words are
judged apart.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap, passing
from .components import components
from .session import arrow_batches, fresh, written
from .textbytes import SPACED, Words, grams, mix, slices, text_bytes

SHINGLE = 5
THRESHOLD = 0.8
ROWS = 4
BANDS = 30
HASHES = ROWS * BANDS
STEP = 16
TOLERANCE = 1e-9
#: Texts and shingles of a tile; a task compares two tiles at a time.
TILE = 512
TILE_SHINGLES = 1 << 19

_A = np.random.RandomState(7).randint(1, 2**63 - 1, HASHES, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_CHUNK = 1 << 15


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP) -> list[tuple[int, int]]:
    """(n, fewest matches among the first n values that keep a pair).

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in [*range(step, HASHES, step), HASHES]:
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def word_digest(text: Column) -> Column:
    """Digest of a text's words: equal for texts that differ in white space only."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))))


def _shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and the place of each text's first; texts without words have none."""
    words = Words(texts, SPACED, lower=False)
    n, begin, h = words.counts, words.first, words.hashes()
    del words
    count = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    out = np.empty(first[-1], np.uint64)
    g = grams(h, SHINGLE)
    long = n >= SHINGLE
    if long.all():
        inside = np.ones(len(g), bool)
        for at in begin[1:-1]:  # shingles across a border of texts
            inside[at - SHINGLE + 1 : at] = False
        out[:] = g[inside]
        return out, first
    for i in np.flatnonzero(n):
        if long[i]:
            out[first[i] : first[i + 1]] = g[begin[i] : begin[i + 1] - SHINGLE + 1]
        else:
            out[first[i]] = grams(h[begin[i] : begin[i + 1]], int(n[i]))[0] ^ np.uint64(n[i])
    return out, first


def _sketches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit MinHash values, one row per text (zeros for texts without words), and numbers of shingles."""
    values, first = _shingle_hashes(texts)
    out = np.zeros((len(texts), HASHES), np.uint16)
    count = np.diff(first)
    have = np.flatnonzero(count)
    i = 0
    while i < len(have):  # some texts at a time, so that the values stay in the CPU's cache
        j = i + 1
        while j < len(have) and first[have[j] + 1] - first[have[i]] <= _CHUNK:
            j += 1
        lo, hi = first[have[i]], first[have[j - 1] + 1]
        part, starts = values[lo:hi], first[have[i:j]] - lo
        buffer = np.empty_like(part)
        least = np.empty((HASHES, j - i), np.uint64)
        for p in range(HASHES):
            np.multiply(part, _A[p], out=buffer)
            least[p] = np.minimum.reduceat(buffer, starts)
        out[have[i:j]] = (mix(least) >> np.uint64(48)).astype(np.uint16).T
        i = j
    return out, count


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, rid, text) to (doc_id, rid, sketch, number of shingles)."""
    for batch in batches:
        texts = text_bytes(batch.column(2))
        sketches: list[bytes | None] = []
        count = np.zeros(len(texts), np.int64)
        for lo, hi in slices(texts):
            rows, count[lo:hi] = _sketches(texts[lo:hi])
            sketches += [r.tobytes() if n else None for r, n in zip(rows, count[lo:hi], strict=True)]
        arrays = [batch.column(0), batch.column(1), pa.array(sketches, pa.binary()), pa.array(count)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "rid", "sketch", "n_shingles"])


def _first_common(keys_a: np.ndarray, keys_b: np.ndarray, band: int) -> np.ndarray:
    """Whether two rows of band keys are equal in ``band`` and differ in every earlier band."""
    ok = keys_a[..., band] == keys_b[..., band]
    for k in range(band):
        ok &= keys_a[..., k] != keys_b[..., k]
    return ok


def _alive(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Places of the pairs (row of a, row of b) that no step drops."""
    left, seen, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in steps:
        seen = seen + (a[left, done:n] == b[left, done:n]).sum(1, dtype=np.int32)
        stay = seen >= least
        left, seen, done = left[stay], seen[stay], n
        if not len(left):
            break
    return left


def _pairs(band: int, sketches: np.ndarray, side: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of one group; groups of two tiles pair rows of different tiles only."""
    n = len(sketches)
    keys = np.ascontiguousarray(sketches).view(np.uint64)
    crossed = side.min() != side.max()
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    width = max(1, (1 << 20) // n)
    for lo in range(0, n, width):
        rows = np.arange(lo, min(n, lo + width))
        ok = _first_common(keys[rows, None, :], keys[None, :, :], band)
        ok &= rows[:, None] < np.arange(n)[None, :]
        if crossed:
            ok &= side[rows, None] != side[None, :]
        i, j = np.nonzero(ok)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)] + lo, j[at : at + (1 << 16)]
            keep = _alive(sketches[a], sketches[b], steps)
            out_i.append(a[keep])
            out_j.append(b[keep])
    return np.concatenate(out_i), np.concatenate(out_j)


def _groups(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined so that each holds whole groups (rows are sorted by the first ``n_key`` columns)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(n_key)], 1)
        last = len(keys) - 1
        change = np.flatnonzero((keys != keys[last]).any(1))
        cut = change[-1] + 1 if len(change) else 0
        if held and (cut or not np.array_equal(keys[0], _key(held[-1], -1, n_key))):
            if cut == 0:
                yield pa.concat_batches(held)
                held = []
            else:
                yield pa.concat_batches([*held, batch.slice(0, cut)])
                held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _key(batch: pa.RecordBatch, row: int, n_key: int) -> np.ndarray:
    return np.array([batch.column(c)[row if row >= 0 else batch.num_rows + row].as_py() for c in range(n_key)])


def _edges_of_groups(batch: pa.RecordBatch, n_key: int) -> np.ndarray:
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(n_key)], 1)
    change = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
    return np.concatenate([[0], change, [len(keys)]])


def _fixed(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


_KEYS = ("bucket", "tile_a", "tile_b")


def _prune(steps) -> Callable:
    """(bucket, tiles, band, tile, rid, sketch) to the rows that take part in a surviving pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, len(_KEYS)):
            border = _edges_of_groups(batch, len(_KEYS))
            sketches = _fixed(batch.column(6), np.uint16)
            band, tile = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            wanted = np.zeros(batch.num_rows, bool)
            size = np.diff(border)
            twos = border[:-1][size == 2]  # most groups: all at once
            if len(twos):
                keys = sketches.view(np.uint64)
                same = keys[twos] == keys[twos + 1]
                ok = same.argmax(1) == band[twos]
                ok &= same.any(1) & ((tile[twos] != tile[twos + 1]) | _one_tile(batch, twos))
                twos = twos[ok]
                twos = twos[_alive(sketches[twos], sketches[twos + 1], steps)]
                wanted[twos] = wanted[twos + 1] = True
            for lo, hi in zip(border[:-1][size > 2], border[1:][size > 2], strict=True):
                side = tile[lo:hi] if not _one_tile(batch, np.array([lo]))[0] else np.zeros(hi - lo, np.int32)
                if side.min() == side.max() and not _one_tile(batch, np.array([lo]))[0]:
                    continue
                i, j = _pairs(int(band[lo]), sketches[lo:hi], side, steps)
                wanted[lo + i] = wanted[lo + j] = True
            yield batch.filter(pa.array(wanted))

    return run


def _one_tile(batch: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    return batch.column(1).to_numpy()[rows] == batch.column(2).to_numpy()[rows]


def _linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Exact check of the pairs (i, j) of shingle sets, i sorted."""
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(names), bool)
    out = np.zeros(len(i), bool)
    border = np.flatnonzero(np.diff(i, prepend=-1))
    for lo, hi in zip(border, np.append(border[1:], len(i)), strict=True):
        own = flat[first[i[lo]] : first[i[lo] + 1]]
        mark[own] = True
        n = size[j[lo:hi]]
        starts = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(starts - first[j[lo:hi]], n)
        both = np.add.reduceat(mark[flat[at]].astype(np.int64), starts)
        union = len(own) + n - both
        out[lo:hi] = both >= np.ceil(threshold * union - 1e-9)
        mark[own] = False
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _verify(steps, threshold: float) -> Callable:
    """The rows of ``_prune`` with shingles, to (rid, root, n_links) of each group."""
    names = ["rid", "root", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, len(_KEYS)):
            border = _edges_of_groups(batch, len(_KEYS))
            sketches, rid = _fixed(batch.column(6), np.uint16), batch.column(5).to_pylist()
            band, tile = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            one = _one_tile(batch, np.arange(batch.num_rows))
            shingles = batch.column(7).to_pylist()
            out: list[tuple] = []
            for lo, hi in zip(border[:-1], border[1:], strict=True):
                if hi - lo < 2:
                    continue
                side = np.zeros(hi - lo, np.int32) if one[lo] else tile[lo:hi]
                i, j = _pairs(int(band[lo]), sketches[lo:hi], side, steps)
                order = np.lexsort((j, i))
                i, j = i[order], j[order]
                if not len(i):
                    continue
                ok = _linked([np.frombuffer(s, np.uint64) for s in shingles[lo:hi]], i, j, threshold)
                i, j = i[ok], j[ok]
                n = np.bincount(i, minlength=hi - lo) + np.bincount(j, minlength=hi - lo)
                root = _roots(hi - lo, i, j)
                out += [(rid[lo + k], rid[lo + root[k]], int(n[k])) for k in np.flatnonzero(n)]
            columns = list(zip(*out, strict=True)) if out else ([], [], [])
            types = (pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _wanted(words) -> Callable:
    """The (rid, text) of (rid, key, text) whose key the bitmap knows, one of each rid in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy().view(np.uint64)
            at = np.flatnonzero(passing(words.value, keys))
            at = at[np.unique(keys[at], return_index=True)[1]]
            yield batch.select([0, 2]).take(pa.array(at))

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) to (rid, shingles)."""
    for batch in batches:
        texts = text_bytes(batch.column(1))
        sets = []
        for lo, hi in slices(texts):
            values, first = _shingle_hashes(texts[lo:hi])
            sets += [np.unique(values[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rid", "shingles"])


def _shingle_sets(texts: DataFrame, flagged: DataFrame) -> DataFrame:
    """(rid, shingles) of the flagged texts, each from one of its rows."""
    spark = texts.sparkSession
    rids = flagged.select("rid").distinct()
    words = spark.sparkContext.broadcast(bitmap(rids.select(F.xxhash64("rid").alias("key"))))
    near = texts.select("rid", F.xxhash64("rid").alias("key"), "text").mapInArrow(_wanted(words), "rid binary, text string")
    one = near.groupBy("rid").agg(F.first("text").alias("text"))
    return one.join(rids, "rid", "left_semi").mapInArrow(_shingled, "rid binary, shingles binary")


def _usable(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(doc_id).alias("doc_id"), word_digest(F.col(text)).alias("rid"), F.col(text).alias("text"))


def _tiled(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """(bucket, tile_a, tile_b, band, tile, rid): each text of a bucket once for every tile it meets."""
    met = met.join(sizes, "rid")
    load = met.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    tiles = F.ceil(F.greatest(F.col("n") / TILE, F.col("w") / TILE_SHINGLES)).cast("int")
    placed = met.join(load.select("bucket", tiles.alias("tiles")), "bucket")
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return placed.select("bucket", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), "band", "tile", "rid")


def _members(texts: DataFrame, id_type: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid) of each row, and (rid, root, first_id, n_links, n_copies) of texts with links or copies."""
    spark = texts.sparkSession
    arrow_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = least_matches(threshold)
    made = texts.mapInArrow(_features, f"doc_id {id_type}, rid binary, sketch binary, n_shingles long")
    rows = written(made, "jaccard-rows")
    distinct = rows.groupBy("rid").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")
    )
    sketches = distinct.filter(F.col("sketch").isNotNull()).select("rid", "sketch")

    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring("sketch", b * 8 + 1, F.lit(8))))
    bands = sketches.select("rid", at.alias("band", "key")).select(
        "rid", "band", F.xxhash64("band", "key").alias("bucket")
    )
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    met = written(bands.join(shared, "bucket"), "jaccard-met")
    placed = _tiled(met, distinct.select("rid", "n_shingles"))
    placed = placed.join(sketches, "rid").select(*_KEYS, "band", "tile", "rid", "sketch")
    grouped = placed.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS)
    flagged = written(grouped.mapInArrow(_prune(steps), placed.schema), "jaccard-flagged")

    full = flagged.join(_shingle_sets(texts, flagged), "rid").select(*_KEYS, "band", "tile", "rid", "sketch", "shingles")
    full = full.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS)
    links = written(full.mapInArrow(_verify(steps, threshold), "rid binary, root binary, n_links long"), "jaccard-links")

    count = links.groupBy("rid").agg(F.sum("n_links").alias("n_links"))
    roots = components(links.select(F.hex("rid").alias("a"), F.hex("root").alias("b")))
    member = distinct.select("rid", "first_id", "n_copies").join(count, "rid", "left")
    member = member.filter("n_copies > 1 or n_links is not null").withColumn("node", F.hex("rid"))
    member = member.join(roots, "node", "left").select("rid", F.coalesce("root", "node").alias("root"), "first_id", "n_links", "n_copies")
    return rows.select("doc_id", "rid"), written(member, "jaccard-members")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row.

    ``class_id`` is the least doc_id of the row's component of links and copies,
    ``n_links`` the number of other different texts with similarity of ``threshold`` or
    more, ``n_copies`` the number of rows with the same words, itself included.
    """
    rows, member = _members(_usable(docs, doc_id, text), docs.schema[doc_id].dataType.simpleString(), threshold)
    least = member.groupBy("root").agg(F.min("first_id").alias("class_id"))
    member = member.join(least, "root").select("rid", "class_id", "n_links", "n_copies")
    known = rows.join(member, "rid", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )
    alone = docs.filter(F.col(doc_id).isNull() | F.col(text).isNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(doc_id).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")
    )
    return known.unionByName(alone)


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with its own columns: a row of the least doc_id, of several with that id one with the least digest of words.

    Of rows that repeat that doc_id and those words one stays, by the hash of all columns.
    """
    rows, member = _members(_usable(docs, doc_id, text), docs.schema[doc_id].dataType.simpleString(), threshold)
    best = member.groupBy("root").agg(F.min(F.struct(F.col("first_id").alias("doc_id"), "rid")).alias("best"))
    stays = (F.col("doc_id") == F.col("best.doc_id")) & (F.col("rid") == F.col("best.rid"))
    others = rows.join(member.select("rid", "root"), "rid").join(best, "root").filter(~stays).select("doc_id", "rid").distinct()
    key, digest = fresh(docs.columns, "_key", "_digest")
    others = written(others.select(F.col("doc_id").alias(key), F.col("rid").alias(digest)), "jaccard-others")
    order = F.xxhash64(*(F.to_json(c) if _is_map(docs, c) else F.col(c) for c in docs.columns))
    named = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    named = named.groupBy(F.col(doc_id).alias(key), word_digest(F.col(text)).alias(digest)).agg(F.min_by(F.struct(*docs.columns), order).alias("r"))
    # The grouping has dealt the documents by the keys of this join, so only the other side moves.
    kept = named.join(others, [key, digest], "left_anti").select("r.*")
    return kept.unionByName(docs.filter(F.col(doc_id).isNull() | F.col(text).isNull()))


def _is_map(docs: DataFrame, column: str) -> bool:
    return "map<" in docs.schema[column].dataType.simpleString()
