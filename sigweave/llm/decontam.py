"""Operator 6: benchmark decontamination by winnowing.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.  Both
sides keep the (rightmost) minimum k-gram hash of every window of ``WINDOW`` k-grams, so
every shared span of at least ``SPAN`` = K + WINDOW - 1 words has a kept fingerprint at
the same place on both sides.  A fingerprint is extended to the spans of SPAN words whose
minimum it is, each with a digest of its words (``Prints.spans``).  Fingerprints with their spans are
joined; equal digests are hits, and hits that follow each other are longer shared spans.
Items shorter than SPAN words are one span of all their words.

Scale.  One narrow pass over the documents makes fingerprints; a bitmap of fixed size over
the benchmark's fingerprints (``bitmap``) lets few others through, and an equi-join on
fingerprint and digest decides, so neither side is ever collected.  Items are grouped before the join:
a span is one row with the class of items that hold it, however many those are, so a document
meets each of its spans once.  The items of a document are looked up at the end, by its set of
classes, once for all documents with the same set.  Equal spans of a text are one row with all their places, so a
text of one repeated word is a few rows.  A text that many documents share is joined once, by its digest.  A
benchmark so large that the bitmap fills up only sends more spans (about one for each
word, 40 bytes each) through the shuffle of the join.  The list of a span's items is held
in one row, so it is bounded by the number of items in the benchmark.

Defined cases: a null or empty text has no words and no hits; an item without words
never occurs; a null item_id is written as an empty string; repeated items with one id
count once; repeated documents are judged each.  Extra columns are ignored unless named
in ``keep``; a column this operator makes gets underscores behind its name if it clashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap, passing
from .session import arrow_batches, fresh, written
from .textbytes import ALNUM, Words, grams, mix, slices, text_bytes, whole

SPAN = 13
K = 8
WINDOW = SPAN - K + 1
_SPAN_ROW = "key:long,n:int,w1:long,w2:long"
_FOUND = f"array<struct<{_SPAN_ROW},places:array<int>>>"
_FOUND_ARROW = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("places", pa.list_(pa.int32()))]))


def minima(hashes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window of k-grams the rightmost place of the least one, and that k-gram's hash."""
    g = grams(hashes, k)
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, which = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        lower = g[j : j + n] <= least
        which[lower] = j
        np.minimum(least, g[j : j + n], out=least)
    return np.arange(n) + which, least


def winnow(hashes: np.ndarray, text_of_word: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are the rightmost minimum of some window inside one text."""
    place, _ = minima(hashes, k, window)
    at = np.unique(place[whole(text_of_word, k + window - 1)])
    return at, grams(hashes, k)[at] if len(at) else np.zeros(0, np.uint64)


class Prints:
    """Fingerprints of a few texts, extended to spans."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts, ALNUM, lower=True)
        self.first, self.counts, self.hashes, self.text = words.first, words.counts, words.hashes(), words.text_of_word()
        self.other = mix(self.hashes ^ np.uint64(0xD1B54A32D192ED03))

    def spans(self, n: int, span: int, k: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place and fingerprint of every span of n words inside a text (of the texts ``only``).

        A whole span's fingerprint is its winnowed k-gram, a shorter one's a hash of its words and n.
        """
        at = np.flatnonzero(whole(self.text, n))
        if only is not None:
            at = at[only[self.text[at]]]
        if n == span:
            return at, minima(self.hashes, k, span - k + 1)[1][at]
        return at, mix(grams(self.hashes, n)[at] + np.uint64(n))

    def rows(self, at: np.ndarray, keys: np.ndarray, n: int) -> Iterator[tuple[int, dict]]:
        """(text, span) with the places of each distinct span of a text; a digest has 128 bits."""
        if not len(at):
            return
        digest = [grams(h, n)[at].astype(np.int64) for h in (self.hashes, self.other)]
        text = self.text[at]
        order = np.lexsort((at, digest[1], digest[0], text))
        new = np.zeros(len(at), bool)
        for x in (text, *digest):
            own = x[order]
            new |= np.concatenate([[True], own[1:] != own[:-1]])
        place = (at - self.first[text])[order].astype(np.int32)
        edges = np.append(np.flatnonzero(new), len(at)).tolist()
        for lo, hi in zip(edges, edges[1:], strict=False):
            i = order[lo]
            row = {"key": int(keys[i].astype(np.int64)), "n": n, "w1": int(digest[0][i]), "w2": int(digest[1][i]), "places": place[lo:hi]}
            yield int(text[i]), row


def _items(span: int, k: int) -> Callable:
    """(item_id, text) of the benchmark to (item_id, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            out: list[tuple] = []
            for lo, hi in slices(texts):
                prints = Prints(texts[lo:hi])
                sizes = [span, *(n for n in np.unique(prints.counts).tolist() if 0 < n < span)]
                for n in sizes:
                    for t, r in prints.rows(*prints.spans(n, span, k, None if n == span else prints.counts == n), n):
                        out.append((ids[lo + t], r["key"], n, r["w1"], r["w2"]))
            columns = list(zip(*out, strict=True)) if out else ([],) * 5
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item_id", "key", "n", "w1", "w2"])

    return run


def _documents(words, sizes: list[int], n_keep: int, span: int, k: int, names: list[str]) -> Callable:
    """(kept columns, rid, text) to (kept columns, rid, n_words, spans whose fingerprints the bitmap knows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(n_keep + 1))
            n_words, found = np.zeros(len(texts), np.int64), [[] for _ in texts]
            for lo, hi in slices(texts):
                prints = Prints(texts[lo:hi])
                n_words[lo:hi] = prints.counts
                for n in [span, *sizes]:
                    at, keys = prints.spans(n, span, k)
                    near = passing(words.value, keys)
                    for t, r in prints.rows(at[near], keys[near], n):
                        found[lo + t].append(r)
            arrays = [*batch.columns[: n_keep + 1], pa.array(n_words), pa.array(found, _FOUND_ARROW)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, classes, hits (n, places)) to (rid, covered ranges as start, end, start, end ..., classes)."""
    for batch in batches:
        ranges = []
        for hits in batch.column(2).to_pylist():
            start = np.concatenate([np.array(h["places"]) for h in hits])
            end = np.concatenate([np.array(h["places"]) + h["n"] for h in hits])
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
            ranges.append(np.stack([start[new], end[np.append(new[1:], len(end)) - 1]], 1).ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranges, pa.list_(pa.int64())), batch.column(1)], names=["rid", "ranges", "classes"])


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _scan(docs: DataFrame, benchmark: DataFrame, keep, text: str, item: str, item_text: str, span: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(kept columns, rid, n_words) of every document, and (rid, ranges, items) of the texts that are hit."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item_id"), F.col(item_text).alias("text"))
    spans = ["key", "n", "w1", "w2"]
    items = rows.mapInArrow(_items(span, k), "item_id string, key long, n int, w1 long, w2 long")
    # Spans with the same items are of one class, which the digest of the items names.
    items = items.groupBy(spans).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    items = written(items.withColumn("class", F.sha2(F.to_json(F.struct("items")), 256)), "decontam-items")
    classes = items.select("class", "items").dropDuplicates(["class"])
    words = spark.sparkContext.broadcast(bitmap(items))
    sizes = [r.n for r in items.select("n").distinct().filter(F.col("n") < span).collect()]  # fewer than span
    source, rid, count, found = fresh(keep, "_text", "_rid", "_n_words", "_found")
    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"{rid} string, {count} long, {found} {_FOUND}"])
    made = docs.select(*keep, digest(F.col(text)).alias(rid), F.col(text).alias(source))
    made = written(made.mapInArrow(_documents(words, sorted(sizes), len(keep), span, k, [*kept.columns, rid, count, found]), schema), "decontam-rows")
    near = made.filter(F.size(found) > 0).groupBy(F.col(rid).alias("rid")).agg(F.first(found).alias("found"))
    near = near.select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    hits = near.join(items.select(*spans, "class"), spans).groupBy("rid").agg(
        F.array_sort(F.collect_set("class")).alias("classes"), F.collect_list(F.struct("n", "places")).alias("hits")
    )
    hits = hits.mapInArrow(_merged, "rid string, ranges array<long>, classes array<string>")
    hits = written(hits.withColumn("set", F.sha2(F.array_join("classes", ","), 256)), "decontam-hits")
    sets = hits.select("set", "classes").dropDuplicates(["set"]).select("set", F.explode("classes").alias("class"))
    sets = sets.join(classes, "class").groupBy("set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return made.drop(found), hits.join(sets, "set").select("rid", "ranges", "items")


def find(
    docs: DataFrame, benchmark: DataFrame, keep=("doc_id",), text: str = "text", item: str = "item_id",
    item_text: str = "text", span: int = SPAN, k: int = K,
) -> DataFrame:
    """``keep`` columns, n_words, hit_ranges (word start, end, ...) and hit_items of every document."""
    rows, hits = _scan(docs, benchmark, keep, text, item, item_text, span, k)
    rid, count = rows.columns[len(keep) :]
    names = fresh(keep, "n_words", "hit_ranges", "hit_items")
    theirs, ranges, items = fresh(rows.columns, "_hit_rid", "_hit_ranges", "_hit_items")
    hits = hits.select(F.col("rid").alias(theirs), F.col("ranges").alias(ranges), F.col("items").alias(items))
    return rows.join(hits, F.col(rid) == F.col(theirs), "left").select(
        *keep, F.col(count).alias(names[0]), F.coalesce(ranges, F.array().cast("array<long>")).alias(names[1]),
        F.coalesce(items, F.array().cast("array<string>")).alias(names[2]),
    )


def verdicts(found: DataFrame, keep=("doc_id",)) -> DataFrame:
    """Digest columns behind ``keep``: n_words, n_hit, n_items, items_sha256 and contaminated."""
    n_words, ranges, items = found.columns[len(keep) :]
    ends = F.filter(ranges, lambda _, i: i % 2 == 1)
    starts = F.filter(ranges, lambda _, i: i % 2 == 0)
    n_hit = F.aggregate(F.zip_with(ends, starts, lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    hit, count, sha, bad = fresh(found.columns, "n_hit", "n_items", "items_sha256", "contaminated")
    out = found.select(
        *keep, n_words, n_hit.alias(hit), F.size(items).cast("long").alias(count),
        F.sha2(F.array_join(items, ","), 256).alias(sha),
    )
    return out.withColumn(bad, (F.col(hit) > 0) & (20 * F.col(hit) >= F.col(n_words)))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    rows, hits = _scan(docs, benchmark, (), "text", "item_id", "text", SPAN, K)
    hit = rows.select(F.col("_rid").alias("rid"), F.col("_n_words").alias("n_words")).join(hits, "rid").dropDuplicates(["rid"])
    judged = verdicts(hit.select("rid", "n_words", "ranges", "items"), ("rid",))
    key = fresh(docs.columns, "_key")[0]
    bad = written(judged.filter("contaminated").select(F.col("rid").alias(key)), "decontam-rejected")
    return docs.withColumn(key, digest(F.col("text"))).join(bad, key, "left_anti").select(*docs.columns)
