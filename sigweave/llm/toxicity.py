"""Operator 7: toxicity by averaged subword embeddings under a linear softmax.

A word's vector is the mean of its character n-gram embeddings and its own; a text's
vector is the mean of its words'; a linear softmax gives the score.  Each embedding counts
by the log ratio of its n-gram's shares of the toxic and the clean training texts (as naive
Bayes would weigh it), so that a few dozen toxic texts teach which words matter.  Embeddings and
softmax are trained jointly in numpy by Adagrad on the driver, on at most
``MAX_ROWS`` labelled rows per class (those with the least hash of doc_id, of at most
``MAX_BYTES`` each) that are not held out.  For scoring, embeddings and softmax fold into
one value per n-gram bucket (a fixed size of 2^17 floats, broadcast), and whole texts are
scored in one narrow Arrow stage.

Defined cases: a null or empty text scores as the model's bias; a null doc_id is not held
out and never learned from; labels without a value are ignored; of several labels of one
doc_id the largest counts, of several texts of one doc_id one is learned (by its hash); without any labels, or with one class only, every score is next to 0 or 1.  Extra columns pass
through if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .session import arrow_batches, fresh
from .subwords import BITS, Bag, lowered
from .textbytes import slices

MAX_ROWS = 3000
MAX_BYTES = 100_000
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.5
#: Features of a single training text are left out, whatever the number of texts; they only learn it by heart.
LEAST_TEXTS = 2
#: Factor of the mean vectors: few texts mean few steps, which must still move the score of a word in few of them.
SCALE = 20.0
SIZES = (3, 4, 5, 6)
CUT = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def drawn(rows: DataFrame, n: int, total: int, key: str = "doc_id") -> DataFrame:
    """The n rows of least hash; a threshold on the hash leaves about 1.5 n of ``total`` rows to order, whatever the input."""
    place = F.xxhash64(key)
    if total > 2 * n:
        rows = rows.filter(place < F.lit(int(-(2**63) + 2**64 * 1.5 * n / total)))
    return rows.orderBy(place, key).limit(n)


@dataclass
class Model:
    """One value per bucket, and a bias, for the log odds."""

    table: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi in slices(texts):
            bag = Bag(texts[lo:hi], SIZES)
            out[lo:hi] = bag.text_means(bag.word_values(self.table))
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -50, 50)))


def _entries(texts: list[bytes], labels: np.ndarray, least: int):
    """Weighted sparse mean vectors without the buckets of fewer than ``least`` texts.

    Used buckets, their weights, entries, their values, first entry of each text.

    Small slices, and a first pass that only counts, keep what the driver holds small.
    """

    def merged() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for lo, hi in slices(texts, 1 << 18):
            text, bucket, weight = Bag(texts[lo:hi], SIZES).vectors()
            pair, inverse = np.unique(text << BITS | bucket, return_inverse=True)
            yield lo, hi, pair, (np.bincount(inverse, weight) * SCALE).astype(np.float32)

    often, total = np.zeros((2, 1 << BITS), np.int64), 0
    for lo, hi, pair, _ in merged():
        bucket, label = pair & ((1 << BITS) - 1), labels[lo:hi][pair >> BITS]
        for value in (0, 1):
            often[value] += np.bincount(bucket[label == value], minlength=1 << BITS)
        total += len(pair)
    keep = often.sum(0) >= least
    share = (often + 0.5) / (np.bincount(labels, minlength=2) + 1)[:, None]
    ratio = np.abs(np.log(share[1] / share[0])).astype(np.float32)
    used = np.flatnonzero(keep)
    rank = np.cumsum(keep, dtype=np.int32) - 1
    count, at = np.zeros(len(texts), np.int64), 0
    entry, value = np.empty(total, np.int32), np.empty(total, np.float32)  # only the part that is filled takes memory
    for lo, hi, pair, weight in merged():
        bucket = pair & ((1 << BITS) - 1)
        own = keep[bucket]
        count[lo:hi] += np.bincount((pair >> BITS)[own], minlength=hi - lo)
        n = int(own.sum())
        entry[at : at + n], value[at : at + n] = rank[bucket[own]], (weight * ratio[bucket])[own]
        at += n
    return used, ratio[used], entry[:at], value[:at], np.concatenate([[0], np.cumsum(count)])


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, least_texts: int = LEAST_TEXTS, seed: int = 1) -> Model:
    """Joint training of embeddings and softmax."""
    rng = np.random.RandomState(seed)
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(1 << BITS), -50.0 if not len(texts) or labels.max() == 0 else 50.0)
    used, ratio, bucket, weight, first = _entries(texts, labels, least_texts)
    emb = (rng.uniform(-1, 1, (len(used), DIMENSIONS)) / DIMENSIONS).astype(np.float32)
    emb_sq = np.full(len(used), 1e-8, np.float32)
    soft = rng.uniform(-1, 1, (DIMENSIONS, 2)).astype(np.float32)
    soft_sq = np.full_like(soft, 1e-4)
    bias, bias_sq = np.zeros(2, np.float32), np.full(2, 1e-4, np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(np.flatnonzero(np.diff(first)))
        for at in range(0, len(order), 32):
            docs = order[at : at + 32]
            n = first[docs + 1] - first[docs]
            take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[docs], n)
            own, w = bucket[take], weight[take]
            starts = np.cumsum(n) - n
            mean = np.add.reduceat(emb[own] * w[:, None], starts)
            z = mean @ soft + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            d = (p - target[docs]) / len(docs)
            back = d @ soft.T
            g_soft, g_bias = mean.T @ d, d.sum(0)
            places, inverse = np.unique(own, return_inverse=True)
            row = np.repeat(back, n, axis=0) * w[:, None]
            g = np.stack([np.bincount(inverse, row[:, k], len(places)) for k in range(DIMENSIONS)], 1)
            emb_sq[places] += (g * g).mean(1)
            emb[places] -= rate * g / np.sqrt(emb_sq[places])[:, None]
            soft_sq += g_soft**2
            soft -= rate * g_soft / np.sqrt(soft_sq)
            bias_sq += g_bias**2
            bias -= rate * g_bias / np.sqrt(bias_sq)
    table = np.zeros(1 << BITS)
    table[used] = SCALE * ratio * (emb @ (soft[:, 1] - soft[:, 0]))
    return Model(table, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = MAX_ROWS, size: int = MAX_BYTES) -> Model:
    """Learn from a bounded sample of labelled rows that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    many = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = many.get(1, 0) / max(1, sum(many.values()))
    sample = None
    for value in (0, 1):
        part = drawn(known.filter(F.col("toxic") == value), rows, many.get(value, 0))
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.filter(F.col("text").isNotNull() & (F.octet_length("text") <= size) & ~held_out()).select("doc_id", "text")
    own = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = own.orderBy("doc_id").toArrow()  # at most 2 * rows rows
    labels_drawn = got.column("toxic").to_numpy().astype(np.int64)
    model = train(lowered(got.column("text").combine_chunks()), labels_drawn)
    if len(labels_drawn) and 0 < labels_drawn.mean() < 1 and 0 < share < 1:
        drawn_share = labels_drawn.mean()  # classes are drawn evenly: back to their share among all labels
        model.bias += float(np.log(share / (1 - share)) - np.log(drawn_share / (1 - drawn_share)))
    return model


def _scorer(model, n_keep: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.scores(lowered(batch.column(n_keep)))
            new = [pa.array(score), pa.array((score >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *new], names=names)

    return run


def score(docs: DataFrame, model: Model, keep=("doc_id",), text: str = "text", names=("score", "predicted")) -> DataFrame:
    """``keep`` columns, the score and the prediction of every whole text."""
    spark = docs.sparkSession
    arrow_batches(spark)
    kept = docs.select(*keep)
    added = [StructField(n, t) for n, t in zip(fresh(keep, *names), (DoubleType(), IntegerType()), strict=True)]
    schema = StructType([*kept.schema, *added])
    shared = spark.sparkContext.broadcast(model)
    return docs.select(*keep, F.col(text).alias(fresh(keep, "_text")[0])).mapInArrow(_scorer(shared, len(keep), schema.names), schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't reject, with their own columns."""
    marked = score(docs, fit(docs, labels), docs.columns)
    return marked.filter(F.col(marked.columns[-1]) == 0).select(*docs.columns)
