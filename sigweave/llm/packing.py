"""Operator 5: length buckets that minimise padding, and token-budget batches inside them.

A text's length is its number of tokens: runs of letters and digits, and single other
marks.  Spark counts a global histogram of lengths over at most ``MAX_BINS`` bins (exact
to ``EXACT``, then ``PER_OCTAVE`` bins per doubling), so its size is bounded whatever the
input; a bin stands for its longest row.  Dynamic programming over the bins finds the
bucket boundaries with the least total padding (each row is padded to its bucket's longest
row).  Within a bucket, rows are numbered and cut into batches of floor(budget / boundary)
rows, one at least.

Scale.  One narrow pass counts tokens; numbering uses a range partitioning by (bucket,
hash, random tie), a count per partition and bucket, and a running sum over those counts,
so no bucket is ordered in one task, nor are the rows of one doc_id.

Defined cases: a null or empty text has 0 tokens and goes to the first bucket; rows of one
doc_id, and of null ids, are in random order among each other and get different numbers;
an empty table gives no rows.  A row longer than the budget is a batch by itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import written

TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
BUCKETS = 16
BUDGET = 32768
EXACT = 512
PER_OCTAVE = 64
MAX_BINS = EXACT + PER_OCTAVE * 50


def tokens(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN)).cast("long")


def bin_edge(length: Column) -> Column:
    """The upper edge of a length's bin: itself up to EXACT, else the next step of its octave."""
    octave = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")))
    step = F.greatest(F.pow(F.lit(2.0), octave) / PER_OCTAVE, F.lit(1.0))
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step).cast("long"))


def boundaries(edges: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Optimal bucket boundaries (a subset of the edges, the last included) and their padding.

    cost(i, j) pads bins i..j to edge j.  Layer by layer, best[k][j] = min over i of
    best[k - 1][i] + cost(i + 1, j); splits are monotone, so each layer is divided and conquered.
    """
    n = len(edges)
    if not n:
        return [], 0
    c = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    t = np.concatenate([[0.0], np.cumsum(totals, dtype=float)])

    def cost(i, j):  # bins i .. j - 1
        return edges[j - 1] * (c[j] - c[i]) - (t[j] - t[i])

    best = np.array([0.0] + [cost(0, j) for j in range(1, n + 1)])
    cuts = []
    for _ in range(min(buckets, n) - 1):
        new, cut = best.copy(), np.full(n + 1, -1)
        stack = [(1, n, 0, n)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            v = best[i] + cost(i, j)
            k = int(v.argmin())
            if v[k] < new[j]:
                new[j], cut[j] = v[k], i[k]
            stack += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        cuts.append(cut)
        best = new
    out, j = [], n
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            out.append(int(edges[j - 1]))
            j = cut[j]
    if j:
        out.append(int(edges[j - 1]))
    return out[::-1], int(round(best[n]))


def histogram(lengths: DataFrame, length: str = "n_tokens") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest length, the number of rows and the tokens of each bin."""
    rows = lengths.groupBy(bin_edge(F.col(length))).agg(F.max(length).alias("edge"), F.count("*").alias("n"), F.sum(length).alias("t"))
    got = rows.select("edge", "n", "t").orderBy("edge").limit(MAX_BINS + 1).collect()
    if len(got) > MAX_BINS:
        raise ValueError("more length bins than MAX_BINS")
    return tuple(np.array([r[k] for r in got], float) for k in range(3))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_tokens, batch (number in its bucket) and slot of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("n_tokens"), F.xxhash64(doc_id).alias("h"), F.rand(5).alias("tie"))
    rows = written(rows, "packing-lengths")
    edges, counts, totals = histogram(rows)
    limits, _ = boundaries(edges, counts, totals, buckets)
    which, top = F.lit(None).cast("int"), F.lit(None).cast("long")
    for b in range(len(limits) - 1, -1, -1):
        fits = F.col("n_tokens") <= limits[b]
        which, top = F.when(fits, b).otherwise(which), F.when(fits, F.lit(limits[b]).cast("long")).otherwise(top)
    rows = rows.withColumn("bucket", which).withColumn("padded_tokens", top)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "bucket", "h", "tie").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "packing-ranges")
    # A partition holds a contiguous range, so there are about as many counts as partitions and buckets.
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = ranged.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    offset = offset.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("bucket", "part").orderBy("h", "tie")
    numbered = ranged.withColumn("n", F.row_number().over(own)).join(F.broadcast(offset), ["bucket", "part"])
    per = F.greatest(F.floor(F.lit(budget) / F.greatest("padded_tokens", F.lit(1))), F.lit(1))
    place = F.col("earlier") + F.col("n") - 1
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "padded_tokens",
        F.floor(place / per).cast("long").alias("batch"), F.pmod(place, per).cast("long").alias("slot"),
    )
