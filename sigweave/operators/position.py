"""Operators on positions: limits, offsets, delays, repeats and resampling; no window is needed."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY, Stream, checked, lengths, values


def head(stream: Stream, n: int) -> Stream:
    """The first n samples; a filter on pos that reaches the scan."""
    tags = stream.tags.filter(F.col("pos") < n) if stream.tags is not None else None
    return Stream(stream.df.filter(F.col("pos") < n), tags)


def skip(stream: Stream, n: int) -> Stream:
    def moved(df: DataFrame) -> DataFrame:
        return df.filter(F.col("pos") >= n).withColumn("pos", F.col("pos") - n)

    return Stream(moved(stream.df), moved(stream.tags) if stream.tags is not None else None)


def delay(stream: Stream, d: int, default=0) -> Stream:
    """d default samples, then the stream; tags move with their samples."""
    df = checked(stream.df)
    ids = df.select("stream_id").distinct()
    fill = [F.lit(default).cast(df.schema[c].dataType).alias(c) for c in values(df)]
    zeros = ids.select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(d - 1).cast("long"))).alias("pos"), *fill) if d else None
    moved = df.withColumn("pos", F.col("pos") + d)
    tags = stream.tags.withColumn("pos", F.col("pos") + d) if stream.tags is not None else None
    return Stream(moved.unionByName(zeros) if d else moved, tags)


def set_delay(stream: Stream, changes: list[tuple[int, int]], default=0) -> Stream:
    """A delay that changes: (input position, new delay), in order.

    A longer delay inserts defaults before that input sample; a shorter one drops as many samples from there on.
    """
    out, at, shift = None, 0, 0
    df, tags = stream.df, stream.tags
    made_tags = None
    for k, (pos, d) in enumerate(changes):
        until = changes[k + 1][0] if k + 1 < len(changes) else None
        if d < shift:
            pos += shift - d
        part = df.filter(F.col("pos") >= pos)
        part = part.filter(F.col("pos") < until) if until is not None else part
        moved = part.withColumn("pos", F.col("pos") + d)
        if d > shift:
            fill = [F.lit(default).cast(df.schema[c].dataType).alias(c) for c in values(df)]
            gap = df.select("stream_id").distinct().select("stream_id", F.explode(F.sequence(F.lit(pos + shift).cast("long"), F.lit(pos + d - 1).cast("long"))).alias("pos"), *fill)
            moved = moved.unionByName(gap)
        if tags is not None:
            t = tags.filter(F.col("pos") >= pos)
            t = (t.filter(F.col("pos") < until) if until is not None else t).withColumn("pos", F.col("pos") + d)
            made_tags = t if made_tags is None else made_tags.unionByName(t)
        if k == 0 and pos > at:
            moved = moved.unionByName(df.filter(F.col("pos") < pos))
        out = moved if out is None else out.unionByName(moved)
        shift = d
    return Stream(out if out is not None else df, made_tags if made_tags is not None else tags)


def repeat(stream: Stream, n: int) -> Stream:
    """The stream n times, one behind the other."""
    long = lengths(stream.df).withColumnRenamed("n", "_len")

    def copies(df: DataFrame) -> DataFrame:
        many = df.join(long, "stream_id").withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return many.withColumn("pos", F.col("pos") + F.col("_rep") * F.col("_len")).drop("_rep", "_len")

    if n == 0:
        return Stream(stream.df.limit(0), stream.tags.limit(0) if stream.tags is not None else None)
    return Stream(copies(stream.df), copies(stream.tags) if stream.tags is not None else None)


def rational_resampler(df: DataFrame, interpolation: int, decimation: int) -> DataFrame:
    """Output j is input floor(j * D / I); tags are dropped.  Each row makes its own outputs, without a shuffle."""
    if interpolation < 1 or decimation < 1:
        raise ValueError("interpolation and decimation must be positive")
    g = gcd(interpolation, decimation)
    i, d = interpolation // g, decimation // g
    first = F.expr(f"(pos * {i} + {d - 1}) div {d}") if d > 1 else F.col("pos") * i
    last = F.expr(f"((pos + 1) * {i} + {d - 1}) div {d} - 1") if d > 1 else (F.col("pos") + 1) * i - 1
    rest = values(checked(df))
    if i == 1:
        return df.filter(F.pmod("pos", F.lit(d)) == 0).select("stream_id", F.expr(f"pos div {d}").alias("pos"), *rest)
    made = df.filter(first <= last).withColumn("pos", F.explode(F.sequence(first, last)))
    return made.select(*KEY, *rest)
