"""Synthetic streams: vectors, constants, sinusoids and strobes.  ``range`` makes the positions, so they scale."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Stream, tag_value
from ..operators.position import repeat as repeated


def _positions(spark: SparkSession, n: int, stream_id: str) -> DataFrame:
    return spark.range(n).select(F.lit(stream_id).alias("stream_id"), F.col("id").alias("pos"))


def vector_source(spark: SparkSession, data: list, repeat: int = 1, tags: list[tuple[int, str, Column]] = (), stream_id: str = "vector", value: str = "v") -> Stream:
    """A fixed vector, ``repeat`` times, with start, repeat and first tags and the user's own at every repetition."""
    if any(not 0 <= p < len(data) for p, _, _ in tags):
        raise ValueError("a tag lies outside the vector")
    rows = [(stream_id, i, *((x.real, x.imag) if isinstance(x, complex) else (x,))) for i, x in enumerate(data)]
    cplx = any(isinstance(x, complex) for x in data)
    kind = "re double, im double" if cplx else f"{value} {'double' if any(isinstance(x, float) for x in data) else 'bigint'}"
    df = spark.createDataFrame(rows, f"stream_id string, pos long, {kind}")
    stream = repeated(Stream(df), repeat)
    reps = spark.range(repeat).select(F.lit(stream_id).alias("stream_id"), (F.col("id") * len(data)).alias("pos"), F.col("id").alias("n"))
    marks = [("VectorSource::start", tag_value("b", True), None), ("VectorSource::repeat", tag_value("u", F.col("n")), None), ("VectorSource::first", tag_value("b", True), F.col("n") == 0)]
    made = None
    for shift, key, val, when in [(0, *m) for m in marks] + [(p, k, v, None) for p, k, v in tags]:
        part = (reps.filter(when) if when is not None else reps).select("stream_id", (F.col("pos") + shift).alias("pos"), F.lit(key).alias("key"), val.alias("val"))
        made = part if made is None else made.unionByName(part)
    return Stream(stream.df, made if data else made.limit(0))


def constant_source(spark: SparkSession, n: int, value, stream_id: str = "constant") -> DataFrame:
    return _positions(spark, n, stream_id).withColumn("v", F.lit(value))


def _phase(samp_rate: float, freq: float) -> Column:
    if samp_rate <= 0:
        raise ValueError("the sample rate must be positive")
    return (F.col("pos") + 1) * F.lit(2 * math.pi * freq / samp_rate)


def signal_source_float(spark: SparkSession, n: int, samp_rate: float, freq: float, amplitude: float = 1.0, stream_id: str = "signal") -> DataFrame:
    """amplitude * sin, the phase one step ahead of the position."""
    return _positions(spark, n, stream_id).withColumn("v", F.sin(_phase(samp_rate, freq)) * amplitude)


def signal_source_complex(spark: SparkSession, n: int, samp_rate: float, freq: float, amplitude: float = 1.0, stream_id: str = "signal") -> DataFrame:
    phase = _phase(samp_rate, freq)
    return _positions(spark, n, stream_id).withColumns({"re": F.sin(phase) * amplitude, "im": F.sin(phase - math.pi / 2) * amplitude})


def strobe(spark: SparkSession, start: str, end: str, period: str, data: str, stream_id: str = "strobe") -> DataFrame:
    """The same message at every period from start to end (batch); use ``streaming.strobe`` for live ones."""
    times = F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {period}"))
    return spark.range(1).select(F.lit(stream_id).alias("stream_id"), F.posexplode(times).alias("pdu_idx", "ts")).select("stream_id", F.col("pdu_idx").cast("long").alias("pdu_idx"), "ts", F.lit(data).alias("msg"))
