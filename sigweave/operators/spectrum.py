"""Fourier transforms of packets and streams (numpy in Arrow tasks), and stream digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY, Stream, sequential, tag_value
from .bits import stream_chunks


def fft(pdus: DataFrame, size: int) -> DataFrame:
    """Forward transform of packets with columns re and im, not normalised; another length than ``size`` is an error."""
    if size < 1:
        raise ValueError("the size must be positive")
    rest = [c for c in pdus.columns if c not in ("re", "im")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            if any(len(x) != size for x in frame["re"]):
                raise ValueError(f"a packet is not of size {size}")
            y = np.fft.fft(np.stack(frame["re"]) + 1j * np.stack(frame["im"]), axis=1)
            yield frame.assign(re=list(y.real), im=list(y.imag))

    schema = pdus.select(*rest, F.col("re").cast("array<double>").alias("re"), F.col("im").cast("array<double>").alias("im"))
    return schema.mapInPandas(run, schema.schema)


def fft_stream(stream: Stream | DataFrame, size: int) -> Stream:
    """Transform of every ``size`` samples, flattened again; tagged with size and frame marks, input tags dropped."""
    df = stream.df if isinstance(stream, Stream) else stream
    frames = fft(stream_chunks(df, size), size)
    rows = frames.select("stream_id", "pdu_idx", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    out = rows.select("stream_id", (F.col("pdu_idx") * size + F.col("k")).alias("pos"), "z.re", "z.im")
    first = F.col("pdu_idx") * size

    def mark(pos: Column, key: str, val: Column) -> Column:
        return F.struct(pos.alias("pos"), F.lit(key).alias("key"), val.alias("val"))

    marks = F.array(
        mark(first, "FftStream::size", tag_value("u", size)), mark(first, "FftStream::frame", tag_value("b", True)),
        mark(first + size - 1, "FftStream::frame", tag_value("b", False)),
    )
    tags = frames.select("stream_id", F.explode(marks).alias("m")).select("stream_id", "m.pos", "m.key", "m.val")
    return Stream(out, tags)


def power_db(pdus: DataFrame) -> DataFrame:
    """10 log10 of the squared magnitude of packets with re and im."""
    power = F.zip_with("re", "im", lambda a, b: 10 * F.log10(a * a + b * b))
    return pdus.select("stream_id", "pdu_idx", power.alias("data"))


def hasher(df: DataFrame, algorithm: str = "sha512") -> DataFrame:
    """Digest of each byte stream (column b) as one packet at its end."""

    def machine():
        digest = hashlib.new(algorithm)

        def step(b, end):
            digest.update(b.astype(np.uint8).tobytes())
            return {"pdu_idx": [0] if end else [], "data": [digest.digest()] if end else []}

        return step

    return sequential(df.select(*KEY, "b"), ("b",), machine, "pdu_idx long, data binary")


def check_hash(df: DataFrame, expected: str, algorithm: str = "sha512") -> DataFrame:
    """(stream_id, matches) of each byte stream against a digest in hexadecimal."""
    return hasher(df, algorithm).select("stream_id", (F.lower(F.hex("data")) == expected.lower()).alias("matches"))
