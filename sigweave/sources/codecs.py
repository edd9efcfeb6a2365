"""Byte formats of samples as Column expressions: little-endian values, AU audio and RTL-SDR bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import CHUNK, KEY

# Little-endian sample types by name, with numpy kinds and value columns.
FORMATS = {
    "float": ("<f4", ("v",)), "complex": ("<f4", ("re", "im")), "u8": ("<u1", ("b",)), "u32": ("<u4", ("v",)), "i32": ("<i4", ("v",)),
}


def sample_size(kind: str) -> int:
    dtype, columns = FORMATS[kind]
    return np.dtype(dtype).itemsize * len(columns)


def sample_schema(kind: str) -> str:
    dtype, columns = FORMATS[kind]
    sql = {"<f4": "float", "<u1": "smallint", "<u4": "bigint", "<i4": "int"}[dtype]
    return ", ".join(f"{c} {sql}" for c in columns)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    dtype, columns = FORMATS[kind]
    size = sample_size(kind)
    return np.frombuffer(data[: len(data) // size * size], dtype).reshape(-1, len(columns))


def _groups(df: DataFrame, size: int, start: int = 0) -> DataFrame:
    """Bytes gathered into arrays of ``size`` by position: (stream_id, pos, _b)."""
    from_start = df.filter(F.col("pos") >= start) if start else df
    place = F.col("pos") - start
    return (
        from_start.groupBy("stream_id", F.expr(f"(pos - {start}) div {size}").alias("pos"))
        .agg(F.array_sort(F.collect_list(F.struct(F.pmod(place, F.lit(size)).alias("k"), F.col("b").cast("int").alias("b")))).alias("_r"))
        .filter(F.size("_r") == size)
        .select("stream_id", "pos", F.col("_r.b").alias("_b"))
    )


def parse(df: DataFrame, kind: str, chunk: int = CHUNK) -> DataFrame:
    """A byte stream to samples of a little-endian type; a trailing part of a sample is unused.

    Bytes travel as one binary per chunk of whole samples and are unpacked by numpy.
    """
    size = sample_size(kind)
    per = max(1, chunk // size)
    hexed = F.lpad(F.hex(F.col("b").cast("bigint")), 2, "0")
    rows = df.groupBy("stream_id", F.expr(f"pos div {per * size}").alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", hexed.alias("h")))).alias("_r"))
    packed = rows.select("stream_id", (F.col("_chunk") * per).alias("first"), F.unhex(F.array_join("_r.h", "")).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                x = unpacked(batch.column(2)[i].as_py(), kind)
                key = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(x), np.int64)))
                pos = pa.array(batch.column(1)[i].as_py() + np.arange(len(x)))
                columns = [pa.array(np.ascontiguousarray(x[:, k])).cast(target.field(2 + k).type) for k in range(x.shape[1])]
                yield pa.RecordBatch.from_arrays([key, pos, *columns], schema=target)

    schema = StructType([df.schema["stream_id"], *StructType.fromDDL("pos long, " + sample_schema(kind)).fields])
    return packed.mapInArrow(run, schema)


def rtlsdr_decode(df: DataFrame) -> DataFrame:
    """Pairs of unsigned bytes to complex samples around 127; an odd last byte is unused."""
    part = lambda k: (F.get("_b", F.lit(k)) - 127) * F.lit(0.008)
    return _groups(df, 2).select(*KEY, part(0).alias("re"), part(1).alias("im"))


def rtlsdr_encode(df: DataFrame) -> DataFrame:
    """Complex samples to pairs of bytes, rounded and clamped to 0..255."""
    byte = lambda c: F.least(F.greatest(F.round(F.col(c) / 0.008 + 127), F.lit(0.0)), F.lit(255.0)).cast("smallint")
    both = df.select("stream_id", "pos", F.posexplode(F.array(byte("re"), byte("im"))).alias("k", "b"))
    return both.select("stream_id", (F.col("pos") * 2 + F.col("k")).alias("pos"), "b")


AU_MAGIC, AU_PCM16, AU_HEADER = 0x2E736E64, 3, 28


def au_header(bitrate: int) -> bytes:
    """Magic, data offset, unknown size, PCM16, rate, one channel, and an empty annotation; big-endian."""
    return struct.pack(">7I", AU_MAGIC, AU_HEADER, 0xFFFFFFFF, AU_PCM16, bitrate, 1, 0)


def au_encode(df: DataFrame, bitrate: int) -> DataFrame:
    """Float samples to the bytes of an AU file: header, then big-endian PCM16, saturated and cut toward zero."""
    spark = df.sparkSession
    scaled = F.coalesce(F.nanvl(F.col("v") * 32767.0, F.lit(0.0)), F.lit(0.0))
    pcm = F.least(F.greatest(scaled, F.lit(-32768.0)), F.lit(32767.0)).cast("int")
    word = F.pmod(pcm, F.lit(65536))
    both = df.select("stream_id", "pos", F.posexplode(F.array(F.shiftright(word, 8), word.bitwiseAND(F.lit(255)))).alias("k", "b"))
    body = both.select("stream_id", (F.col("pos") * 2 + F.col("k") + AU_HEADER).alias("pos"), F.col("b").cast("smallint").alias("b"))
    head = spark.createDataFrame([(i, b) for i, b in enumerate(au_header(bitrate))], "pos long, b smallint")
    return body.unionByName(df.select("stream_id").distinct().crossJoin(F.broadcast(head)).select("stream_id", "pos", "b"))


def au_decode(df: DataFrame, bitrate: int) -> DataFrame:
    """The bytes of AU files to float samples; a header of another kind than mono PCM16 at the bitrate is an error."""
    head = df.filter(F.col("pos") < 24).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.lpad(F.hex(F.col("b").cast("bigint")), 2, "0").alias("h")))).alias("_r"))
    text = head.select("stream_id", F.array_join("_r.h", "").alias("h"))

    def word(k: int) -> Column:
        return F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long")

    rules = {"not an AU file": word(0) == AU_MAGIC, "not PCM16": word(3) == AU_PCM16, "another bitrate": word(4) == bitrate, "not mono": word(5) == 1}
    offset = word(1)
    for message, good in rules.items():
        offset = F.when(good, offset).otherwise(F.raise_error(F.lit(message)).cast("long"))
    # A row per stream: Spark broadcasts it if it is small.
    body = df.join(text.select("stream_id", offset.alias("_at")), "stream_id").filter(F.col("pos") >= F.col("_at"))
    place = body.withColumn("pos", F.col("pos") - F.col("_at"))
    word16 = F.get("_b", F.lit(0)) * 256 + F.get("_b", F.lit(1))
    signed = F.when(word16 >= 32768, word16 - 65536).otherwise(word16)
    return _groups(place.select("stream_id", "pos", "b"), 2).select(*KEY, (signed / 32767.0).alias("v"))
