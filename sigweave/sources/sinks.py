"""Sinks: text, bounded collections, packet files and no-ops.  Raw sample files are in ``files``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY, Stream, values
from .files import filesystem


def null_sink(df: DataFrame) -> None:
    """Compute everything, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def vector_sink(df: DataFrame, max_size: int) -> list:
    """At most ``max_size`` rows in order; more is an error, and only max_size + 1 rows reach the driver."""
    order = [c for c in ("stream_id", "pos", "pdu_idx") if c in df.columns]
    rows = df.orderBy(*order).limit(max_size + 1).collect()
    if len(rows) > max_size:
        raise ValueError(f"more than {max_size} rows")
    return rows


def value_text(val: Column) -> Column:
    """A tag value as text."""
    return F.coalesce(val["s"], val["f"].cast("string"), val["b"].cast("string"), val["u"].cast("string"), val["i"].cast("string"))


def _tag_text(tags: DataFrame, between: str, joined: str) -> DataFrame:
    one = F.concat(F.col("key"), F.lit(between), value_text(F.col("val")))
    return tags.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list(one)), joined).alias("_t"))


def to_text(streams: list[Stream]) -> DataFrame:
    """Lines (stream_id, pos, line) of the values of streams side by side, tags in parentheses; as long as the shortest."""
    parts = []
    for k, s in enumerate(streams):
        shown = [F.col(c).cast("string") for c in values(s.df)]
        value = shown[0] if len(shown) == 1 else F.concat(F.lit("("), F.array_join(F.array(*shown), ","), F.lit(")"))
        df = s.df.select(*KEY, value.alias(f"_v{k}"))
        if s.tags is not None:
            df = df.join(_tag_text(s.tags, "=", ","), list(KEY), "left")
            df = df.withColumn(f"_v{k}", F.concat(f"_v{k}", F.coalesce(F.concat(F.lit(" ("), "_t", F.lit(")")), F.lit("")))).drop("_t")
        parts.append(df)
    lines = reduce(lambda a, b: a.join(b, list(KEY)), parts)
    return lines.select(*KEY, F.concat_ws(" ", *(f"_v{k}" for k in range(len(streams)))).alias("line"))


def debug_filter(stream: Stream) -> DataFrame:
    """One text packet per sample: its value and its tags as key => value."""
    shown = F.concat_ws(" ", *(F.col(c).cast("string") for c in values(stream.df)))
    df = stream.df.select("stream_id", "pos", shown.alias("msg"))
    if stream.tags is not None:
        df = df.join(_tag_text(stream.tags, " => ", ","), list(KEY), "left")
        df = df.select("stream_id", "pos", F.concat("msg", F.lit(" "), F.coalesce("_t", F.lit(""))).alias("msg"))
    return df.select("stream_id", F.col("pos").alias("pdu_idx"), "msg")


def debug_sink(stream: Stream, n: int = 20) -> None:
    debug_filter(stream).orderBy("stream_id", "pdu_idx").select(F.concat(F.lit("debug: "), "msg").alias("debug")).show(n, truncate=False)


def packet_name(stream_id, pdu_idx: int) -> str:
    """A file name that no other stream or number has: signs of the stream's name that aren't plain become percent codes."""
    return f"{quote(str(stream_id), safe='').replace('~', '%7E')}-{pdu_idx:012d}"


def pdu_writer(pdus: DataFrame, path: str, column: str = "data") -> DataFrame:
    """One file per packet, named by stream and number; (name, size) rows tell what was written.

    Names are deterministic and files are moved into place whole, so a repeated task writes the
    same.  A file of that name with other content is an error, never replaced.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, inner = filesystem(path)
        fs.create_dir(inner, recursive=True)
        for frame in frames:
            out = []
            for stream_id, pdu_idx, data in zip(frame["stream_id"], frame["pdu_idx"], frame["data"], strict=True):
                name, data = packet_name(stream_id, pdu_idx), bytes(data)
                if not _same(fs, f"{inner}/{name}", data):
                    part = f"{inner}/_{name}-{uuid.uuid4().hex}"
                    with fs.open_output_stream(part) as f:
                        f.write(data)
                    fs.move(part, f"{inner}/{name}")
                out.append((name, len(data)))
            yield pd.DataFrame(out, columns=["name", "size"])

    return pdus.select("stream_id", "pdu_idx", F.col(column).alias("data")).mapInPandas(run, "name string, size long")


def _same(fs, path: str, data: bytes) -> bool:
    """Whether the file is there with this content; other content is an error."""
    info = fs.get_file_info(path)
    if not info.is_file:
        return False
    if info.size == len(data):
        with fs.open_input_file(path) as f:
            if f.read() == data:
                return True
    raise FileExistsError(f"{path} holds another packet")


def pdu_writer_live(pdus: DataFrame, path: str, checkpoint: str, column: str = "data"):
    """A live ``pdu_writer``; a micro-batch that runs again writes the same files.  Returns the writer, to be started."""

    def batch(df: DataFrame, _: int) -> None:
        null_sink(pdu_writer(df, path, column))

    return pdus.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def no_copy_file_sink_live(pdus: DataFrame, path: str, checkpoint: str, column: str = "msg"):
    """Text of packets as they come, one a line; Spark's file sink writes each once.  Returns the writer, to be started."""
    return pdus.select(F.col(column).cast("string").alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)


def no_copy_file_sink(pdus: DataFrame, path: str, column: str = "msg") -> None:
    """Text of packets, one a line, in order across part files."""
    n = int(pdus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pdus.repartitionByRange(n, "stream_id", "pdu_idx").sortWithinPartitions("stream_id", "pdu_idx")
    ordered.select(F.col(column).cast("string").alias("value")).write.text(path)
