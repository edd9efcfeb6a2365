"""Raw sample files, SigMF recordings and framed TCP bytes as Spark data sources.

``register(spark)`` makes the formats ``raw_samples`` (read and write, batch and streaming
writes) and ``tcp_samples`` (streaming) known.  Files are opened through pyarrow filesystems by
URI, and read by byte ranges, so a large file is many partitions.  Comparisons of ``pos`` and
``stream_id`` with constants are pushed into the reader: only the bytes of those positions are read.
"""

from __future__ import annotations

import json
import socket
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    LessThan, LessThanOrEqual, SimpleDataSourceStreamReader, WriterCommitMessage,
)

from ..model import KEY
from .codecs import FORMATS, sample_schema, sample_size, unpacked

SPLIT_BYTES = 32 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class _Range(InputPartition):
    path: str
    stream_id: str
    offset: int
    length: int
    first: int


class RawSamples(DataSource):
    """Options: path, kind (float, complex, u8, u32, i32), repeat (1), offset and length in bytes, stream_id (file name)."""

    @classmethod
    def name(cls) -> str:
        return "raw_samples"

    def schema(self) -> str:
        return "stream_id string, pos long, " + sample_schema(self.options.get("kind", "float"))

    def reader(self, schema) -> DataSourceReader:
        return _RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _RawWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _RawStreamWriter(self.options)


class _RawReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "float")
        self.repeat, self.split = int(options.get("repeat", "1")), int(options.get("splitbytes", SPLIT_BYTES))
        self.offset, self.length, self.stream_id = int(options.get("offset", "0")), options.get("length"), options.get("stream_id")
        self.lo, self.hi, self.names = 0, None, None  # positions from lo to hi (exclusive), of these streams

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of pos and stream_id with constants; gives back the others."""
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        column = getattr(f, "attribute", None)
        value = getattr(f, "value", None)
        if isinstance(f, IsNotNull) and column in (("pos",), ("stream_id",)):
            return True  # they never are
        if column == ("pos",) and isinstance(value, int):
            lo, hi = {EqualTo: (value, value + 1), GreaterThan: (value + 1, None), GreaterThanOrEqual: (value, None), LessThan: (0, value), LessThanOrEqual: (0, value + 1)}.get(type(f), (None, None))
            if lo is None:
                return False
            self.lo, self.hi = max(self.lo, lo), hi if self.hi is None else self.hi if hi is None else min(self.hi, hi)
            return True
        if column == ("stream_id",) and isinstance(f, (EqualTo, In)):
            names = {value} if isinstance(f, EqualTo) else set(value)
            self.names = names if self.names is None else self.names & names
            return True
        return False

    def partitions(self) -> list[_Range]:
        fs, inner = filesystem(self.path)
        info = fs.get_file_info(inner)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(inner))
        files = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        if not info.is_file:  # parts of micro-batches count once a manifest names them
            files = [f for f in files if not f.rsplit("/", 1)[-1].startswith(_EPOCH)]
            files += [f"{inner.rstrip('/')}/{name}" for name in _published(fs, [f for f in found if f.is_file])]
        size, out = sample_size(self.kind), []
        step = max(size, self.split // size * size)
        for path in files:
            n = fs.get_file_info(path).size - self.offset
            n = min(n, int(self.length)) if self.length else n
            n = n // size * size  # a trailing part of a sample is unused, at every repetition
            name = self.stream_id or path.rsplit("/", 1)[-1]
            if self.names is not None and name not in self.names:
                continue
            for r in range(self.repeat):
                first = r * n // size  # position of this repetition's first sample
                lo = min(max(self.lo - first, 0) * size, n)
                hi = n if self.hi is None else min(max(self.hi - first, 0) * size, n)
                out += [_Range(path, name, self.offset + at, min(step, hi - at), first + at // size) for at in range(lo, hi, step)]
        return out

    def read(self, part: _Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing to read
            return
        fs, _ = filesystem(self.path)
        names = ["stream_id", "pos", *FORMATS[self.kind][1]]
        cast = {"<u1": pa.int16(), "<u4": pa.int64()}
        with fs.open_input_file(part.path) as f:
            size = sample_size(self.kind)
            step = max(1, (1 << 20) // size) * size
            for at in range(0, part.length, step):
                x = unpacked(f.read_at(min(step, part.length - at), part.offset + at), self.kind)
                pos = part.first + at // size + np.arange(len(x))
                columns = [pa.array(np.ascontiguousarray(x[:, k])).cast(cast.get(FORMATS[self.kind][0], pa.from_numpy_dtype(x.dtype))) for k in range(x.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array([part.stream_id] * len(x)), pa.array(pos), *columns], names=names)


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    name: str
    samples: int
    first: tuple = ()


def _write_part(path: str, kind: str, name: str, iterator: Iterator[pa.RecordBatch]) -> _Part:
    from pyspark import TaskContext

    fs, inner = filesystem(path)
    fs.create_dir(inner, recursive=True)
    n = 0
    dtype, columns = FORMATS[kind]
    with fs.open_output_stream(f"{inner}/{name}") as f:
        for batch in iterator:
            x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns], 1)
            f.write(x.astype(dtype).tobytes())
            n += len(x)
    return _Part(TaskContext.get().partitionId(), name, n)


def _listed(fs: pafs.FileSystem, inner: str) -> list[pafs.FileInfo]:
    return [f for f in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if f.is_file]


class _RawWriter(DataSourceArrowWriter):
    """One part file per partition, in partition order; write streams that ``in_order`` has arranged.

    Parts are written under unfinished names of this job and renamed on commit; whatever else
    has the job's name then, from failed and repeated tasks too, is deleted.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "float"), overwrite
        self.mode, self.job = options.get("mode", "create"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        return _write_part(self.path, self.kind, f"_part-{self.job}-{uuid.uuid4().hex}", iterator)

    def commit(self, messages) -> None:
        fs, inner = filesystem(self.path)
        old = [f.path for f in _listed(fs, inner) if not f.base_name.startswith("_")]
        if old and self.mode == "create" and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} already has samples")
        if self.overwrite or self.mode == "overwrite":
            for f in old:
                fs.delete_file(f)
            old = []
        for k, m in enumerate(sorted((m for m in messages if m), key=lambda m: m.partition)):
            fs.move(f"{inner}/{m.name}", f"{inner}/part-{len(old) + k:06d}")
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, inner = filesystem(self.path)
        for f in _listed(fs, inner):
            if f.base_name.startswith(f"_part-{self.job}-"):
                fs.delete_file(f.path)


#: Parts of a micro-batch, and the list that makes them count.
_EPOCH, _MANIFEST = "epoch-", "_manifest-"


def _published(fs: pafs.FileSystem, files: list[pafs.FileInfo]) -> list[str]:
    """Parts that manifests name, in order of micro-batch and position."""
    names = []
    for f in sorted((f for f in files if f.base_name.startswith(_MANIFEST)), key=lambda f: f.base_name):
        with fs.open_input_file(f.path) as m:
            names += json.loads(m.read())
    return names


class _RawStreamWriter(DataSourceStreamArrowWriter):
    """Parts of a micro-batch under names of their own; one manifest, moved into place whole, publishes them.

    A batch that was published is not published again, so what runs twice between a write and
    Spark's own commit counts once.  Readers take the parts that manifests name.
    """

    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "float")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        """A task's rows of one micro-batch, which its trigger bounds, in order of stream and position."""
        batches = list(iterator)
        if not sum(b.num_rows for b in batches):
            return _Part(0, "", 0)
        rows = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in KEY])
        part = _write_part(self.path, self.kind, f"{_EPOCH}{uuid.uuid4().hex}", iter(rows.to_batches()))
        return replace(part, first=(str(rows["stream_id"][0].as_py()), rows["pos"][0].as_py()))

    def commit(self, messages, batchId: int) -> None:
        fs, inner = filesystem(self.path)
        target = f"{inner}/{_MANIFEST}{batchId:012d}"
        if fs.get_file_info(target).is_file:
            self.abort(messages, batchId)
            return
        names = [m.name for m in sorted((m for m in messages if m and m.samples), key=lambda m: m.first)]
        fs.create_dir(inner, recursive=True)
        unfinished = f"{inner}/_unfinished-{uuid.uuid4().hex}"
        with fs.open_output_stream(unfinished) as f:
            f.write(json.dumps(names).encode())
        fs.move(unfinished, target)

    def abort(self, messages, batchId: int) -> None:
        fs, inner = filesystem(self.path)
        for m in messages:
            if m and m.samples and fs.get_file_info(f"{inner}/{m.name}").is_file:
                fs.delete_file(f"{inner}/{m.name}")


def in_order(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows ranged and sorted by stream and position, so that files of partitions follow each other."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *KEY).sortWithinPartitions(*KEY)


def write_raw(df: DataFrame, path: str, kind: str, mode: str = "create", parts: int | None = None) -> None:
    """mode: create (fails if samples exist), overwrite or append."""
    register(df.sparkSession)
    in_order(df, parts).select(*KEY, *FORMATS[kind][1]).write.format("raw_samples").option("path", path).option("kind", kind).option("mode", mode).mode("append").save()


def read_raw(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("raw_samples").options(path=path, kind=kind, **options).load()


class TcpSamples(DataSource):
    """Streaming client of a TCP server of little-endian samples.  Options: host, port, kind, stream_id."""

    @classmethod
    def name(cls) -> str:
        return "tcp_samples"

    def schema(self) -> str:
        return "stream_id string, pos long, " + sample_schema(self.options.get("kind", "float"))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _TcpReader(self.options)


class _TcpReader(SimpleDataSourceStreamReader):
    """Keeps what it has read until Spark commits it, so that a batch can be read again."""

    def __init__(self, options):
        self.address = options["host"], int(options["port"])
        self.kind, self.stream_id = options.get("kind", "float"), options.get("stream_id", "tcp")
        self.limit = int(options.get("maxbytes", 1 << 20))
        self.socket, self.rest, self.rows, self.base = None, b"", [], 0

    def initialOffset(self) -> dict:
        return {"pos": 0}

    def _more(self) -> bytes:
        if self.socket is None:
            self.socket = socket.create_connection(self.address, timeout=5)
            self.socket.settimeout(0.2)
        got = []
        try:
            while sum(map(len, got)) < self.limit:
                data = self.socket.recv(65536)
                if not data:
                    break
                got.append(data)
        except TimeoutError:
            pass
        return b"".join(got)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        data = self.rest + self._more()
        size = sample_size(self.kind)
        x = unpacked(data, self.kind)
        self.rest = data[len(x) * size :]
        first = start["pos"]
        rows = [(self.stream_id, first + i, *v) for i, v in enumerate(x.tolist())]
        self.rows = [r for r in self.rows if r[1] < first] + rows
        return iter(rows), {"pos": first + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for r in self.rows if start["pos"] <= r[1] < end["pos"]])

    def commit(self, end: dict) -> None:
        self.rows = [r for r in self.rows if r[1] >= end["pos"]]


def write_raw_stream(df: DataFrame, path: str, kind: str, checkpoint: str):
    """A live sink of samples; returns the writer, to be started.  Each micro-batch is sorted by stream and position within its parts."""
    register(df.sparkSession)
    own = df.select(*KEY, *FORMATS[kind][1])
    return own.writeStream.format("raw_samples").option("path", path).option("kind", kind).option("checkpointLocation", checkpoint)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawSamples)
    spark.dataSource.register(TcpSamples)


# SigMF data types by sample kind.
SIGMF_TYPES = {"cf32_le": "complex", "cf32": "complex", "rf32_le": "float", "rf32": "float", "ru8": "u8", "ru8_le": "u8", "ri32_le": "i32", "ri32": "i32"}
SIGMF_VERSION = "1.1.0"


def sigmf_parse(text: str) -> dict:
    """SigMF metadata with its global, captures and annotations parts."""
    meta = json.loads(text)
    if "core:datatype" not in meta.get("global", {}) or "core:version" not in meta["global"]:
        raise ValueError("SigMF metadata needs core:datatype and core:version")
    return {"global": meta["global"], "captures": meta.get("captures", []), "annotations": meta.get("annotations", [])}


def sigmf_meta(samp_rate: float, freq: float, datatype: str = "cf32_le", captures: list[dict] | None = None, annotations: list[dict] | None = None) -> str:
    first = {"core:sample_start": 0, "core:frequency": freq}
    head = {"core:datatype": datatype, "core:sample_rate": samp_rate, "core:version": SIGMF_VERSION}
    return json.dumps({"global": head, "captures": captures or [first], "annotations": annotations or []})


def sigmf_captures(spark: SparkSession, meta: dict) -> DataFrame:
    rows = [(c["core:sample_start"], c.get("core:frequency"), c.get("core:datetime")) for c in meta["captures"]]
    return spark.createDataFrame(rows, "sample_start long, frequency double, datetime string")


def _archive_parts(path: str) -> tuple[str, int, int]:
    """Metadata text, and offset and length of the data, of a tar archive with one recording."""
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as f, tarfile.open(fileobj=f, mode="r:") as tar:
        members = {m.name: m for m in tar if m.isfile()}
        metas, datas = ([n for n in members if n.endswith(e)] for e in (".sigmf-meta", ".sigmf-data"))
        if len(metas) != 1 or len(datas) != 1:
            raise ValueError("the archive must hold one recording")
        data = members[datas[0]]
        return tar.extractfile(members[metas[0]]).read().decode(), data.offset_data, data.size


def read_sigmf(spark: SparkSession, path: str, sample_rate: float | None = None, kind: str = "complex", ignore_type_error: bool = False, repeat: int = 1) -> tuple[DataFrame, dict]:
    """Samples and metadata of a recording (path without -meta/-data ending) or of a tar archive (.sigmf)."""
    base = path.removesuffix("-meta").removesuffix("-data")
    fs, inner = filesystem(base)
    if fs.get_file_info(f"{inner}-meta").is_file:
        with fs.open_input_file(f"{inner}-meta") as f:
            text, data, options = f.read().decode(), f"{base}-data", {}
    else:
        text, offset, length = _archive_parts(base)
        data, options = base, {"offset": str(offset), "length": str(length)}
    meta = sigmf_parse(text)
    rate = meta["global"].get("core:sample_rate")
    if sample_rate is not None and rate is not None and rate != sample_rate:
        raise ValueError(f"the recording has sample rate {rate}, not {sample_rate}")
    if SIGMF_TYPES.get(meta["global"]["core:datatype"]) != kind and not ignore_type_error:
        raise ValueError(f"the recording has type {meta['global']['core:datatype']}")
    return read_raw(spark, data, kind, repeat=str(repeat), stream_id=inner.rsplit("/", 1)[-1], **options), meta


def write_sigmf(df: DataFrame, path: str, samp_rate: float, freq: float) -> None:
    """A complex recording: metadata at path-meta and one data file at path-data (one ordered partition)."""
    fs, inner = filesystem(path)
    write_raw(df, f"{path}-parts", "complex", mode="overwrite")
    parts, start = filesystem(f"{path}-parts")
    with fs.open_output_stream(f"{inner}-data") as out:
        for f in sorted(x.path for x in parts.get_file_info(pafs.FileSelector(start))):
            with parts.open_input_stream(f) as part:
                while chunk := part.read(1 << 22):
                    out.write(chunk)
    with fs.open_output_stream(f"{inner}-meta") as out:
        out.write(sigmf_meta(samp_rate, freq).encode())


def tags_to_captures(tags: DataFrame, frequency_key: str = "frequency") -> DataFrame:
    """SigMF captures from frequency tags: one where the frequency changes."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id").orderBy("pos")
    own = tags.filter(F.col("key") == frequency_key).select("stream_id", F.col("pos").alias("sample_start"), F.col("pos"), F.col("val.f").alias("frequency"))
    changed = own.withColumn("_was", F.lag("frequency").over(w)).filter(~F.col("frequency").eqNullSafe(F.col("_was")))
    return changed.select("stream_id", "sample_start", "frequency")

