"""Operator 3: WARC archives in which repeated payloads become revisit records.

Method.  Headers are grouped by payload digest; the largest page_id of a digest is
its response, the others join to it and become revisits.  Tasks write the archives: WARC/1.1
records with fresh headers (a record id of its own, the date of writing, and for revisits
the id, URI and date of the response), each a gzip member of its own, a ``warcinfo`` record first,
as readers of such archives expect.  Every task writes files under new names, and the stored
manifest (file, offset and length of each record) tells which count, so retried tasks leave
nothing that is read.  Reading streams each archive member by member, holds one record at a
time, recomputes digests from the payload bytes and joins revisits to responses.

Scale.  Payloads are pre-aggregated by digest before their one shuffle (a digest held
by a third of all pages sends one payload per map task); header joins carry ids only
and their hot digests are split by Spark's adaptive skew join.  Nothing is collected.

Defined cases: a null html is an empty payload; a null url has no target header and is
read as null, an empty one stays empty; a null page_id ranks lowest and stays null; of repeated rows with one
page_id and payload, one is the response and the rest revisit it.  Payloads below
``min_bytes`` are all responses.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import arrow_batches, shared_dir, written

END = "\r\n\r\n"
RECORD = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long, intact boolean, profile string, "
    "record_id string, refers_to_id string, refers_to_uri string, date string"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits become four base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row per page: page_id, url, record_type, payload_digest, payload_bytes, refers_to, refers_url, copy, html (responses only).

    ``copy`` tells apart rows that repeat page_id, url and payload; it is 0 for the response.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("html")))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long"))
    large = rows.filter(F.col("payload_bytes") >= min_bytes)
    # Digests are computed once more for the payloads below, all else reads this narrow table.
    headers = written(large.select("payload_digest", "page_id", "url", "payload_bytes"), "warc-headers")
    first = large.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url", "html")).alias("r"))
    responses = first.select(
        "r.page_id", "r.url", F.lit("response").alias("record_type"), "payload_digest",
        F.octet_length("r.html").cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_url"), F.lit(0).cast("long").alias("copy"), "r.html",
    )
    heads = headers.groupBy("payload_digest", "page_id", "url").agg(
        F.count("*").alias("n"), F.first("payload_bytes").alias("payload_bytes")
    )
    chosen = headers.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies"))
    again = heads.join(chosen.filter("copies > 1"), "payload_digest")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    revisits = (
        again.withColumn("n", F.col("n") - F.when(is_first, 1).otherwise(0))
        .filter("n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select(
            "page_id", "url", F.lit("revisit").alias("record_type"), "payload_digest", "payload_bytes",
            F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"), "copy", F.lit(None).cast("string").alias("html"),
        )
    )
    small = rows.filter(F.col("payload_bytes") < min_bytes).groupBy("page_id", "url", "html", "payload_digest", "payload_bytes").count()
    small = small.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).select(
        "page_id", "url", F.lit("response").alias("record_type"), "payload_digest", "payload_bytes", F.lit(None).cast("long").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_url"), "copy", "html",
    )
    return responses.unionByName(revisits).unionByName(small) if min_bytes > 0 else responses.unionByName(revisits)


def _urn(digest: Column, page: Column, url: Column, record_type: Column, copy: Column) -> Column:
    """A record id from what makes a record unique."""
    name = F.md5(F.concat_ws("/", digest, F.coalesce(page.cast("string"), F.lit("null")), record_type, copy.cast("string"), url))
    parts = [F.substring(name, lo, n) for lo, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line without line breaks in its value; nothing for null."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), F.regexp_replace(value, "[\\r\\n]", "%0A")), F.lit(""))


def record_text(at: str | None = None) -> Column:
    """The WARC record of a planned row without its terminator; ``at``: its date, now by default."""
    date = F.lit(at or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    urn = _urn(F.col("payload_digest"), F.col("page_id"), F.col("url"), F.col("record_type"), F.col("copy"))
    original = _urn(F.col("payload_digest"), F.col("refers_to"), F.col("refers_url"), F.lit("response"), F.lit(0))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    is_response = F.col("record_type") == "response"
    block = F.when(is_response, F.concat(http, "html")).otherwise(http)
    revisit = F.concat(
        F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        _header("WARC-Refers-To", original), _header("WARC-Refers-To-Target-URI", F.col("refers_url")), _header("WARC-Refers-To-Date", date),
    )
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), _header("WARC-Record-ID", urn), _header("WARC-Date", date),
        _header("WARC-Target-URI", F.col("url")), _header("X-Page-Id", page),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), F.when(is_response, F.lit("")).otherwise(revisit),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END),
    )
    return F.concat(head, block)


MANIFEST = "file string, offset long, length long, page_id long, record_type string"


def _member(record: bytes) -> bytes:
    """A record with its terminator as one gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.compress(END.encode()) + packer.flush()


def _info(name: str, at: str) -> bytes:
    """The record that begins an archive."""
    block = b"software: sigweave\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {at}\r\nWARC-Filename: {name}\r\n"
    return head.encode() + f"Content-Type: application/warc-fields\r\nContent-Length: {len(block)}{END}".encode() + block


def write_archives(planned: DataFrame, path: str) -> DataFrame:
    """Archives under ``path``, one for each task that has rows; returns the stored manifest of their records."""
    arrow_batches(planned.sparkSession)
    at = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = planned.select("page_id", "record_type", record_text(at).cast("binary").alias("record"))
    fs, inner = pafs.FileSystem.from_uri(path)
    fs.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pafs.FileSystem.from_uri(path)
        name = f"archive-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at_byte = None, 0
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{inner}/{name}", compression=None)
                at_byte = out.write(_member(_info(name, at)))
            offsets, sizes = [], []
            for record in batch.column(2):
                offsets.append(at_byte)
                sizes.append(out.write(_member(record.as_py())))
                at_byte += sizes[-1]
            n = batch.num_rows
            columns = [pa.array([name] * n, pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "offset", "length", "page_id", "record_type"])
        if out is not None:
            out.close()

    return written(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def _parse(head: bytes, block: bytes) -> dict:
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    page, kind = fields["X-Page-Id"], fields["WARC-Type"]
    digest, size, intact = fields["WARC-Payload-Digest"].removeprefix("sha1:"), None, True
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        digest, intact = found, found == digest
    return {
        "page_id": None if page == "null" else int(page), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "payload_digest": digest, "payload_bytes": size, "intact": intact, "profile": fields.get("WARC-Profile"),
        "record_id": fields["WARC-Record-ID"], "refers_to_id": fields.get("WARC-Refers-To"),
        "refers_to_uri": fields.get("WARC-Refers-To-Target-URI"), "date": fields["WARC-Date"],
    }


def _members(stream) -> Iterator[bytes]:
    """The records of an archive, one gzip member at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 16):
        while data:
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("an archive ends inside a record")


def _record(data: bytes) -> dict | None:
    """Fields of one record; None for one that holds no page."""
    at = data.find(END.encode())
    if at < 0 or not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record: " + repr(data[:80]))
    length = int(data[data.rindex(b"Content-Length: ", 0, at) + 16 : at])
    if len(data) != at + length + 8 or not data.endswith(END.encode()):
        raise ValueError("a WARC record of another length than its header says: " + repr(data[:80]))
    return None if b"\r\nWARC-Type: warcinfo\r\n" in data[: at + 2] else _parse(data[:at], data[at + 4 : at + 4 + length])


_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("profile", pa.string()),
    ("record_id", pa.string()), ("refers_to_id", pa.string()), ("refers_to_uri", pa.string()), ("date", pa.string()),
])


def read_archives(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Records of the archives under ``path`` that the manifest names; each is read in order by one task."""
    arrow_batches(spark)
    files = manifest.select("file").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{inner}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        if record := _record(data):
                            rows.append(record)
                        if len(rows) == 1024:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.repartition(parts, "file").mapInArrow(run, RECORD)


def resolve(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Join revisits to the responses that hold their payloads; one row per record."""
    responses = records.filter("record_type = 'response'")
    heads = ["page_id", "payload_bytes", "payload_digest", "record_type", "intact"]
    own = responses.select(*heads, F.lit(None).cast("long").alias("refers_to"))
    originals = responses.filter(F.col("payload_bytes") >= min_bytes)
    originals = originals.select("payload_digest", "payload_bytes", "intact", F.col("page_id").alias("refers_to"))
    again = records.filter("record_type = 'revisit'").select("page_id", "payload_digest", "record_type")
    return own.unionByName(again.join(originals, "payload_digest", "left").select(*own.columns))


def deduplicated(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the deduplicated archives of ``pages`` and read them back, resolved."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    manifest = write_archives(plan_records(pages, min_bytes), path)
    return resolve(written(read_archives(spark, path, manifest), "warc-records"), min_bytes)
