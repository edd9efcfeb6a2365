"""The framed data stream protocol: version, request and data packets in length-prefixed frames.

All integers are little-endian: u32 length of type and body, u8 type, body.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION, REQUEST, DATA = 1, 2, 3
MAX_PACKET = 64 << 20


def _framed(kind: int, body: bytes) -> bytes:
    return struct.pack("<IB", len(body) + 1, kind) + body


def version_packet(version: int = 0) -> bytes:
    return _framed(VERSION, struct.pack("<I", version))


def request_packet(stream_id: str, window: int) -> bytes:
    return _framed(REQUEST, struct.pack("<I", window) + stream_id.encode())


def data_packet(stream_id: str, data: bytes) -> bytes:
    name = stream_id.encode()
    return _framed(DATA, struct.pack("<I", len(name)) + name + data)


class Packets:
    """Incremental reader: feed bytes, get (kind, version or window, stream id, data)."""

    def __init__(self, limit: int = MAX_PACKET):
        self.held, self.limit = b"", limit

    def feed(self, data: bytes) -> Iterator[tuple[str, int | None, str | None, bytes | None]]:
        self.held += data
        while len(self.held) >= 4:
            size = struct.unpack_from("<I", self.held)[0]
            if not 0 < size <= self.limit:
                raise ValueError(f"bad packet length {size}")
            if len(self.held) < 4 + size:
                return
            packet, self.held = self.held[4 : 4 + size], self.held[4 + size :]
            yield _parsed(packet[0], packet[1:])


def _parsed(kind: int, body: bytes):
    if kind == VERSION and len(body) == 4:
        return "version", struct.unpack("<I", body)[0], None, None
    if kind == REQUEST and len(body) >= 4:
        return "request", struct.unpack_from("<I", body)[0], body[4:].decode(), None
    if kind == DATA and len(body) >= 4:
        n = struct.unpack_from("<I", body)[0]
        if 4 + n <= len(body):
            return "data", None, body[4 : 4 + n].decode(), body[4 + n :]
    raise ValueError(f"bad packet of type {kind}")


def check_version(packets: Iterator) -> None:
    first = next(packets, None)
    if first is None or first[0] != "version" or first[1] != 0:
        raise ValueError("the other side must send version 0 first")


def decode(frames: DataFrame, column: str = "data") -> DataFrame:
    """Binary columns of whole packets to rows (stream_id, pdu_idx, packet, kind, number, name, payload)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (r.stream_id, r.pdu_idx, k, *p)
                for r in batch.itertuples(index=False) for k, p in enumerate(Packets().feed(bytes(r.data)))
            ]
            yield pd.DataFrame(rows, columns=["stream_id", "pdu_idx", "packet", "kind", "number", "name", "payload"])

    kind = frames.schema["stream_id"].dataType.simpleString()
    return frames.select("stream_id", "pdu_idx", F.col(column).alias("data")).mapInPandas(
        run, f"stream_id {kind}, pdu_idx long, packet int, kind string, number long, name string, payload binary"
    )


def _u32(n: Column) -> Column:
    hexed = F.lpad(F.hex(n.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*(F.substring(hexed, p, 2) for p in (7, 5, 3, 1))))


def encode_data(pdus: DataFrame, name: str, column: str = "data") -> DataFrame:
    """Data packets of binary payloads, as an expression."""
    own = F.lit(name).cast("binary")
    size = F.octet_length(own) + F.octet_length(F.col(column)) + 5
    return pdus.withColumn(column, F.concat(_u32(size), F.unhex(F.lit("03")), _u32(F.octet_length(own)), own, F.col(column)))
