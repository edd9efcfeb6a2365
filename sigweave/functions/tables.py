"""Operators as SQL table functions: ``SELECT * FROM iir(TABLE(samples), 0.2)``.

``register(spark)`` makes the functions of ``FUNCTIONS`` known; ``custom`` registers a machine of
the caller (``feed(pos, *columns) -> dict``, and on demand ``end() -> dict``), ``closure`` a
function from one packet to a list of packets.  Their ``analyze`` deals the table argument by
``stream_id`` and orders it by position, so Spark partitions and sorts; a function instance
sees one stream, feeds its machine ``BATCH`` rows at a time and holds no more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..streaming import live

BATCH = 4096


def _analysis(order: str, columns: tuple[str, ...], output: StructType) -> Callable[..., AnalyzeResult]:
    def analyze(rows: AnalyzeArgument, *arguments: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table: f(TABLE(samples), ...)")
        missing = [c for c in ("stream_id", order, *columns) if c not in rows.dataType.names]
        if missing:
            raise ValueError(f"the table has no columns {missing}")
        if not all(a.isConstantExpression for a in arguments):
            raise ValueError("arguments behind the table must be constants")
        fields = [rows.dataType["stream_id"], *output.fields]
        return AnalyzeResult(schema=StructType(fields), partitionBy=[PartitioningColumn("stream_id")], orderBy=[OrderingColumn(order)])

    return analyze


def custom(spark: SparkSession, name: str, machine: Callable[..., object], columns: tuple[str, ...], output: str, order: str = "pos") -> None:
    """Register the machine that ``machine(*arguments)`` makes; ``output`` names its result's columns behind stream_id."""
    made_of = StructType.fromDDL(output)
    names = made_of.names

    class Streams:
        analyze = staticmethod(_analysis(order, columns, made_of))

        def __init__(self, *_):
            self.own, self.key, self.rows = None, None, []

        def eval(self, row, *arguments):
            if self.own is None:
                self.own, self.key = machine(*arguments), row["stream_id"]
            self.rows.append([row[order], *(row[c] for c in columns)])
            if len(self.rows) >= BATCH:
                yield from self.fed()

        def fed(self):
            arrays = [np.array(x) if not isinstance(x[0], (bytes, bytearray, list)) else list(x) for x in zip(*self.rows, strict=True)]
            self.rows = []
            yield from self.listed(self.own.feed(*arrays))

        def listed(self, made):
            for row in zip(*(made[n] for n in names), strict=True):
                yield (self.key, *(v.tolist() if isinstance(v, (np.generic, np.ndarray)) else v for v in row))

        def terminate(self):
            if self.rows:
                yield from self.fed()
            if self.own is not None and hasattr(self.own, "end"):
                yield from self.listed(self.own.end())

    spark.udtf.register(name, udtf(Streams))


class _Closure:
    """Packets of a function, numbered anew."""

    def __init__(self, f: Callable):
        self.f, self.n = f, 0

    def feed(self, number, data):
        made = [x for d in data for x in self.f(d)]
        first, self.n = self.n, self.n + len(made)
        return {"pdu_idx": list(range(first, self.n)), "data": made}


def closure(spark: SparkSession, name: str, f: Callable, kind: str = "array<double>") -> None:
    """Register a function from one packet (column data) to a list of packets of type ``kind``."""
    custom(spark, name, lambda: _Closure(f), ("data",), f"pdu_idx long, data {kind}", "pdu_idx")


#: name: (machine, columns, output)
FUNCTIONS: dict[str, tuple[Callable, tuple[str, ...], str]] = {
    "iir": (live.SinglePole, ("v",), "pos long, v double"),
    "vco": (live.Vco, ("v",), "pos long, re double, im double"),
    "iq_balance": (live.IqBalance, ("re", "im"), "pos long, re double, im double"),
    "quadrature_demod": (live.Demod, ("re", "im"), "pos long, v double"),
    "nrzi_decode": (live.Nrzi, ("bit",), "pos long, bit byte"),
    "descramble": (live.Descrambler, ("bit",), "pos long, bit byte"),
    "resample": (live.Resampler, ("v",), "pos long, v double"),
    "zero_crossing": (live.ZeroCrossing, ("v",), "pos long, v double"),
    "symbol_sync": (live.Clock, ("v",), "pos long, v double"),
    "stream_chunks": (live.Chunks, ("v",), "pdu_idx long, data array<double>"),
    "fft_stream": (live.FftFrames, ("re", "im"), "pos long, re double, im double"),
    "hdlc_frames": (live.Hdlc, ("bit",), "pdu_idx long, data binary, packet_pos long"),
    "kiss_frames": (live.Kiss, ("b",), "pdu_idx long, data binary"),
}


def register(spark: SparkSession) -> None:
    for name, (machine, columns, output) in FUNCTIONS.items():
        custom(spark, name, machine, columns, output)
