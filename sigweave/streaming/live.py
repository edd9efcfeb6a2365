"""Structured Streaming versions: per-stream state across micro-batches.

Rows of a micro-batch may come in any order.  State is kept by ``transformWithState``: a value
with the next position and counts, a value with the registers of the stream's machine, and a
map of the segments that wait behind a gap (first position to arrays), of which only those that
come or go are written.  Rows that come again (below the next position) are dropped and counted.
With ``idle_ms`` a timer ends a stream that was silent so long: its machine gives what it
still has, and all its state is deleted.  ``ttl_ms`` lets state expire that isn't touched at all.

State lives in RocksDB, which ``transformWithState`` needs; a session without that setting gets it.
Machines are the ones of the batch operators where those have any; each is picklable and
bounded by its own limits, and at most ``MAX_HELD`` rows wait for a missing position.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import KEY, tag_value

MAX_HELD = 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Streams(StatefulProcessor):
    """Feeds each stream's machine the rows that continue it."""

    def __init__(self, columns: tuple[str, ...], machine: Callable[[], object], fields: list[str], idle_ms: int | None, ttl_ms: int | None):
        self.columns, self.machine, self.fields, self.idle_ms, self.ttl_ms = columns, machine, fields, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, late long, held long", self.ttl_ms)
        self.registers = handle.getValueState("registers", "machine binary", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "first long", ", ".join(f"{c} array<double>" for c in self.columns), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        nxt, late, held = self.place.get() if self.place.exists() else (0, 0, 0)
        own = pickle.loads(self.registers.get()[0]) if self.registers.exists() else self.machine()
        fresh = frame[frame["pos"] >= nxt].drop_duplicates("pos").sort_values("pos")
        late += len(frame) - len(fresh)
        pos = fresh["pos"].to_numpy()
        values = [fresh[c].to_numpy().astype(float) for c in self.columns]
        edges = [0, *(np.flatnonzero(np.diff(pos) != 1) + 1).tolist(), len(pos)] if len(pos) else [0]
        for lo, hi in pairwise(edges):
            first, part = int(pos[lo]), [v[lo:hi] for v in values]
            if first <= nxt:  # later segments start behind
                yield from self.fed(key, own, first, part)
                nxt = first + hi - lo
            else:
                held += self.hold(first, part)
        if held:
            for first in sorted(k[0] for k in self.waiting.keys()):
                if first > nxt:
                    break
                part = [np.asarray(v, float)[nxt - first :] for v in self.waiting.getValue((first,))]
                held -= len(part[0]) + nxt - first
                self.waiting.removeKey((first,))
                if len(part[0]):
                    yield from self.fed(key, own, nxt, part)
                    nxt += len(part[0])
        if held > MAX_HELD:
            raise ValueError("too many rows wait for a missing position")
        self.place.update((nxt, late, held))
        self.registers.update((pickle.dumps(own),))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def hold(self, first: int, part: list[np.ndarray]) -> int:
        """Keep a segment; of two with the same start the longer."""
        before = len(self.waiting.getValue((first,))[0]) if self.waiting.containsKey((first,)) else 0
        if len(part[0]) <= before:
            return 0
        self.waiting.updateValue((first,), tuple(v.tolist() for v in part))
        return len(part[0]) - before

    def fed(self, key, own, first: int, part: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        yield from self.rows(key, own.feed(first + np.arange(len(part[0])), *part))

    def rows(self, key, made: dict) -> Iterator[pd.DataFrame]:
        n = len(next(iter(made.values())))
        if n:
            yield pd.DataFrame({"stream_id": pd.Series([key[0]] * n, dtype=object)} | made)[["stream_id", *self.fields]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = pickle.loads(self.registers.get()[0]) if self.registers.exists() else None
        if own is not None and hasattr(own, "end"):
            yield from self.rows(key, own.end())
        for state in (self.place, self.registers, self.waiting):
            state.clear()

    def close(self) -> None:
        pass


def stateful(df: DataFrame, columns: tuple[str, ...], machine: Callable[[], object], schema: str, fields: list[str], idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Run a picklable machine with ``feed(pos, *columns) -> dict`` (and, on demand, ``end() -> dict``) over every stream of a streaming DataFrame."""
    conf = df.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = df.schema["stream_id"].dataType.simpleString()
    mode = "None" if idle_ms is None and ttl_ms is None else "ProcessingTime"
    return df.select(*KEY, *columns).groupBy("stream_id").transformWithStateInPandas(
        _Streams(columns, machine, fields, idle_ms, ttl_ms), f"stream_id {kind}, {schema}", "append", mode
    )


def _decayed(x: np.ndarray, decay: float, before: float) -> np.ndarray:
    """y[n] = x[n] + decay * y[n - 1] by doubling steps."""
    y, reach, d = x.copy(), 1, decay
    y[0] += decay * before
    while reach < len(y) and d != 0:
        y[reach:] = y[reach:] + d * y[:-reach]
        reach, d = reach * 2, d * d
    return y


class SinglePole:
    def __init__(self, alpha: float):
        self.alpha, self.y = alpha, 0.0

    def feed(self, pos, v):
        out = _decayed(self.alpha * np.asarray(v, float), 1 - self.alpha, self.y)
        self.y = float(out[-1])
        return {"pos": pos, "v": out}


class Fir:
    """Decimating FIR over live samples; keeps the last T - 1 samples and the phase."""

    def __init__(self, taps, decimation: int = 1):
        self.taps, self.d, self.rest, self.skip, self.n = np.asarray(taps, float), decimation, np.zeros(0), 0, 0

    def feed(self, pos, v):
        x = np.concatenate([self.rest, np.asarray(v, float)])
        full = np.convolve(x, self.taps, "valid") if len(x) >= len(self.taps) else np.zeros(0)
        out = full[self.skip :: self.d]
        self.skip = (self.skip - len(full)) % self.d
        self.rest = x[len(full) :]
        first, self.n = self.n, self.n + len(out)
        return {"pos": np.arange(first, self.n), "v": out}


class Nrzi:
    def __init__(self):
        self.last = 0

    def feed(self, pos, bit):
        before = np.concatenate([[self.last], bit[:-1]]).astype(int)
        self.last = int(bit[-1])
        return {"pos": pos, "bit": (1 ^ bit.astype(int) ^ before).astype(np.int8)}


class Bursts:
    """Edges of a level crossing a threshold."""

    def __init__(self, threshold: float):
        self.threshold, self.high = threshold, False

    def feed(self, pos, v):
        level = np.asarray(v) > self.threshold
        edge = np.flatnonzero(level != np.concatenate([[self.high], level[:-1]]))
        self.high = bool(level[-1])
        return {"pos": pos[edge], "high": level[edge]}


class Hdlc:
    def __init__(self, min_size: int, max_size: int):
        from ..operators.framing import Deframer

        self.own, self.n = Deframer(min_size, max_size), 0

    def feed(self, pos, bit):
        from ..operators.framing import crc16_x25

        found = [(p, f) for p, f in self.own.feed(np.asarray(bit).astype(np.uint8).tobytes()) if len(f) >= 2]
        good = [(p, f[:-2]) for p, f in found if crc16_x25(f[:-2]) == int.from_bytes(f[-2:], "little")]
        first, self.n = self.n, self.n + len(good)
        return {"pdu_idx": list(range(first, self.n)), "data": [f for _, f in good], "packet_pos": [p for p, _ in good]}


class Clock:
    """Picks between sign changes by arithmetic; only those move the clock."""

    def __init__(self, sps: float, max_deviation: float, taps=(0.5, 0.5)):
        from ..operators.clock import SymbolClock

        self.own, self.grid, self.high, self.n = SymbolClock(sps, max_deviation, taps), (-1, 0.0, float(sps)), False, 0

    def feed(self, pos, v):
        from ..operators.clock import on_grid

        v, pos = np.asarray(v, float), np.asarray(pos)
        high = v > 0
        changes = np.flatnonzero(high != np.concatenate([[self.high], high[:-1]]))
        self.high = bool(high[-1])
        picked, lo = np.zeros(len(v), bool), 0
        for hi in [*changes.tolist(), len(v) - 1]:
            picked[lo : hi + 1] = on_grid(pos[lo : hi + 1], *self.grid)
            new = self.own(int(pos[hi])) if hi in changes else None
            self.grid = (int(pos[hi]), *new) if new else self.grid
            lo = hi + 1
        first, self.n = self.n, self.n + int(picked.sum())
        return {"pos": np.arange(first, self.n), "v": v[picked]}


class Demod:
    """Angle from each complex sample to the next."""

    def __init__(self, gain: float):
        self.gain, self.last, self.n = gain, np.zeros(0, complex), 0

    def feed(self, pos, re, im):
        z = np.concatenate([self.last, np.asarray(re) + 1j * np.asarray(im)])
        self.last = z[-1:]
        out = self.gain * np.angle(z[1:] * z[:-1].conj())
        first, self.n = self.n, self.n + len(out)
        return {"pos": np.arange(first, self.n), "v": out}


class Resampler:
    """Output j is the input at j * decimation div interpolation."""

    def __init__(self, interpolation: int, decimation: int):
        g = math.gcd(interpolation, decimation)
        self.i, self.d, self.n = interpolation // g, decimation // g, 0

    def feed(self, pos, v):
        end = -(-(int(pos[-1]) + 1) * self.i // self.d)  # outputs whose input is here
        j = np.arange(self.n, end)
        self.n = max(self.n, end)
        return {"pos": j, "v": np.asarray(v, float)[j * self.d // self.i - int(pos[0])]}


class Packets:
    """Samples while a trigger is above the threshold; longer bursts than ``max_size`` are dropped."""

    def __init__(self, threshold: float, max_size: int):
        self.threshold, self.max_size, self.held, self.size, self.start, self.n = threshold, max_size, [], 0, None, 0

    def feed(self, pos, v, trigger):
        pos, v = np.asarray(pos), np.asarray(v, float)
        level = np.asarray(trigger) > self.threshold
        was = np.concatenate([[self.start is not None], level[:-1]])
        made = {"pdu_idx": [], "start_pos": [], "data": []}
        lo = 0
        for at in [*np.flatnonzero(level != was).tolist(), len(v)]:
            if self.start is not None:
                self.size += at - lo
                self.held = [*self.held, v[lo:at]] if self.size <= self.max_size else []  # never more than max_size
                if at < len(v):
                    if self.size <= self.max_size:
                        made["pdu_idx"].append(self.n)
                        made["start_pos"].append(self.start)
                        made["data"].append(np.concatenate(self.held).tolist())
                        self.n += 1
                    self.held, self.size, self.start = [], 0, None
            elif at < len(v):
                self.start = int(pos[at])
            lo = at
        return made


class Kiss:
    """Byte strings between C0 marks, marks left out; empty ones are skipped."""

    def __init__(self):
        self.rest, self.n, self.open = b"", 0, False

    def feed(self, pos, b):
        *parts, self.rest = (self.rest + np.asarray(b).astype(np.uint8).tobytes()).split(b"\xc0")
        if parts and not self.open:
            parts, self.open = parts[1:], True  # what comes before the first mark is no frame
        frames = [f for f in parts if f]
        first, self.n = self.n, self.n + len(frames)
        return {"pdu_idx": list(range(first, self.n)), "data": frames}


class IqBalance:
    """Samples less their running mean, which takes them in first."""

    def __init__(self, alpha: float):
        self.alpha, self.re, self.im = alpha, 0.0, 0.0

    def feed(self, pos, re, im):
        mr, mi = (_decayed(self.alpha * np.asarray(x, float), 1 - self.alpha, y) for x, y in ((re, self.re), (im, self.im)))
        self.re, self.im = float(mr[-1]), float(mi[-1])
        return {"pos": pos, "re": re - mr, "im": im - mi}


class Vco:
    def __init__(self, k: float):
        self.k, self.phase = k, 0.0

    def feed(self, pos, v):
        phase = self.phase + np.cumsum(self.k * np.asarray(v, float))
        self.phase = float(phase[-1])
        return {"pos": pos, "re": np.sin(phase), "im": np.cos(phase)}


class Descrambler:
    """Bits xor the masked ones before them; the seed stands for those before the start."""

    def __init__(self, mask: int, seed: int, length: int):
        self.lags = [length + 1 - b for b in range(64) if mask >> b & 1]
        self.past = np.array([seed >> i & 1 for i in range(length + 1)], np.int8)

    def feed(self, pos, bit):
        x = np.concatenate([self.past, np.asarray(bit).astype(np.int8)])
        reach, out = len(self.past), x[len(self.past) :].copy()
        for k in self.lags:
            out ^= x[reach - k : len(x) - k]
        self.past = x[len(x) - reach :]
        return {"pos": pos, "bit": out}


class Correlator:
    """Distance of the last bits to a code, once there are enough."""

    def __init__(self, code: list[int], allowed: int, tags: bool):
        if not code:
            raise ValueError("an access code needs bits")
        self.code, self.allowed, self.tags, self.past = np.array(code, np.int8), allowed, tags, np.zeros(0, np.int8)

    def feed(self, pos, bit):
        x = np.concatenate([self.past, np.asarray(bit).astype(np.int8)])
        size = len(self.code)
        far = np.full(len(bit), size + self.allowed + 1)
        if len(x) >= size:
            near = (np.lib.stride_tricks.sliding_window_view(x, size) != self.code).sum(1)
            far[len(far) - len(near) :] = near
        self.past = x[max(0, len(x) - size + 1) :] if size > 1 else x[:0]
        hit = far <= self.allowed
        return {"pos": np.asarray(pos)[hit], "distance": far[hit]} if self.tags else {"pos": pos, "bit": hit.astype(np.int8)}


class ZeroCrossing:
    """Grid points behind the last sign change before each sample."""

    def __init__(self, sps: float):
        self.sps, self.high, self.at, self.n = float(sps), False, -1, 0

    def feed(self, pos, v):
        pos, high = np.asarray(pos), np.asarray(v, float) > 0
        changed = high != np.concatenate([[self.high], high[:-1]])
        upto = np.maximum.accumulate(np.concatenate([[self.at], np.where(changed, pos, -1)]))
        at, self.at, self.high = upto[:-1], int(upto[-1]), bool(high[-1])
        middle = np.maximum(at, 0) + self.sps / 2
        j = np.ceil((pos - middle) / self.sps)
        picked = (j >= 0) & (np.floor(middle + j * self.sps) == pos) & ((at < 0) | (self.sps >= 2))
        first, self.n = self.n, self.n + int(picked.sum())
        return {"pos": np.arange(first, self.n), "v": np.asarray(v, float)[picked]}


class Chunks:
    """Packets of ``size`` samples, each the mean of ``n`` such packets."""

    def __init__(self, size: int, n: int = 1):
        self.size, self.n, self.rest, self.done = size, n, np.zeros(0), 0

    def feed(self, pos, v):
        x = np.concatenate([self.rest, np.asarray(v, float)])
        whole = len(x) // (self.size * self.n)
        used = whole * self.size * self.n
        self.rest = x[used:]
        mean = x[:used].reshape(whole, self.n, self.size).mean(1) if whole else np.zeros((0, self.size))
        first, self.done = self.done, self.done + whole
        return {"pdu_idx": np.arange(first, self.done), "data": mean.tolist()}


class FftFrames:
    """Transforms of every ``size`` complex samples, flattened."""

    def __init__(self, size: int):
        self.size, self.rest, self.done = size, np.zeros(0, complex), 0

    def feed(self, pos, re, im):
        z = np.concatenate([self.rest, np.asarray(re) + 1j * np.asarray(im)])
        used = len(z) // self.size * self.size
        y = np.fft.fft(z[:used].reshape(-1, self.size), axis=1).ravel() if used else np.zeros(0, complex)
        self.rest = z[used:]
        first, self.done = self.done, self.done + used
        return {"pos": np.arange(first, self.done), "re": y.real, "im": y.imag}


class Pwm:
    """Level changes under hysteresis, walked by the batch operator's machine."""

    def __init__(self, settings):
        from ..operators.pwm import Pulses

        settings.check()
        self.s, self.own, self.high, self.size = settings, Pulses(settings), False, 0

    def feed(self, pos, v):
        v = np.asarray(v, float)
        told = np.where(v > self.s.high_threshold, 1, np.where((v < self.s.low) | np.isnan(v), 0, -1))
        known = np.maximum.accumulate(np.where(told >= 0, np.arange(len(v)), -1))
        level = np.where(known >= 0, told[np.maximum(known, 0)], int(self.high)).astype(bool)
        for i in np.flatnonzero(level != np.concatenate([[self.high], level[:-1]])).tolist():
            self.own.edge(int(pos[i]), bool(level[i]))
        self.high, self.size = bool(level[-1]), int(pos[-1]) + 1
        return self.own.taken()

    def end(self):
        """The stream is over: what is complete is given."""
        self.own.end(self.size)
        return self.own.taken()


def single_pole_iir(df: DataFrame, alpha: float) -> DataFrame:
    return stateful(df, ("v",), lambda: SinglePole(alpha), "pos long, v double", ["pos", "v"])


def fir_filter(df: DataFrame, taps, decimation: int = 1) -> DataFrame:
    return stateful(df, ("v",), lambda: Fir(taps, decimation), "pos long, v double", ["pos", "v"])


def nrzi_decode(df: DataFrame) -> DataFrame:
    return stateful(df, ("bit",), Nrzi, "pos long, bit byte", ["pos", "bit"])


def burst_edges(df: DataFrame, threshold: float, column: str = "v") -> DataFrame:
    return stateful(df, (column,), lambda: Bursts(threshold), "pos long, high boolean", ["pos", "high"])


def hdlc_deframer(df: DataFrame, min_size: int, max_size: int) -> DataFrame:
    return stateful(df, ("bit",), lambda: Hdlc(min_size, max_size), "pdu_idx long, data binary, packet_pos long", ["pdu_idx", "data", "packet_pos"])


def symbol_sync(df: DataFrame, sps: float, max_deviation: float, taps=(0.5, 0.5)) -> DataFrame:
    return stateful(df, ("v",), lambda: Clock(sps, max_deviation, taps), "pos long, v double", ["pos", "v"])


def quadrature_demod(df: DataFrame, gain: float = 1.0) -> DataFrame:
    return stateful(df, ("re", "im"), lambda: Demod(gain), "pos long, v double", ["pos", "v"])


def rational_resampler(df: DataFrame, interpolation: int, decimation: int) -> DataFrame:
    return stateful(df, ("v",), lambda: Resampler(interpolation, decimation), "pos long, v double", ["pos", "v"])


def stream_to_pdu(df: DataFrame, threshold: float, max_size: int) -> DataFrame:
    """Bursts of ``v`` while the column ``trigger`` is above the threshold."""
    return stateful(df, ("v", "trigger"), lambda: Packets(threshold, max_size), "pdu_idx long, start_pos long, data array<double>", ["pdu_idx", "start_pos", "data"])


def kiss_frame(df: DataFrame) -> DataFrame:
    return stateful(df, ("b",), Kiss, "pdu_idx long, data binary", ["pdu_idx", "data"])


def iq_balance(df: DataFrame, alpha: float, **kept) -> DataFrame:
    return stateful(df, ("re", "im"), lambda: IqBalance(alpha), "pos long, re double, im double", ["pos", "re", "im"], **kept)


def vco(df: DataFrame, k: float, **kept) -> DataFrame:
    return stateful(df, ("v",), lambda: Vco(k), "pos long, re double, im double", ["pos", "re", "im"], **kept)


def descrambler(df: DataFrame, mask: int = 0x21, seed: int = 0, length: int = 16, **kept) -> DataFrame:
    return stateful(df, ("bit",), lambda: Descrambler(mask, seed, length), "pos long, bit byte", ["pos", "bit"], **kept)


def correlate_access_code(df: DataFrame, code: list[int], allowed: int = 0, **kept) -> DataFrame:
    return stateful(df, ("bit",), lambda: Correlator(code, allowed, False), "pos long, bit byte", ["pos", "bit"], **kept)


def correlate_access_code_tag(df: DataFrame, code: list[int], key: str, allowed: int = 0, **kept) -> DataFrame:
    """Tags (stream_id, pos, key, val) on the last bit of each match."""
    found = stateful(df, ("bit",), lambda: Correlator(code, allowed, True), "pos long, distance long", ["pos", "distance"], **kept)
    return found.select(*KEY, F.lit(key).alias("key"), tag_value("u", F.col("distance")).alias("val"))


def zero_crossing(df: DataFrame, sps: float, **kept) -> DataFrame:
    return stateful(df, ("v",), lambda: ZeroCrossing(sps), "pos long, v double", ["pos", "v"], **kept)


def stream_chunks(df: DataFrame, size: int, **kept) -> DataFrame:
    return stateful(df, ("v",), lambda: Chunks(size), "pdu_idx long, data array<double>", ["pdu_idx", "data"], **kept)


def pdu_average(pdus: DataFrame, n: int, size: int, **kept) -> DataFrame:
    """Mean of every n packets (stream_id, pdu_idx, data) of ``size`` values; another length is an error."""
    right = F.when(F.size("data") == size, F.col("data")).otherwise(F.raise_error(F.lit(f"a packet is not of size {size}")).cast("array<double>"))
    rows = pdus.select("stream_id", "pdu_idx", F.posexplode(right).alias("_k", "v"))
    rows = rows.select("stream_id", (F.col("pdu_idx") * size + F.col("_k")).alias("pos"), "v")
    return stateful(rows, ("v",), lambda: Chunks(size, n), "pdu_idx long, data array<double>", ["pdu_idx", "data"], **kept)


def fft_stream(df: DataFrame, size: int, **kept) -> DataFrame:
    return stateful(df, ("re", "im"), lambda: FftFrames(size), "pos long, re double, im double", ["pos", "re", "im"], **kept)


def pwm_decoder(df: DataFrame, settings, **kept) -> DataFrame:
    """Frames when their transmission ends; with ``idle_ms`` also those of a stream that fell silent."""
    return stateful(df, ("v",), lambda: Pwm(settings), "pdu_idx long, bits array<byte>, repeats int, first_sample long", ["pdu_idx", "bits", "repeats", "first_sample"], **kept)


# Zips: joins of two live streams on (stream_id, pos).


def zip_streams(a: DataFrame, b: DataFrame, ts: str = "ts", late: str = "10 seconds", apart: str = "1 minute", suffix: str = "_2") -> DataFrame:
    """Samples of both streams at the same position, whichever comes first.

    Both have an event time ``ts``.  Rows of one position lie at most ``apart`` from each other,
    so once the watermark (``late`` behind the newest time of the slower source) has passed that far beyond a row, matched
    or not, its state is dropped.  The result keeps the first stream's time.
    """
    mine = [c for c in a.columns if c not in (*KEY, ts)]
    theirs = {c: c + suffix if c in mine else c for c in b.columns if c not in (*KEY, ts)}
    left = a.withWatermark(ts, late)
    right = b.select(F.col("stream_id").alias("_s"), F.col("pos").alias("_p"), F.col(ts).alias("_ts"), *(F.col(c).alias(n) for c, n in theirs.items())).withWatermark("_ts", late)
    near = F.expr(f"_ts BETWEEN {ts} - INTERVAL {apart} AND {ts} + INTERVAL {apart}")
    both = left.join(right, (F.col("stream_id") == F.col("_s")) & (F.col("pos") == F.col("_p")) & near)
    return both.select(*KEY, ts, *mine, *theirs.values())


def _zipped(a: DataFrame, b: DataFrame, made: dict[str, Column], options: dict) -> DataFrame:
    return zip_streams(a, b, **options).select(*KEY, *(c.alias(n) for n, c in made.items()))


def add(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    names = [c for c in ("v", "re", "im") if c in a.columns]
    return _zipped(a, b, {c: F.col(c) + F.col(f"{c}_2") for c in names}, options)


def xor(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    return _zipped(a, b, {"bit": F.col("bit").bitwiseXOR(F.col("bit_2"))}, options)


def float_to_complex(re: DataFrame, im: DataFrame, **options) -> DataFrame:
    return _zipped(re, im, {"re": F.col("v"), "im": F.col("v_2")}, options)


def to_text(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """Lines of both values with a space between."""
    return _zipped(a, b, {"line": F.concat_ws(" ", F.col("v").cast("string"), F.col("v_2").cast("string"))}, options)


def triggered(data: DataFrame, trigger: DataFrame, **options) -> DataFrame:
    """Samples with the trigger at their position, as ``stream_to_pdu`` and ``burst_edges`` take them."""
    return _zipped(data, trigger, {"v": F.col("v"), "trigger": F.col("v_2")}, options)


def strobe(spark: SparkSession, data: str, per_second: int = 1, stream_id: str = "strobe") -> DataFrame:
    """The same message at a fixed rate."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select(F.lit(stream_id).alias("stream_id"), F.col("value").alias("pdu_idx"), F.col("timestamp").alias("ts"), F.lit(data).alias("msg"))


def canary(spark: SparkSession, name: str, f: Callable[[], None]):
    """Call ``f`` when the streaming query of that name ends; returns the listener (remove it when done)."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def __init__(self):
            self.ids = set()

        def onQueryStarted(self, event):
            if event.name == name:
                self.ids.add(event.id)

        def onQueryProgress(self, event):
            pass

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            if event.id in self.ids:
                f()

    listener = Listener()
    spark.streams.addListener(listener)
    return listener
