"""Filters and demodulators.

Short filters are sums of lagged columns inside halo windows (JVM only); long ones run on
array chunks, each with the neighbour samples it needs, through numpy in Arrow tasks.
Outputs are numbered densely; no filter needs more than one small sort per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taps import WindowType, hilbert_taps
from ..model import KEY, Stream, affine_scan, halo, lagged, lengths, sequential, stored, values, windowed

#: More taps than this go through array chunks.
SHORT_TAPS = 16
#: More taps than this are applied by multiplying spectra (overlap-save over the chunks).
SHORT_FFT = 64


def _is_complex(df: DataFrame) -> bool:
    return "re" in df.columns


def _array_chunks(df: DataFrame, left: int, right: int, chunk: int) -> DataFrame:
    """(stream_id, _chunk, first, data...) with halo rows, in order of pos."""
    names = values(df)
    packed = halo(df, left, right, chunk).groupBy("stream_id", "_chunk").agg(
        F.array_sort(F.collect_list(F.struct("pos", *names))).alias("_rows")
    )
    columns = [F.col(f"_rows.{c}").cast("array<double>").alias(c) for c in names]
    return packed.select("stream_id", "_chunk", F.element_at("_rows.pos", 1).alias("_first"), *columns)


def _convolved(df: DataFrame, taps: np.ndarray, offset: int, ahead: int = 0, chunk: int = 8192) -> DataFrame:
    """y[n] = sum of taps[t] * x[n + offset - t], zeros outside; rows of all n for which the input has n + ahead."""
    size = len(taps)
    left, right = max(0, size - 1 - offset), max(0, offset, ahead)
    chunk = max(chunk, 2 * size, left + 1, right + 1)
    cplx = _is_complex(df) or np.iscomplexobj(taps)
    names = values(df)
    schema = f"stream_id {df.schema['stream_id'].dataType.simpleString()}, pos long, " + ("re double, im double" if cplx else "v double")

    spectra: dict[int, np.ndarray] = {}

    def filtered(x: np.ndarray) -> np.ndarray:
        """Full convolution, through spectra where that is less work."""
        if size <= SHORT_FFT:
            return np.convolve(x, taps)
        width = 1 << (len(x) + size - 2).bit_length()
        if width not in spectra:
            spectra[width] = np.fft.fft(taps, width)
        y = np.fft.ifft(np.fft.fft(x, width) * spectra[width])[: len(x) + size - 1]
        return y if cplx else y.real

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = [batch.column(3 + c)[i].values.to_numpy(zero_copy_only=False) for c in range(len(names))]
                x = data[0] + 1j * data[1] if len(names) == 2 else data[0]
                number, first = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                lo, hi = number * chunk, min((number + 1) * chunk, first + len(x) - ahead)
                # x starts at position first; full convolution puts tap t on sample s at s + t.
                full = filtered(x)
                at = np.arange(lo, hi) + offset - first
                y = full[np.clip(at, 0, len(full) - 1)] * ((at >= 0) & (at < len(full)))
                key = pa.array([batch.column(0)[i].as_py()], batch.column(0).type).take(pa.array(np.zeros(len(y), np.int64)))
                parts = [pa.array(np.ascontiguousarray(v)) for v in ((y.real, y.imag) if cplx else (y.real,))]
                yield pa.RecordBatch.from_arrays([key, pa.array(np.arange(lo, hi)), *parts], names=["stream_id", "pos", *(("re", "im") if cplx else ("v",))])

    return _array_chunks(df, left, right, chunk).mapInArrow(run, schema)


def fir_filter(stream: Stream | DataFrame, taps, decimation: int = 1, samp_rate: float = 0.0, translate: float = 0.0) -> Stream:
    """Decimating FIR filter, only where all taps have samples: y[j] = sum of taps[t] * x[j * D + T - 1 - t].

    ``translate`` first mixes by -translate Hz, folded into the taps.  Tags go to pos div D
    if their sample is consumed.
    """
    stream = stream if isinstance(stream, Stream) else Stream(stream)
    df, taps, d = stream.df, np.asarray(taps), decimation
    t = len(taps)
    if translate:
        omega = 2 * math.pi * translate / samp_rate
        taps = taps * np.exp(1j * omega * np.arange(t))
    # An output needs the t samples under its taps and d samples to consume, the last of them t + d - 2 ahead.
    y = (_lag_filter if t <= SHORT_TAPS else _convolved)(df, taps, t - 1, t + d - 2)
    y = y.filter(F.pmod("pos", F.lit(d)) == 0).withColumn("pos", F.expr(f"pos div {d}"))
    if translate:
        phase = F.lit(-omega) * (F.lit(t - 1) + F.col("pos") * d)
        re, im = F.col("re"), F.col("im")
        y = y.select(*KEY, (re * F.cos(phase) - im * F.sin(phase)).alias("re"), (re * F.sin(phase) + im * F.cos(phase)).alias("im"))
    tags = stream.tags
    if tags is not None:
        n_out = lengths(df).select("stream_id", F.when(F.col("n") >= t + d - 1, F.floor((F.col("n") - t + 1) / d)).otherwise(0).alias("_n"))
        tags = tags.join(n_out, "stream_id").filter(F.col("pos") < F.col("_n") * d).withColumn("pos", F.expr(f"pos div {d}")).drop("_n")
    return Stream(y, tags)


def _lag_filter(df: DataFrame, taps: np.ndarray, offset: int, ahead: int = 0) -> DataFrame:
    """The same as ``_convolved`` as a sum of lagged columns."""
    t, cplx = len(taps), _is_complex(df) or np.iscomplexobj(taps)

    def columns(w: Window) -> dict[str, Column]:
        return made(w) | ({"_ahead": F.lead("pos", ahead).over(w)} if ahead else {})

    def made(w: Window) -> dict[str, Column]:
        x = [lagged("re" if _is_complex(df) else "v", k - offset, w, 0.0) for k in range(t)]
        if not cplx:
            return {"v": _dot(taps.real, x)}
        y = [lagged("im", k - offset, w, 0.0) for k in range(t)] if _is_complex(df) else None
        re, im = _dot(taps.real, x), _dot(taps.imag, x)
        return {"re": re - _dot(taps.imag, y), "im": im + _dot(taps.real, y)} if y else {"re": re, "im": im}

    out = windowed(df, max(0, t - 1 - offset), max(0, offset, ahead), columns)
    out = out.filter(F.col("_ahead").isNotNull()) if ahead else out
    return out.select(*KEY, *(("re", "im") if cplx else ("v",)))


def _dot(taps, xs: list[Column]) -> Column:
    out = F.lit(0.0)
    for c, x in zip(taps, xs, strict=True):
        out = out + F.lit(float(c)) * x
    return out


def fft_filter(stream: Stream | DataFrame, taps, flush: bool = False) -> Stream:
    """Causal filter y[n] = sum of taps[t] * x[n - t] with zero history.

    Output comes in whole blocks of F - T samples, F twice the next power of two of T; the
    rest at the end is lost, unless ``flush``.  Tags stay at their positions.
    """
    stream = stream if isinstance(stream, Stream) else Stream(stream)
    taps = np.asarray(taps)
    t = len(taps)
    size = 2 * (1 << max(0, (t - 1).bit_length()))
    block = size - t
    y = _lag_filter(stream.df, taps, 0) if t <= SHORT_TAPS else _convolved(stream.df, taps, 0)
    tags = stream.tags
    if not flush:
        n_out = lengths(stream.df).select("stream_id", (F.floor(F.col("n") / block) * block).alias("_n"))
        y = y.join(n_out, "stream_id").filter("pos < _n").drop("_n")
        tags = tags.join(n_out, "stream_id").filter("pos < _n").drop("_n") if tags is not None else None
    return Stream(y, tags)


def hilbert(stream: Stream | DataFrame, n_taps: int, window: WindowType) -> Stream:
    """Analytic signal: re is the input delayed by T - T div 2, im the Hilbert filter of the last T samples before the current."""
    if n_taps % 2 == 0 or n_taps < 3:
        raise ValueError("a Hilbert filter needs an odd number of taps above 1")
    stream = stream if isinstance(stream, Stream) else Stream(stream)
    taps = hilbert_taps(window.make_window(n_taps))
    back = n_taps - n_taps // 2
    delayed = windowed(stream.df, back, 0, lambda w: {"re": lagged("v", back, w, 0.0)}).select(*KEY, "re")
    im = _convolved(stream.df, taps, -1).withColumnRenamed("v", "im")
    return Stream(delayed.join(im, list(KEY)), stream.tags)


def single_pole_iir(df: DataFrame, alpha: float) -> DataFrame | None:
    """y[n] = alpha * x[n] + (1 - alpha) * y[n - 1]; None for an alpha outside [0, 1]."""
    if not 0 <= alpha <= 1:
        return None
    return affine_scan(df, 1 - alpha, {c: F.col(c) * alpha for c in values(df)}).select(*KEY, *values(df))


def iq_balance(df: DataFrame, samp_rate: float | None = None, tau: float = 0.2, alpha: float | None = None) -> DataFrame:
    """Subtract the running mean (updated first) of re and im."""
    if alpha is None:
        good = samp_rate and math.isfinite(tau) and tau > 0
        alpha = 1 - math.exp(-1 / (tau * samp_rate)) if good else 0.5
    mean = affine_scan(df, 1 - alpha, {"_mr": F.col("re") * alpha, "_mi": F.col("im") * alpha})
    return mean.select(*KEY, (F.col("re") - F.col("_mr")).alias("re"), (F.col("im") - F.col("_mi")).alias("im"))


class Iir:
    """A general recursive filter of a few numbers: y = taps[0] * x + sum of taps[i + 1] * y[-1 - i], clamped on demand."""

    def __init__(self, taps):
        if not len(taps):
            raise ValueError("an IIR filter needs taps")
        self.taps, self.past = list(map(float, taps)), []

    def fill(self, value: float) -> None:
        self.past = [float(value)] * (len(self.taps) - 1)

    def __call__(self, x: float, least: float = -math.inf, most: float = math.inf) -> float:
        y = self.taps[0] * x + sum(t * p for t, p in zip(self.taps[1:], reversed(self.past), strict=False))
        y = min(max(y, least), most)
        self.past = [*self.past, y][-(len(self.taps) - 1) :] if len(self.taps) > 1 else []
        return y


def iir_filter(df: DataFrame, taps, least: float = -math.inf, most: float = math.inf, chunk: int = 4096) -> DataFrame:
    """The general recursive filter y[n] = taps[0] * x[n] + sum of taps[k] * y[n - k], optionally clamped.

    Without limits it is a scan with the filter's companion matrix, with one feedback tap a scan
    of clamped maps; both run chunk by chunk, and only chunk ends pass through a task per stream.
    Clamped filters of higher order have no maps that stay small: their chunks are speculated.
    """
    if not len(taps):
        raise ValueError("an IIR filter needs taps")
    head, *back = map(float, taps)
    xs = df.select(*KEY, F.col("v").cast("double").alias("v"))
    if not back:
        return xs.select(*KEY, F.greatest(F.least(F.col("v") * head, F.lit(float(most))), F.lit(float(least))).alias("v"))
    limited = least > -math.inf or most < math.inf
    if limited and len(back) > 1:
        return speculated(xs, len(back), _clamped_lanes(head, back, least, most), chunk=chunk, outputs=("v",))[0]
    scan = _ClampedScan(head, back[0], least, most) if limited else _CompanionScan(head, back, chunk)
    return _scanned(xs, scan, chunk)


class _CompanionScan:
    """State: the last outputs, the latest first.  A chunk moves it by a power of the companion matrix and adds its own part."""

    def __init__(self, head: float, back: list[float], chunk: int):
        k = len(back)
        self.head, self.k = head, k
        self.matrix = np.eye(k, k=-1)
        self.matrix[0] = back
        self.start = np.zeros(k)
        powers = [np.eye(k)]
        with np.errstate(all="ignore"):  # of a filter that runs away
            for _ in range(chunk):
                powers.append(powers[-1] @ self.matrix)
        self.powers = np.array(powers)

    def local(self, x: np.ndarray) -> np.ndarray:
        """States behind each sample from a zero state, by doubling steps."""
        s = np.zeros((len(x), self.k))
        s[:, 0] = self.head * x
        step = 1
        with np.errstate(all="ignore"):
            while step < len(x):
                s[step:] = s[step:] + s[:-step] @ self.powers[step].T
                step *= 2
        return s

    def summary(self, x: np.ndarray) -> np.ndarray:
        return self.local(x)[-1]

    def moved(self, state: np.ndarray, summary: np.ndarray, n: int) -> np.ndarray:
        return self.powers[n] @ state + summary

    def output(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        return self.local(x)[:, 0] + self.powers[1 : len(x) + 1, 0] @ state


class _ClampedScan:
    """State: the last output.  Samples are maps y -> clamp(a * y + c, lo, hi), which are closed under composition."""

    def __init__(self, head: float, a: float, least: float, most: float):
        self.head, self.a, self.least, self.most = head, a, least, most
        self.start = np.zeros(1)

    def maps(self, x: np.ndarray) -> np.ndarray:
        """(a, c, lo, hi) of all samples up to each, by doubling steps."""
        f = np.stack([np.full(len(x), self.a), self.head * x, np.full(len(x), float(self.least)), np.full(len(x), float(self.most))])
        step = 1
        while step < len(x):
            f[:, step:] = _then(f[:, :-step], f[:, step:])
            step *= 2
        return f

    def summary(self, x: np.ndarray) -> np.ndarray:
        return self.maps(x)[:, -1]

    def moved(self, state: np.ndarray, summary: np.ndarray, n: int) -> np.ndarray:
        return _at(summary[:, None], state)

    def output(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        return _at(self.maps(x), state)


def _at(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values of clamped maps; a slope of zero takes infinities too."""
    a, c, lo, hi = f
    return np.clip(np.where(a == 0, 0, np.where(a == 0, 1, a) * np.where(a == 0, 0, y)) + c, lo, hi)


def _then(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """First f, then g."""
    a, c = g[0] * f[0], g[0] * f[1] + g[1]
    ends = _at(g, f[2]), _at(g, f[3])
    return np.stack([a, c, np.minimum(*ends), np.maximum(*ends)])


def _sample_chunks(df: DataFrame, names: tuple[str, ...], chunk: int) -> DataFrame:
    """(stream_id, _chunk, an array of doubles for each name)."""
    packed = df.groupBy("stream_id", F.floor(F.col("pos") / chunk).alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("_rows"))
    return packed.select("stream_id", "_chunk", *(F.col(f"_rows.{c}").cast("array<double>").alias(c) for c in names))


def _scanned(df: DataFrame, scan, chunk: int) -> DataFrame:
    """Chunks by the maps of ``scan``: its summaries, a fold over them, and outputs from each chunk's state."""
    chunks = _sample_chunks(df, ("v",), chunk)

    def summaries(column: pd.Series) -> pd.Series:
        return pd.Series([scan.summary(np.asarray(x, float)) for x in column])

    def outputs(column: pd.Series, states: pd.Series) -> pd.Series:
        return pd.Series([scan.output(np.asarray(x, float), np.asarray(s, float)) for x, s in zip(column, states, strict=True)])

    def machine():
        state = [scan.start]

        def step(pos, summary, n, end):
            before = []
            for own, size in zip(summary.tolist(), n.tolist(), strict=True):
                before.append(state[0].tolist())
                state[0] = scan.moved(state[0], np.asarray(own, float), int(size))
            return {"pos": pos.astype(np.int64), "_state": before}

        return step

    ends = chunks.select("stream_id", F.col("_chunk").alias("pos"), F.pandas_udf(summaries, "array<double>")("v").alias("_s"), F.size("v").cast("long").alias("_n"))
    carried = sequential(ends, ("pos", "_s", "_n"), machine, "pos long, _state array<double>").withColumnRenamed("pos", "_chunk")
    made = chunks.join(carried, ["stream_id", "_chunk"]).select("stream_id", "_chunk", F.pandas_udf(outputs, "array<double>")("v", "_state").alias("_y"))
    return made.select("stream_id", "_chunk", F.posexplode("_y").alias("_k", "v")).select("stream_id", (F.col("_chunk") * chunk + F.col("_k")).alias("pos"), "v")


#: Lanes that one array step takes at once, and starts that count as equal.
_LANES, _SAME = 256, 1e-12


def speculated(df: DataFrame, size: int, lanes: Callable, start=None, chunk: int = 4096, outputs: tuple[str, ...] = ("v",), ahead: int = 0, same: float = _SAME) -> tuple[DataFrame, float]:
    """A machine without small maps, run on all chunks at once from guessed states until the guesses hold.

    ``lanes(states, samples, lengths) -> (outputs, states behind)`` steps many chunks side by side.  A
    chunk's first guess is the state behind the chunk before it, run from ``start``.  Chunks
    whose guess differs from what the chunk before now leaves run again, until none does: the
    first chunk of a stream is right, so in the end all are, to ``same`` (0: bit for bit).
    Returns the outputs and the share of chunks that ran again.
    """
    names = tuple(values(df))
    begin = np.zeros(size) if start is None else np.asarray(start, float)
    spread = halo(df, 0, ahead, chunk).drop("_own") if ahead else df.withColumn("_chunk", F.floor(F.col("pos") / chunk))
    packed = spread.groupBy("stream_id", "_chunk").agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("_rows"))
    packed = packed.filter(F.col("_rows")[0]["pos"] < (F.col("_chunk") + 1) * chunk)
    chunks = stored(packed.select("stream_id", "_chunk", *(F.col(f"_rows.{c}").cast("array<double>").alias(c) for c in names)))
    key = ["stream_id", "_chunk"]

    def run(rows: DataFrame, full: bool) -> DataFrame:
        """States behind each chunk from ``_state``; with ``full`` the outputs."""
        kind = df.schema["stream_id"].dataType.simpleString()
        schema = f"stream_id {kind}, _chunk long, " + (", ".join(f"{c} array<double>" for c in outputs) if full else "_end array<double>")

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, _LANES):
                    own = batch.slice(lo, _LANES)
                    arrays = [[x.values.to_numpy() for x in own.column(2 + i)] for i in range(len(names))]
                    n = np.array([len(x) for x in arrays[0]])
                    samples = [np.stack([np.pad(x, (0, n.max() - len(x))) for x in a]) for a in arrays]
                    states = np.stack([x.values.to_numpy() for x in own.column(2 + len(names))]).astype(float)
                    made, behind = lanes(states, samples, n)
                    if full:
                        last = np.clip(n - ahead, 0, chunk)
                        lists = [pa.array([y[:m] for y, m in zip(o, last, strict=True)], pa.list_(pa.float64())) for o in made]
                    else:
                        lists = [pa.array(list(behind), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *lists], names=["stream_id", "_chunk", *(outputs if full else ("_end",))])

        return rows.select(*key, *names, "_state").mapInArrow(step, schema)

    order = Window.partitionBy("stream_id").orderBy("_chunk")
    first = F.array(*map(F.lit, begin.tolist())).cast("array<double>")
    near = lambda x, y: x.eqNullSafe(y) | (F.abs(y) < math.inf) & (F.abs(x - y) <= F.lit(float(same)) * (1 + F.abs(y)))
    far = lambda a, b: F.exists(F.zip_with(a, b, lambda x, y: ~near(x, y)), lambda z: F.coalesce(z, F.lit(True)))
    # A first run from the start tells each chunk a state to begin with; all but the first chunks run again from it.
    cold = stored(run(chunks.withColumn("_state", first), False))
    guess = cold.withColumn("_state", F.coalesce(F.lag("_end").over(order), first)).drop("_end")
    later = run(chunks.join(guess.filter("_chunk > 0"), key), False)
    now = stored(guess.join(later.unionByName(cold.filter("_chunk = 0")), key))
    total, again = now.count(), 0
    while True:
        next_ = now.withColumn("_left", F.coalesce(F.lag("_end").over(order), first))
        wrong = stored(next_.filter(far(F.col("_state"), F.col("_left"))).select(*key, F.col("_left").alias("_state")))
        n = wrong.count()
        if not n:
            break
        again += n
        fixed = wrong.join(run(chunks.join(wrong, key), False), key)
        now = stored(now.join(wrong, key, "left_anti").unionByName(fixed))
    made = run(chunks.join(now.drop("_end"), key), True)
    rows = made.select(*key, F.posexplode(F.arrays_zip(*outputs)).alias("_k", "_z"))
    out = rows.select("stream_id", (F.col("_chunk") * chunk + F.col("_k")).alias("pos"), *(F.col(f"_z.{c}").alias(c) for c in outputs))
    return out, again / max(total, 1)


def _clamped_lanes(head: float, back: list[float], least: float, most: float) -> Callable:
    """Clamped recursive filters side by side; the latest output comes first in a state."""

    def lanes(states: np.ndarray, samples: list[np.ndarray], n: np.ndarray):
        (x,) = samples
        k = len(back)
        past = np.concatenate([states[:, ::-1], np.zeros_like(x)], 1)
        for t in range(x.shape[1]):
            y = head * x[:, t]
            for j, c in enumerate(back, 1):
                y = y + c * past[:, k + t - j]
            past[:, k + t] = np.clip(y, least, most)
        behind = np.stack([past[np.arange(len(n)), k + n - 1 - j] for j in range(k)], 1)
        return [past[:, k:]], behind

    return lanes


def cma_equalizer(stream: Stream | DataFrame, n_taps: int, modulus: float, step_size: float, chunk: int = 4096) -> Stream | DataFrame:
    """Constant-modulus equaliser: taps adapt behind every output; N - T + 1 outputs.

    Loud samples make the taps run away, and rounding with them; so sums are taken tap by tap, real
    parts apart from imaginary ones, as a plain loop takes them, and chunks join bit for bit.
    A Stream keeps the tags of positions that the output has.
    """
    return equalized(stream, n_taps, modulus, step_size, chunk)[0]


def equalized(stream: Stream | DataFrame, n_taps: int, modulus: float, step_size: float, chunk: int = 4096) -> tuple[Stream | DataFrame, float]:
    """The equaliser's output, and the share of chunks whose taps were guessed wrong at first and ran again."""
    if n_taps < 1:
        raise ValueError("an equaliser needs taps")
    df = stream.df if isinstance(stream, Stream) else stream
    start = np.zeros(2 * n_taps)
    start[0] = 1

    def lanes(states: np.ndarray, samples: list[np.ndarray], n: np.ndarray):
        x, z = samples
        a, b = list(states[:, :n_taps].T), list(states[:, n_taps:].T)
        steps = np.clip(n - (n_taps - 1), 0, chunk)
        re = np.zeros((len(n), max(int(steps.max(initial=0)), 0)))
        im = np.zeros_like(re)
        with np.errstate(all="ignore"):  # of taps that run away
            for t in range(re.shape[1]):
                own = [(x[:, t + i], z[:, t + i]) for i in range(n_taps)]
                u, v = a[0] * own[0][0] - b[0] * own[0][1], a[0] * own[0][1] + b[0] * own[0][0]
                for i in range(1, n_taps):
                    u, v = u + a[i] * own[i][0] - b[i] * own[i][1], v + a[i] * own[i][1] + b[i] * own[i][0]
                re[:, t], im[:, t] = u, v
                gain, live = step_size * (modulus - (u * u + v * v)), t < steps
                for i, (p, q) in enumerate(own):
                    a[i], b[i] = np.where(live, a[i] + gain * (u * p + v * q), a[i]), np.where(live, b[i] + gain * (v * p - u * q), b[i])
        return [re, im], np.stack([*a, *b], 1)

    out, share = speculated(df.select(*KEY, "re", "im"), 2 * n_taps, lanes, start, chunk, ("re", "im"), n_taps - 1, same=0.0)
    if not isinstance(stream, Stream):
        return out, share
    n_out = lengths(df).select("stream_id", (F.col("n") - (n_taps - 1)).alias("_n"))
    tags = stream.tags.join(n_out, "stream_id").filter("pos < _n").drop("_n") if stream.tags is not None else None
    return Stream(out, tags), share


def quadrature_demod(df: DataFrame, gain: float = 1.0) -> DataFrame:
    """Angle from each sample to the next, times the gain; one output less, tags dropped."""

    def columns(w: Window) -> dict[str, Column]:
        nr, ni = F.lead("re").over(w), F.lead("im").over(w)
        re, im = F.col("re"), F.col("im")
        return {"v": F.atan2(re * ni - im * nr, re * nr + im * ni) * gain}

    return windowed(df, 0, 1, columns).select(*KEY, "v").filter(F.col("v").isNotNull())


def fast_fm(df: DataFrame) -> DataFrame:
    """A cheap discriminator over three samples, zeros before the start."""

    def columns(w: Window) -> dict[str, Column]:
        re1, re2, im1, im2 = (lagged(c, n, w, 0.0) for c, n in (("re", 1), ("re", 2), ("im", 1), ("im", 2)))
        return {"v": (F.col("im") - im2) * re1 - (F.col("re") - re2) * im1}

    return windowed(df, 2, 0, columns).select(*KEY, "v")
