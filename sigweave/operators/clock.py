"""Symbol clock recovery.

A stream is cut into chunks once; each tells its sign changes.  Only they can move a clock, so
only they pass through a state machine per stream (symbol sync) or a window over chunks (zero crossing).  Between
two changes of the clock the picked samples lie on a grid (phase + j * clock), so each chunk
picks its samples by arithmetic from the last grid before them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import CHUNK, KEY, by_chunks, sequential, unpacked


def _chunks(df: DataFrame, chunk: int) -> DataFrame:
    """Packed chunks with the sample before each, and ``_at``: their sign changes."""

    def changes(number: int, first: int, arrays: list[np.ndarray]) -> tuple:
        return first, arrays[0], _changes(number, first, arrays[0], chunk)

    rows = df.select(*KEY, F.col("v").cast("double").alias("v"))
    return by_chunks(rows, ("v",), changes, "_first long, v array<double>, _at array<long>", 1, 0, chunk)


def _changes(number: int, first: int, v: np.ndarray, chunk: int) -> np.ndarray:
    high = v > 0
    at = first + np.flatnonzero(high != np.concatenate([[False], high])[: len(high)])
    return at[at >= number * chunk]


def _own(number: int, first: int, v, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and samples of the chunk itself."""
    skip = number * chunk - first
    v = np.asarray(v, float)[skip:]
    return number * chunk + np.arange(len(v)), v


def _numbered(found: DataFrame) -> DataFrame:
    """The picked samples as a stream of v and clock."""
    rows = found.select("stream_id", "_chunk", F.arrays_zip("_z.v", "_z.clock").alias("_z"))
    return unpacked(rows, "_z", "pos").select("stream_id", "pos", "_z.v", "_z.clock")


_PICKED = "v array<double>, clock array<double>"


def _checked(sps: float) -> float:
    if sps <= 1:
        raise ValueError("more than one sample per symbol is needed")
    return float(sps)


def zero_crossing(df: DataFrame, sps: float, max_deviation: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """One sample per symbol, the first half a symbol behind each sign change; ``max_deviation`` is accepted and has no effect."""
    sps = _checked(sps)
    chunks = _chunks(df, chunk)
    before = Window.partitionBy("stream_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = chunks.select("stream_id", "_chunk", F.get("_at", F.size("_at") - 1).alias("_l"))
    last = last.select("stream_id", "_chunk", F.coalesce(F.last("_l", ignorenulls=True).over(before), F.lit(-1)).alias("_before"))

    def picked(number: pd.Series, first: pd.Series, column: pd.Series, changes: pd.Series, early: pd.Series) -> pd.DataFrame:
        out = []
        for c, f, x, own, e in zip(number, first, column, changes, early, strict=True):
            pos, v = _own(c, f, x, chunk)
            ends = np.concatenate([[e], np.asarray(own, np.int64)])
            at = ends[np.searchsorted(ends[1:], pos, "left")]  # the last change before each sample
            middle = np.maximum(at, 0) + sps / 2
            j = np.ceil((pos - middle) / sps)
            # The grid of a sign change starts behind it; with fewer than two samples a symbol it starts on it and is missed.
            hit = (j >= 0) & (np.floor(middle + j * sps) == pos) & ((at < 0) | (sps >= 2))
            out.append((v[hit], np.full(int(hit.sum()), sps)))
        return pd.DataFrame(out, columns=["v", "clock"])

    both = chunks.join(last, ["stream_id", "_chunk"])
    return _numbered(both.select("stream_id", "_chunk", F.pandas_udf(picked, _PICKED)("_chunk", "_first", "v", "_at", "_before").alias("_z")))


class SymbolClock:
    """The clock over sign changes alone; a call with a sign change's place returns the grid it starts."""

    def __init__(self, sps: float, deviation: float, taps):
        if not len(taps):
            raise ValueError("a clock filter needs taps")
        self.sps, self.least, self.most = sps, sps - deviation, sps + deviation
        self.taps, self.past = list(map(float, taps)), []
        self.clock, self.last = sps, None

    def state(self) -> list[float]:
        return [self.clock, math.nan if self.last is None else self.last, *self.past]

    def resume(self, state: list[float]) -> None:
        self.clock, last, *self.past = state
        self.last = None if math.isnan(last) else int(last)

    def _filtered(self, x: float) -> float:
        y = self.taps[0] * x + sum(t * p for t, p in zip(self.taps[1:], self.past, strict=False))
        y = min(max(y, self.least - self.sps), self.most - self.sps)
        self.past = [y, *self.past][: len(self.taps) - 1]
        return y

    def __call__(self, at: int) -> tuple[float, float] | None:
        """(a picked place, clock) from the sign change ``at`` on, or None if the grid stays."""
        last, self.last = self.last, at
        if not last:  # none before, or one at the very start, whose symbol may have begun earlier
            return None
        gap = at - last
        # Whole symbols without a sign change are taken off until one remains, or less than one and a half.
        whole = min(math.ceil((gap - self.most) / self.clock), math.floor(gap / self.clock - 0.5))
        gap -= max(whole, 0) * self.clock
        if not self.least * 0.8 < gap < self.most * 1.2:
            return None
        self.clock = self.sps + self._filtered(gap - self.sps)
        middle = last + self.clock / 2
        return middle + max(0, math.ceil((at - middle) / self.clock)) * self.clock, self.clock


    def steady(self) -> bool:
        """Whether a change whole symbols behind the last one leaves the clock as it is."""
        whole = self.sps.is_integer() and 0 <= self.most - self.sps < self.sps
        return whole and bool(self.last) and self.clock == self.sps and not any(self.past)

    def run(self, at: np.ndarray, grid: tuple) -> np.ndarray:
        """The grid before the changes, then those that they start; stretches of whole symbols on a steady clock are taken at once."""
        found, places, i = [np.array([grid])], at.tolist(), 0
        broken = 1 + np.flatnonzero(np.diff(at) % self.sps != 0)
        while i < len(places):
            if self.steady() and (places[i] - self.last) % self.sps == 0:
                k = int(np.searchsorted(broken, i, "right"))
                stop = int(broken[k]) if k < len(broken) else len(places)
                own = at[i:stop].astype(float)
                found.append(np.stack([own, own + self.sps / 2, np.full(len(own), self.sps)], 1))
                self.last, i = places[stop - 1], stop
                continue
            new = self(places[i])
            if new:
                found.append(np.array([(float(places[i]), *new)]))
            i += 1
        return np.concatenate(found)


def on_grid(pos: np.ndarray, at, middle, clock) -> np.ndarray:
    """Which positions behind ``at`` the grid picks: the first whole number from each of its points."""
    j = np.floor((pos - middle) / clock)
    return (j >= 0) & (np.ceil(middle + j * clock) == pos) | (pos == at + 1) & (np.ceil(middle) <= at)


def symbol_sync(df: DataFrame, sps: float, max_deviation: float, taps=(0.5, 0.5), chunk: int = CHUNK) -> DataFrame:
    """One sample per symbol, from its middle, with the clock at that time (samples per symbol).

    The distance of sign changes, filtered and held within ``sps`` plus and minus ``max_deviation``, is the clock.
    """
    chunks = _chunks(df, chunk)
    at = F.transform("_at", lambda p: (p - F.col("_chunk") * chunk).cast("int"))
    return _numbered(synced(chunks, at, ("_first", "v"), lambda number, first, v: (first, np.asarray(v, float)), sps, max_deviation, taps, chunk))


def synced(
    chunks: DataFrame, at: Column, columns: tuple[str, ...], samples: Callable, sps: float, max_deviation: float, taps=(0.5, 0.5), chunk: int = CHUNK,
    made: Callable = lambda v, clock: (v, clock), kind: str = _PICKED,
) -> DataFrame:
    """Symbol sync over chunks: (stream_id, _chunk, _z) with ``made(values, clocks)`` of the picked samples, of type ``kind``.

    ``samples(number, *columns) -> (first position, values)`` makes a chunk's samples, with the one before it, and ``at``
    (``sign_changes``) are the places of sign changes in the chunk.  Only those pass through the task of a stream, and what
    comes back is the clock's state before each chunk, from which the chunk runs its changes again.
    """
    sps, names = _checked(sps), StructType.fromDDL(kind).names

    def machine():
        clock = SymbolClock(sps, max_deviation, taps)
        state = {"grid": (-1.0, 0.0, sps)}

        def step(number, changes, end):
            states = []
            for c, own in zip(number.tolist(), changes, strict=True):
                states.append([*state["grid"], *clock.state()])
                state["grid"] = tuple(clock.run(int(c) * chunk + own.astype(np.int64), state["grid"])[-1].tolist())
            return {"pos": number.astype(np.int64), "_state": states}

        return step

    machine()  # wrong arguments fail here, not in a task
    ends = chunks.select("stream_id", F.col("_chunk").alias("pos"), at.alias("_at"))
    states = sequential(ends, ("pos", "_at"), machine, "pos long, _state array<double>").withColumnRenamed("pos", "_chunk")

    def picked(number: pd.Series, known: pd.Series, *own: pd.Series) -> pd.DataFrame:
        out = []
        for c, state, *values in zip(number, known, *own, strict=True):
            first, x = samples(c, *values)
            clock = SymbolClock(sps, max_deviation, taps)
            clock.resume(list(state[3:]))
            grids = clock.run(_changes(c, first, x, chunk), tuple(state[:3]))
            pos, v = _own(c, first, x, chunk)
            k = np.searchsorted(grids[1:, 0], pos, "left")  # a grid holds behind its change, up to the next one's
            hit = on_grid(pos, grids[k, 0], grids[k, 1], grids[k, 2])
            out.append(made(v[hit], grids[k, 2][hit]))
        return pd.DataFrame(out, columns=names)

    both = chunks.join(states, ["stream_id", "_chunk"])
    return both.select("stream_id", "_chunk", F.pandas_udf(picked, kind)("_chunk", "_state", *columns).alias("_z"))


def sign_changes(columns: tuple[str, ...], samples: Callable, chunk: int) -> Column:
    """The places of sign changes in chunks whose samples ``samples`` makes, counted from the chunk's start."""

    def changed(number: pd.Series, *own: pd.Series) -> pd.Series:
        return pd.Series([(_changes(c, *samples(c, *values), chunk) - c * chunk).astype(np.int32) for c, *values in zip(number, *own, strict=True)])

    return F.pandas_udf(changed, "array<int>")("_chunk", *columns)
