"""PWM decoding of on-off keyed power samples.

Spark finds level changes (hysteresis as a last-known value, two-phase); frames and
transmissions are sessions over them, a sparse sequence, by window functions.  ``Pulses`` walks
the same level changes one by one for live streams.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import last_known, lagged, windowed


@dataclass(frozen=True)
class PwmSettings:
    """Widths and gaps in samples; a pulse in front of a frame gap is data or a delimiter."""

    high_threshold: float
    short_width: int
    long_width: int
    frame_gap: int
    reset_gap: int
    low_threshold: float | None = None
    pulse_tolerance: int | None = None
    frame_bits: int | None = None
    max_frame_bits: int = 4096
    max_distinct_frames: int = 256
    min_repeats: int = 1
    short_is_one: bool = True
    gap_pulse: str = "data"

    @property
    def low(self) -> float:
        return self.high_threshold / 2 if self.low_threshold is None else self.low_threshold

    @property
    def tolerance(self) -> int:
        return (self.long_width - self.short_width) // 2 if self.pulse_tolerance is None else self.pulse_tolerance

    def check(self) -> None:
        rules = {
            "the high threshold must be finite and positive": math.isfinite(self.high_threshold) and self.high_threshold > 0,
            "the low threshold must be finite, positive and not above the high one": math.isfinite(self.low) and 0 < self.low <= self.high_threshold,
            "the short width must be positive": self.short_width > 0,
            "the long width must be above the short one": self.long_width > self.short_width,
            "the frame gap must be positive": self.frame_gap > 0,
            "the reset gap must not be below the frame gap": self.reset_gap >= self.frame_gap,
            "the frame length must be positive": self.frame_bits is None or self.frame_bits > 0,
            "the longest frame must be positive": self.max_frame_bits > 0,
            "the frame length must not exceed the longest frame": self.frame_bits is None or self.frame_bits <= self.max_frame_bits,
            "at least one distinct frame must be kept": self.max_distinct_frames > 0,
            "at least one repeat is needed": self.min_repeats > 0,
            "a gap pulse is data or delimiter": self.gap_pulse in ("data", "delimiter"),
        }
        for text, good in rules.items():
            if not good:
                raise ValueError(text)


class _Frames:
    """Walks (width of a pulse, its first sample, length of the gap behind it)."""

    def __init__(self, settings: PwmSettings):
        self.s = settings
        self.bits: list[int] = []
        self.start, self.bad = None, False
        self.seen: dict[tuple, list[int]] = {}
        self.out: list[tuple] = []

    def pulse(self, width: int, first: int, gap: int | None) -> None:
        """``gap`` is None for a pulse that the stream ends in; an unfinished gap counts as far as it goes."""
        s = self.s
        if not self.bits and not self.bad:
            self.start = first
        if gap is None:
            return
        ends = gap >= s.frame_gap
        if not ends or s.gap_pulse == "data":
            self._bit(width)
        if ends:
            self._finish(first + width + s.frame_gap - 1)
        if gap >= s.reset_gap:
            self.reset()

    def _bit(self, width: int) -> None:
        s = self.s
        off = {True: abs(width - s.short_width), False: abs(width - s.long_width)}
        fits = [short for short in (True, False) if off[short] <= s.tolerance]
        if not fits or len(self.bits) == s.max_frame_bits:
            self.bits, self.start, self.bad = [], None, True
            return
        self.bits.append(int(min(fits, key=lambda short: (off[short], not short)) == s.short_is_one))

    def _finish(self, now: int) -> None:
        s, bits = self.s, tuple(self.bits)
        if bits and not self.bad and s.frame_bits in (None, len(bits)):
            if bits in self.seen:
                self.seen[bits][0] += 1
            elif len(self.seen) < s.max_distinct_frames:
                self.seen[bits] = [1, now if self.start is None else self.start]
        self.bits, self.start, self.bad = [], None, False

    def reset(self) -> None:
        """A transmission ends: give the frames that came often enough."""
        self.bits, self.start, self.bad = [], None, False
        self.out += [(list(b), n, first) for b, (n, first) in self.seen.items() if n >= self.s.min_repeats]
        self.seen = {}


class Pulses:
    """Walks level changes: a pulse is known when the next one rises, or at the stream's end."""

    def __init__(self, settings: PwmSettings):
        self.frames = _Frames(settings)
        self.rise, self.fall, self.n = None, None, 0

    def edge(self, pos: int, high: bool) -> None:
        if not high:
            self.fall = pos
            return
        if self.rise is not None:
            self.frames.pulse(self.fall - self.rise, self.rise, pos - self.fall)
        self.rise, self.fall = pos, None

    def end(self, size: int) -> None:
        """After ``size`` samples; a gap that is long enough ends a frame, however long it would get."""
        if self.rise is not None and self.fall is not None and size - self.fall >= self.frames.s.frame_gap:
            self.frames.pulse(self.fall - self.rise, self.rise, size - self.fall)
        self.frames.reset()

    def taken(self) -> dict[str, list]:
        made, self.frames.out = self.frames.out, []
        first, self.n = self.n, self.n + len(made)
        return {"pdu_idx": list(range(first, self.n)), "bits": [m[0] for m in made], "repeats": [m[1] for m in made], "first_sample": [m[2] for m in made]}


def pwm_decoder(df: DataFrame, settings: PwmSettings) -> DataFrame:
    """Power samples to frames (stream_id, pdu_idx, bits, repeats, first_sample), given when their transmission ends.

    At the end of a stream, frames that were complete are given, an open one is not.  Frames are
    sessions of pulses, transmissions sessions of frames, both told by running counts of gaps;
    equal frames of a transmission are one group, and the first ``max_distinct_frames`` groups count.
    """
    settings.check()
    s = settings
    v = F.col("v")
    decisive = F.when((v > s.high_threshold) & ~F.isnan("v"), True).when((v < s.low) | F.isnan("v"), False)
    level = last_known(df, decisive, "_high", False)
    edges = windowed(level, 1, 1, lambda w: {"_was": lagged("_high", 1, w, False), "_end": F.lead("pos").over(w).isNull()})
    # The stream's last sample tells its length; halo windows see the next row whenever there is one.
    changed = F.col("_high") != F.col("_was")
    edges = edges.filter(changed | F.col("_end")).select("stream_id", "pos", changed.alias("_edge"), "_high")
    order = Window.partitionBy("stream_id").orderBy("pos")
    size = F.max("pos").over(Window.partitionBy("stream_id")) + 1
    turns = edges.withColumn("_size", size).filter("_edge")
    turns = turns.withColumns({"_fall": F.lead("pos").over(order), "_next": F.lead("pos", 2).over(order)})
    pulses = turns.filter(F.col("_high") & F.col("_fall").isNotNull()).select(
        "stream_id", "pos", (F.col("_fall") - F.col("pos")).alias("_width"), F.col("_next").isNull().alias("_last"),
        (F.coalesce("_next", "_size") - F.col("_fall")).alias("_gap"),
    )
    ends = F.col("_gap") >= s.frame_gap
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pulses = pulses.filter(ends | ~F.col("_last")).withColumns({
        "_frame": F.coalesce(F.count_if(ends).over(before), F.lit(0)), "_sent": F.coalesce(F.count_if(F.col("_gap") >= s.reset_gap).over(before), F.lit(0)),
    })
    short, long = F.abs(F.col("_width") - s.short_width), F.abs(F.col("_width") - s.long_width)
    is_short = (short <= s.tolerance) & ((long > s.tolerance) | (short <= long))
    bit = F.when(is_short, F.lit(int(s.short_is_one))).when(long <= s.tolerance, F.lit(int(not s.short_is_one))).cast("tinyint")
    counts = F.lit(True) if s.gap_pulse == "data" else ~ends
    frames = pulses.groupBy("stream_id", "_frame").agg(
        F.min("_sent").alias("_sent"), F.min("pos").alias("_first"), F.max(ends).alias("_done"), F.max(counts & bit.isNull()).alias("_bad"),
        F.transform(F.array_sort(F.collect_list(F.when(counts, F.struct("pos", bit.alias("bit"))))), lambda x: x["bit"]).alias("bits"),
    )
    fits = F.size("bits").between(1, s.max_frame_bits) if s.frame_bits is None else F.size("bits") == s.frame_bits
    good = frames.filter(F.col("_done") & ~F.col("_bad") & fits)
    seen = good.groupBy("stream_id", "_sent", "bits").agg(F.count("*").cast("int").alias("repeats"), F.min("_first").alias("first_sample"))
    rank = F.row_number().over(Window.partitionBy("stream_id", "_sent").orderBy("first_sample"))
    kept = seen.withColumn("_rank", rank).filter((F.col("_rank") <= s.max_distinct_frames) & (F.col("repeats") >= s.min_repeats))
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("_sent", "first_sample")) - 1
    return kept.select("stream_id", number.cast("long").alias("pdu_idx"), "bits", "repeats", "first_sample")


# Bits of a restaurant pager's frame, and names of its functions.
PAGER_BITS = 25
PAGER_FUNCTIONS = {0x0D: "Buzz", 0x0F: "Sync"}


def pager_messages(frames: DataFrame, sample_rate: float) -> DataFrame:
    """Frames of ``pwm_decoder`` that are restaurant pager messages, with their fields and a line of text.

    Such a frame has PAGER_BITS bits, the last of them 1: 16 of the system, 4 of the pager, 4 of the function.
    """
    raw = F.aggregate("bits", F.lit(0), lambda value, bit: value * 2 + bit.cast("int"))
    own = frames.filter((F.size("bits") == PAGER_BITS) & (F.element_at("bits", -1) == 1)).withColumn("raw", raw)
    part = lambda shift, mask: F.shiftright("raw", shift).bitwiseAND(F.lit(mask))
    names = F.create_map(*(F.lit(x) for item in PAGER_FUNCTIONS.items() for x in item))
    own = own.withColumns({"system_id": part(9, 0xFFFF), "pager": part(5, 15), "function": part(1, 15), "seconds": F.col("first_sample") / float(sample_rate)})
    own = own.withColumn("function_name", F.coalesce(F.element_at(names, F.col("function")), F.lit("Unknown")))
    line = F.format_string("Restaurant-Pager: id=0x%04x pager=%d function=%s (0x%x) repeats=%d raw=0x%07x time=%.6fs", "system_id", "pager", "function_name", "function", "repeats", "raw", "seconds")
    return own.select("stream_id", "pdu_idx", "raw", "system_id", "pager", "function", "function_name", "repeats", "first_sample", "seconds", line.alias("line"))
