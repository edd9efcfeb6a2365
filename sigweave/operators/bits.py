"""Bit coding, correlation, bursts, and conversion between streams and packets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..model import CHUNK, KEY, Stream, by_chunks, carried, chunk_window, halo, lagged, running_sum, sequential, stored, tag_value, values, windowed, zip_streams


def _in_pieces(df: DataFrame) -> bool:
    return isinstance(df.schema["bit"].dataType, BinaryType)


def nrzi_decode(df: DataFrame) -> DataFrame:
    """1 where a bit equals the one before it (0 before the start); pieces (see ``by_chunks``) give pieces."""
    if _in_pieces(df):

        def decoded(number: int, first: int, arrays: list[np.ndarray]) -> tuple:
            bits = arrays[0] & 1
            lo = number * CHUNK - first
            return ((1 ^ bits ^ np.concatenate([[0], bits[:-1]])).astype(np.uint8)[lo:].tobytes(),)

        return by_chunks(df, ("bit",), decoded, "bit binary", 1).select("stream_id", (F.col("_chunk") * CHUNK).alias("pos"), "bit")
    return windowed(df, 1, 0, lambda w: {"bit": (F.lit(1).cast("tinyint").bitwiseXOR(F.col("bit"))).bitwiseXOR(lagged("bit", 1, w)).cast("tinyint")})


def nrzi_encode(df: DataFrame) -> DataFrame:
    """Parity of the zeros so far; pieces give pieces."""
    if _in_pieces(df):

        def counted(number: int, first: int, arrays: list[np.ndarray]) -> tuple:
            bits = arrays[0] & 1
            return bits.tobytes(), len(bits) - int(bits.sum())

        def encoded(column, zeros):
            return pd.Series([((z + np.cumsum(1 - np.frombuffer(x, np.int8))) % 2).astype(np.uint8).tobytes() for x, z in zip(column, zeros, strict=True)])

        chunks = by_chunks(df, ("bit",), counted, "_b binary, _n long")
        both = chunks.join(carried(chunks, F.col("_n"), "_z"), ["stream_id", "_chunk"])
        return both.select("stream_id", (F.col("_chunk") * CHUNK).alias("pos"), F.pandas_udf(encoded, "binary")("_b", "_z").alias("bit"))
    zeros = running_sum(df, (F.col("bit") == 0).cast("long"), "_zeros")
    return zeros.select(*KEY, F.pmod("_zeros", F.lit(2)).cast("tinyint").alias("bit"))


def _taps(mask: int, length: int) -> list[int]:
    return [length + 1 - b for b in range(64) if mask >> b & 1]


def descrambler(df: DataFrame, mask: int = 0x21, seed: int = 0, length: int = 16) -> DataFrame:
    """x[n] xor the masked earlier inputs; inputs before the start are the seed's bits."""
    if not 0 < length < 64:
        raise ValueError("the register length must be below 64")
    reach = length + 1
    lags = _taps(mask, length)

    def columns(w: Window) -> dict[str, Column]:
        out = F.col("bit").cast("int")
        for k in lags:
            early = F.lit(0)
            for p in range(k):  # position p takes seed bit: the register shifts right, new bits enter at the top
                early = F.when(F.col("pos") == p, seed >> (reach - k + p) & 1).otherwise(early) if seed else early
            out = out.bitwiseXOR(F.coalesce(F.lag("bit", k).over(w).cast("int"), early))
        return {"bit": out.cast("tinyint")}

    return windowed(df, reach, 0, columns)


def _scrambled(register: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The 17 bits of the register and those that follow them: s[n] = x[n] xor s[n - 12] xor s[n - 17]."""
    s = np.concatenate([register, bits]).astype(np.int8)
    for n in range(17, len(s), 12):  # the nearest tap is 12 back, so 12 bits are known at a time
        part = s[n : n + 12]
        part ^= s[n - 12 : n - 12 + len(part)] ^ s[n - 17 : n - 17 + len(part)]
    return s


def scrambler_g3ruh(df: DataFrame, chunk: int = 4096) -> DataFrame:
    """Self-synchronising scrambler of 17 bits with taps 12 and 17; output is 17 bits late.

    The recurrence is linear over bits: chunks run from a register of zeros, one machine per
    stream adds up only the registers at their ends, and chunks run again from what came before.
    """
    places = 1 << np.arange(17)
    moved = [int(_scrambled(places == p, np.zeros(chunk))[-17:] @ places) for p in places]  # what a chunk of zeros makes of each bit

    def cut(number: int, first: int, arrays: list[np.ndarray]) -> tuple:
        return arrays[0], int(_scrambled(np.zeros(17), arrays[0])[-17:] @ places)

    def run(column, registers):
        return pd.Series([_scrambled(r >> np.arange(17) & 1, bits)[: len(bits)] for bits, r in zip(column, registers, strict=True)])

    def machine():
        state = {"register": 0}

        def step(pos, own, end):
            before = []
            for register in own.tolist():
                before.append(state["register"])
                for k in range(17):
                    register ^= moved[k] if before[-1] >> k & 1 else 0
                state["register"] = register
            return {"pos": pos.astype(np.int64), "before": np.array(before, np.int64)}

        return step

    chunks = by_chunks(df.select(*KEY, F.col("bit").cast("tinyint").alias("bit")), ("bit",), cut, "_bits array<tinyint>, own long", chunk=chunk)
    ends = chunks.select("stream_id", F.col("_chunk").alias("pos"), "own")
    registers = sequential(ends, ("pos", "own"), machine, "pos long, before long").withColumnRenamed("pos", "_chunk")
    whole = chunks.join(registers, ["stream_id", "_chunk"]).withColumn("_s", F.pandas_udf(run, "array<tinyint>")("_bits", "before"))
    rows = whole.select("stream_id", "_chunk", F.posexplode("_s").alias("_k", "bit"))
    return rows.select("stream_id", (F.col("_chunk") * chunk + F.col("_k")).alias("pos"), "bit")


def _distances(df: DataFrame, code: list[int]) -> DataFrame:
    """Bits with ``_d``, the differences of the last bits to the code; null before there are enough.

    Every position gets its last 64 bits as one long, by doubling steps; a long code takes the
    longs 64, 128 ... positions back too.  So expressions grow with the logarithm of the code.
    """
    if not code:
        raise ValueError("an access code needs bits")
    size = len(code)
    out = halo(df.withColumn("_w", F.col("bit").cast("long")), size - 1, 0)
    w, have = chunk_window(), 1
    while have < min(size, 64):
        out = out.withColumn("_w", F.shiftleft(F.coalesce(F.lag("_w", have).over(w), F.lit(0)), have).bitwiseOR(F.col("_w")))
        have *= 2
    distance = F.lit(0)
    for lo in range(0, size, 64):  # the last bits first
        part = code[::-1][lo : lo + 64]
        want = sum(c << k for k, c in enumerate(part))
        own = F.lag("_w", lo).over(w) if lo else F.col("_w")
        mask = (1 << len(part)) - 1
        signed = lambda n: F.lit(n - (1 << 64) if n >= 1 << 63 else n).cast("long")
        distance = distance + F.bit_count(own.bitwiseXOR(signed(want)).bitwiseAND(signed(mask)))
    out = out.withColumn("_d", F.when(F.col("pos") >= size - 1, distance))
    return out.filter("_own").drop("_chunk", "_own", "_w")


def correlate_access_code(df: DataFrame, code: list[int], allowed: int = 0) -> DataFrame:
    """1 where the last bits match the code with at most ``allowed`` differences."""
    return _distances(df, code).select(*KEY, F.coalesce(F.col("_d") <= allowed, F.lit(False)).cast("tinyint").alias("bit"))


def correlate_access_code_tag(stream: Stream | DataFrame, code: list[int], key: str, allowed: int = 0) -> Stream:
    """Bits pass; the last bit of a match is tagged with the number of differences."""
    stream = stream if isinstance(stream, Stream) else Stream(stream)
    near = _distances(stream.df, code).filter(F.col("_d") <= allowed)
    tags = near.select(*KEY, F.lit(key).alias("key"), tag_value("u", F.col("_d")).alias("val"))
    return Stream(stream.df, tags if stream.tags is None else stream.tags.unionByName(tags))


def burst_tagger(data: Stream | DataFrame, trigger: DataFrame, threshold: float, key: str = "burst") -> Stream:
    """Tag data where the trigger crosses the threshold: true when it rises, false when it falls."""
    data = data if isinstance(data, Stream) else Stream(data)
    both = zip_streams(data.df, trigger.select(*KEY, F.col("v").alias("_t")))
    above = both.withColumn("_on", F.col("_t") > threshold)
    edges = windowed(above, 1, 0, lambda w: {"_was": lagged("_on", 1, w, False)}).filter("_on <> _was")
    tags = edges.select(*KEY, F.lit(key).alias("key"), tag_value("b", F.col("_on")).alias("val"))
    kept = both.select(*KEY, *values(data.df))
    return Stream(kept, tags if data.tags is None else data.tags.unionByName(tags))


def bursts(tags: DataFrame, key: str, tail: int = 0) -> DataFrame:
    """(stream_id, pdu_idx, start, stop) of the bursts that the tags mark, stop exclusive.

    A burst ends at its false tag plus ``tail``; tags inside a burst's tail and repeated
    starts are ignored; start and end at one position give an empty burst if tail is 0.
    Runs over the sparse tags only: by window functions, or by a state machine where tails
    hide tags.
    """
    own = tags.filter(F.col("key") == key).select("stream_id", "pos", F.col("val.b").alias("on"))
    own = own.filter(F.col("on").isNotNull())
    if tail == 0:
        return _bursts_without_tail(own)

    def machine():
        state = {"start": None, "busy": -1, "n": 0}

        def step(pos, on, end):
            made = {"pdu_idx": [], "start": [], "stop": []}
            places = {}
            for p, o in zip(pos.tolist(), on.tolist(), strict=True):
                places.setdefault(int(p), set()).add(bool(o))
            for p in sorted(places):
                if p < state["busy"]:
                    continue
                if True in places[p] and state["start"] is None:
                    state["start"] = p
                if False in places[p] and state["start"] is not None:
                    made["pdu_idx"].append(state["n"])
                    made["start"].append(state["start"])
                    made["stop"].append(p + tail)
                    state.update(start=None, busy=p + tail, n=state["n"] + 1)
            return made

        return step

    return sequential(own, ("pos", "on"), machine, "pdu_idx long, start long, stop long")


def _bursts_without_tail(own: DataFrame) -> DataFrame:
    """Without tails a burst is open behind a position whose tags are all true, whatever came before."""
    order = Window.partitionBy("stream_id").orderBy("pos")
    marks = own.repartition("stream_id").groupBy("stream_id", "pos").agg(F.max("on").alias("_starts"), F.min("on").alias("_open"))
    marks = marks.withColumn("_was", F.coalesce(F.lag("_open").over(order), F.lit(False)))
    begun = F.last(F.when(F.col("_open") & ~F.col("_was"), F.col("pos")), ignorenulls=True)
    before = begun.over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = marks.withColumn("start", F.when(F.col("_was"), before).otherwise(F.col("pos")))
    ends = ends.filter(~F.col("_open") & (F.col("_was") | F.col("_starts")))
    return ends.select("stream_id", (F.row_number().over(order) - 1).cast("long").alias("pdu_idx"), "start", F.col("pos").alias("stop"))


def stream_to_pdu(stream: Stream, key: str, max_size: int, tail: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Packets of the samples between true and false tags: (stream_id, pdu_idx, data..., tags).

    Longer bursts than ``max_size`` are dropped, unfinished ones too.  Samples join bursts by
    the position chunks that a burst touches, an equi-join.
    """
    found = bursts(stream.tags, key, tail)
    if tail:  # tags lie on samples, so only a tail can reach behind the last one
        ends = stream.df.groupBy("stream_id").agg((F.max("pos") + 1).alias("_len"))
        found = found.join(ends, "stream_id").filter(F.col("stop") <= F.col("_len")).drop("_len")
    found = found.filter(F.col("stop") - F.col("start") <= max_size)
    renumber = Window.partitionBy("stream_id").orderBy("start", "pdu_idx")
    found = found.withColumn("pdu_idx", (F.row_number().over(renumber) - 1).cast("long"))
    first, last = F.floor(F.col("start") / chunk), F.floor(F.greatest(F.col("stop") - 1, "start") / chunk)
    spread = found.withColumn("_chunk", F.explode(F.sequence(first, last)))
    names = values(stream.df)
    # Samples and the other tags join the bursts together, and are gathered by one grouping.
    sample = F.struct("pos", *names)
    tag = F.struct("pos", "key", "val")
    rows = stream.df.select(*KEY, sample.alias("_x"))
    others = stream.tags.filter(F.col("key") != key).select(*KEY, tag.alias("_t"))
    kinds = {"_x": rows.schema["_x"].dataType, "_t": others.schema["_t"].dataType}
    rows = rows.withColumn("_t", F.lit(None).cast(kinds["_t"])).unionByName(others.withColumn("_x", F.lit(None).cast(kinds["_x"])))
    both = rows.withColumn("_chunk", F.floor(F.col("pos") / chunk)).join(spread, ["stream_id", "_chunk"])
    # An empty burst is kept by the sample that it lies on.
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))
    empty = (F.col("pos") == F.col("start")) & (F.col("stop") == F.col("start")) & F.col("_x").isNotNull()
    moved = F.struct((F.col("_t.pos") - F.col("start")).alias("pos"), F.col("_t.key").alias("key"), F.col("_t.val").alias("val"))
    out = both.filter(inside | empty).groupBy("stream_id", "pdu_idx").agg(
        F.first("start").alias("start_pos"), F.array_sort(F.collect_list(F.when(inside, F.col("_x")))).alias("_rows"),
        F.array_sort(F.collect_list(F.when(inside & F.col("_t").isNotNull(), moved))).alias("tags"),
    )
    data = [F.col(f"_rows.{c}").alias("data" if names == [c] else c) for c in names]
    return out.select("stream_id", "pdu_idx", "start_pos", *data, F.when(F.size("tags") > 0, F.col("tags")).alias("tags"))


def pdu_to_stream(pdus: DataFrame, column: str = "data", value: str = "v") -> Stream:
    """Packets one behind the other, tagged ``PduToStream::start`` and ``::end`` with their length; empty ones are skipped.

    Packets stay in chunks of their numbers; only the sizes of chunks are summed up along a stream.
    """
    full = pdus.filter(F.size(column) > 0).select("stream_id", F.col("pdu_idx").alias("pos"), F.col(column).alias("_d"))
    placed = running_sum(full, F.size("_d").cast("long"), "_to", chunk=4096).withColumn("_from", F.col("_to") - F.size("_d"))
    rows = placed.select("stream_id", "_from", F.posexplode("_d").alias("_k", value)).select("stream_id", (F.col("_from") + F.col("_k")).alias("pos"), value)
    n = F.size("_d").cast("long")
    marks = F.explode(F.array(F.struct(F.col("_from").alias("pos"), F.lit("PduToStream::start").alias("key")), F.struct((F.col("_from") + n - 1).alias("pos"), F.lit("PduToStream::end").alias("key"))))
    tags = placed.select("stream_id", n.alias("_n"), marks.alias("_m")).select("stream_id", "_m.pos", "_m.key", tag_value("u", F.col("_n")).alias("val"))
    return Stream(rows, tags)


def pdu_to_pieces(pdus: DataFrame, column: str = "data", value: str = "bit") -> DataFrame:
    """Binary packets one behind the other as a stream in pieces (stream_id, pos, value): a row for each packet instead of each sample."""
    size = F.octet_length(value).cast("long")
    # Stored before anything looks at it, so that packets are made once.
    full = stored(pdus.select("stream_id", F.col("pdu_idx").alias("pos"), F.col(column).alias(value))).filter(size > 0)
    placed = running_sum(full, size, "_to", chunk=4096)
    return placed.select("stream_id", (F.col("_to") - size).alias("pos"), value)


def stream_chunks(stream: Stream | DataFrame, size: int) -> DataFrame:
    """Packets of ``size`` samples each; the rest at the end is lost.

    With tags, each packet has ``tags`` (pos in the packet, key, val); a tag behind the last packet is lost.
    """
    df = stream.df if isinstance(stream, Stream) else stream
    tags = stream.tags if isinstance(stream, Stream) else None
    names = values(df)
    rows = df.groupBy("stream_id", F.expr(f"pos div {size}").alias("pdu_idx")).agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("_rows"))
    rows = rows.filter(F.size("_rows") == size)
    out = rows.select("stream_id", "pdu_idx", *(F.col(f"_rows.{c}").alias("data" if len(names) == 1 else c) for c in names))
    if tags is None:
        return out
    own = tags.groupBy("stream_id", F.expr(f"pos div {size}").alias("pdu_idx")).agg(
        F.array_sort(F.collect_list(F.struct(F.pmod("pos", F.lit(size)).alias("pos"), "key", "val"))).alias("tags")
    )
    return out.join(own, ["stream_id", "pdu_idx"], "left")


def pdu_average(pdus: DataFrame, n: int, column: str = "data") -> DataFrame:
    """Element-wise mean of every n packets; an incomplete batch is lost, unequal lengths are an error."""
    batch = F.expr(f"pdu_idx div {n}")
    sized = pdus.withColumn("_size", F.size(column)).withColumn("_batch", batch)
    rows = sized.select("stream_id", "_batch", "_size", F.posexplode(column).alias("_k", "_x"))
    mean = rows.groupBy("stream_id", "_batch", "_k").agg(
        F.avg("_x").alias("_y"), F.count("*").alias("_n"), F.min("_size").alias("_lo"), F.max("_size").alias("_hi")
    )
    packed = mean.groupBy("stream_id", F.col("_batch").alias("pdu_idx")).agg(
        F.array_sort(F.collect_list(F.struct("_k", "_y"))).alias("_rows"), F.max("_n").alias("_n"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
    ).filter(F.col("_n") == n)
    equal = F.when(F.col("_lo") == F.col("_hi"), F.col("_rows._y")).otherwise(F.raise_error(F.lit("packets of a batch differ in length")).cast("array<double>"))
    return packed.select("stream_id", "pdu_idx", equal.alias("data"))


def midpointer(pdus: DataFrame, column: str = "data") -> DataFrame:
    """Centre each packet between the upper medians of its values above the mean and of the rest.

    Packets with a not-a-number mean, or with one side empty, are dropped.
    """
    rows = pdus.select("stream_id", "pdu_idx", F.col(column).cast("array<double>").alias("data")).filter(F.size("data") > 0)
    # A value that a lambda takes is worked out once, where a column of its own would be written out at every use.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    middle = lambda c: F.get(c, F.floor(F.size(c) / 2).cast("int"))
    mean = F.aggregate("data", F.lit(0.0), lambda s, v: s + v) / F.size("data")

    def between(sides: Column) -> Column:
        hi, lo = sides["hi"], sides["lo"]
        return F.when((F.size(hi) > 0) & (F.size(lo) > 0), middle(lo) + (middle(hi) - middle(lo)) / 2)

    def sides(m: Column) -> Column:
        hi, lo = (F.array_sort(F.filter("data", f)) for f in (lambda v: v > m, lambda v: v <= m))
        return F.when(~F.isnan(m), once(F.struct(hi.alias("hi"), lo.alias("lo")), between))

    centred = once(once(mean, sides), lambda o: F.when(o.isNotNull(), F.transform("data", lambda v: v - o)))
    return rows.select("stream_id", "pdu_idx", centred.alias("data")).filter(F.col("data").isNotNull())


def _line(places: list[int], k: int, m: int) -> complex:
    """Line k of the spectrum of ones at some of m places, summed term by term: at whole fractions of a turn the last bit decides its sign."""
    re = im = 0.0
    for n in places:
        turn = 2 * math.pi * k * n / m
        re, im = re + math.cos(turn), im + math.sin(turn)
    return complex(re, -im)


def _symbol_rate(crossings: np.ndarray, n: int) -> tuple[float, float] | None:
    """Symbols per sample and start phase: the lowest strong line in the spectrum of the sign changes.

    A fast transform settles which line that is, but for comparisons too close for it; lines of those are summed again.
    """
    m, places = len(crossings), np.flatnonzero(crossings).tolist()
    power = np.abs(np.fft.rfft(crossings)[: m // 2])
    if len(power) < 4:
        return None
    near = 1e-9 * max(len(places), 1)
    gap = np.abs(np.diff(power[2:], append=np.inf)) <= near
    top = power[2:].max()
    again = gap | (np.abs(power[2:] - 0.8 * top) <= near) | (power[2:] >= top - near)
    again[1:] |= gap[:-1]
    for k in (2 + np.flatnonzero(again)).tolist() if places else ():
        line = _line(places, k, m)
        power[k] = math.sqrt(line.real * line.real + line.imag * line.imag)
    strong = (power[2:-1] > 0.8 * power[2:].max()) & (power[2:-1] > power[3:])
    if not strong.any():
        return None
    k = 2 + int(strong.argmax())
    line = _line(places, k, m)
    turn = math.atan2(line.imag, line.real) / (2 * math.pi)
    return k / n, turn + (0.5 if turn > 0 else 1.5)


def _recover(samples: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """Symbols, symbols per sample and end phase of one packet; a sample is picked where the phase passes a whole number."""
    if len(samples) < 4:
        return None
    found = _symbol_rate(np.diff(samples > 0).astype(float), len(samples))
    if found is None:
        return None
    rate, start = found
    turns = np.floor(start + rate * np.arange(len(samples)))
    picked = np.diff(turns, prepend=0) > 0
    return samples[picked], rate, start + rate * len(samples) - float(picked.sum())


def wpcr(pdus: DataFrame, samp_rate: float | None = None) -> DataFrame:
    """Whole-packet clock recovery: symbols of each packet with sps, phase and frequency; packets without a clock are dropped."""

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                found = _recover(np.asarray(row.data, float))
                if found:
                    out.append((row.stream_id, row.pdu_idx, found[0], found[1], found[2], found[1] * samp_rate if samp_rate else None))
            yield pd.DataFrame(out, columns=["stream_id", "pdu_idx", "data", "sps", "phase", "frequency"])

    kind = pdus.schema["stream_id"].dataType.simpleString()
    return pdus.select("stream_id", "pdu_idx", "data").mapInPandas(
        run, f"stream_id {kind}, pdu_idx long, data array<double>, sps double, phase double, frequency double"
    )
