"""Packet framing: HDLC, KISS, IL2P headers and checksums.

Framers and per-packet codecs are Column expressions over bit strings and hex; deframers
stream each stream's bits through a small state machine with bounded memory.
"""

from __future__ import annotations

import binascii
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CHUNK, KEY, by_chunks, sequential, unpacked

FLAGS = 20


def crc16_x25(data: bytes) -> int:
    """CRC-16/X.25: reflected polynomial 0x8408, start and final xor 0xffff."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x8408 if crc & 1 else 0)
    return crc ^ 0xFFFF


def _reduce(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ (0x8408 if value & 1 else 0)
    return value


CRC_TABLE = [_reduce(i) for i in range(256)]


def crc_column(data: Column) -> Column:
    """CRC-16/X.25 of a binary column, without Python."""
    table = F.array(*map(F.lit, CRC_TABLE))
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")
    crc = F.aggregate(places, F.lit(0xFFFF), lambda c, i: F.shiftright(c, 8).bitwiseXOR(F.get(table, c.bitwiseXOR(byte(i)).bitwiseAND(F.lit(255)))))
    return crc.bitwiseXOR(F.lit(0xFFFF))


def fcs_adder(pdus: DataFrame, column: str = "data") -> DataFrame:
    """Append the little-endian CRC-16/X.25 to each binary packet."""
    crc = F.lpad(F.hex(crc_column(F.col(column)).cast("bigint")), 4, "0")
    return pdus.withColumn(column, F.concat(column, F.unhex(F.regexp_replace(crc, "(..)(..)", "$2$1"))))


def bit_text(data: Column) -> Column:
    """Bits of a binary column as 0/1 text, least significant first."""
    octets = F.filter(F.split(F.regexp_replace(F.hex(data), "(..)", "$1 "), " "), lambda h: h != "")
    return F.array_join(F.transform(octets, lambda h: F.reverse(F.lpad(F.conv(h, 16, 2), 8, "0"))), "")


def hdlc_text(column: Column, flags: int = FLAGS) -> Column:
    """0/1 text of a binary packet: flags, bits with a 0 stuffed behind every five 1s, flags."""
    flag = F.lit("01111110" * flags)
    return F.concat(flag, F.regexp_replace(bit_text(column), "11111", "111110"), flag)


def hdlc_framer(pdus: DataFrame, column: str = "data", flags: int = FLAGS, packed: bool = False) -> DataFrame:
    """Binary packets to bit packets, framed; ``packed`` ones are binary, an ASCII 0 or 1 for each bit."""
    text = hdlc_text(F.col(column), flags)
    if packed:
        return pdus.withColumn(column, text.cast("binary"))
    return pdus.withColumn(column, F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("tinyint")))


#: A flipped bit k places before the end of the data changes the checksum by one value, whatever the data; it recurs every _CYCLE bits.
_CYCLE = 32767
_SYNDROMES: dict[int, int] = {}


def syndromes() -> dict[int, int]:
    """How far before the end of the data a bit lies whose flip changes the checksum by each value."""
    if not _SYNDROMES:
        change = 0x8408
        for k in range(_CYCLE):
            _SYNDROMES[change] = k
            change = change >> 1 ^ (0x8408 if change & 1 else 0)
    return _SYNDROMES


def _repaired(data: bytes, crc: int) -> bytes | None:
    """The data with at most one bit flipped, data bits in order first, then CRC bits; None if nothing fits."""
    change = _crc16(data) ^ crc
    if not change:
        return data
    size, back = 8 * len(data), syndromes().get(change)
    if back is not None and back < size:
        place = size - 1 - (back + (size - 1 - back) // _CYCLE * _CYCLE)  # the first of the bits that fit
        copy = bytearray(data)
        copy[place >> 3] ^= 1 << (place & 7)
        return bytes(copy)
    return data if change.bit_count() == 1 else None


_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _crc16(data: bytes) -> int:
    """CRC-16/X.25 by the library's CRC of the mirrored polynomial: bits of bytes and result turned round."""
    mirrored = binascii.crc_hqx(data.translate(_REVERSED), 0xFFFF)
    return (_REVERSED[mirrored & 255] << 8 | _REVERSED[mirrored >> 8]) ^ 0xFFFF


def checked_frame(frame: bytes, fix_bits: bool) -> bytes | None:
    """The data of a frame whose checksum fits, on demand after the flip of one bit."""
    if len(frame) < 2:
        return None
    data, crc = frame[:-2], int.from_bytes(frame[-2:], "little")
    return _repaired(data, crc) if fix_bits else data if _crc16(data) == crc else None


class Deframer:
    """HDLC frames from bits: flags are found as runs of six 1s, so Python touches runs, not bits.

    ``feed`` takes bits as bytes 0/1 and yields (position of the closing bit, frame bytes).
    """

    SIX = b"\1" * 6

    def __init__(self, min_size: int, max_size: int):
        self.min_size, self.max_size = min_size, max_size
        self.synced, self.held, self.base = False, b"", 0

    def feed(self, bits: bytes):
        data, at = self.held + bits, 0
        while True:
            if not self.synced:
                flag = data.find(b"\0" + self.SIX + b"\0", at)
                if flag < 0:
                    at = max(at, len(data) - 7)
                    break
                at, self.synced = flag + 8, True
            run = data.find(self.SIX, at)
            if run < 0 or run + 6 >= len(data):
                if self._long(data[at : run if run >= 0 else len(data)]):
                    at = self._lost(data, at)
                    continue
                break
            stuffed = data[at:run]
            if self._long(stuffed + self.SIX[1:]):  # a frame is too long before its flag's last one
                at = self._lost(data, at)
                continue
            if data[run + 6] or len(stuffed) < 1:
                self.synced, at = False, run + 7  # seven 1s, or a flag without a 0 of its own
                continue
            frame = self._frame(stuffed)
            if frame is not None:
                yield self.base + run + 6, frame
            at = run + 7
        self.held = data[at:]
        self.base += at

    @staticmethod
    def _plain(stuffed: bytes) -> bytes:
        return stuffed.replace(b"\1\1\1\1\1\0", b"\1\1\1\1\1")

    def _long(self, stuffed: bytes) -> bool:
        return len(stuffed) > self.max_size * 8 and len(self._plain(stuffed)) > self.max_size * 8

    def _lost(self, data: bytes, at: int) -> int:
        """Out of sync at the bit behind the longest frame."""
        self.synced = False
        want, place = self.max_size * 8 + 1, at
        while want > 0:  # stuffed bits put the limit further out
            have = len(self._plain(data[at : place + want]))
            place += want
            want = self.max_size * 8 + 1 - have if have < self.max_size * 8 + 1 else 0
        return min(place + 1, len(data))

    def _frame(self, stuffed: bytes) -> bytes | None:
        plain = self._plain(stuffed)[:-1]  # without the flag's own zero
        if len(plain) % 8 or len(plain) // 8 < self.min_size:
            return None
        return np.packbits(np.frombuffer(plain, np.uint8), bitorder="little").tobytes()


#: What is known before a run of six ones or more: behind a flag, searching, or searching from the last bit of a flag on.
_SYNCED, _FREE, _RESET = range(3)


def _ones(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of six ones or more."""
    edge = np.diff(np.concatenate([[0], bits, [0]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= 6
    return start[long], (end - start)[long]


@dataclass
class _Marks:
    """Runs of six ones or more in some bits: where they start, what each state before becomes behind, and frames that end there."""

    start: np.ndarray
    moves: np.ndarray  # (run, state before) -> state behind
    frames: dict[int, bytes]

    def before(self) -> np.ndarray:
        """(run, state before the first) -> state before the run: moves composed in doubling steps."""
        behind, step = self.moves.copy(), 1
        while step < len(behind):
            behind[step:] = np.take_along_axis(behind[step:], behind[:-step], 1)
            step *= 2
        return np.concatenate([np.arange(3)[None], behind]) if len(behind) else np.arange(3)[None]


def _marks(bits: np.ndarray, own: int, stop: int, min_size: int, max_size: int, keep_checksum: bool, fix_bits: bool) -> _Marks:
    """Runs that start at ``own`` or later, before ``stop``; the bits reach further back than any frame, or to the stream's start.

    Behind a flag, more plain bits than a frame may have end the search for its partner: at once
    if the next flag starts two bits or more behind, else that flag is lost too.  A flag that
    shares its first zero with the one before is none for either.
    """
    start, length = _ones(bits)
    end = start + length
    flag = (length == 6) & (end < len(bits)) & (start > 0)
    # Zeros behind exactly five ones are stuffed; how many before each place.
    ones = np.convolve(bits, np.ones(5, np.int8))[: len(bits)]  # ones among the five bits up to each place
    five = np.concatenate([[False] * 5, ones[4:-1] == 5])
    six_back = np.concatenate([np.zeros(6, np.int8), bits[:-6]])[: len(bits)]
    dropped = (bits == 0) & five[: len(bits)] & (six_back == 0)
    count = np.concatenate([[0], np.cumsum(dropped)])
    here = np.flatnonzero((start >= own) & (start < stop))
    if not len(here):
        return _Marks(np.zeros(0, np.int64), np.zeros((0, 3), np.int64), {})
    a, most = start[here], 8 * max_size
    known = here > 0
    last = here - known  # a run without one before it is as if far behind a flag
    base = end[last] + 1  # the first bit behind a flag
    plain = np.where(known, (a - base) - (count[a] - count[np.minimum(base, len(bits))]), most + 9)
    nearer = np.where(known, np.maximum(a - 2 - base, 0) - (count[np.maximum(a - 2, 0)] - count[np.minimum(base, np.maximum(a - 2, 0))]), most + 9)
    early, late = nearer > most, plain + 5 > most
    shared = known & (a == base) & flag[last]
    moves = np.full((len(here), 3), _FREE)
    moves[flag[here], _FREE] = _SYNCED
    moves[flag[here] & ~shared, _RESET] = _SYNCED
    moves[:, _SYNCED] = np.where(early, moves[:, _FREE], np.where(late | ~flag[here], _FREE, np.where(shared, _RESET, _SYNCED)))
    frames = {}
    for k in np.flatnonzero(flag[here] & flag[last] & known & ~late & ~shared & ((plain - 1) % 8 == 0) & (plain - 1 >= 8 * min_size)).tolist():
        lo, hi = int(base[k]), int(a[k])
        body = bits[lo:hi][~dropped[lo:hi]][:-1]
        frame = np.packbits(body, bitorder="little").tobytes()
        frame = frame if keep_checksum else checked_frame(frame, fix_bits)
        if frame is not None:
            frames[k] = frame
    return _Marks(a, moves, frames)


def hdlc_deframer(df: DataFrame, min_size: int, max_size: int, fix_bits: bool = False, keep_checksum: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Bits to packets (stream_id, pdu_idx, data, packet_pos), with a right checksum unless it is kept.

    A scan over functions: every chunk of bits, with as many before it as a frame can have, maps
    each of three states before its first run of six ones to the state behind its last and the number of frames
    on the way.  Only these maps, one row for each chunk, pass through a task per stream, which
    tells each chunk its state and the number of its first packet.  Bits may come in pieces (see
    ``by_chunks``), of whose bytes the lowest bit counts.
    """
    left, right = 8 * max_size * 6 // 5 + 32, 8
    chunk = max(chunk, 2 * left)

    def summary(number: int, first: int, arrays: list[np.ndarray]) -> tuple:
        lo = number * chunk - first
        own = _marks(arrays[0].astype(np.int8) & 1, lo, lo + chunk, min_size, max_size, keep_checksum, fix_bits)
        before = own.before()
        synced = before == _SYNCED
        frames = sorted(own.frames)
        counts = synced[frames].sum(0).tolist() if frames else [0] * 3
        listed = [{"of": synced[k].tolist(), "data": own.frames[k], "packet_pos": int(first + own.start[k] + 6)} for k in frames]
        return before[-1].tolist(), counts, listed

    kinds = "_to array<long>, _n array<long>, _frames array<struct<of:array<boolean>,data:binary,packet_pos:bigint>>"
    chunks = by_chunks(df, ("bit",), summary, kinds, left, right, chunk)

    def machine():
        state = [_FREE, 0]

        def step(pos, to, n, end):
            states, counts = [], []
            for moves, own in zip(to, n, strict=True):
                states.append(state[0])
                counts.append(state[1])
                state[:] = int(moves[state[0]]), state[1] + int(own[state[0]])
            return {"pos": pos.astype(np.int64), "_state": np.array(states, np.int64), "_before": np.array(counts, np.int64)}

        return step

    ends = chunks.select("stream_id", F.col("_chunk").alias("pos"), "_to", "_n")
    carried = sequential(ends, ("pos", "_to", "_n"), machine, "pos long, _state long, _before long").withColumnRenamed("pos", "_chunk")
    own = F.filter("_frames", lambda f: F.get(f["of"], F.col("_state").cast("int")))
    made = chunks.filter(F.size("_frames") > 0).join(carried, ["stream_id", "_chunk"]).select("stream_id", "_before", F.posexplode(own).alias("_k", "_f"))
    return made.select("stream_id", (F.col("_before") + F.col("_k")).alias("pdu_idx"), "_f.data", "_f.packet_pos")


FEND = 0xC0


def kiss_frame(df: DataFrame, limit: int = 10_000, chunk: int = CHUNK) -> DataFrame:
    """Byte stream to packets between frame ends, which are kept at both sides; empty and overlong frames are left out.

    Chunks of bytes, each with as many before it as a frame can have, are cut at frame ends; a
    frame belongs to the chunk of its second end.  Only the numbers of frames pass through a window per stream.
    """
    chunk = max(chunk, 2 * (limit + 2))

    def cut(number: int, first: int, arrays: list[np.ndarray]) -> tuple:
        data = arrays[0].astype(np.uint8)
        ends = np.flatnonzero(data == FEND)
        size = np.diff(ends) - 1
        good = np.flatnonzero((size > 0) & (size <= limit) & (first + ends[1:] >= number * chunk))
        return ([data[ends[i] : ends[i + 1] + 1].tobytes() for i in good],)

    return unpacked(by_chunks(df, ("b",), cut, "data array<binary>", limit + 1, 0, chunk), "data", "pdu_idx")


def _octets(hexed: Column) -> Column:
    return F.trim(F.regexp_replace(hexed, "(..)", "$1 "))


def kiss_decode(pdus: DataFrame, column: str = "data") -> DataFrame:
    """Payload of each KISS frame with port, input_bytes and output_bytes; other commands and bad escapes are dropped."""
    spaced = _octets(F.hex(column))
    inner = F.regexp_replace(F.regexp_replace(spaced, "^(C0 ?)+", ""), "( ?C0)+$", "")
    port = F.conv(F.substring(inner, 1, 2), 16, 10).cast("int")
    payload = F.substring(inner, F.lit(4), F.length(inner))
    bad = F.regexp_replace(payload, "DB (DC|DD)", "").rlike("DB|C0")
    plain = F.regexp_replace(F.regexp_replace(payload, "DB DC", "C0"), "DB DD", "DB")
    data = F.unhex(F.replace(plain, F.lit(" "), F.lit("")))
    good = pdus.filter((F.length(inner) >= 2) & (port.bitwiseAND(F.lit(15)) == 0) & ~bad)
    return good.select(
        "stream_id", "pdu_idx", data.alias("data"), F.shiftright(port, 4).alias("port"),
        F.floor((F.length(payload) + 1) / 3).cast("long").alias("input_bytes"), F.octet_length(data).cast("long").alias("output_bytes"),
    )


def kiss_encode(pdus: DataFrame, column: str = "data", port: str | None = None) -> DataFrame:
    """Frames with escaped payloads; ``port`` names a column (below 16).  The port byte itself is not escaped."""
    number = F.coalesce(F.col(port), F.lit(0)) if port else F.lit(0)
    escaped = F.regexp_replace(F.regexp_replace(_octets(F.hex(column)), "DB", "DB DD"), "C0", "DB DC")
    head = F.lpad(F.hex(F.shiftleft(number.cast("int"), 4).cast("bigint")), 2, "0")
    head = F.when(number.between(0, 15), head).otherwise(F.raise_error(F.lit("KISS ports are below 16")).cast("string"))
    data = F.unhex(F.concat(F.lit("C0"), head, F.replace(escaped, F.lit(" "), F.lit("")), F.lit("C0")))
    return pdus.withColumns({"input_bytes": F.octet_length(column).cast("long"), column: data, "output_bytes": F.octet_length(data).cast("long")})


IL2P_HEADER_BITS = 120
#: The 24-bit word in front of an IL2P header.
IL2P_SYNC = [int(c) for c in f"{0xF15E48:024b}"]


def _il2p_header(bits: np.ndarray) -> dict | None:
    """Descramble 120 header bits and unpack the fields; the two parity bytes are not used."""
    register, plain = 0x1F0, []
    for bit in bits.astype(int).tolist():
        plain.append((bit ^ register) & 1)
        register = register >> 1 ^ (0x108 if bit else 0)
    h = np.packbits(np.array(plain, np.uint8)).tolist()[:13]

    def callsign(part: list[int], ssid: int) -> str:
        return "".join(chr((c & 63) + 32) for c in part if c & 63) + f"-{ssid}"

    def spread(shift: int, first: int, last: int) -> int:
        out = 0
        for k in range(first, last + 1):
            out = out << 1 | (h[k] >> shift & 1)
        return out

    return {
        "dst": callsign(h[:6], h[12] >> 4), "src": callsign(h[6:12], h[12] & 15), "ui": bool(h[0] & 0x40), "fec": bool(h[0] & 0x80),
        "hdrtype1": bool(h[1] & 0x80), "pid": spread(6, 1, 4), "control": spread(6, 5, 11), "payload_size": spread(7, 2, 11),
    }


def il2p_deframer(df: DataFrame, tags: DataFrame, key: str = "sync", chunk: int = CHUNK) -> DataFrame:
    """Header fields behind every sync tag (on the last bit of the sync word); tags inside a header are ignored."""

    def machine():
        state = {"free": -1, "n": 0}

        def step(pos, end):
            made = {"pdu_idx": [], "start": []}
            for p in pos.tolist():
                if p >= state["free"]:
                    made["pdu_idx"].append(state["n"])
                    made["start"].append(int(p) + 1)
                    state.update(free=int(p) + 1 + IL2P_HEADER_BITS, n=state["n"] + 1)
            return made

        return step

    found = sequential(tags.filter(F.col("key") == key), ("pos",), machine, "pdu_idx long, start long")
    touched = F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("start") + IL2P_HEADER_BITS - 1) / chunk))
    spread = found.withColumn("_chunk", F.explode(touched))
    both = df.withColumn("_chunk", F.floor(F.col("pos") / chunk)).join(spread, ["stream_id", "_chunk"])
    both = both.filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + IL2P_HEADER_BITS))
    rows = both.groupBy("stream_id", "pdu_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "bit"))).alias("_rows"))
    full = rows.filter(F.size("_rows") == IL2P_HEADER_BITS).select("stream_id", "pdu_idx", F.col("_rows.bit").alias("bits"))
    fields = ["dst", "src", "ui", "fec", "hdrtype1", "pid", "control", "payload_size"]

    def run(frames):
        for frame in frames:
            made = [_il2p_header(np.asarray(b)) for b in frame["bits"]]
            yield pd.concat([frame[["stream_id", "pdu_idx"]].reset_index(drop=True), pd.DataFrame(made, columns=fields)], axis=1)

    kind = df.schema["stream_id"].dataType.simpleString()
    return full.mapInPandas(
        run, f"stream_id {kind}, pdu_idx long, dst string, src string, ui boolean, fec boolean, hdrtype1 boolean, pid int, control int, payload_size int"
    )


def sync_tags(df: DataFrame, key: str = "sync", allowed: int = 0) -> DataFrame:
    """Tags on the last bit of every IL2P sync word."""
    from .bits import correlate_access_code_tag

    return correlate_access_code_tag(df.select(*KEY, "bit"), IL2P_SYNC, key, allowed).tags

