"""Golden vectors of the operators (inputs and outputs are fixed values), and invariance under chunk size."""

import math
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigweave.functions import taps
from sigweave.functions.parsing import parse_frequency, parse_verbosity
from sigweave.model import Stream, affine_scan, last_known, running_sum, tag_value
from sigweave.operators import bits, clock, filters, framing, maps, position, pwm, spectrum
from sigweave.sources import codecs, datastream, files, sinks, synthetic

from .helpers import close, stream, values

C6 = [1 + 0j, 2 + 0j, 3 + 0.2j, 4.1 + 0j, 5 + 0j, 6 + 0.2j]


def bools(spark, pairs, stream_id="s", key="burst"):
    df = spark.createDataFrame([(stream_id, p, b) for p, b in pairs], "stream_id string, pos long, b boolean")
    return df.select("stream_id", "pos", F.lit(key).alias("key"), tag_value("b", F.col("b")).alias("val"))


@pytest.mark.parametrize("d", [1, 2, 3, 5, 7, 12, 13, 18])
def test_fir_identity(spark, d):
    out = filters.fir_filter(stream(spark, C6 * 2), [1.0], decimation=d).df
    assert close(values(out, "re", "im"), (C6 * 2)[::d][: 12 // d])


def test_fir_moving_average_and_translate(spark):
    out = filters.fir_filter(stream(spark, C6), [0.5, 0.5]).df
    assert close(values(out, "re", "im"), [1.5, 2.5 + 0.1j, 3.55 + 0.1j, 4.55, 5.5 + 0.1j])
    x = [complex(i, 0.25 * i) for i in range(32)]
    h = np.array([0.5 - 0.1j, 1 + 0.2j, -0.25 + 0.05j, 0.125 - 0.3j])
    mixed = np.array(x) * np.exp(-2j * math.pi * 2 / 8 * np.arange(32))
    want = np.convolve(mixed, h, "valid")[::3][: (32 - 4 + 1) // 3]
    got = filters.fir_filter(stream(spark, x), h, decimation=3, samp_rate=8.0, translate=2.0).df
    assert close(values(got, "re", "im"), want)


def test_fir_tags(spark):
    s = synthetic.vector_source(spark, [float(i) for i in range(12)], repeat=2)
    out = filters.fir_filter(s, [1.0], decimation=2)
    assert sorted((r.pos, r.key) for r in out.tags.collect()) == [
        (0, "VectorSource::first"), (0, "VectorSource::repeat"), (0, "VectorSource::start"),
        (6, "VectorSource::repeat"), (6, "VectorSource::start"),
    ]


def test_taps():
    got = taps.low_pass(10000, 1000, 1000, taps.hamming(0.54))
    assert len(got) == 25 and abs(got[12] - 0.19922684) < 1e-5 and abs(got[0] - 0.002010403) < 1e-5
    assert taps.multiband([(0.9, 0.1)], 8, np.ones(8)) is None
    assert len(taps.multiband([(0.1, 0.4)], 16, np.ones(16))) == 16
    assert abs(taps.BLACKMAN.make_window(4)[2] - 1) < 1e-9


def test_long_and_short_filters_agree(spark):
    rng = np.random.RandomState(0)
    x, h = rng.randn(300), rng.randn(40)
    got = filters._convolved(stream(spark, x), h, 5, 0, chunk=64)
    full = np.convolve(x, h)
    assert close(values(got, "v"), [full[n + 5] if n + 5 < len(full) else 0 for n in range(300)], 1e-9)
    fft = filters.fft_filter(stream(spark, x), h[:20], flush=True).df
    assert close(values(fft, "v"), np.convolve(x, h[:20])[:300], 1e-9)


def test_resampler(spark):
    x = stream(spark, range(50))
    assert values(position.rational_resampler(x, 25, 64), "v") == [0, 2, 5, 7, 10, 12, 15, 17, 20, 23, 25, 28, 30, 33, 35, 38, 40, 43, 46, 48]
    assert values(position.rational_resampler(x, 25, 128), "v") == [0, 5, 10, 15, 20, 25, 30, 35, 40, 46]
    for n, i, d, m in [(10, 1, 1, 10), (10, 1, 2, 5), (10, 2, 1, 20), (100, 2, 3, 67), (100, 3, 2, 150), (100, 300, 200, 150), (100, 200000, 1024000, 20)]:
        assert position.rational_resampler(stream(spark, range(n)), i, d).count() == m
    with pytest.raises(ValueError):
        position.rational_resampler(x, 0, 1)


def test_demod(spark):
    x = [1 + 0j, 0.707 - 0.707j, -1j, -1 + 0j]
    assert close(values(filters.quadrature_demod(stream(spark, x)), "v"), [-math.pi / 4, -math.pi / 4, -math.pi / 2])
    assert close(values(filters.quadrature_demod(stream(spark, [0j] * 4)), "v"), [0, 0, 0])
    assert filters.fast_fm(stream(spark, x)).count() == 4


def test_bit_codes(spark):
    assert values(bits.nrzi_decode(stream(spark, [0, 0, 0, 0, 1, 1, 1, 1], "bit")), "bit") == [1, 1, 1, 1, 0, 1, 1, 1]
    assert values(bits.nrzi_encode(stream(spark, [1, 1, 1, 1, 0, 1, 1, 1], "bit")), "bit") == [0, 0, 0, 0, 1, 1, 1, 1]
    x = [int(c) for c in "1111010111010110"] + [0] * 17
    assert "".join(map(str, values(bits.scrambler_g3ruh(stream(spark, x, "bit")), "bit")[17:])) == "1111010111011001"
    ones = [1] * 24 + [0] * 17
    assert values(bits.scrambler_g3ruh(stream(spark, ones, "bit")), "bit")[17:] == [1] * 12 + [0] * 5 + [1] * 7


@pytest.mark.parametrize("chunk", [5, 17, 64, 4096])
def test_scrambler_in_chunks(spark, chunk):
    data = np.random.RandomState(chunk).randint(0, 2, (3, 500))
    df = stream(spark, data[0], "bit", "a").union(stream(spark, data[1], "bit", "b")).union(stream(spark, data[2][:1], "bit", "c"))
    got = bits.scrambler_g3ruh(df, chunk)
    assert got.dtypes == df.dtypes
    for name, x in zip("abc", [data[0], data[1], data[2][:1]], strict=True):
        s = [0] * 17
        for bit in x:
            s.append(int(bit) ^ s[-12] ^ s[-17])
        assert values(got.filter(got.stream_id == name), "bit") == s[: len(x)]
    assert bits.scrambler_g3ruh(df.filter("pos < 0"), chunk).count() == 0


def test_burst_tagger(spark):
    trigger = stream(spark, [0.1] * 80 + [0.3] * 10 + [0.2] * 10)
    got = bits.burst_tagger(stream(spark, range(100)), trigger, 0.25).tags.orderBy("pos").collect()
    assert [(r.pos, r.val.b) for r in got] == [(80, True), (90, False)]


@pytest.mark.parametrize(
    "start,end,tail,limit,want",
    [
        (0, 7, 0, 10, [[1, 2, 3, 4, 5, 6, 7]]), (0, 0, 0, 10, [[]]), (0, 0, 1, 10, [[1]]), (1, 1, 3, 10, [[2, 3, 4]]),
        (1, 1, 9, 10, [list(range(2, 11))]), (9, 7, 0, 10, []), (7, 9, 1, 10, [[8, 9, 10]]),
        (0, 3, 0, 3, [[1, 2, 3]]), (0, 4, 0, 3, []), (1, 3, 1, 3, [[2, 3, 4]]), (1, 4, 1, 3, []),
    ],
)
def test_stream_to_pdu(spark, start, end, tail, limit, want):
    s = Stream(stream(spark, range(1, 11)), bools(spark, [(start, True), (end, False)]))
    got = bits.stream_to_pdu(s, "burst", limit, tail).orderBy("pdu_idx").collect()
    assert [list(r.data) for r in got] == want


def test_bursts_without_tail(spark):
    rng = np.random.RandomState(3)
    marks = [(int(p), bool(v)) for p, v in zip(rng.randint(0, 120, 150), rng.randint(0, 2, 150), strict=True)]
    want, start = [], None
    for p in sorted({p for p, _ in marks}):
        start = p if start is None and (p, True) in marks else start
        if start is not None and (p, False) in marks:
            want.append((len(want), start, p))
            start = None
    got = bits.bursts(bools(spark, marks), "burst").orderBy("pdu_idx").collect()
    assert [(r.pdu_idx, r.start, r.stop) for r in got] == want and len(want) > 10


@pytest.mark.parametrize("n,n_taps,d", [(100, 5, 1), (101, 5, 4), (7, 5, 3), (6, 5, 3), (4, 5, 1), (300, 20, 7), (25, 20, 7), (26, 20, 7), (0, 3, 2)])
def test_fir_ends(spark, n, n_taps, d):
    x, taps = np.random.RandomState(n).rand(n), np.arange(1.0, n_taps + 1)
    whole = np.convolve(x, taps, "valid") if n >= n_taps else np.zeros(0)
    want = whole[: (n - n_taps + 1) // d * d : d] if n >= n_taps + d - 1 else []
    df = stream(spark, x) if n else stream(spark, [0.0]).filter("pos < 0")
    got = [r.v for r in filters.fir_filter(df, taps, d).df.orderBy("pos").collect()]
    assert len(got) == len(want) and np.allclose(got, want)


def test_stream_to_pdu_tags_and_back(spark):
    tags = bools(spark, [(3, True), (7, True), (7, False)]).unionByName(bools(spark, [(4, True)], key="test"))
    got = bits.stream_to_pdu(Stream(stream(spark, range(1, 11)), tags), "burst", 10, 1).collect()
    assert list(got[0].data) == [4, 5, 6, 7, 8] and [(t.pos, t.key) for t in got[0].tags] == [(1, "test")]
    pdus = spark.createDataFrame([("s", 0, [11, 22, 33]), ("s", 1, []), ("s", 2, [3, 2, 1, 0])], "stream_id string, pdu_idx long, data array<int>")
    flat = bits.pdu_to_stream(pdus)
    assert values(flat.df, "v") == [11, 22, 33, 3, 2, 1, 0]
    assert sorted((r.pos, r.key.split("::")[1], int(r.val.u)) for r in flat.tags.collect()) == [(0, "start", 3), (2, "end", 3), (3, "start", 4), (6, "end", 4)]


def test_pdu_average(spark):
    pdus = spark.createDataFrame([("s", i, [float(x) for x in r]) for i, r in enumerate([[1, 2, 3], [4, 5, 6], [7, 8, 9], [0, 0, 0]])], "stream_id string, pdu_idx long, data array<double>")
    assert [list(r.data) for r in bits.pdu_average(pdus, 3).collect()] == [[4, 5, 6]]
    with pytest.raises(Exception, match="differ in length"):
        bits.pdu_average(pdus.withColumn("data", F.when(F.col("pdu_idx") == 0, F.array(F.lit(1.0))).otherwise(F.col("data"))), 2).collect()


def _bits(text):
    return [int(c) for c in text]


@pytest.mark.parametrize(
    "text,low,high,keep,want",
    [
        ("01111110010101011110000001111110", 1, 10, True, ["aa07"]),
        ("01111110111110111110111110101111110", 1, 10, True, ["ffff"]), ("01111110111110111110111110101111110", 3, 10, True, []),
        ("01111110111110111110111110101111110", 1, 1, True, []), ("0111111010101010000010101010111101111110", 1, 10, False, ["55"]),
    ],
)
def test_hdlc_deframer(spark, text, low, high, keep, want):
    got = framing.hdlc_deframer(stream(spark, _bits(text), "bit"), low, high, keep_checksum=keep).orderBy("pdu_idx").collect()
    assert [bytes(r.data).hex() for r in got] == want


FLAG = "01111110"


def _between_flags(text, least, most):
    """(place of the closing flag's last bit, bytes) of the frames in a text of bits.

    A frame is what lies between two flags, zeros behind five ones left out, in whole bytes.
    Six ones that are no flag, or more bits than a frame and six more may have, lose the
    flag; then the search goes on for a whole new one.
    """
    out, flag = [], text.find(FLAG)
    while flag >= 0:
        start, ones = flag + len(FLAG), text.find("111111", flag + len(FLAG))
        body = text[start : ones + 5 if ones >= 0 else len(text)]
        stuffed = {m.end() - 1 for m in re.finditer("111110", body)}
        kept = [i for i in range(len(body)) if i not in stuffed]
        if len(kept) > 8 * most:
            flag = text.find(FLAG, start + kept[8 * most] + 2)
        elif ones < 0 or ones + 6 == len(text):
            break
        elif ones == start or text[ones + 6] == "1":
            flag = text.find(FLAG, ones + 7)
        else:
            frame = "".join(body[i] for i in kept[:-6])
            if len(frame) % 8 == 0 and len(frame) >= 8 * least:
                out.append((ones + 6, bytes(int(frame[i : i + 8][::-1], 2) for i in range(0, len(frame), 8))))
            flag = ones - 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["01111110", "0", "1", "11111", "0101010101010101", "111110"]), max_size=40), st.integers(1, 30), st.integers(1, 3))
def test_deframer_like_its_description(parts, piece, max_size):
    data = _bits("".join(parts))
    own, got = framing.Deframer(1, max_size), []
    for i in range(0, len(data), piece):
        got += list(own.feed(bytes(data[i : i + piece])))
    assert got == _between_flags("".join(parts), 1, max_size)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["01111110", "0", "1", "11111", "0101010101010101", "111110", "1111110"]), max_size=60), st.sampled_from([1, 9, 41, 1000]), st.integers(1, 3))
def test_hdlc_scan_like_its_description(parts, chunk, max_size):
    """Maps of chunks, put together, at four chunk sizes."""
    data, reach, state, got = np.array(_bits("".join(parts)), np.int8), 8 * max_size * 6 // 5 + 32, framing._FREE, []
    for lo in range(0, len(data), chunk):
        first = max(0, lo - reach)
        own = framing._marks(data[first : lo + chunk + 8], lo - first, lo - first + chunk, 1, max_size, True, False)
        before = own.before()
        got += [(first + int(own.start[k]) + 6, own.frames[k]) for k in sorted(own.frames) if before[k, state] == framing._SYNCED]
        state = before[-1, state]
    assert got == _between_flags("".join(parts), 1, max_size)


def test_hdlc_over_many_chunks(spark):
    rnd = np.random.RandomState(4)
    texts = ["".join(rnd.choice(["01111110", "01111110", "01010101", "01010101", "111110", "11111", "1111110"], 250)) for _ in range(3)]
    df = spark.createDataFrame([(f"s{k}", i, b) for k, t in enumerate(texts) for i, b in enumerate(_bits(t))], "stream_id string, pos long, bit tinyint")
    got = framing.hdlc_deframer(df, 1, 2, keep_checksum=True, chunk=1).orderBy("stream_id", "pdu_idx").collect()
    want = [(f"s{k}", i, data, place) for k, t in enumerate(texts) for i, (place, data) in enumerate(_between_flags(t, 1, 2))]
    assert len(want) > 20 and [(r.stream_id, r.pdu_idx, bytes(r.data), r.packet_pos) for r in got] == want


def test_every_single_flip_is_found():
    rnd = np.random.RandomState(1)
    for size in (1, 2, 7, 60):
        data = rnd.bytes(size)
        crc = framing.crc16_x25(data)
        assert framing._crc16(data) == crc and framing._repaired(data, crc) == data
        for i in range(8 * size):
            wrong = bytearray(data)
            wrong[i >> 3] ^= 1 << (i & 7)
            assert framing._repaired(bytes(wrong), crc) == data
        for i in range(16):  # a flip of the checksum, unless one of the data comes first
            fits = [k for k in range(8 * size) if framing.crc16_x25(bytes(b ^ (1 << (k & 7)) * (j == k >> 3) for j, b in enumerate(data))) == crc ^ 1 << i]
            got = framing._repaired(data, crc ^ 1 << i)
            assert got == data if not fits else framing.crc16_x25(got) == crc ^ 1 << i
    long = bytearray(rnd.bytes(5000))
    crc = framing.crc16_x25(bytes(long))
    for i in (0, 3000, 32767 + 100, 39_999):  # the same change recurs after 32,767 bits: the first fitting bit is flipped
        wrong = bytearray(long)
        wrong[i >> 3] ^= 1 << (i & 7)
        got = framing._repaired(bytes(wrong), crc)
        assert framing.crc16_x25(got) == crc and (i >= 32767 or got == long)


def test_framer_and_checksums(spark):
    pdus = spark.createDataFrame([("s", 0, bytes.fromhex("0055")), ("s", 1, bytes.fromhex("00ff55")), ("s", 2, bytes.fromhex("aa07"))], "stream_id string, pdu_idx long, data binary")
    got = framing.hdlc_framer(pdus).orderBy("pdu_idx").collect()
    flags = "01111110" * 20
    assert ["".join(map(str, r.data)).removeprefix(flags).removesuffix(flags) for r in got] == ["0000000010101010", "0000000011111011110101010", "0101010111100000"]
    assert framing.crc16_x25(b"123456789") == 0x906E
    assert bytes(framing.fcs_adder(pdus).filter("pdu_idx = 0").first().data)[2:] == framing.crc16_x25(bytes.fromhex("0055")).to_bytes(2, "little")
    assert framing._repaired(b"abd", framing.crc16_x25(b"abc")) is None
    assert framing._repaired(b"abb", framing.crc16_x25(b"abc")) == b"abc"


def test_kiss(spark):
    frame = b"\xc0\x30foo\xdb\xdcA\xdb\xdd"
    pdus = spark.createDataFrame([("s", 0, frame), ("s", 1, b"\xc0\x31no"), ("s", 2, b"\xc0\x00\xdb\x01\xc0")], "stream_id string, pdu_idx long, data binary")
    got = framing.kiss_decode(pdus).collect()
    assert [(bytes(r.data), r.port, r.input_bytes, r.output_bytes) for r in got] == [(b"foo\xc0A\xdb", 3, 8, 6)]
    raw = b"junk\xc0\x00ab\xc0\xc0\x00c\xdb\xdc\xc0rest"
    frames = framing.kiss_frame(stream(spark, raw, "b")).orderBy("pdu_idx").collect()
    assert [bytes(r.data) for r in frames] == [b"\xc0\x00ab\xc0", b"\xc0\x00c\xdb\xdc\xc0"]


def test_morse(spark):
    rows = spark.createDataFrame([("s", i, m) for i, m in enumerate(["", "A", "A B", "é"])], "stream_id string, pdu_idx long, msg string")
    got = ["".join(map(str, r.data)) for r in maps.morse_encode(rows).orderBy("pdu_idx").collect()]
    assert got[:2] == ["000000", "101110000000"] and got[3] == "000000"
    assert got[2] == "101110" + "000000" + "1110101010" + "000000"


def test_rtlsdr_and_au(spark):
    got = values(codecs.rtlsdr_decode(stream(spark, [0, 10, 20, 10, 0, 13, 9], "b")), "re", "im")
    assert close(got, [-1.016 - 0.936j, -0.856 - 0.936j, -1.016 - 0.912j])
    assert values(codecs.rtlsdr_encode(stream(spark, got)), "b") == [0, 10, 20, 10, 0, 13]
    assert values(codecs.rtlsdr_encode(stream(spark, [-10 + 10j])), "b") == [0, 255]
    audio = codecs.au_encode(stream(spark, [0.5, -1.0, 2.0, 0.0]), 8000)
    assert audio.count() == 36 and bytes(values(audio, "b")[:4]) == b".snd"
    assert close(values(codecs.au_decode(audio, 8000), "v"), [0.5, -1.0, 1.0, 0.0])
    with pytest.raises(Exception, match="bitrate"):
        codecs.au_decode(audio, 44100).collect()


def test_iir(spark):
    own = filters.Iir([1, 0.9, 0.1])
    assert close([own(100) for _ in range(4)], [100, 190, 281, 371.9])
    own = filters.Iir([0.9, 0.1])
    assert close([own(100) for _ in range(4)], [90, 99, 99.9, 99.99])
    assert filters.single_pole_iir(stream(spark, [1, 2]), 1.5) is None


@pytest.mark.parametrize("chunk", [1, 3, 7, 64])
def test_chunk_size_does_not_matter(spark, chunk):
    rng = np.random.RandomState(1)
    x = rng.randn(50)
    df = stream(spark, x)
    y, want = 0.0, []
    for v in x:
        y = v + 0.8 * y
        want.append(y)
    assert close(values(affine_scan(df, 0.8, {"v": F.col("v")}, chunk), "v"), want, 1e-9)
    assert close(values(running_sum(df, F.col("v"), "y", chunk), "y"), np.cumsum(x), 1e-9)
    known = last_known(df, F.when(F.col("v") > 0.5, F.col("pos")), "y", -1, chunk)
    last, expected = -1, []
    for i, v in enumerate(x):
        last = i if v > 0.5 else last
        expected.append(last)
    assert values(known, "y") == expected


@pytest.mark.parametrize("decay", [1.0, 0.999999, 0.99])
def test_far_carries(spark, decay):
    """Carries over many chunks, scanned level by level."""
    x = np.random.RandomState(4).randn(700)
    y, want = 0.0, []
    for v in x:
        y = v + decay * y
        want.append(y)
    assert close(values(affine_scan(stream(spark, x), decay, {"v": F.col("v")}, 3), "v"), want, 1e-8)


def test_parse_verbosity():
    assert [parse_verbosity(x) for x in ("error", "WARN", "info", "debug", "Trace")] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="valid values are error, warn"):
        parse_verbosity("loud")


def test_check_hash(spark):
    import hashlib

    df = stream(spark, b"some bytes", "b")
    assert spectrum.check_hash(df, hashlib.sha512(b"some bytes").hexdigest()).first().matches
    assert not spectrum.check_hash(df, hashlib.sha512(b"other").hexdigest()).first().matches


@pytest.mark.parametrize("n_taps", [20, 65, 300])
@pytest.mark.parametrize("kind", ["real", "complex taps", "complex"])
def test_long_filters(spark, n_taps, kind):
    rng = np.random.RandomState(n_taps)
    x = rng.randn(900) + (1j * rng.randn(900) if kind == "complex" else 0)
    taps_ = rng.randn(n_taps) + (1j * rng.randn(n_taps) if kind != "real" else 0)
    want = np.convolve(x, taps_)[:900]
    got = values(filters.fft_filter(stream(spark, x), taps_, flush=True).df, *(("v",) if kind == "real" else ("re", "im")))
    assert close(got, want, 1e-8)
    chunked = filters._convolved(stream(spark, x), taps_, 0, chunk=100)
    assert close(values(chunked, *(("v",) if kind == "real" else ("re", "im"))), want, 1e-8)


def test_equalizer_keeps_tags(spark):
    tags = spark.createDataFrame([("s", 1, "a"), ("s", 5, "b")], "stream_id string, pos long, key string").withColumn("val", tag_value("b", True))
    out = filters.cma_equalizer(Stream(stream(spark, C6), tags), 2, 1.0, 0.001)
    assert values(out.tags, "key") == ["a"] and out.df.count() == 5


@pytest.mark.parametrize("chunk", [8, 4096])
def test_equalizer_with_taps_that_run_away(spark, chunk):
    """Loud samples make the taps grow without bound: outputs equal a plain loop's bit for bit until they overflow."""
    rng = np.random.RandomState(3)
    x = [complex(*(rng.randn(2) * (12 if i > 30 else 0.5))) for i in range(60)]
    a, b, want = [1.0, 0.0, 0.0], [0.0, 0.0, 0.0], []
    with np.errstate(all="ignore"):
        for t in range(len(x) - 2):
            own = [(np.float64(s.real), np.float64(s.imag)) for s in x[t : t + 3]]
            u, v = a[0] * own[0][0] - b[0] * own[0][1], a[0] * own[0][1] + b[0] * own[0][0]
            for i in (1, 2):
                u, v = u + a[i] * own[i][0] - b[i] * own[i][1], v + a[i] * own[i][1] + b[i] * own[i][0]
            want.append((u, v))
            gain = 0.01 * (1.0 - (u * u + v * v))
            for i, (p, q) in enumerate(own):
                a[i], b[i] = a[i] + gain * (u * p + v * q), b[i] + gain * (v * p - u * q)
    assert max(abs(u) for u, _ in want[:40]) > 1e30 and not np.isfinite(want[-1]).all()
    got = values(filters.cma_equalizer(stream(spark, x), 3, 1.0, 0.01, chunk), "re", "im")
    assert np.array_equal([(z.real, z.imag) for z in got], want, equal_nan=True)


def test_symbol_sync(spark):
    """Without sign changes the grid starts at 0; with them it is half a clock behind each, and the clock follows their distance."""
    assert [(r.pos, r.clock) for r in clock.symbol_sync(stream(spark, [0.0] * 10), 4, 0.5, (1.0,)).orderBy("pos").collect()] == [(0, 4.0), (1, 4.0), (2, 4.0)]
    x = [k + 0.5 if k // 5 % 2 else -k - 0.5 for k in range(60)]  # symbols of five samples
    got = clock.symbol_sync(stream(spark, x), 4.8, 0.5, (1.0,)).orderBy("pos").collect()
    assert [abs(r.v) for r in got[-8:]] == [k + 0.5 for k in range(23, 60, 5)] and got[-1].clock == 5.0
    with pytest.raises(ValueError, match="more than one"):
        clock.symbol_sync(stream(spark, x), 1, 0.5)


def test_zero_crossing(spark):
    x = [1.0 if k // 4 % 2 else -1.0 for k in range(24)]
    x = [s * (k + 1) for k, s in enumerate(x)]
    assert [abs(v) - 1 for v in values(clock.zero_crossing(stream(spark, x), 4), "v")] == [2, 6, 10, 14, 18, 22]


def test_wpcr(spark):
    """Symbols of four samples: one value of each, at a quarter of the rate."""
    symbols = [1, -1, 1, 1, -1, -1, 1, -1, 1, -1, -1, 1, -1, 1, -1, 1]
    pdus = spark.createDataFrame([("s", 0, [float(s) for s in symbols for _ in range(4)]), ("s", 1, [1.0] * 3)], "stream_id string, pdu_idx long, data array<double>")
    (row,) = bits.wpcr(pdus, 100.0).collect()
    assert row.pdu_idx == 0 and abs(row.sps - 0.25) < 0.01 and row.frequency == row.sps * 100
    assert [int(v) for v in row.data][:14] in ([int(s) for s in symbols[:14]], [int(s) for s in symbols[1:15]])


def test_symbol_rate_at_whole_fractions_of_a_turn():
    """Sign changes on every third place have a line whose phase is 0 or half a turn but for rounding: the sums of a plain loop decide."""
    rng = np.random.RandomState(1)
    for _ in range(300):
        crossings = (rng.rand(63) < np.where(np.arange(63) % 3 == 0, 0.9, 0.15)).astype(float)
        lines = [sum((c * complex(math.cos(a := 2 * math.pi * k * n / 63), math.sin(a)) for n, c in enumerate(crossings)), 0j) for k in range(31)]
        power = [math.sqrt(z.real * z.real + z.imag * z.imag) for z in lines]
        k = next(k for k in range(2, 30) if power[k] > 0.8 * max(power[2:]) and power[k] > power[k + 1])
        turn = math.atan2(-lines[k].imag, lines[k].real) / (2 * math.pi)
        assert bits._symbol_rate(crossings, 64) == (k / 64, turn + (0.5 if turn > 0 else 1.5))


def test_scrambler_of_many_short_streams(spark):
    """What a stream costs is its bits, not a table for its length of chunk."""
    df = spark.range(12_000 * 20).selectExpr("id div 20 AS stream_id", "id % 20 AS pos", "CAST((id * id) % 3 % 2 AS TINYINT) AS bit")
    start = time.time()
    got = bits.scrambler_g3ruh(df).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("pos", "bit"))).alias("rows")).collect()
    assert time.time() - start < 15
    assert len(got) == 12_000
    for row in got[:50]:
        x = [(20 * row.stream_id + i) ** 2 % 3 % 2 for i in range(20)]
        s = [0] * 17
        for bit in x:
            s.append(bit ^ s[-12] ^ s[-17])
        assert [r.bit for r in row.rows] == s[:20]


def test_hdlc_in_pieces(spark):
    """Packets that stay whole give the frames that their bits one by one give, over many chunks."""
    pdus = spark.range(300).selectExpr("id % 2 AS stream_id", "id div 2 AS pdu_idx", "CAST(concat('packet ', id * id) AS BINARY) AS data")
    sent = framing.fcs_adder(pdus)
    rows = bits.pdu_to_stream(framing.hdlc_framer(sent, flags=2), value="bit").df
    pieces = bits.pdu_to_pieces(framing.hdlc_framer(sent, flags=2, packed=True))
    order = ["stream_id", "pdu_idx"]
    got, want = (framing.hdlc_deframer(df, 3, 20, chunk=1).orderBy(*order).collect() for df in (pieces, rows))
    assert len(got) == 300 and got == want
    assert [(r.stream_id, r.pdu_idx, r.data) for r in got] == [tuple(r) for r in pdus.orderBy(*order).collect()]


def test_steady_clock_takes_stretches_as_single_changes():
    rng = np.random.RandomState(5)
    for sps in (4.0, 5.0, 2.5):
        at = np.cumsum(np.where(rng.rand(6000) < 0.001, rng.randint(1, 12, 6000), int(2 * sps) * rng.randint(1, 5, 6000)))
        one, many = clock.SymbolClock(sps, 0.5, (0.5, 0.25)), clock.SymbolClock(sps, 0.5, (0.5, 0.25))
        want = [(-1.0, 0.0, sps)] + [(float(p), *new) for p in at.tolist() if (new := one(p))]
        assert np.array_equal(many.run(at, (-1.0, 0.0, sps)), want) and many.last == one.last and many.clock == one.clock


def test_modem_stores_bits_only(spark, sf_dir):
    """What a packet's 288 bits leave on disk does not grow to rows of its 1152 samples."""
    from pathlib import Path

    from sigweave.queries import QUERIES

    root = Path(spark.conf.get("spark.checkpoint.dir")[7:])
    used = lambda: sum(f.stat().st_size for f in root.rglob("*") if f.is_file())
    before = used()
    packets = QUERIES["modem_loop"](spark, sf_dir).count()
    assert packets > 100 and used() - before < 300_000 + 600 * packets


def test_stream_chunks_keep_tags(spark):
    tags = spark.createDataFrame([("s", 1, "a"), ("s", 4, "b"), ("s", 6, "c")], "stream_id string, pos long, key string").withColumn("val", tag_value("b", True))
    got = bits.stream_chunks(Stream(stream(spark, range(7)), tags), 3).orderBy("pdu_idx").collect()
    assert [[(t.pos, t.key) for t in r.tags] for r in got] == [[(1, "a")], [(1, "b")]]


def test_delay(spark):
    s = Stream(stream(spark, [1, 2, 3]))
    assert values(position.delay(s, 1).df, "v") == [0, 1, 2, 3]
    assert values(position.set_delay(Stream(stream(spark, [1, 2])), [(0, 2)]).df, "v") == [0, 0, 1, 2]


def test_pwm(spark):
    def frame(bits_):
        out = []
        for b in bits_:
            out += [1.0] * (2 if b else 5) + [0.0] * 3
        return out

    x = [0.0] * 3
    for f in ([1, 1, 1, 1, 1], *[[1, 0, 1, 1, 0]] * 3):
        x += frame(f) + [1.0] * 2 + [0.0] * 10
    x += [0.0] * 25
    s = pwm.PwmSettings(0.5, 2, 5, 9, 20, low_threshold=0.25, pulse_tolerance=1, max_frame_bits=16, frame_bits=5, min_repeats=3, gap_pulse="delimiter")
    got = pwm.pwm_decoder(stream(spark, x), s).collect()
    assert [(list(r.bits), r.repeats) for r in got] == [([1, 0, 1, 1, 0], 3)]
    with pytest.raises(ValueError):
        pwm.PwmSettings(0.5, 5, 2, 9, 20).check()


def test_sources_and_sinks(spark, tmp_path):
    s = synthetic.vector_source(spark, [1.0, 2.0], repeat=3, tags=[(1, "mine", tag_value("s", "x"))])
    assert values(s.df, "v") == [1, 2] * 3 and s.tags.filter("key = 'mine'").count() == 3
    with pytest.raises(ValueError):
        synthetic.vector_source(spark, [1.0], tags=[(1, "t", tag_value("s", "x"))])
    path = f"file://{tmp_path}/raw"
    files.write_raw(stream(spark, [1 + 2j, 3 - 1j, 0.5j]), path, "complex", parts=1)
    assert close(values(files.read_raw(spark, path, "complex", splitbytes="8"), "re", "im"), [1 + 2j, 3 - 1j, 0.5j])
    with pytest.raises(Exception, match="already has samples"):
        files.write_raw(stream(spark, [1j]), path, "complex")
    files.write_sigmf(stream(spark, [1 + 2j, 3 - 1j]), f"file://{tmp_path}/rec.sigmf", 48000.0, 1e6)
    df, meta = files.read_sigmf(spark, f"file://{tmp_path}/rec.sigmf", 48000.0)
    assert close(values(df, "re", "im"), [1 + 2j, 3 - 1j]) and meta["captures"][0]["core:frequency"] == 1e6
    with pytest.raises(ValueError):
        files.read_sigmf(spark, f"file://{tmp_path}/rec.sigmf", 44100.0)
    assert len(sinks.vector_sink(s.df, 6)) == 6
    with pytest.raises(ValueError):
        sinks.vector_sink(s.df, 5)
    pdus = spark.createDataFrame([("s", 0, b"ab"), ("s", 1, b"c")], "stream_id string, pdu_idx long, data binary")
    assert sorted((r.name, r.size) for r in sinks.pdu_writer(pdus, f"file://{tmp_path}/pdus").collect()) == [("s-000000000000", 2), ("s-000000000001", 1)]
    assert values(sinks.to_text([Stream(stream(spark, [1, 2])), Stream(stream(spark, [3, 4, 5]))]), "line") == ["1.0 3.0", "2.0 4.0"]


def test_data_stream():
    raw = datastream.version_packet() + datastream.request_packet("a", 9) + datastream.data_packet("é", b"xyz")
    own, got = datastream.Packets(), []
    for i in range(0, len(raw), 3):
        got += list(own.feed(raw[i : i + 3]))
    assert got == [("version", 0, None, None), ("request", 9, "a", None), ("data", None, "é", b"xyz")]
    datastream.check_version(iter(got))
    with pytest.raises(ValueError):
        list(datastream.Packets().feed(b"\0\0\0\0"))
    assert [parse_frequency(x) for x in ("100k", "2_0M", "1.5g", "7")] == [100e3, 20e6, 1.5e9, 7.0]


def _recursive(x, taps, least=-np.inf, most=np.inf):
    y = []
    for v in x:
        own = taps[0] * v + sum(t * y[-k] for k, t in enumerate(taps[1:], 1) if len(y) >= k)
        y.append(min(max(own, least), most))
    return y


@pytest.mark.parametrize(
    "taps,least,most",
    [
        ([0.5], -1, 1), ([0.5, 0.9], -np.inf, np.inf), ([0.5, -0.9], -1, 1.5), ([1.0, 1.0], -2, 2), ([1.0, 0.0], -1, 1), ([1.0, -1.0], -np.inf, 3), ([0.3, 0.5, -0.3, 0.2], -np.inf, np.inf),
        ([1.0, 1.6, -0.8], -np.inf, np.inf), ([1.0, 1.6, -0.8], -2, 2), ([1.0, 0.2, 0.1, 0.6], -1, 0.5), ([1.0, 2.0], -5, 5), ([1.0, 0.99, 0.01], -3, 3),
    ],
)
def test_iir_in_chunks(spark, taps, least, most):
    """Chunks of eight samples against the plain recursion; the last ones never forget, so all their chunks run again."""
    x = np.random.RandomState(7).randn(70)
    df = stream(spark, x).unionByName(stream(spark, x[:3], stream_id="t"))
    got = filters.iir_filter(df, taps, least, most, chunk=8)
    assert close(values(got.filter("stream_id = 's'"), "v"), _recursive(x, taps, least, most), 1e-9)
    assert close(values(got.filter("stream_id = 't'"), "v"), _recursive(x[:3], taps, least, most), 1e-9)


def test_cma_in_chunks(spark):
    rnd = np.random.RandomState(3)
    z = np.exp(0.5j * np.pi * rnd.randint(0, 4, 90)) + 0.1 * rnd.randn(90)
    taps, want = np.array([1, 0, 0], complex), []
    for i in range(88):
        y = taps @ z[i : i + 3]
        taps = taps + 0.01 * (1 - abs(y) ** 2) * y * z[i : i + 3].conj()
        want.append(y)
    got, share = filters.equalized(stream(spark, z), 3, 1.0, 0.01, chunk=16)
    assert close(values(got, "re", "im"), want, 1e-9) and 0 < share
    whole, none = filters.equalized(stream(spark, z), 3, 1.0, 0.01)
    assert close(values(whole, "re", "im"), want, 1e-12) and none == 0


@pytest.mark.parametrize("seed", range(4))
def test_pwm_windows_like_the_walk(spark, seed):
    """Sessions by windows against the machine that walks level changes, over both gap modes and all limits."""
    rnd = np.random.RandomState(seed)
    runs = np.concatenate([[0.0] * rnd.choice([1, 2, 3, 5, 9]) + [1.0] * rnd.choice([1, 1, 2, 3, 3, 6]) for _ in range(120)])
    x = np.concatenate([runs, [0.0] * rnd.choice([0, 3, 6])])
    for gap_pulse in ("data", "delimiter"):
        for more in ({}, {"max_distinct_frames": 2, "min_repeats": 2}, {"frame_bits": 2}, {"max_frame_bits": 3, "short_is_one": False, "max_distinct_frames": 3}):
            settings = pwm.PwmSettings(0.5, 1, 3, 4, 8, low_threshold=0.2, pulse_tolerance=1, gap_pulse=gap_pulse, **more)
            walk = pwm.Pulses(settings)
            for i in np.flatnonzero(np.diff(x, prepend=0.0)).tolist():
                walk.edge(i, x[i] > 0)
            walk.end(len(x))
            made = walk.taken()
            got = pwm.pwm_decoder(stream(spark, x), settings).orderBy("pdu_idx").collect()
            assert [(r.pdu_idx, list(r.bits), r.repeats, r.first_sample) for r in got] == list(zip(*(made[k] for k in ("pdu_idx", "bits", "repeats", "first_sample")), strict=True))


@pytest.mark.parametrize("chunk", [2, 50])
def test_clocks_in_chunks(spark, chunk):
    """However a stream is cut, the same samples are picked with the same clocks."""
    from sigweave.operators import clock

    x = np.repeat(np.random.RandomState(8).randn(60), np.random.RandomState(9).randint(1, 6, 60))
    df = stream(spark, x).unionByName(stream(spark, x[:5], stream_id="t")).unionByName(stream(spark, [1.0], stream_id="u"))
    for op, more in ((clock.symbol_sync, (0.5,)), (clock.zero_crossing, ())):
        rows = lambda c, op=op, more=more: sorted(map(tuple, op(df, 2.5, *more, chunk=c).select("stream_id", "pos", "v", "clock").collect()))
        assert rows(chunk) == rows(1000) and len(rows(1000)) > 30


def test_kiss_frames_over_many_chunks(spark):
    rnd = np.random.RandomState(6)
    data = rnd.choice([0xC0, 1, 2, 3], 400, p=[0.2, 0.3, 0.3, 0.2]).astype(np.uint8).tobytes()
    want = [f for f in data.split(b"\xc0")[1:-1] if 0 < len(f) <= 5]
    got = framing.kiss_frame(stream(spark, data, "b"), limit=5, chunk=1).orderBy("pdu_idx").collect()
    assert [bytes(r.data) for r in got] == [b"\xc0" + f + b"\xc0" for f in want] and [r.pdu_idx for r in got] == list(range(len(want)))


def test_pager_messages(spark):
    """One pulse train of a pager message, from samples to fields."""
    raw = 0x1234 << 9 | 7 << 5 | 0x0D << 1 | 1
    train = [0.0] * 5
    for _ in range(2):
        for k in reversed(range(25)):
            train += [1.0] * (1 if raw >> k & 1 else 3) + [0.0] * (8 if k == 0 else 2)
    settings = pwm.PwmSettings(0.5, 1, 3, 5, 20, low_threshold=0.2, pulse_tolerance=0, frame_bits=25)
    frames = pwm.pwm_decoder(stream(spark, train + [0.0] * 30), settings)
    got = pwm.pager_messages(frames, 1000).first()
    assert (got.raw, got.system_id, got.pager, got.function_name, got.repeats, got.first_sample) == (raw, 0x1234, 7, "Buzz", 2, 5)
    assert got.line == f"Restaurant-Pager: id=0x1234 pager=7 function=Buzz (0xd) repeats=2 raw=0x{raw:07x} time=0.005000s"
    short = frames.withColumn("bits", F.slice("bits", 1, 24))
    assert pwm.pager_messages(short, 1000).count() == 0
