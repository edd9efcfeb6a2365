"""Live operators over files that arrive in another order than their positions."""

import glob
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.operators import bits, clock, filters, framing, maps, position, pwm, spectrum
from sigweave.streaming import live

from .helpers import close, stream, values


def _arrive(spark, df, path, pieces, column):
    """Write the stream in pieces; later files hold earlier positions."""
    rows = df.orderBy("pos").collect()
    size = -(-len(rows) // pieces)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    order = [*range(1, len(parts)), 0] if len(parts) > 2 else range(len(parts))
    for k in order:
        spark.createDataFrame(parts[k], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return df.sparkSession.table(name)


def _restarted(spark, df, make, path, name, order="pos"):
    """Results of a query over shuffled pieces of the stream, stopped and started again after half of them."""
    rows = df.orderBy("stream_id", order).collect()
    parts = [[r for r in rows if (ord(r.stream_id) + r[order] // 9 * 7) % 5 == k] for k in range(5)]
    for k, half in enumerate((parts[:2], parts[2:])):
        for part in half:
            if part:
                spark.createDataFrame(part[::-1], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        query = make(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
        query.awaitTermination(300)
    return spark.read.parquet(f"{path}/out")


_X = np.random.RandomState(11).randn(3, 60).round(3)
_BITS = (_X[0] > 0).astype(int)
_PWM = pwm.PwmSettings(0.5, 1, 3, 4, 8, low_threshold=0.2, pulse_tolerance=1)


def _complex(spark):
    return stream(spark, _X[0] + 1j * _X[1]).unionByName(stream(spark, _X[1][:31] + 1j * _X[2][:31], stream_id="t"))


def _floats(spark):
    return stream(spark, _X[0]).unionByName(stream(spark, _X[2][:31], stream_id="t"))


def _bit_rows(spark):
    return stream(spark, _BITS, "bit").unionByName(stream(spark, _BITS[5:40], "bit", "t"))


TWINS = {
    "iq_balance": (_complex, lambda d: live.iq_balance(d, 0.1), lambda d: filters.iq_balance(d, alpha=0.1)),
    "vco": (_floats, lambda d: live.vco(d, 0.3), lambda d: maps.vco(d, 0.3)),
    "single_pole": (_floats, lambda d: live.single_pole_iir(d, 0.3), lambda d: filters.single_pole_iir(d, 0.3)),
    "descrambler": (_bit_rows, lambda d: live.descrambler(d, 0x21, 0x1234), lambda d: bits.descrambler(d, 0x21, 0x1234)),
    "correlate": (_bit_rows, lambda d: live.correlate_access_code(d, [1, 0, 1, 1], 1), lambda d: bits.correlate_access_code(d, [1, 0, 1, 1], 1)),
    "correlate_tag": (_bit_rows, lambda d: live.correlate_access_code_tag(d, [1, 0, 1, 1], "sync", 1), lambda d: bits.correlate_access_code_tag(d, [1, 0, 1, 1], "sync", 1).tags),
    "zero_crossing": (_floats, lambda d: live.zero_crossing(d, 2.5), lambda d: clock.zero_crossing(d, 2.5).drop("clock")),
    "stream_chunks": (_floats, lambda d: live.stream_chunks(d, 7), lambda d: bits.stream_chunks(d, 7)),
    "fft_stream": (_complex, lambda d: live.fft_stream(d, 8), lambda d: spectrum.fft_stream(d, 8).df),
}


def _plain(rows):
    def one(v):
        return [round(x, 6) for x in v] if isinstance(v, list) else round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(one(v) for _, v in sorted(r.asDict().items())) for r in rows), key=str)


@pytest.mark.parametrize("name", TWINS)
def test_live_equals_batch_after_a_restart(spark, tmp_path, name):
    source, alive, batch = TWINS[name]
    df = source(spark)
    got = _restarted(spark, df, alive, tmp_path, name)
    want = _plain(batch(df).collect())
    assert want and _plain(got.collect()) == want


def test_live_average(spark, tmp_path):
    pdus = spark.createDataFrame([("s", i, [float(i), i * i / 2, 1.0]) for i in range(24)], "stream_id string, pdu_idx long, data array<double>")
    got = _restarted(spark, pdus, lambda d: live.pdu_average(d, 4, 3), tmp_path, "average", "pdu_idx")
    assert _plain(got.collect()) == _plain(bits.pdu_average(pdus, 4).collect())


def test_idle_streams_end_and_leave_no_state(spark, tmp_path):
    """A silent stream's frames come, its state is gone; the other stream goes on."""
    on = [0] * 3 + [1] + [0] * 5 + [1] * 3 + [0] * 5
    df = stream(spark, on).unionByName(stream(spark, on, stream_id="t"))
    path = f"{tmp_path}/in"
    df.coalesce(1).write.parquet(path)
    source = spark.readStream.schema(df.schema).parquet(path)
    query = live.pwm_decoder(source, _PWM, idle_ms=1500).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(150):
            states = [p["stateOperators"][0]["numRowsTotal"] for p in map(json.loads, (x.json for x in query.recentProgress)) if p["stateOperators"]]
            if len(states) > 1 and max(states) and not states[-1] and glob.glob(f"{tmp_path}/out/*.parquet"):
                break
            time.sleep(0.2)
    finally:
        query.stop()
    assert max(states) > 0 and states[-1] == 0
    want = _plain(pwm.pwm_decoder(df, _PWM).collect())
    assert want and _plain(spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_live_zips(spark, tmp_path):
    """A fast and a slow source; what both have passed leaves the state."""
    n = 400
    a = spark.range(n).select(F.lit("s").alias("stream_id"), F.col("id").alias("pos"), F.timestamp_seconds(F.col("id") + 1000).alias("ts"), (F.col("id") * 1.5).alias("v"))
    b = a.withColumn("v", F.col("v") * 2).withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 seconds"))
    for name, df, pieces in (("a", a, 4), ("b", b, 20)):
        for k in range(pieces):
            df.filter((F.col("pos") >= n // pieces * k) & (F.col("pos") < n // pieces * (k + 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            time.sleep(0.01)
    left, right = (spark.readStream.schema(a.schema).option("maxFilesPerTrigger", k).parquet(f"{tmp_path}/{x}") for x, k in (("a", 1), ("b", 2)))
    for name, make, batch in (("add", live.add, maps.add), ("complex", live.float_to_complex, maps.float_to_complex), ("text", live.to_text, None)):
        out = make(left, right, apart="5 seconds", late="1 seconds")
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-ck").trigger(availableNow=True).start()
        query.awaitTermination(300)
        got = spark.read.parquet(f"{tmp_path}/{name}-out")
        assert got.count() == n
        if batch:
            assert _plain(got.collect()) == _plain(batch(a.drop("ts"), b.drop("ts")).collect())
        else:
            assert got.filter("pos = 3").first().line == "4.5 9.0"
        held = [p["stateOperators"][0]["numRowsTotal"] for p in map(json.loads, (x.json for x in query.recentProgress))]
        assert max(held) < 2 * n and held[-1] < 100


def test_live_filters(spark, tmp_path):
    x = np.random.RandomState(2).randn(40)
    live_df = _arrive(spark, stream(spark, x), f"{tmp_path}/in", 3, "v")
    got = _run(live.fir_filter(live_df, [0.5, 0.25, -1.0], 2), "live_fir", tmp_path)
    assert close(values(got, "v"), values(filters.fir_filter(stream(spark, x), [0.5, 0.25, -1.0], 2).df, "v"), 1e-9)


def test_live_twins_of_batch_operators(spark):
    """The machines of live operators against the batch operators."""
    x, y = np.random.RandomState(5).randn(2, 80)
    pos, one = np.arange(80), stream(spark, x)
    assert close(live.Clock(3.0, 0.5).feed(pos, x)["v"], values(clock.symbol_sync(one, 3.0, 0.5), "v"))
    assert close(live.Demod(0.5).feed(pos, x, y)["v"], values(filters.quadrature_demod(stream(spark, x + 1j * y), 0.5), "v"))
    assert close(live.Resampler(6, 4).feed(pos, x)["v"], values(position.rational_resampler(one, 6, 4), "v"))
    tagged = bits.burst_tagger(one, stream(spark, y), 0.2)
    packets = bits.stream_to_pdu(tagged, "burst", 5).orderBy("pdu_idx").collect()
    got = live.Packets(0.2, 5).feed(pos, x, y)
    assert got["start_pos"] == [r.start_pos for r in packets] and got["data"] == [r.data for r in packets]


def test_live_kiss(spark, tmp_path):
    data = b"junk\xc0one\xc0\xc0two\xc0tail"
    got = _run(live.kiss_frame(_arrive(spark, stream(spark, data, "b"), f"{tmp_path}/in", 3, "b")), "live_kiss", tmp_path)
    assert [bytes(r) for r in values(got, "data", order="pdu_idx")] == [b"one", b"two"]


def test_live_frames(spark, tmp_path):
    pdus = spark.createDataFrame([("s", i, bytes([i] * 5)) for i in range(3)], "stream_id string, pdu_idx long, data binary")
    framed = framing.hdlc_framer(framing.fcs_adder(pdus), flags=2)
    flat = bits.pdu_to_stream(framed, value="bit").df
    live_df = _arrive(spark, flat, f"{tmp_path}/in", 4, "bit")
    got = _run(live.hdlc_deframer(live_df, 3, 100), "live_hdlc", tmp_path)
    assert [bytes(r) for r in values(got, "data", order="pdu_idx")] == [bytes([i] * 5) for i in range(3)]


def test_live_machines_in_pieces():
    x, y = np.random.RandomState(3).randn(2, 60)
    marks = np.where(np.abs(x) < 0.3, 0xC0, 65)
    for make, *columns in (
        (lambda: live.SinglePole(0.3), x), (lambda: live.Bursts(0.2), x), (lambda: live.Clock(3.0, 0.5), x), (lambda: live.Demod(2.0), x, y),
        (lambda: live.IqBalance(0.2), x, y), (lambda: live.Vco(0.4), x), (lambda: live.Descrambler(0x21, 5, 16), x > 0), (lambda: live.Correlator([1, 0, 1], 1, False), x > 0),
        (lambda: live.ZeroCrossing(3.3), x), (lambda: live.Chunks(4, 3), x), (lambda: live.FftFrames(8), x, y), (lambda: live.Resampler(3, 7), x), (lambda: live.Resampler(5, 2), x), (lambda: live.Packets(-0.5, 4), x, y), (lambda: live.Kiss(), marks),
    ):
        whole, parts = make(), make()
        pos = np.arange(60)
        a = whole.feed(pos, *columns)
        b = [parts.feed(pos[i : i + 7], *(c[i : i + 7] for c in columns)) for i in range(0, 60, 7)]
        if "data" in a:
            assert all([*map(str, a[k])] == [str(v) for p in b for v in p[k]] for k in a) and a["data"]
            continue
        for key in a:
            assert np.allclose(np.asarray(a[key], float), np.concatenate([np.asarray(p[key], float) for p in b]))


def test_canary(spark, tmp_path):
    import time

    ended = []
    listener = live.canary(spark, "live_canary", lambda: ended.append(1))
    _run(_arrive(spark, stream(spark, [1.0, 2.0]), f"{tmp_path}/in", 1, "v"), "live_canary", tmp_path)
    for _ in range(50):
        if ended:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert ended == [1]


class _Every:
    """A block of a user's own: every n-th sample, and the rest at the end."""

    def __init__(self, n):
        self.n, self.left = n, []

    def feed(self, pos, v):
        self.left = [*self.left, *v.tolist()]
        hit = self.left[self.n - 1 :: self.n]
        self.left = self.left[len(hit) * self.n :]
        return {"v": hit}

    def end(self):
        return {"v": [sum(self.left)]}


def test_table_functions(spark):
    """Blocks and operators from SQL; wrong calls are told when the query is analysed."""
    from sigweave.functions import tables

    tables.register(spark)
    tables.custom(spark, "every", _Every, ("v",), "v double")
    stream(spark, range(10)).unionByName(stream(spark, range(5), stream_id="t")).repartition(3).createOrReplaceTempView("samples")
    got = spark.sql("SELECT stream_id, v FROM every(TABLE(samples), 4)").collect()
    assert sorted(map(tuple, got)) == [("s", 3.0), ("s", 7.0), ("s", 17.0), ("t", 3.0), ("t", 4.0)]
    framed = framing.hdlc_framer(framing.fcs_adder(spark.createDataFrame([("s", 0, b"abc"), ("s", 1, b"defg")], "stream_id string, pdu_idx long, data binary")), flags=2)
    bits.pdu_to_stream(framed, value="bit").df.createOrReplaceTempView("line")
    assert [bytes(r.data) for r in spark.sql("SELECT * FROM hdlc_frames(TABLE(line), 3, 100) ORDER BY pdu_idx").collect()] == [b"abc", b"defg"]
    for call in ("iir(TABLE(line), 0.5D)", "iir(1, 0.5D)"):
        with pytest.raises(Exception, match="column|table"):
            spark.sql(f"SELECT * FROM {call}")
