"""Raw files, live sinks, packet files, and operators that had no test of their own."""

import glob
import os
import socket
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from sigweave.functions import taps
from sigweave.model import Stream, tag_value
from sigweave.operators import bits, filters, maps, position
from sigweave.sources import files, sinks, synthetic
from sigweave.streaming import live

from .helpers import close, stream, values


def _raw(path, n):
    os.makedirs(path, exist_ok=True)
    np.arange(n, dtype="<f4").tofile(f"{path}/a")
    np.arange(100, 100 + n, dtype="<f4").tofile(f"{path}/b")
    return f"file://{path}"


def test_positions_are_pushed_into_the_reader(spark, tmp_path):
    path = _raw(f"{tmp_path}/in", 1000)
    df = files.read_raw(spark, path, "float")
    head = position.head(Stream(df.filter("stream_id = 'b'")), 20).df
    assert values(head, "v") == list(range(100, 120))
    plan = head._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert values(df.filter("stream_id = 'a' AND pos > 990 AND pos <= 995 AND v < 994"), "v") == [991.0, 992.0, 993.0]
    assert df.filter("pos >= 2000").count() == 0 and df.filter("stream_id IN ('a', 'c') AND pos = 7").first().v == 7.0


@pytest.mark.parametrize(
    "pushed,repeat,want",
    [
        ([LessThan(("pos",), 20)], 1, 2 * 80), ([GreaterThanOrEqual(("pos",), 900), EqualTo(("stream_id",), "a")], 1, 400), ([EqualTo(("pos",), 5)], 1, 8),
        ([GreaterThan(("pos",), 999)], 2, 8000), ([LessThanOrEqual(("pos",), 1000), In(("stream_id",), ("a", "x"))], 2, 4004), ([GreaterThan(("pos",), 5000)], 1, 0), ([LessThan(("pos",), 0)], 1, 0),
    ],
)
def test_bytes_that_pushed_positions_need(tmp_path, pushed, repeat, want):
    reader = files._RawReader({"path": _raw(f"{tmp_path}/in", 1000), "repeat": str(repeat), "splitbytes": "256"})
    other = EqualTo(("v",), 1.0)
    assert list(reader.pushFilters([*pushed, other])) == [other]
    assert sum(p.length for p in reader.partitions()) == want


def test_append_and_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/raw"
    files.write_raw(stream(spark, [1.0, 2.0]), path, "float", parts=1)
    files.write_raw(stream(spark, [3.0]), path, "float", mode="append", parts=1)
    assert sorted(values(files.read_raw(spark, path, "float"), "v", order="v")) == [1, 2, 3]
    files.write_raw(stream(spark, [4.0]), path, "float", mode="overwrite", parts=1)
    assert values(files.read_raw(spark, path, "float"), "v") == [4]


def test_failed_tasks_leave_no_parts(spark, tmp_path):
    path = f"file://{tmp_path}/raw"
    broken = stream(spark, [1.0] * 200).withColumn("v", F.when(F.col("pos") == 150, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("double"))
    with pytest.raises(Exception, match="no"):
        files.register(spark)
        broken.repartition(4).write.format("raw_samples").option("path", path).mode("append").save()
    time.sleep(1)
    assert not glob.glob(f"{tmp_path}/raw/*")


def test_live_raw_sink_counts_each_batch_once(spark, tmp_path, monkeypatch):
    source = f"{tmp_path}/in"
    for k in range(3):
        stream(spark, np.arange(10) + 10 * k).withColumn("pos", F.col("pos") + 10 * k).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.01)
    live_df = spark.readStream.schema("stream_id string, pos long, v double").option("maxFilesPerTrigger", 1).parquet(source)
    path = f"file://{tmp_path}/raw"
    for again in (False, True):
        if again:  # as if Spark had died between the sink's commit and its own
            os.remove(f"{tmp_path}/ck/commits/2")
            os.path.exists(f"{tmp_path}/ck/commits/.2.crc") and os.remove(f"{tmp_path}/ck/commits/.2.crc")
        files.write_raw_stream(live_df, path, "float", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(300)
        got = files.read_raw(spark, path, "float")
        assert sorted(values(got, "v", order="v")) == list(range(30))
    with open(f"{tmp_path}/raw/epoch-orphan", "wb") as f:  # written, never published
        f.write(np.zeros(5, "<f4").tobytes())
    assert files.read_raw(spark, path, "float").count() == 30


def test_packet_files(spark, tmp_path):
    path = f"file://{tmp_path}/pdus"
    rows = [("a/b", 0, b"one"), ("a_b", 0, b"two"), ("a%2Fb", 0, b"three"), ("ä ~", 1, b"")]
    pdus = spark.createDataFrame(rows, "stream_id string, pdu_idx long, data binary")
    for _ in range(2):  # again writes the same
        assert sorted(r.size for r in sinks.pdu_writer(pdus, path).collect()) == [0, 3, 3, 5]
    found = {sinks.packet_name(s, i): d for s, i, d in rows}
    assert len(found) == 4 and sorted(os.listdir(f"{tmp_path}/pdus")) == sorted(found)
    assert all(open(f"{tmp_path}/pdus/{n}", "rb").read() == d for n, d in found.items())
    with pytest.raises(Exception, match="another packet"):
        sinks.pdu_writer(spark.createDataFrame([("a_b", 0, b"new")], pdus.schema), path).collect()


def test_live_packet_and_text_sinks(spark, tmp_path):
    pdus = spark.createDataFrame([("s", i, bytes([65 + i]) * 3, f"m{i}") for i in range(6)], "stream_id string, pdu_idx long, data binary, msg string")
    pdus.repartition(3).write.parquet(f"{tmp_path}/in")
    live_df = spark.readStream.schema(pdus.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sinks.pdu_writer_live(live_df, f"file://{tmp_path}/pdus", f"{tmp_path}/ck1").trigger(availableNow=True).start().awaitTermination(300)
    assert sorted(open(f, "rb").read() for f in glob.glob(f"{tmp_path}/pdus/s-*")) == [bytes([65 + i]) * 3 for i in range(6)]
    sinks.no_copy_file_sink_live(live_df, f"{tmp_path}/text", f"{tmp_path}/ck2").trigger(availableNow=True).start().awaitTermination(300)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/text").collect()) == [f"m{i}" for i in range(6)]


def test_plain_sinks(spark, tmp_path, capsys):
    one = stream(spark, [1.0, 2.0])
    sinks.null_sink(one)
    sinks.debug_sink(Stream(one))
    assert "debug: 1.0" in capsys.readouterr().out
    pdus = spark.createDataFrame([("s", i, f"line {i}") for i in range(30)], "stream_id string, pdu_idx long, msg string")
    sinks.no_copy_file_sink(pdus.repartition(5), f"{tmp_path}/text")
    lines = [line.rstrip("\n") for f in sorted(glob.glob(f"{tmp_path}/text/part-*")) for line in open(f)]
    assert lines == [f"line {i}" for i in range(30)]


def test_sources_of_signals(spark):
    got = values(synthetic.signal_source_float(spark, 8, 8.0, 1.0, 2.0), "v")
    assert close(got, [2 * np.sin(2 * np.pi * (i + 1) / 8) for i in range(8)], 1e-6)
    rows = live.strobe(spark, "hello", 5).writeStream.format("memory").queryName("strobes").start()
    for _ in range(100):
        if spark.table("strobes").count() >= 3:
            break
        time.sleep(0.2)
    rows.stop()
    got = spark.table("strobes").orderBy("pdu_idx").collect()
    assert [r.pdu_idx for r in got] == list(range(len(got))) and {r.msg for r in got} == {"hello"} and len(got) >= 3


def test_maps_that_rewrite_tags_and_captures(spark):
    kinds = "stream_id string, pos long, key string, f double"
    tags = spark.createDataFrame([("s", 0, "frequency", 1e6), ("s", 5, "frequency", 1e6), ("s", 9, "frequency", 2e6), ("s", 9, "gain", 3.0)], kinds)
    tags = tags.select("stream_id", "pos", "key", tag_value("f", F.col("f")).alias("val"))
    got = files.tags_to_captures(tags).orderBy("sample_start").collect()
    assert [(r.sample_start, r.frequency) for r in got] == [(0, 1e6), (9, 2e6)]
    out = maps.map_with_tags(Stream(stream(spark, [1.0, 2.0]), tags), {"v": F.col("v") * 10}, lambda t: t.filter("key = 'gain'"))
    assert values(out.df, "v") == [10.0, 20.0] and [r.key for r in out.tags.collect()] == ["gain"]


def test_complex_taps(spark):
    real, own = taps.low_pass(1000.0, 100.0, 60.0), taps.low_pass_complex(1000.0, 100.0, 60.0)
    assert np.iscomplexobj(own) and close(own, np.asarray(real, complex), 1e-12)
    x = np.random.RandomState(0).randn(200)
    assert close(values(filters.fir_filter(stream(spark, x), own).df, "re"), values(filters.fir_filter(stream(spark, x), real).df, "v"), 1e-9)


@pytest.mark.parametrize("size", [1, 24, 63, 64, 65, 100])
def test_long_access_codes(spark, size):
    rnd = np.random.RandomState(size)
    x, code = rnd.randint(0, 2, 300), rnd.randint(0, 2, size)
    x[150 : 150 + size] = code
    x[151] ^= size > 2
    want = [int(i >= size - 1 and (x[i - size + 1 : i + 1] != code).sum() <= 1) for i in range(300)]
    assert values(bits.correlate_access_code(stream(spark, x, "bit"), code.tolist(), 1), "bit") == want and sum(want)
    plan = bits.correlate_access_code(stream(spark, x, "bit"), code.tolist(), 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(") <= 12


def test_tcp_source(spark, tmp_path):
    """Samples of a server that this test runs."""
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(np.arange(50, dtype="<f4").tobytes())
        time.sleep(20)
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    files.register(spark)
    rows = spark.readStream.format("tcp_samples").option("host", "127.0.0.1").option("port", server.getsockname()[1]).option("stream_id", "t").load()
    query = rows.writeStream.format("memory").queryName("tcp").option("checkpointLocation", f"{tmp_path}/ck").start()
    for _ in range(150):
        if spark.table("tcp").count() >= 50:
            break
        time.sleep(0.1)
    query.stop()
    server.close()
    assert values(spark.table("tcp"), "v") == list(range(50))
