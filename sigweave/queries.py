"""Registered queries of the stream operators over the given tables, with DuckDB twins.

Views: ``ev`` is events by user (pos in order of time, v the value), ``long`` all events as
one stream (pos the event_id), ``iq`` complex samples of ev (the value and the one before,
both less 50), ``bits`` whether the value is above 50, ``octets`` the bytes of customer names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import tables, taps
from .functions.parsing import frequency
from .model import Stream, by_chunks, carried, dealt, shared_root, stored, zip_streams
from .operators import bits, clock, filters, framing, maps, position, pwm, spectrum
from .sources import codecs, datastream, sinks, synthetic

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS v FROM events)"
LONG = "long AS (SELECT 'events' AS stream_id, event_id AS pos, value AS v FROM events)"
BITS = EV + ", bits AS (SELECT stream_id, pos, (v > 50)::INT AS bit FROM ev)"
IQ = EV + ", iq AS (SELECT stream_id, pos, v - 50 AS re, coalesce(lag(v) OVER (PARTITION BY stream_id ORDER BY pos) - 50, 0) AS im FROM ev)"
OCTETS = """octets AS (SELECT c_custkey AS stream_id, i - 1 AS pos, ord(substr(c_name, i, 1)) AS b
  FROM (SELECT c_custkey, c_name, unnest(range(1, length(c_name) + 1)) AS i FROM customer))"""


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").select(F.col("user_id").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("value").alias("v"))


def long(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.lit("events").alias("stream_id"), F.col("event_id").alias("pos"), F.col("value").alias("v"))


def bit_view(spark: SparkSession, d: str) -> DataFrame:
    return maps.map_values(ev(spark, d), bit=(F.col("v") > 50).cast("tinyint"))


def iq(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("stream_id").orderBy("pos")
    return ev(spark, d).select("stream_id", "pos", (F.col("v") - 50).alias("re"), F.coalesce(F.lag("v").over(w) - 50, F.lit(0.0)).alias("im"))


def octets(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("stream_id"), F.posexplode(F.split("c_name", "")).alias("pos", "c"))
    return rows.filter(F.col("c") != "").select("stream_id", F.col("pos").cast("long").alias("pos"), F.ascii("c").cast("smallint").alias("b"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """Packets of customer names by nation."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("pdu_idx"), F.col("c_name").cast("binary").alias("data"))


NAMES = "names AS (SELECT c_nationkey AS stream_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pdu_idx, c_name AS data FROM customer)"


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def one(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return (F.round(F.col(c).cast("double"), digits) + 0.0).alias(c)
        if kinds[c] in ("array<double>", "array<float>"):
            return F.array_join(F.transform(c, lambda x: F.format_number(F.round(x.cast("double"), digits) + 0.0, digits)), ";").alias(c)
        if kinds[c].startswith("array"):
            return F.array_join(F.transform(c, lambda x: x.cast("string")), "").alias(c)
        return F.hex(c).alias(c) if kinds[c] == "binary" else F.col(c)

    return df.select(*(one(c) for c in df.columns))


def query(sql: str | None = None):
    def register(f):
        name = f.__name__
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _rounded_like_sql(c: str, digits: int = 5) -> Column:
    """Round by multiplying and dividing, as DuckDB does; ``rounded`` rounds the shortest decimal text, which differs for huge values."""
    x, scale = F.col(c), F.lit(10.0**digits)
    up = F.abs(x) * scale
    whole = F.floor(up).cast("double")
    near = F.when(up < 2.0**52, F.signum(x) * (whole + F.when(up - whole >= 0.5, 1.0).otherwise(0.0))).otherwise(x * scale) / scale
    return F.when(F.abs(near) < math.inf, near).otherwise(x).alias(c)


def _r(x: str) -> str:
    return f"round({x}, 5) + 0.0"


# Maps and zips.


@query(f"WITH {EV} SELECT stream_id, pos, {_r('v * 2 + 1')} AS v FROM ev")
def map_scale_offset(spark, d):
    return maps.add_const(maps.multiply_const(ev(spark, d), 2.0), 1.0)


@query(f"WITH {EV} SELECT a.stream_id, a.pos, {_r('a.v + b.v')} AS v FROM ev a JOIN ev b ON a.stream_id = b.stream_id - 1 AND a.pos = b.pos")
def zip_add(spark, d):
    return maps.add(ev(spark, d), ev(spark, d).withColumn("stream_id", F.col("stream_id") - 1))


@query(f"WITH {EV} SELECT a.stream_id, a.pos, {_r('a.v + 1.1')} AS re, {_r('b.v + 2')} AS im FROM ev a JOIN ev b ON a.stream_id = b.stream_id - 1 AND a.pos = b.pos")
def zip_complex(spark, d):
    both = maps.float_to_complex(ev(spark, d), ev(spark, d).withColumn("stream_id", F.col("stream_id") - 1))
    return maps.add_const(both, 1.1 + 2j)


@query(f"WITH {BITS} SELECT a.stream_id, a.pos, xor(a.bit, b.bit) AS bit FROM bits a JOIN bits b ON a.stream_id = b.stream_id - 1 AND a.pos = b.pos")
def xor_streams(spark, d):
    out = maps.xor(bit_view(spark, d), bit_view(spark, d).withColumn("stream_id", F.col("stream_id") - 1))
    return out.withColumn("bit", F.col("bit").cast("int"))


@query(f"WITH {BITS} SELECT stream_id, pos, xor(bit, 1) AS bit FROM bits")
def xor_const(spark, d):
    return maps.xor_const(bit_view(spark, d), 1).withColumn("bit", F.col("bit").cast("int"))


@query(f"WITH {IQ} SELECT stream_id, pos, {_r('re')} AS v, 'im' AS part FROM (SELECT stream_id, pos, im AS re FROM iq) UNION ALL SELECT stream_id, pos, {_r('re')}, 're' FROM iq")
def complex_split(spark, d):
    re, im = maps.complex_to_float(iq(spark, d))
    return re.withColumn("part", F.lit("re")).unionByName(im.withColumn("part", F.lit("im")))


@query(f"WITH {IQ} SELECT stream_id, pos, {_r('re * re + im * im')} AS v FROM iq")
def complex_mag2(spark, d):
    return maps.complex_to_mag2(iq(spark, d))


@query(f"WITH {EV} SELECT stream_id, pos, (v - 50 > 0)::INT AS bit FROM ev")
def slicer(spark, d):
    return maps.binary_slicer(maps.add_const(ev(spark, d), -50.0)).withColumn("bit", F.col("bit").cast("int"))


@query(f"WITH {EV} SELECT stream_id, pos, v, 1 AS tap FROM ev UNION ALL SELECT stream_id, pos, v * 2, 2 FROM ev")
def tee_union(spark, d):
    a, b = maps.tee(Stream(ev(spark, d)))
    return a.df.withColumn("tap", F.lit(1)).unionByName(maps.multiply_const(b.df, 2.0).withColumn("tap", F.lit(2)))


@query(f"WITH {EV} SELECT stream_id, pos, v FROM ev WHERE NOT isnan(v)")
def inspect_observed(spark, d):
    return maps.inspect(ev(spark, d), "samples", F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


@query(f"""WITH {EV} SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY pos, k) - 1 AS pdu_idx, {_r('v + k')} AS data
FROM (SELECT stream_id, pos, v, unnest(range(0, CASE WHEN v > 80 THEN 2 WHEN v > 20 THEN 1 ELSE 0 END)) AS k FROM ev)""")
def flat_map(spark, d):
    pdus = ev(spark, d).withColumnsRenamed({"pos": "pdu_idx", "v": "data"})
    x = F.col("data")
    return maps.flat_map(pdus, "data", F.when(x > 80, F.array(x, x + 1)).when(x > 20, F.array(x)).otherwise(F.array().cast("array<double>")))


@query(f"WITH {EV} SELECT stream_id, pos, {_r('v * 2 + 1')} AS v FROM ev")
def map_by_function(spark, d):
    return maps.map_function(ev(spark, d), lambda x: x * 2 + 1)


@query(f"""WITH {EV} SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY pos, k) - 1 AS pdu_idx, {_r('v + k')} AS data
FROM (SELECT stream_id, pos, v, unnest(range(0, CASE WHEN v > 80 THEN 2 WHEN v > 20 THEN 1 ELSE 0 END)) AS k FROM ev)""")
def flat_map_by_function(spark, d):
    pdus = ev(spark, d).withColumnsRenamed({"pos": "pdu_idx", "v": "data"})
    return maps.flat_map_function(pdus, lambda x: [x, x + 1] if x > 80 else [x] if x > 20 else [], kind="double")


@query(f"WITH {EV}, p AS (SELECT stream_id, pos, sum(0.01 * v) OVER (PARTITION BY stream_id ORDER BY pos) AS f FROM ev) SELECT stream_id, pos, {_r('sin(f)')} AS re, {_r('cos(f)')} AS im FROM p")
def vco(spark, d):
    return maps.vco(ev(spark, d), 0.01)


@query(f"WITH {LONG}, p AS (SELECT stream_id, pos, sum(0.001 * v) OVER (ORDER BY pos) AS f FROM long) SELECT stream_id, pos, {_r('sin(f)')} AS re, {_r('cos(f)')} AS im FROM p")
def vco_long(spark, d):
    return maps.vco(long(spark, d), 0.001)


_MORSE = "MAP {" + ", ".join(f"'{c}': '{m.replace('-', '1110').replace('.', '10')}'" for c, m in maps.MORSE.items()) + "}"


@query(f"""WITH m AS (SELECT p_partkey AS pdu_idx, list_filter(string_split(regexp_replace(upper(p_name), '[^A-Z0-9 ]', '', 'g'), ''), lambda c: c <> '') AS cs FROM part),
t AS (SELECT pdu_idx, array_to_string(list_transform(cs, lambda c: CASE WHEN c = ' ' THEN 'S' ELSE element_at({_MORSE}, c)[1] || 'C' END), '') || 'E' AS s FROM m)
SELECT 'parts' AS stream_id, pdu_idx,
  regexp_replace(replace(replace(replace(s, 'CS', 'S'), 'CE', 'E'), 'C', '00'), '[SE]', '000000', 'g') AS data FROM t""")
def morse(spark, d):
    parts = _t(spark, d, "part").select(F.lit("parts").alias("stream_id"), F.col("p_partkey").alias("pdu_idx"), F.col("p_name").alias("msg"))
    return maps.morse_encode(parts).select("stream_id", "pdu_idx", "data")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN floor(o_totalprice) * 1000 WHEN 1 THEN floor(o_totalprice) ELSE floor(o_totalprice) * 1000000 END AS hz FROM orders""")
def parse_frequency(spark, d):
    text = F.concat(F.floor("o_totalprice").cast("bigint").cast("string"), F.element_at(F.array(F.lit("k"), F.lit(""), F.lit("_M")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return _t(spark, d, "orders").select("o_orderkey", frequency(text).alias("hz"))


# Positions.


@query(f"WITH {EV} SELECT * FROM ev WHERE pos < 20")
def head(spark, d):
    return position.head(Stream(ev(spark, d)), 20).df


@query(f"WITH {EV} SELECT stream_id, pos - 20 AS pos, v FROM ev WHERE pos >= 20")
def skip(spark, d):
    return position.skip(Stream(ev(spark, d)), 20).df


@query(f"WITH {EV} SELECT stream_id, pos + 3 AS pos, v FROM ev UNION ALL SELECT DISTINCT stream_id, p, 0.0 FROM ev, (SELECT unnest(range(0, 3)) AS p)")
def delay(spark, d):
    return position.delay(Stream(ev(spark, d)), 3).df


@query(f"WITH {EV}, n AS (SELECT stream_id, max(pos) + 1 AS n FROM ev GROUP BY 1) SELECT ev.stream_id, pos + r * n AS pos, v FROM ev JOIN n USING (stream_id), (SELECT unnest(range(0, 3)) AS r)")
def repeat(spark, d):
    return position.repeat(Stream(ev(spark, d)), 3).df


def _resample_sql(view: str, i: int, k: int) -> str:
    return f"""WITH {view}, j AS (SELECT stream_id, unnest(range(0, ((max(pos) + 1) * {i} + {k} - 1) // {k})) AS j FROM {view.split()[0]} GROUP BY 1)
SELECT j.stream_id, j AS pos, v FROM j JOIN {view.split()[0]} e ON e.stream_id = j.stream_id AND e.pos = j * {k} // {i}"""


@query(_resample_sql(EV, 25, 64))
def resample_25_64(spark, d):
    return position.rational_resampler(ev(spark, d), 25, 64)


@query(_resample_sql(LONG, 3, 2))
def resample_3_2(spark, d):
    return position.rational_resampler(long(spark, d), 6, 4)


# Filters.


def _iir_sql(view: str, name: str, x: str, a: float) -> str:
    return f"""WITH RECURSIVE {view}, y AS (SELECT stream_id, pos, {a} * {x} AS y FROM {name} WHERE pos = 0
UNION ALL SELECT e.stream_id, e.pos, {a} * e.{x} + {1 - a} * y.y FROM y JOIN {name} e ON e.stream_id = y.stream_id AND e.pos = y.pos + 1)"""


@query(_iir_sql(EV, "ev", "v", 0.2) + f" SELECT stream_id, pos, {_r('y')} AS v FROM y")
def iir_single_pole(spark, d):
    return filters.single_pole_iir(ev(spark, d), 0.2)


@query(f"""WITH {LONG}, y AS (SELECT a.stream_id, a.pos, sum(0.3 * b.v * pow(0.7, a.pos - b.pos)) AS y FROM long a JOIN long b ON b.pos BETWEEN a.pos - 80 AND a.pos GROUP BY 1, 2)
SELECT stream_id, pos, {_r('y')} AS v FROM y""")
def iir_long_scan(spark, d):
    return filters.single_pole_iir(long(spark, d), 0.3)


@query(f"""WITH {LONG}, y AS (SELECT stream_id, pos, v, pow(0.9999::DOUBLE, pos) AS d FROM long)
SELECT stream_id, pos, {_r('0.0001 * d * sum(v / d) OVER (ORDER BY pos)')} AS v FROM y""")
def iir_slow_scan(spark, d):
    """A pole near 1, whose carries reach far back."""
    return filters.single_pole_iir(long(spark, d), 0.0001)


@query(f"""WITH RECURSIVE {IQ}, y AS (SELECT stream_id, pos, 0.1 * re AS mr, 0.1 * im AS mi FROM iq WHERE pos = 0
UNION ALL SELECT e.stream_id, e.pos, 0.1 * e.re + 0.9 * y.mr, 0.1 * e.im + 0.9 * y.mi FROM y JOIN iq e ON e.stream_id = y.stream_id AND e.pos = y.pos + 1)
SELECT iq.stream_id, iq.pos, {_r('re - mr')} AS re, {_r('im - mi')} AS im FROM iq JOIN y USING (stream_id, pos)""")
def iq_balance(spark, d):
    return filters.iq_balance(iq(spark, d), alpha=0.1)


SHORT = [0.5, -0.25, 0.125, 0.3, 0.1]


def _fir_sql(view: str, name: str, h, offset: int, count: str, deci: int = 1) -> str:
    """y[j] = sum h[t] x[j * deci + offset - t] for j below count (an expression of n)."""
    rows = ", ".join(f"({t}, {c!r})" for t, c in enumerate(map(float, h)))
    return f"""WITH {view}, h(t, c) AS (VALUES {rows}), n AS (SELECT stream_id, max(pos) + 1 AS n FROM {name} GROUP BY 1),
j AS (SELECT stream_id, unnest(range(0, ({count})::BIGINT)) AS j FROM n),
y AS (SELECT j.stream_id, j.j, sum(h.c * coalesce(e.v, 0)) AS y FROM j CROSS JOIN h LEFT JOIN {name} e ON e.stream_id = j.stream_id AND e.pos = j.j * {deci} + {offset} - h.t GROUP BY 1, 2)
SELECT stream_id, j AS pos, {_r('y')} AS v FROM y"""


@query(_fir_sql(EV, "ev", SHORT, 4, "greatest(n - 4, 0)"))
def fir_short(spark, d):
    return filters.fir_filter(ev(spark, d), SHORT).df


@query(_fir_sql(EV, "ev", SHORT, 4, "CASE WHEN n >= 7 THEN (n - 4) // 3 ELSE 0 END", 3))
def fir_decimate(spark, d):
    return filters.fir_filter(ev(spark, d), SHORT, decimation=3).df


LOW = taps.low_pass(1000.0, 100.0, 60.0)


@query(_fir_sql(LONG, "long", LOW, len(LOW) - 1, f"n - {len(LOW) - 1}"))
def fir_low_pass(spark, d):
    return filters.fir_filter(long(spark, d), LOW).df


_BLOCK = 2 * (1 << (len(LOW) - 1).bit_length()) - len(LOW)


@query(_fir_sql(LONG, "long", LOW, 0, f"n // {_BLOCK} * {_BLOCK}"))
def fft_filter(spark, d):
    return filters.fft_filter(long(spark, d), LOW).df


_HILBERT = taps.hilbert_taps(taps.HAMMING.make_window(17))


@query(_fir_sql(EV, "ev", _HILBERT, -1, "n").replace("SELECT stream_id, j AS pos", "SELECT y.stream_id, j AS pos, round(coalesce(e.v, 0), 5) + 0.0 AS re").replace("AS v FROM y", "AS im FROM y LEFT JOIN ev e ON e.stream_id = y.stream_id AND e.pos = j - 9"))
def hilbert(spark, d):
    return filters.hilbert(ev(spark, d), 17, taps.HAMMING).df


_MIX = 2 * math.pi * 2 / 8


@query(f"""WITH {IQ}, m AS (SELECT stream_id, pos, re * cos({_MIX} * pos) + im * sin({_MIX} * pos) AS re, im * cos({_MIX} * pos) - re * sin({_MIX} * pos) AS im FROM iq),
h(t, c) AS (VALUES {', '.join(f'({t}, {c})' for t, c in enumerate(SHORT))}), n AS (SELECT stream_id, max(pos) + 1 AS n FROM iq GROUP BY 1),
j AS (SELECT stream_id, unnest(range(0, CASE WHEN n >= 6 THEN (n - 4) // 2 ELSE 0 END)) AS j FROM n)
SELECT j.stream_id, j AS pos, {_r('sum(c * re)')} AS re, {_r('sum(c * im)')} AS im FROM j CROSS JOIN h JOIN m ON m.stream_id = j.stream_id AND m.pos = j * 2 + 4 - t GROUP BY 1, 2""")
def fir_translate(spark, d):
    return filters.fir_filter(iq(spark, d), SHORT, decimation=2, samp_rate=8.0, translate=2.0).df


@query(f"""WITH {IQ}, z AS (SELECT stream_id, pos, re, im, lead(re) OVER w AS nr, lead(im) OVER w AS ni FROM iq WINDOW w AS (PARTITION BY stream_id ORDER BY pos))
SELECT stream_id, pos, {_r('0.5 * atan2(re * ni - im * nr, re * nr + im * ni)')} AS v FROM z WHERE nr IS NOT NULL""")
def quadrature_demod(spark, d):
    return filters.quadrature_demod(iq(spark, d), 0.5)


@query(f"""WITH {IQ}, z AS (SELECT *, lag(re, 1, 0) OVER w AS r1, lag(im, 1, 0) OVER w AS i1, lag(re, 2, 0) OVER w AS r2, lag(im, 2, 0) OVER w AS i2 FROM iq WINDOW w AS (PARTITION BY stream_id ORDER BY pos))
SELECT stream_id, pos, {_r('(im - i2) * r1 - (re - r2) * i1')} AS v FROM z""")
def fast_fm(spark, d):
    return filters.fast_fm(iq(spark, d))


@query(f"WITH {LONG} SELECT stream_id, pos, {_r('v * sin((pos + 1) * 2 * pi() * 50 / 1000)')} AS re, {_r('v * sin((pos + 1) * 2 * pi() * 50 / 1000 - pi() / 2)')} AS im FROM long")
def mix_signal_source(spark, d):
    data = long(spark, d)
    n = data.count()
    tone = synthetic.signal_source_complex(spark, n, 1000.0, 50.0, stream_id="events")
    both = zip_streams(data, tone)
    return both.select("stream_id", "pos", (F.col("v") * F.col("re")).alias("re"), (F.col("v") * F.col("im")).alias("im"))


@query(f"WITH {LONG} SELECT stream_id, pos, {_r('v * 2.5')} AS v FROM long")
def scale_constant_source(spark, d):
    data = long(spark, d)
    both = zip_streams(data, synthetic.constant_source(spark, data.count(), 2.5, "events"))
    return both.select("stream_id", "pos", (F.col("v") * F.col("v_2")).alias("v"))


@query(f"""WITH RECURSIVE {EV}, y AS (SELECT stream_id, pos, greatest(least(v, 200), -200) AS y, 0.0::DOUBLE AS y1 FROM ev WHERE pos = 0
UNION ALL SELECT e.stream_id, e.pos, greatest(least(e.v + 0.9 * y.y - 0.2 * y.y1, 200), -200), y.y FROM y JOIN ev e ON e.stream_id = y.stream_id AND e.pos = y.pos + 1)
SELECT stream_id, pos, {_r('y')} AS v FROM y""")
def iir_clamped(spark, d):
    return filters.iir_filter(ev(spark, d), [1.0, 0.9, -0.2], -200.0, 200.0)


@query(f"""WITH RECURSIVE {EV}, y AS (SELECT stream_id, pos, greatest(least(0.47123889803 * v, 60), 5) AS y FROM ev WHERE pos = 0
UNION ALL SELECT e.stream_id, e.pos, greatest(least(0.47123889803 * e.v - 0.78539816339 * y.y, 60), 5) FROM y JOIN ev e ON e.stream_id = y.stream_id AND e.pos = y.pos + 1)
SELECT stream_id, pos, {_r('y')} AS v FROM y""")
def iir_clamped_pole(spark, d):
    """One feedback tap, clamped: a scan over clamped maps."""
    return filters.iir_filter(ev(spark, d), [0.47123889803, -0.78539816339], 5.0, 60.0)


@query(f"""WITH RECURSIVE {EV}, y AS (SELECT stream_id, pos, 0.31831 * v AS y, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2 FROM ev WHERE pos = 0
UNION ALL SELECT e.stream_id, e.pos, 0.31831 * e.v + 0.47113 * y.y - 0.27183 * y.y1 + 0.19737 * y.y2, y.y, y.y1 FROM y JOIN ev e ON e.stream_id = y.stream_id AND e.pos = y.pos + 1)
SELECT stream_id, pos, {_r('y')} AS v FROM y""")
def iir_order3(spark, d):
    """Three feedback taps: a scan with the companion matrix."""
    return filters.iir_filter(ev(spark, d), [0.31831, 0.47113, -0.27183, 0.19737])


def _cma_sql(n: int, modulus: float, step: float) -> str:
    """The equaliser's recursion, taps as columns a (real) and b (imaginary), samples of the window as x and z."""
    k = range(n)
    re = " + ".join(f"a{i} * x{i} - b{i} * z{i}" for i in k)
    im = " + ".join(f"a{i} * z{i} + b{i} * x{i}" for i in k)
    window = ", ".join(f"lead(re, {i}) OVER w AS x{i}, lead(im, {i}) OVER w AS z{i}" for i in k)
    columns = ", ".join(f"x{i}, z{i}" for i in k)
    first = ", ".join(f"{float(i == 0)}::DOUBLE AS a{i}, 0.0::DOUBLE AS b{i}" for i in k)
    gain = f"{step} * ({modulus} - (o.re * o.re + o.im * o.im))"
    taps_ = ", ".join(f"o.a{i} + {gain} * (o.re * o.x{i} + o.im * o.z{i}) AS a{i}, o.b{i} + {gain} * (o.im * o.x{i} - o.re * o.z{i}) AS b{i}" for i in k)
    return f"""WITH RECURSIVE {IQ}, s AS (SELECT stream_id, pos, re * 0.02 AS re, im * 0.02 AS im FROM iq),
w AS (SELECT stream_id, pos, {window} FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
o AS (SELECT stream_id, pos, {columns}, x0 AS re, z0 AS im, {first} FROM w WHERE pos = 0 AND x{n - 1} IS NOT NULL
UNION ALL SELECT stream_id, pos, {columns}, {re} AS re, {im} AS im, {", ".join(f"a{i}, b{i}" for i in k)}
FROM (SELECT w.stream_id, w.pos, {", ".join(f"w.x{i}, w.z{i}" for i in k)}, {taps_} FROM o JOIN w ON w.stream_id = o.stream_id AND w.pos = o.pos + 1 WHERE w.x{n - 1} IS NOT NULL))
SELECT stream_id, pos, {_r("re")} AS re, {_r("im")} AS im FROM o"""


@query(_cma_sql(5, 1.0, 0.001))  # with steps of 0.01 the taps run off to infinity
def cma_equalizer(spark, d):
    out = filters.cma_equalizer(maps.multiply_const(iq(spark, d), 0.02), 5, 1.0, 0.001)
    return out.select("stream_id", "pos", _rounded_like_sql("re"), _rounded_like_sql("im"))


# Spectra.


def embedding_pdus(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.lit("embeddings").alias("stream_id"), F.col("vec_id").alias("pdu_idx"), F.transform("embedding", lambda x: x.cast("double")).alias("data"))


_DFT = """e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS t, unnest(embedding)::DOUBLE AS x FROM embeddings),
f AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * t / 64)) AS re, -sum(x * sin(2 * pi() * k * t / 64)) AS im FROM e, (SELECT unnest(range(0, 64)) AS k) GROUP BY 1, 2)"""


def _embedding_fft(spark, d) -> DataFrame:
    pdus = embedding_pdus(spark, d)
    zeros = F.transform("data", lambda x: F.lit(0.0))
    return spectrum.fft(pdus.select("stream_id", "pdu_idx", F.col("data").alias("re"), zeros.alias("im")), 64)


@query(f"WITH {_DFT} SELECT vec_id AS pdu_idx, k, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM f")
def fft_pdu(spark, d):
    rows = _embedding_fft(spark, d).select("pdu_idx", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return rows.select("pdu_idx", F.col("k").cast("long").alias("k"), (F.round("z.re", 3) + 0.0).alias("re"), (F.round("z.im", 3) + 0.0).alias("im"))


@query(f"WITH {_DFT} SELECT vec_id AS pdu_idx, count(*) FILTER (re * re + im * im > 1) AS loud, round(max(10 * log10(re * re + im * im)), 2) AS peak_db FROM f GROUP BY 1")
def fft_power_db(spark, d):
    db = spectrum.power_db(_embedding_fft(spark, d))
    return db.select("pdu_idx", F.size(F.filter("data", lambda x: x > 0)).cast("long").alias("loud"), F.round(F.array_max("data"), 2).alias("peak_db"))


@query(f"""WITH {IQ}, n AS (SELECT stream_id, (max(pos) + 1) // 8 AS frames FROM iq GROUP BY 1),
x AS (SELECT iq.stream_id, pos // 8 AS f, pos % 8 AS t, re, im FROM iq JOIN n USING (stream_id) WHERE pos < frames * 8)
SELECT stream_id, f * 8 + k AS pos, round(sum(re * cos(2 * pi() * k * t / 8) + im * sin(2 * pi() * k * t / 8)), 3) + 0.0 AS re,
  round(sum(im * cos(2 * pi() * k * t / 8) - re * sin(2 * pi() * k * t / 8)), 3) + 0.0 AS im FROM x, (SELECT unnest(range(0, 8)) AS k) GROUP BY stream_id, f, k""")
def fft_stream(spark, d):
    out = spectrum.fft_stream(iq(spark, d), 8).df
    return out.select("stream_id", "pos", (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


@query(f"WITH {IQ}, n AS (SELECT stream_id, unnest(range(0, (max(pos) + 1) // 8)) AS f FROM iq GROUP BY 1) SELECT stream_id, f * 8 AS pos, 'FftStream::size' AS key, '8' AS val FROM n UNION ALL SELECT stream_id, f * 8, 'FftStream::frame', 'true' FROM n UNION ALL SELECT stream_id, f * 8 + 7, 'FftStream::frame', 'false' FROM n")
def fft_stream_tags(spark, d):
    tags = spectrum.fft_stream(iq(spark, d), 8).tags
    return tags.select("stream_id", "pos", "key", sinks.value_text(F.col("val")).alias("val"))


@query("SELECT c_custkey AS stream_id, 0 AS pdu_idx, upper(sha256(c_name)) AS data FROM customer")
def sha256_stream(spark, d):
    return spectrum.hasher(octets(spark, d), "sha256").withColumn("pdu_idx", F.col("pdu_idx").cast("int"))


@query()
def sha512_stream(spark, d):
    return spectrum.hasher(octets(spark, d))


# Bits.


def _int_bit(df: DataFrame) -> DataFrame:
    return df.withColumn("bit", F.col("bit").cast("int"))


@query(f"WITH {BITS} SELECT stream_id, pos, xor(1, xor(bit, lag(bit, 1, 0) OVER (PARTITION BY stream_id ORDER BY pos))) AS bit FROM bits")
def nrzi_decode(spark, d):
    return _int_bit(bits.nrzi_decode(bit_view(spark, d)))


@query(f"WITH {BITS} SELECT stream_id, pos, (sum(1 - bit) OVER (PARTITION BY stream_id ORDER BY pos) % 2)::INT AS bit FROM bits")
def nrzi_encode(spark, d):
    return _int_bit(bits.nrzi_encode(bit_view(spark, d)))


@query(f"WITH {BITS} SELECT stream_id, pos, xor(bit, xor(lag(bit, 12, 0) OVER w, lag(bit, 17, 0) OVER w)) AS bit FROM bits WINDOW w AS (PARTITION BY stream_id ORDER BY pos)")
def descramble_g3ruh(spark, d):
    return _int_bit(bits.descrambler(bit_view(spark, d)))


@query(f"WITH {BITS} SELECT stream_id, pos, lag(bit, 17, 0) OVER (PARTITION BY stream_id ORDER BY pos) AS bit FROM bits")
def scramble_roundtrip(spark, d):
    return _int_bit(bits.descrambler(bits.scrambler_g3ruh(bit_view(spark, d))))


_CODE = [1, 0, 1, 1, 0]
_DIST = " + ".join(f"(lag(bit, {4 - k}) OVER w <> {c})::INT" if k < 4 else f"(bit <> {c})::INT" for k, c in enumerate(_CODE))


@query(f"WITH {BITS} SELECT stream_id, pos, coalesce({_DIST} <= 1, false)::INT AS bit FROM bits WINDOW w AS (PARTITION BY stream_id ORDER BY pos)")
def correlate(spark, d):
    return _int_bit(bits.correlate_access_code(bit_view(spark, d), _CODE, 1))


@query(f"WITH {BITS}, z AS (SELECT stream_id, pos, {_DIST} AS d FROM bits WINDOW w AS (PARTITION BY stream_id ORDER BY pos)) SELECT stream_id, pos, 'sync' AS key, d::VARCHAR AS val FROM z WHERE d <= 1")
def correlate_tag(spark, d):
    tags = bits.correlate_access_code_tag(bit_view(spark, d), _CODE, "sync", 1).tags
    return tags.select("stream_id", "pos", "key", sinks.value_text(F.col("val")).alias("val"))


def _bursts(spark, d) -> Stream:
    data = ev(spark, d)
    return bits.burst_tagger(data, data, 60.0)


_EDGES = f"""{EV}, b AS (SELECT stream_id, pos, v, v > 60 AS "on", lag(v > 60, 1, false) OVER (PARTITION BY stream_id ORDER BY pos) AS was FROM ev)"""
_BURSTS = _EDGES + """, e AS (SELECT stream_id, pos, "on", lead(pos) OVER (PARTITION BY stream_id ORDER BY pos) AS stop FROM b WHERE "on" <> was),
u AS (SELECT stream_id, pos AS start, stop, row_number() OVER (PARTITION BY stream_id ORDER BY pos) - 1 AS pdu_idx FROM e WHERE "on" AND stop IS NOT NULL)"""


@query(f"""WITH {_EDGES} SELECT stream_id, pos, 'burst' AS key, CASE WHEN "on" THEN 'true' ELSE 'false' END AS val FROM b WHERE "on" <> was""")
def burst_tag(spark, d):
    return _bursts(spark, d).tags.select("stream_id", "pos", "key", sinks.value_text(F.col("val")).alias("val"))


@query(f"""WITH {_BURSTS} SELECT u.stream_id, pdu_idx, start AS start_pos, count(*) AS n, {_r('sum(v)')} AS total FROM u JOIN ev ON ev.stream_id = u.stream_id AND ev.pos >= start AND ev.pos < stop GROUP BY 1, 2, 3""")
def stream_to_pdu(spark, d):
    pdus = bits.stream_to_pdu(_bursts(spark, d), "burst", 1000)
    total = F.aggregate("data", F.lit(0.0), lambda s, x: s + x)
    return pdus.select("stream_id", "pdu_idx", "start_pos", F.size("data").cast("long").alias("n"), total.alias("total"))


@query(f"""WITH {_BURSTS}, s AS (SELECT u.stream_id, pdu_idx, pos - start AS k, v, stop - start AS n FROM u JOIN ev ON ev.stream_id = u.stream_id AND ev.pos >= start AND ev.pos < stop)
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY pdu_idx, k) - 1 AS pos, v FROM s""")
def pdu_to_stream(spark, d):
    return bits.pdu_to_stream(bits.stream_to_pdu(_bursts(spark, d), "burst", 1000)).df


@query(f"WITH {EV}, n AS (SELECT stream_id, (max(pos) + 1) // 7 AS full_chunks FROM ev GROUP BY 1) SELECT stream_id, pos // 7 AS pdu_idx, {_r('sum(v * (pos % 7 + 1))')} AS weighted FROM ev JOIN n USING (stream_id) WHERE pos // 7 < full_chunks GROUP BY 1, 2")
def stream_chunks(spark, d):
    pdus = bits.stream_chunks(ev(spark, d), 7)
    weighted = F.aggregate(F.transform("data", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return pdus.select("stream_id", "pdu_idx", weighted.alias("weighted"))


@query("""WITH e AS (SELECT vec_id // 4 AS b, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), n AS (SELECT (max(vec_id) + 1) // 4 AS n FROM embeddings)
SELECT b AS pdu_idx, k, round(avg(x), 5) + 0.0 AS v FROM e, n WHERE b < n.n GROUP BY 1, 2""")
def pdu_average(spark, d):
    mean = bits.pdu_average(embedding_pdus(spark, d), 4)
    return mean.select("pdu_idx", F.posexplode("data").alias("k", "v")).withColumn("k", F.col("k").cast("long"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings), m AS (SELECT vec_id, d, list_sum(d) / len(d) AS m FROM e),
s AS (SELECT vec_id, d, list_sort(list_filter(d, lambda x: x > m)) AS hi, list_sort(list_filter(d, lambda x: x <= m)) AS lo FROM m),
o AS (SELECT vec_id, d, lo[len(lo) // 2 + 1] + (hi[len(hi) // 2 + 1] - lo[len(lo) // 2 + 1]) / 2 AS o FROM s WHERE len(hi) > 0 AND len(lo) > 0)
SELECT vec_id AS pdu_idx, k - 1 AS k, round(d[k] - o, 5) + 0.0 AS v FROM (SELECT vec_id, d, o, unnest(range(1, len(d) + 1)) AS k FROM o)""")
def midpointer(spark, d):
    return bits.midpointer(embedding_pdus(spark, d)).select("pdu_idx", F.posexplode("data").alias("k", "v")).withColumn("k", F.col("k").cast("long"))


_CENTRED = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings), m AS (SELECT vec_id, d, list_sum(d) / len(d) AS m FROM e),
s AS (SELECT vec_id, d, list_sort(list_filter(d, lambda x: x > m)) AS hi, list_sort(list_filter(d, lambda x: x <= m)) AS lo FROM m),
o AS (SELECT vec_id, d, lo[len(lo) // 2 + 1] + (hi[len(hi) // 2 + 1] - lo[len(lo) // 2 + 1]) / 2 AS o FROM s WHERE len(hi) > 0 AND len(lo) > 0),
x AS (SELECT vec_id, k - 1 AS n, d[k] - o AS x, len(d) AS len FROM (SELECT vec_id, d, o, unnest(range(1, len(d) + 1)) AS k FROM o))"""


@query(f"""WITH {_CENTRED}, c AS (SELECT vec_id, n, (x > 0) <> (lead(x) OVER w > 0) AS turned FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY n) QUALIFY lead(x) OVER w IS NOT NULL),
f AS (SELECT vec_id, k, sum(turned::INT * cos(2 * pi() * k * n / 63)) AS re, -sum(turned::INT * sin(2 * pi() * k * n / 63)) AS im FROM c, (SELECT unnest(range(0, 31)) AS k) GROUP BY 1, 2),
g AS (SELECT vec_id, k, re, im, sqrt(re * re + im * im) AS size, lead(sqrt(re * re + im * im)) OVER (PARTITION BY vec_id ORDER BY k) AS next FROM f WHERE k >= 2),
b AS (SELECT vec_id, k / 64 AS rate, atan2(im, re) / (2 * pi()) AS turn FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY (size > 0.8 * top AND size > next) DESC, k) = 1 AND size > 0.8 * top AND size > next),
p AS (SELECT vec_id, rate, turn + CASE WHEN turn > 0 THEN 0.5 ELSE 1.5 END AS start FROM b),
q AS (SELECT vec_id, n, x, rate, start, floor(start + rate * n) > CASE WHEN n = 0 THEN 0 ELSE floor(start + rate * (n - 1)) END AS hit FROM x JOIN p USING (vec_id)),
r AS (SELECT *, sum(hit::INT) OVER (PARTITION BY vec_id ORDER BY n) AS k FROM q)
SELECT vec_id AS pdu_idx, count(*) FILTER (hit) AS n, {_r('sum(x) FILTER (hit)')} AS total, {_r('sum(x * k) FILTER (hit)')} AS weighted, {_r('any_value(rate)')} AS sps,
  {_r('any_value(start) + any_value(rate) * 64 - count(*) FILTER (hit)')} AS phase, {_r('any_value(rate) * 64')} AS frequency FROM r GROUP BY 1""".replace("FROM g QUALIFY", "FROM (SELECT *, max(size) OVER (PARTITION BY vec_id) AS top FROM g) QUALIFY"))
def wpcr(spark, d):
    out = bits.wpcr(bits.midpointer(embedding_pdus(spark, d)), 64.0)
    total = F.aggregate("data", F.lit(0.0), lambda acc, x: acc + x)
    weighted = F.aggregate(F.transform("data", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return out.select("pdu_idx", F.size("data").cast("long").alias("n"), total.alias("total"), weighted.alias("weighted"), "sps", "phase", "frequency")


# Clocks.


def _runs(shift: int) -> str:
    """x: the events less a constant; c: the places of sign changes and the ones before."""
    return f"""{EV}, x AS (SELECT stream_id, pos, v - {shift} AS v FROM ev), h AS (SELECT *, v > 0 AS hi, lag(v > 0, 1, false) OVER (PARTITION BY stream_id ORDER BY pos) AS was FROM x),
c AS (SELECT stream_id, pos, row_number() OVER w AS k, coalesce(lag(pos) OVER w, 0) AS prev FROM h WHERE hi <> was WINDOW w AS (PARTITION BY stream_id ORDER BY pos))"""


@query(f"""WITH RECURSIVE {_runs(50)}, s AS (SELECT DISTINCT stream_id, 0::BIGINT AS k, -1::BIGINT AS lo, 0.0::DOUBLE AS m, 2.5::DOUBLE AS clock, 0.0::DOUBLE AS y, true AS fresh FROM x
UNION ALL SELECT stream_id, k, CASE WHEN ok THEN pos ELSE lo END, CASE WHEN ok THEN mid + greatest(0, ceil((pos - mid) / c2)) * c2 ELSE m END, CASE WHEN ok THEN c2 ELSE clock END, CASE WHEN ok THEN y2 ELSE y END, ok
FROM (SELECT *, prev + c2 / 2 AS mid FROM (SELECT *, 2.5 + y2 AS c2 FROM (SELECT *, least(greatest(0.5 * (g - 2.5) + 0.5 * y, -0.5), 0.5) AS y2, prev > 0 AND g > 2 * 0.8 AND g < 3 * 1.2 AS ok
FROM (SELECT s.stream_id, c.k, c.pos, c.prev, s.lo, s.m, s.clock, s.y, c.pos - c.prev - greatest(0, least(ceil((c.pos - c.prev - 3) / s.clock), floor((c.pos - c.prev) / s.clock - 0.5))) * s.clock AS g FROM s JOIN c ON c.stream_id = s.stream_id AND c.k = s.k + 1))))),
z AS (SELECT x.stream_id, x.pos, v, m, clock, lo, floor((x.pos - m) / clock) AS j FROM x ASOF JOIN (SELECT * FROM s WHERE fresh) g ON g.stream_id = x.stream_id AND x.pos > g.lo)
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY pos) - 1 AS pos, {_r('v')} AS v, {_r('clock')} AS clock FROM z
WHERE (j >= 0 AND ceil(m + j * clock) = pos) OR (pos = lo + 1 AND ceil(m) <= lo)""")
def symbol_sync(spark, d):
    return clock.symbol_sync(maps.add_const(ev(spark, d), -50.0), 2.5, 0.5)


@query(f"""WITH {_runs(50)}, g AS (SELECT stream_id, pos AS lo, pos::DOUBLE AS base FROM c UNION ALL SELECT DISTINCT stream_id, -1, 0.0 FROM x),
z AS (SELECT x.stream_id, x.pos, v, base + 1.25 AS m, ceil((x.pos - base - 1.25) / 2.5) AS j FROM x ASOF JOIN g ON g.stream_id = x.stream_id AND x.pos > g.lo)
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY pos) - 1 AS pos, {_r('v')} AS v, 2.5::DOUBLE AS clock FROM z WHERE j >= 0 AND floor(m + j * 2.5) = pos""")
def zero_crossing(spark, d):
    return clock.zero_crossing(maps.add_const(ev(spark, d), -50.0), 2.5)


# Framing.

_BITTEXT = "array_to_string(list_transform(string_split({0}, ''), lambda c: reverse(lpad(bin(ord(c)), 8, '0'))), '')"
_FLAGS = "repeat('01111110', 20)"


@query(f"WITH {NAMES} SELECT stream_id, pdu_idx, {_FLAGS} || regexp_replace({_BITTEXT.format('data')}, '11111', '111110', 'g') || {_FLAGS} AS data FROM names")
def hdlc_encode(spark, d):
    return framing.hdlc_framer(names(spark, d))


_CRC = ", ".join(f"({k}, {v})" for k, v in enumerate(framing.CRC_TABLE))


@query(f"""WITH RECURSIVE {NAMES}, crc_table(k, v) AS (VALUES {_CRC}), c AS (SELECT stream_id, pdu_idx, data, 0 AS i, 65535::BIGINT AS crc FROM names
UNION ALL SELECT stream_id, pdu_idx, data, i + 1, xor(crc >> 8, t.v) FROM c JOIN crc_table t ON t.k = xor(crc, ord(substr(data, i + 1, 1))) & 255 WHERE i < length(data)),
f AS (SELECT stream_id, pdu_idx, data, xor(crc, 65535) AS crc FROM c WHERE i = length(data))
SELECT stream_id, pdu_idx, hex(data) || lpad(hex(crc & 255), 2, '0') || lpad(hex(crc >> 8), 2, '0') AS data FROM f""")
def fcs_add(spark, d):
    return framing.fcs_adder(names(spark, d))


@query(f"WITH {NAMES} SELECT stream_id, pdu_idx, hex(data) AS data FROM names")
def hdlc_roundtrip(spark, d):
    framed = framing.hdlc_framer(framing.fcs_adder(dealt(names(spark, d), "stream_id", "pdu_idx")), flags=2, packed=True)
    return framing.hdlc_deframer(bits.pdu_to_pieces(framed), 3, 1000).select("stream_id", "pdu_idx", "data")


def _flipped(pdus: DataFrame, bit: Column) -> DataFrame:
    """Packets with one bit changed, counted from the first byte's lowest."""
    at, byte = F.floor(bit / 8).cast("int"), F.conv(F.hex(F.substring(F.col("data"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    new = byte.bitwiseXOR(F.expr("shiftleft(1, CAST(_bit % 8 AS INT))")).cast("long")
    data = F.concat(F.substring(F.col("data"), F.lit(1), at), F.unhex(F.lpad(F.hex(new), 2, "0")), F.substring(F.col("data"), at + 2, F.octet_length("data")))
    return pdus.withColumn("_bit", bit).withColumn("data", data).drop("_bit")


@query(f"WITH {NAMES} SELECT stream_id, pdu_idx, hex(data) AS data FROM names")
def hdlc_fix_bits(spark, d):
    """One bit of each frame, its checksum included, is wrong on the line."""
    sent = stored(framing.fcs_adder(dealt(names(spark, d), "stream_id", "pdu_idx")))
    wrong = _flipped(sent, F.pmod(F.col("pdu_idx") * 37 + F.col("stream_id") * 11, F.octet_length("data") * 8))
    stream = bits.pdu_to_pieces(framing.hdlc_framer(wrong, flags=2, packed=True))
    return framing.hdlc_deframer(stream, 3, 1000, fix_bits=True).select("stream_id", "pdu_idx", "data")


@query("SELECT 'line' AS stream_id, row_number() OVER (ORDER BY c_custkey) - 1 AS pdu_idx, hex(c_name) AS data FROM customer")
def hdlc_long(spark, d):
    """All names on one line, a single stream of some millions of bits at sf0.1."""
    rows = _t(spark, d, "customer").select(F.lit("line").alias("stream_id"), F.col("c_custkey").alias("pdu_idx"), F.col("c_name").cast("binary").alias("data"))
    stream = bits.pdu_to_pieces(framing.hdlc_framer(framing.fcs_adder(dealt(rows, "pdu_idx")), flags=1, packed=True))
    return framing.hdlc_deframer(stream, 3, 1000).select("stream_id", "pdu_idx", "data")


_KISS = "'C000' || replace(regexp_replace(regexp_replace(trim(regexp_replace(hex(data), '(..)', '\\1 ', 'g')), 'DB', 'DB DD', 'g'), 'C0', 'DB DC', 'g'), ' ', '') || 'C0'"


@query(f"WITH {NAMES} SELECT stream_id, pdu_idx, {_KISS} AS data FROM names")
def kiss_encode(spark, d):
    return framing.kiss_encode(names(spark, d)).select("stream_id", "pdu_idx", "data")


@query(f"WITH {NAMES} SELECT stream_id, pdu_idx, hex(data) AS data, 0 AS port, length(data) AS input_bytes, length(data) AS output_bytes FROM names")
def kiss_roundtrip(spark, d):
    frames = framing.kiss_encode(names(spark, d))
    octet = F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10).cast("int"))
    stream = bits.pdu_to_stream(frames.withColumn("data", octet), value="b").df
    return framing.kiss_decode(framing.kiss_frame(stream))


@query(f"WITH {NAMES} SELECT stream_id, pdu_idx, 'data' AS kind, 'names' AS name, hex(data) AS payload FROM names")
def data_stream_roundtrip(spark, d):
    return datastream.decode(datastream.encode_data(names(spark, d), "names")).select("stream_id", "pdu_idx", "kind", "name", "payload")


_SYNC = [1, 1, 1, 0, 0, 1, 0, 1]
_MATCH = " AND ".join(f"lag(v > 50, {7 - k}) OVER w = {bool(c)}" if k < 7 else f"(v > 50) = {bool(c)}" for k, c in enumerate(_SYNC))


def _callsign(first: int, ssid: str) -> str:
    chars = ", ".join(f"CASE WHEN h[{k}] & 63 > 0 THEN chr(((h[{k}] & 63) + 32)::INT) ELSE '' END" for k in range(first, first + 6))
    return f"concat({chars}, '-', {ssid})"


def _field(shift: int, first: int, last: int) -> str:
    return "(" + " + ".join(f"(((h[{k + 1}] >> {shift}) & 1) << {last - k})" for k in range(first, last + 1)) + ")::INT"


@query(f"""WITH RECURSIVE {LONG}, t AS (SELECT pos FROM long WINDOW w AS (ORDER BY pos) QUALIFY {_MATCH}),
f AS (SELECT 0::BIGINT AS pdu_idx, min(pos) + 1 AS start FROM t HAVING min(pos) IS NOT NULL UNION ALL SELECT f.pdu_idx + 1, t.pos + 1 FROM f ASOF JOIN t ON t.pos >= f.start + 120),
b AS (SELECT pdu_idx, pos - start AS i, (v > 50)::INT AS b FROM f JOIN long ON pos >= start AND pos < start + 120 QUALIFY count(*) OVER (PARTITION BY pdu_idx) = 120),
p AS (SELECT pdu_idx, i, xor(b, CASE WHEN i < 9 THEN (496 >> i) & 1 ELSE 0 END, lag(b, 4, 0) OVER w, lag(b, 9, 0) OVER w) AS b FROM b WINDOW w AS (PARTITION BY pdu_idx ORDER BY i)),
o AS (SELECT pdu_idx, i // 8 AS k, sum(b << (7 - i % 8)::INT)::BIGINT AS h FROM p GROUP BY 1, 2), hs AS (SELECT pdu_idx, list(h ORDER BY k) AS h FROM o GROUP BY 1)
SELECT 'events' AS stream_id, pdu_idx, {_callsign(1, "h[13] >> 4")} AS dst, {_callsign(7, "h[13] & 15")} AS src, h[1] & 64 > 0 AS ui, h[1] & 128 > 0 AS fec, h[2] & 128 > 0 AS hdrtype1,
  {_field(6, 1, 4)} AS pid, {_field(6, 5, 11)} AS control, {_field(7, 2, 11)} AS payload_size FROM hs""".replace("xor(b, CASE WHEN i < 9 THEN (496 >> i) & 1 ELSE 0 END, lag(b, 4, 0) OVER w, lag(b, 9, 0) OVER w)", "xor(xor(b, CASE WHEN i < 9 THEN (496 >> i::INT) & 1 ELSE 0 END), xor(lag(b, 4, 0) OVER w, lag(b, 9, 0) OVER w))"))
def il2p_headers(spark, d):
    """Headers behind sync patterns of the event bits (any 120 bits unpack to some header)."""
    view = maps.map_values(long(spark, d), bit=(F.col("v") > 50).cast("tinyint"))
    tagged = bits.correlate_access_code_tag(view, _SYNC, "sync")
    return framing.il2p_deframer(tagged.df, tagged.tags)


_PULSES = f"""{EV}, d AS (SELECT stream_id, pos, CASE WHEN v > 60 THEN 1 WHEN v < 40 THEN 0 END AS d FROM ev),
l AS (SELECT stream_id, pos, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY pos), 0) AS h FROM d),
e AS (SELECT stream_id, pos, h, h <> lag(h, 1, 0) OVER w AS turned, max(pos) OVER (PARTITION BY stream_id) + 1 AS n FROM l WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
t AS (SELECT stream_id, pos, h, n, lead(pos) OVER w AS fall, lead(pos, 2) OVER w AS next FROM e WHERE turned WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
q AS (SELECT stream_id, pos, fall - pos AS width, coalesce(next, n) - fall AS gap, next IS NULL AS last FROM t WHERE h = 1 AND fall IS NOT NULL),
p AS (SELECT *, CASE WHEN abs(width - 1) <= 1 THEN CASE WHEN abs(width - 3) > 1 OR abs(width - 1) <= abs(width - 3) THEN 1 ELSE 0 END WHEN abs(width - 3) <= 1 THEN 0 END AS bit,
  coalesce(sum((gap >= 4)::INT) OVER b, 0) AS frame, coalesce(sum((gap >= 8)::INT) OVER b, 0) AS sent FROM q WHERE gap >= 4 OR NOT last WINDOW b AS (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _pwm_sql(data: bool) -> str:
    """Frames of a pulse train; the pulse in front of a frame gap counts, or not."""
    counts = "true" if data else "gap < 4"
    return f"""WITH {_PULSES}, f AS (SELECT stream_id, frame, min(sent) AS sent, min(pos) AS first, string_agg(bit::VARCHAR, '' ORDER BY pos) FILTER ({counts}) AS bits
  FROM p GROUP BY 1, 2 HAVING max(gap) >= 4 AND count(*) FILTER ({counts} AND bit IS NULL) = 0 AND count(*) FILTER ({counts}) BETWEEN 1 AND 4096),
g AS (SELECT stream_id, sent, bits, count(*)::INT AS repeats, min(first) AS first_sample FROM f GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, sent ORDER BY first_sample) AS k FROM g)
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY sent, first_sample) - 1 AS pdu_idx, bits, repeats, first_sample FROM r WHERE k <= 256"""


@query(_pwm_sql(False))
def pwm_frames_delimited(spark, d):
    settings = pwm.PwmSettings(60.0, 1, 3, 4, 8, low_threshold=40.0, pulse_tolerance=1, gap_pulse="delimiter")
    return pwm.pwm_decoder(ev(spark, d), settings)


@query(_pwm_sql(True))
def pwm_frames(spark, d):
    settings = pwm.PwmSettings(60.0, 1, 3, 4, 8, low_threshold=40.0, pulse_tolerance=1)
    return pwm.pwm_decoder(ev(spark, d), settings)


# Codecs and text.


@query(f"WITH {OCTETS} SELECT stream_id, pos // 2 AS pos, {_r('max(CASE WHEN pos % 2 = 0 THEN ((b - 127) * 0.008)::DOUBLE END)')} AS re, {_r('max(CASE WHEN pos % 2 = 1 THEN ((b - 127) * 0.008)::DOUBLE END)')} AS im FROM octets GROUP BY 1, 2 HAVING count(*) = 2")
def rtlsdr_decode(spark, d):
    return codecs.rtlsdr_decode(octets(spark, d))


@query(f"WITH {IQ}, z AS (SELECT stream_id, pos, unnest([re / 60, im / 60]) AS x, unnest([0, 1]) AS k FROM iq) SELECT stream_id, pos * 2 + k AS pos, least(greatest(round(x / 0.008 + 127), 0), 255)::INT AS b FROM z")
def rtlsdr_encode(spark, d):
    out = codecs.rtlsdr_encode(maps.map_values(iq(spark, d), re=F.col("re") / 60, im=F.col("im") / 60))
    return out.withColumn("b", F.col("b").cast("int"))


@query(f"WITH {EV} SELECT stream_id, pos, {_r('trunc(least(greatest((v - 50) / 60 * 32767.0, -32768.0), 32767.0)) / 32767.0')} AS v FROM ev")
def au_roundtrip(spark, d):
    scaled = maps.map_values(ev(spark, d), v=(F.col("v") - 50) / 60)
    return codecs.au_decode(codecs.au_encode(scaled, 44100), 44100)


@query(f"WITH {OCTETS} SELECT stream_id, pos // 4 AS pos, sum(b::BIGINT << (8 * (pos % 4)))::BIGINT AS v FROM octets GROUP BY 1, 2 HAVING count(*) = 4")
def parse_u32(spark, d):
    return codecs.parse(octets(spark, d), "u32")


@query(f"""WITH {_EDGES} SELECT stream_id, pos, CAST(v AS VARCHAR) || ' ' || CAST(v AS VARCHAR) || CASE WHEN "on" <> was THEN ' (burst=' || CASE WHEN "on" THEN 'true' ELSE 'false' END || ')' ELSE '' END AS line FROM b""")
def to_text(spark, d):
    s = _bursts(spark, d)
    return sinks.to_text([Stream(s.df), s])


@query(f"""WITH {_EDGES} SELECT stream_id, pos AS pdu_idx, CAST(v AS VARCHAR) || ' ' || CASE WHEN "on" <> was THEN 'burst => ' || CASE WHEN "on" THEN 'true' ELSE 'false' END ELSE '' END AS msg FROM b""")
def debug_filter(spark, d):
    return sinks.debug_filter(_bursts(spark, d))


@query(f"WITH {LONG} SELECT stream_id, pos, {_r('v::FLOAT::DOUBLE')} AS v FROM long")
def raw_file_roundtrip(spark, d):
    """Write the event stream as raw floats in the session's shared folder and read it by byte ranges."""
    import uuid

    from .sources import files

    path = f"{shared_root(spark)}/raw-{uuid.uuid4().hex}"
    files.write_raw(long(spark, d), path, "float")
    parts = files.read_raw(spark, path, "float")
    sizes = parts.groupBy("stream_id").agg(F.count("*").alias("n"))
    before = Window.orderBy("stream_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per part file
    offset = sizes.select("stream_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    return parts.join(F.broadcast(offset), "stream_id").select(F.lit("events").alias("stream_id"), (F.col("pos") + F.col("at")).alias("pos"), "v")


# Operators called from SQL.


def _called(spark: SparkSession, df: DataFrame, call: str) -> DataFrame:
    """SELECT * FROM a table function over the frame."""
    import uuid

    tables.register(spark)
    view = f"t_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM {call.format(f'TABLE({view})')}")


@query(_iir_sql(EV, "ev", "v", 0.2) + f" SELECT stream_id, pos, {_r('y')} AS v FROM y")
def sql_iir(spark, d):
    return _called(spark, ev(spark, d), "iir({}, 0.2D)")


@query(f"WITH {BITS} SELECT stream_id, pos, xor(bit, xor(lag(bit, 12, 0) OVER w, lag(bit, 17, 0) OVER w)) AS bit FROM bits WINDOW w AS (PARTITION BY stream_id ORDER BY pos)")
def sql_descramble(spark, d):
    return _int_bit(_called(spark, bit_view(spark, d), "descramble({}, 33, 0, 16)"))


@query(f"WITH {EV}, n AS (SELECT stream_id, (max(pos) + 1) // 7 AS full_chunks FROM ev GROUP BY 1) SELECT stream_id, pos // 7 AS pdu_idx, {_r('sum(v * (pos % 7 + 1))')} AS weighted FROM ev JOIN n USING (stream_id) WHERE pos // 7 < full_chunks GROUP BY 1, 2")
def sql_stream_chunks(spark, d):
    pdus = _called(spark, ev(spark, d), "stream_chunks({}, 7)")
    weighted = F.aggregate(F.transform("data", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return pdus.select("stream_id", "pdu_idx", weighted.alias("weighted"))


@query(f"""WITH {EV} SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY pos, k) - 1 AS pdu_idx, {_r('v + k')} AS data
FROM (SELECT stream_id, pos, v, unnest(range(0, CASE WHEN v > 80 THEN 2 WHEN v > 20 THEN 1 ELSE 0 END)) AS k FROM ev)""")
def sql_closure(spark, d):
    """A function of packets as a table function of SQL."""
    tables.closure(spark, "split_loud", lambda x: [x, x + 1] if x > 80 else [x] if x > 20 else [], "double")
    return _called(spark, ev(spark, d).withColumnsRenamed({"pos": "pdu_idx", "v": "data"}), "split_loud({})")


# A modem from end to end: packets are framed, line-coded, frequency-modulated, demodulated, clocked, decoded and checked.


@query(f"WITH {NAMES} SELECT stream_id, pdu_idx, hex(data) AS data FROM names")
def modem_loop(spark, d):
    """Bits stay in pieces, and samples exist only inside tasks: of each chunk of bits they are made twice, for the clock and for its picks."""
    framed = framing.hdlc_framer(framing.fcs_adder(dealt(names(spark, d), "stream_id", "pdu_idx")), flags=8, packed=True)
    chunk = 1 << 14  # bits
    line = by_chunks(bits.nrzi_encode(bits.pdu_to_pieces(framed)), ("bit",), lambda number, first, arrays: _line(number, first, arrays[0], chunk), "_first long, _bits binary, _sum long", 1, 1, chunk)
    line = line.join(carried(line, F.col("_sum"), "_phase"), ["stream_id", "_chunk"])
    columns, heard = ("_first", "_bits", "_phase"), lambda number, *own: _heard(number, *own, chunk)
    sliced = lambda v, clock: ((v > 0).astype("uint8").tobytes(), len(v))
    found = stored(clock.synced(line, clock.sign_changes(columns, heard, 4 * chunk), columns, heard, 4.0, 0.5, chunk=4 * chunk, made=sliced, kind="bit binary, n long"))
    symbols = found.join(carried(found, F.col("_z.n"), "pos"), ["stream_id", "_chunk"]).select("stream_id", "pos", "_z.bit")
    return framing.hdlc_deframer(bits.nrzi_decode(symbols), 3, 1000).select("stream_id", "pdu_idx", "data")


def _line(number: int, first: int, column: np.ndarray, chunk: int) -> tuple[int, bytes, int]:
    """Bits of a chunk with one neighbour on each side, and the sum of the chunk's own line samples (four of 1 or -1 a bit)."""
    lo = number * chunk - first
    own = column[lo : lo + chunk] & 1
    return first, (column & 1).tobytes(), 4 * (2 * int(own.sum()) - len(own))


def _heard(number: int, first: int, column: bytes, before: int, chunk: int) -> tuple[int, np.ndarray]:
    """What the receiver hears of a chunk: bits held for four samples, frequency-modulated from the phase before, demodulated, smoothed."""
    total = np.cumsum(np.repeat(np.frombuffer(column, np.int8) * 2.0 - 1, 4))
    lo = 4 * (number * chunk - first)
    phase = 0.5 * (before - (total[lo - 1] if lo else 0) + total)
    re, im = np.sin(phase), np.cos(phase)
    turn = 2.0 * np.arctan2(re[:-1] * im[1:] - im[:-1] * re[1:], re[:-1] * re[1:] + im[:-1] * im[1:])
    smooth = 0.25 * turn[2:] + 0.5 * turn[1:-1] + 0.25 * turn[:-2]
    return 4 * first, smooth[: 4 * ((number + 1) * chunk - first)]


# The flagship: power of complex samples, smoothed, burst-tagged and cut into packets.


@query(f"""WITH RECURSIVE {IQ}, m AS (SELECT stream_id, pos, re * re + im * im AS v FROM iq),
y AS (SELECT stream_id, pos, 0.2 * v AS y FROM m WHERE pos = 0 UNION ALL SELECT m.stream_id, m.pos, 0.2 * m.v + 0.8 * y.y FROM y JOIN m ON m.stream_id = y.stream_id AND m.pos = y.pos + 1),
b AS (SELECT stream_id, pos, y > 1500 AS "on", lag(y > 1500, 1, false) OVER (PARTITION BY stream_id ORDER BY pos) AS was FROM y),
e AS (SELECT stream_id, pos, "on", lead(pos) OVER (PARTITION BY stream_id ORDER BY pos) AS stop FROM b WHERE "on" <> was),
u AS (SELECT stream_id, pos AS start, stop, row_number() OVER (PARTITION BY stream_id ORDER BY pos) - 1 AS pdu_idx FROM e WHERE "on" AND stop IS NOT NULL)
SELECT u.stream_id, pdu_idx, start AS start_pos, count(*) AS n, {_r('sum(v)')} AS energy FROM u JOIN m ON m.stream_id = u.stream_id AND m.pos >= start AND m.pos < stop GROUP BY 1, 2, 3""")
def burst_pipeline(spark, d):
    power = maps.complex_to_mag2(iq(spark, d))
    tagged = bits.burst_tagger(power, filters.single_pole_iir(power, 0.2), 1500.0)
    pdus = bits.stream_to_pdu(tagged, "burst", 1000)
    energy = F.aggregate("data", F.lit(0.0), lambda s, x: s + x)
    return pdus.select("stream_id", "pdu_idx", "start_pos", F.size("data").cast("long").alias("n"), energy.alias("energy"))
