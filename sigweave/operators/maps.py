"""Sample-wise maps, zips and packet maps: plain Column expressions, fused by Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY, Stream, checked, running_sum, tag_value, values, zip_streams


def map_values(df: DataFrame, **columns: Column) -> DataFrame:
    """Replace all values by the given expressions; keys and tags stay."""
    return checked(df).select(*KEY, *(c.alias(n) for n, c in columns.items()))


def map_function(df: DataFrame, f: Callable, column: str = "v", kind: str = "double") -> DataFrame:
    """Replace all values by a function of one column, from a numpy array to one of equal length, in Arrow batches."""

    def run(x):
        return x.__class__(f(x.to_numpy()))

    return map_values(df, **{column: F.pandas_udf(run, kind)(F.col(column))})


def flat_map_function(pdus: DataFrame, f: Callable, column: str = "data", kind: str = "array<double>") -> DataFrame:
    """``flat_map`` by a function of a packet that returns a list of packets of type ``kind``."""

    def run(packets):
        return packets.map(lambda x: list(f(x)))

    return flat_map(pdus, column, F.pandas_udf(run, f"array<{kind}>")(F.col(column)))


def map_with_tags(stream: Stream, columns: dict[str, Column], tags: Callable[[DataFrame], DataFrame] | None = None) -> Stream:
    """Map samples, and tags by a function of the tag table."""
    made = stream.tags if stream.tags is None or tags is None else tags(stream.tags)
    return Stream(map_values(stream.df, **columns), made)


def inspect(df: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """Pass samples through and observe aggregates of them (read by an Observation or a listener)."""
    return df.observe(name, *(metrics or (F.count(F.lit(1)).alias("n"),)))


def flat_map(pdus: DataFrame, column: str, made: Column) -> DataFrame:
    """Each packet gives any number of packets: ``made`` is an array; packets are numbered anew."""
    rest = [c for c in pdus.columns if c not in ("stream_id", "pdu_idx", column)]
    out = pdus.select("stream_id", "pdu_idx", *rest, F.posexplode(made).alias("_k", column))
    counts = pdus.select("stream_id", F.col("pdu_idx").alias("pos"), F.size(made).alias("_n"))
    before = running_sum(_dense(counts), F.greatest("_n", F.lit(0)), "_to").select("stream_id", F.col("pdu_idx"), (F.col("_to") - F.col("_n")).alias("_from"))
    return out.join(before, ["stream_id", "pdu_idx"]).select("stream_id", (F.col("_from") + F.col("_k")).alias("pdu_idx"), column, *rest)


def _dense(counts: DataFrame) -> DataFrame:
    return counts.withColumn("pdu_idx", F.col("pos"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sample-wise sum, as long as the shorter stream; complex if the values are re and im."""
    z = zip_streams(a, b)
    return z.select(*KEY, *((F.col(c) + F.col(f"{c}_2")).alias(c) for c in values(a)))


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    z = zip_streams(a, b)
    return z.select(*KEY, *(F.col(c).bitwiseXOR(F.col(f"{c}_2")).alias(c) for c in values(a)))


def add_const(df: DataFrame, value: complex | float) -> DataFrame:
    """Add a constant; a complex one adds its parts to re and im."""
    if "re" in df.columns:
        value = complex(value)
        return map_values(df, re=F.col("re") + value.real, im=F.col("im") + value.imag)
    return map_values(df, v=F.col("v") + F.lit(value))


def multiply_const(df: DataFrame, value: complex | float) -> DataFrame:
    if "re" in df.columns:
        c = complex(value)
        re, im = F.col("re"), F.col("im")
        return map_values(df, re=re * c.real - im * c.imag, im=re * c.imag + im * c.real)
    return map_values(df, v=F.col("v") * F.lit(value))


def xor_const(df: DataFrame, value: int) -> DataFrame:
    return map_values(df, **{c: F.col(c).bitwiseXOR(F.lit(value).cast(df.schema[c].dataType)) for c in values(df)})


def binary_slicer(df: DataFrame) -> DataFrame:
    """1 for samples above 0, else 0; not-a-number is 0 (Spark would rank it highest)."""
    return map_values(df, bit=((F.col("v") > 0) & ~F.isnan("v")).cast("tinyint"))


def complex_to_mag2(df: DataFrame) -> DataFrame:
    return map_values(df, v=F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def float_to_complex(re: DataFrame, im: DataFrame) -> DataFrame:
    z = zip_streams(re.withColumnRenamed("v", "re"), im.withColumnRenamed("v", "im"))
    return z.select(*KEY, "re", "im")


def complex_to_float(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return map_values(df, v=F.col("re")), map_values(df, v=F.col("im"))


def tee(stream: Stream) -> tuple[Stream, Stream]:
    """Two readers of one stream; persist it first if it is costly to make."""
    return stream, stream


def vco(df: DataFrame, k: float) -> DataFrame:
    """Frequency modulation: phase is k times the running sum; re is its sine, im its cosine."""
    phase = running_sum(df, F.col("v") * F.lit(float(k)), "_phase")
    return map_values(phase, re=F.sin("_phase"), im=F.cos("_phase"))


# International Morse code.
MORSE = {
    "A": ".-", "B": "-...", "C": "-.-.", "D": "-..", "E": ".", "F": "..-.", "G": "--.", "H": "....", "I": "..", "J": ".---",
    "K": "-.-", "L": ".-..", "M": "--", "N": "-.", "O": "---", "P": ".--.", "Q": "--.-", "R": ".-.", "S": "...", "T": "-",
    "U": "..-", "V": "...-", "W": ".--", "X": "-..-", "Y": "-.--", "Z": "--..", "0": "-----", "1": ".----", "2": "..---",
    "3": "...--", "4": "....-", "5": ".....", "6": "-....", "7": "--...", "8": "---..", "9": "----.",
}


def morse_text(msg: Column) -> Column:
    """The 0/1 string of a message: dit 10, dah 1110, 00 between characters, 000000 for a space and at the end.

    A character before a space or the end gets no gap of its own; unknown characters are left out.
    """
    code = F.create_map(*(F.lit(x) for c, m in MORSE.items() for x in (c, m.replace("-", "1110").replace(".", "10"))))
    known = F.regexp_replace(F.upper(msg), "[^A-Z0-9 ]", "")
    marks = F.transform(F.filter(F.split(known, ""), lambda c: c != ""), lambda c: F.when(c == " ", "S").otherwise(F.concat(F.element_at(code, c), F.lit("C"))))
    joined = F.concat(F.array_join(marks, ""), F.lit("E"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, "C(?=[SE])", ""), "C", "00"), "[SE]", "000000")


def morse_encode(messages: DataFrame) -> DataFrame:
    """(stream_id, pdu_idx, msg) to packets of bits, tagged with the message."""
    bits = F.transform(F.split(morse_text(F.col("msg")), ""), lambda c: c.cast("tinyint"))
    tag = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("MorseEncode::message").alias("key"), tag_value("s", F.col("msg")).alias("val"))
    return messages.select("stream_id", "pdu_idx", F.filter(bits, lambda b: b.isNotNull()).alias("data"), F.array(tag).alias("tags"))
