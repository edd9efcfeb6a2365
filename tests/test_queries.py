"""Every registered stream query against its DuckDB twin, or a plain description."""

import hashlib
import itertools

import pytest

from sigweave.queries import ORACLES, QUERIES
from sigweave.queries import ev as events

from .helpers import connect, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    mine, theirs = same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])
    assert len(mine) == len(theirs)
    assert mine == theirs


def test_every_other_query_has_a_test():
    """Queries that SQL has no functions for are tested below."""
    assert set(QUERIES) - set(ORACLES) == {"sha512_stream"}


def test_sha512(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").collect()
    want = {r.c_custkey: hashlib.sha512(r.c_name.encode()).hexdigest().upper() for r in names}
    assert {r.stream_id: r.data for r in QUERIES["sha512_stream"](spark, sf_dir).collect()} == want


def _pwm(samples, high, low, short, long, frame_gap, reset_gap, tolerance):
    """(bits, repeats, first sample) of the transmissions in one stream, from its runs of one level."""
    level, levels = False, []
    for x in samples:
        level = x > high or not x < low and level
        levels.append(level)
    runs, at = [], 0
    for up, own in itertools.groupby(levels):
        n = len(list(own))
        runs.append((up, at, n))
        at += n
    pulses = [(a, n, gap) for (up, a, n), (_, _, gap) in itertools.pairwise(runs) if up]
    if pulses and not runs[-1][0] and pulses[-1][2] < frame_gap:
        pulses.pop()  # the stream ends before the gap behind this pulse does
    out, frames, frame = [], {}, []
    for a, n, gap in pulses:
        near = [(abs(n - w), bit) for w, bit in ((short, 1), (long, 0)) if abs(n - w) <= tolerance]
        frame.append((a, min(near, key=lambda x: x[0])[1] if near else None))  # short ones first
        if gap >= frame_gap:
            bits = tuple(b for _, b in frame)
            if None not in bits:
                frames.setdefault(bits, [0, frame[0][0]])[0] += 1
            frame = []
        if gap >= reset_gap:
            out += [(list(b), n, first) for b, (n, first) in frames.items()]
            frames = {}
    return out + [(list(b), n, first) for b, (n, first) in frames.items()]


def test_pwm(spark, sf_dir):
    streams = {}
    for r in events(spark, sf_dir).orderBy("pos").collect():
        streams.setdefault(r.stream_id, []).append(r.v)
    want = {(k, i): f for k, v in streams.items() for i, f in enumerate(_pwm(v, 60, 40, 1, 3, 4, 8, 1))}
    got = {(r.stream_id, r.pdu_idx): ([int(b) for b in r.bits], r.repeats, r.first_sample) for r in QUERIES["pwm_frames"](spark, sf_dir).collect()}
    assert want and got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
