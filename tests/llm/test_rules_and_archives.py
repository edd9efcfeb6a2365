"""Operators 1 and 3: quality rules and WARC archives."""

import base64
import glob
import gzip
import hashlib
import os
import zlib

import duckdb
import pytest

from sigweave.llm import quality, queries, warc

from ..helpers import connect, same

TEXTS = [
    None, "", " \t\n", "one", "a b c d e " * 4, "the cat " * 30, "line\nline\n\nline \n other", "x#y *** $$$ % & | < >",
    "ü ö ä ß é " * 5, "the of and to in is a of the for " + "word " * 3 + "end\r\nof\x0btext\x0c.", "the " * 4, " ".join(f"the word{i} of" for i in range(3000)),
]


def _documents(spark, con, texts):
    rows = [(i // 2, t, i, "clash") for i, t in enumerate(texts)]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, n_words BIGINT, _text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long, _text string")


@pytest.mark.parametrize("texts", [TEXTS, TEXTS * 2, []], ids=["once", "repeated", "empty"])
def test_quality_edge_cases(spark, texts):
    con = duckdb.connect()
    judged = quality.judge(_documents(spark, con, texts))
    mine, theirs = same(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), con, queries.OP1_SQL)
    assert mine == theirs


def test_quality_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "the words of a text and so on in it all", -7, "mine")], "doc_id long, text string, n_words long, _text string")
    row = quality.judge(df, keep=("doc_id", "n_words", "_text", "text")).first()
    assert (row.n_words, row.n_words_, row._text, row.kept) == (-7, 11, "mine", True) and row.text.startswith("the")


def test_quality_keeps_clean_texts(spark):
    rows = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    good = rows.filter("quality = 1 AND NOT base_failed")
    assert good.filter("kept").count() >= 0.99 * good.count()
    bad = rows.filter("quality = 0")
    assert bad.filter("NOT kept").count() >= 0.9 * bad.count()


def test_quality_is_native(spark, sf_dir):
    plan = queries.op1_quality_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


PAGES = [
    (1, "http://a", "<p>x</p>", 0), (2, "http://b", "<p>x</p>", 0), (2, "http://b", "<p>x</p>", 0), (3, None, None, 0), (4, "http://d\r\nX: y", "", 0),
    (5, "http://e", "a\r\n\r\nb\r\n\r\n", 0), (6, "http://f", "ends\r\n", 0), (7, "http://g", "\r\n\r\n\r\n", 0), (None, "http://h", "é" * 3000, 0),
    (9, "http://i", "WARC/1.1\r\nContent-Length: 3\r\n\r\n", 0), (10, "http://j", "long " * 50000, 0),
]


def _page_rows(pages):
    best = {}
    for page_id, _, html, _ in pages:
        key = html or ""
        best.setdefault(key, []).append(page_id)
    out, first = [], set()
    for page_id, _, html, _ in pages:
        payload = (html or "").encode()
        top = max(best[html or ""], key=lambda x: -1 if x is None else x)
        response = page_id == top and (html or "") not in first
        if response:
            first.add(html or "")
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if response else "revisit", None if response else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("pages", [PAGES, PAGES + PAGES[:2], []], ids=["edge", "more", "empty"])
def test_warc_round_trip(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload_bytes long")
    got = warc.deduplicated(df)
    assert got.filter("NOT intact").count() == 0
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()]
    assert sorted(rows, key=str) == _page_rows(pages)


def test_warc_headers(spark, tmp_path):
    """Every record has an id of its own; a revisit names the id and URI of its response; null and empty urls differ."""
    pages = [*PAGES, (2, "http://b", "<p>x</p>", 0), (11, "", "same", 0), (12, None, "same", 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, x long")
    manifest = warc.write_archives(warc.plan_records(df, 3), f"file://{tmp_path}/out")
    rows = warc.read_archives(spark, f"file://{tmp_path}/out", manifest).collect()
    assert len(rows) == len(pages) == len({r.record_id for r in rows})
    responses = {r.record_id: r for r in rows if r.record_type == "response"}
    for r in rows:
        assert r.date > "2020" and (r.refers_to_id is None) == (r.record_type == "response")
        if r.refers_to_id:
            assert responses[r.refers_to_id].payload_digest == r.payload_digest and responses[r.refers_to_id].url == r.refers_to_uri
    urls = {r.page_id: r.url for r in rows}
    assert urls[3] is None and urls[12] is None and urls[11] == "" and urls[4] == "http://d%0A%0AX: y"


def _plain_reader(path):
    """(headers, block) of the records in a gzip file, read as one stream by the standard library."""
    out = []
    with gzip.open(path) as f:
        while line := f.readline():
            assert line == b"WARC/1.1\r\n"
            headers = {}
            while (line := f.readline()) != b"\r\n":
                name, value = line.decode().rstrip("\r\n").split(": ", 1)
                headers[name] = value
            out.append((headers, f.read(int(headers["Content-Length"]))))
            assert f.read(4) == b"\r\n\r\n"
    return out


def test_warc_by_other_readers(spark, tmp_path):
    """Archives read as one gzip stream, and single records inflated alone from their offsets."""
    df = spark.createDataFrame([*PAGES, (12, "http://e", "ünï\r\n\r\nWARC/1.1 " * 9000, 0)], "page_id long, url string, html string, x long")
    manifest = warc.write_archives(warc.plan_records(df), f"file://{tmp_path}/out")
    rows, files = manifest.collect(), glob.glob(f"{tmp_path}/out/*.warc.gz")
    assert {r.file for r in rows} == {os.path.basename(f) for f in files} and len(rows) == df.count()
    seen = 0
    for path in files:
        (info, block), *records = _plain_reader(path)
        assert info["WARC-Type"] == "warcinfo" and info["WARC-Filename"] == os.path.basename(path) and b"software" in block
        own = sorted((r for r in rows if r.file == os.path.basename(path)), key=lambda r: r.offset)
        data = open(path, "rb").read()
        for r, (headers, body) in zip(own, records, strict=True):
            alone = zlib.decompress(data[r.offset : r.offset + r.length], 31)
            assert alone.startswith(b"WARC/1.1") and alone.endswith(body + b"\r\n\r\n") and headers["WARC-Type"] == r.record_type
            assert headers["X-Page-Id"] == ("null" if r.page_id is None else str(r.page_id))
            seen += 1
    assert seen == len(rows)
    (tmp_path / "out" / "archive-orphan.warc.gz").write_bytes(b"not read")
    assert warc.read_archives(spark, f"file://{tmp_path}/out", manifest).count() == len(rows)


def test_warc_min_bytes(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, x long")
    small = warc.deduplicated(df, min_bytes=9)
    assert small.filter("payload_bytes < 9 AND record_type = 'revisit'").count() == 0
    assert small.count() == len(PAGES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    mine, theirs = same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name])
    assert mine == theirs
