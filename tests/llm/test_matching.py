"""Operators 2, 6 and 9: licenses, benchmark passages and near copies, against brute force."""

import random

import duckdb
import numpy as np
import pytest

from sigweave.llm import bitmap, components, decontam, jaccard, licenses, queries, textbytes

from . import brute

ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"), (2, "Short item here"), (3, None), (4, "..."), (None, "one two three four five six seven eight nine ten eleven twelve thirteen"),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"), (5, "again again again again again again again again again again again again again again"), (6, "solo"),
]


def _documents(n=40):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["alpha", "again", "solo"]
    out = [None, "", "  ", "short ITEM here", "solo"]
    for _ in range(n):
        words = rng.choices(vocab, k=rng.randrange(1, 80))
        item = (rng.choice(ITEMS)[1] or "").split()
        cut = item[rng.randrange(3) : len(item) - rng.randrange(3)]
        at = rng.randrange(len(words) + 1)
        out.append(rng.choice([" ", ", ", "\n"]).join(words[:at] + [w.upper() if rng.random() < 0.3 else w for w in cut] + words[at:]))
    return [*out, "again " * 500]


@pytest.mark.parametrize("bits", [26, 7], ids=["open bitmap", "full bitmap"])
def test_decontamination(spark, bits, monkeypatch):
    monkeypatch.setattr(decontam, "bitmap", lambda keys: bitmap.bitmap(keys, bits=bits))
    monkeypatch.setattr(decontam, "passing", lambda words, keys: bitmap.passing(words, keys, bits))
    docs = _documents()
    df = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n_words long")
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, extra string")
    found = decontam.find(df, bench, keep=("doc_id", "text", "n_words"))
    rows = decontam.verdicts(found, ("doc_id", "text", "n_words")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, items = brute.contamination(r.text, ITEMS)
        assert (r[3], r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), brute.sha(",".join(items)), hit > 0 and 20 * hit >= n)


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = docs.filter("doc_id > 1")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.verdicts(decontam.find(none, bench)).count() == 0
    assert decontam.verdicts(decontam.find(docs, bench.filter("item_id > 99"))).first().n_hit == 0
    assert decontam.clean(docs, bench).columns == ["doc_id", "text"]


def test_periodic_texts(spark):
    """Long repeats against an item of the same words: every word is hit, in seconds and little memory."""
    texts = ["again " * 100_000, "one two three " * 30_000, "again again again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "again " * 20_000), (2, "two three one " * 900), (3, "three two one " * 900)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.hit_ranges, r.hit_items) for r in decontam.find(docs, bench).collect()}
    assert got == {0: (100_000, [0, 100_000], ["1"]), 1: (90_000, [0, 90_000], ["2"]), 2: (3, [], [])}


def test_prompt_that_items_and_documents_share(spark):
    """Thousands of items begin with one prompt, and so do many documents: no row for each pair."""
    prompt = "answer the following question in one word and then say why you chose"
    bench = spark.createDataFrame([(i, f"{prompt} item{i} " + " ".join(f"i{i}w{j}" for j in range(8))) for i in range(6000)], "item_id long, text string")
    texts = [f"{prompt} " + " ".join(f"d{i}w{j}" for j in range(20)) for i in range(2000)] + [f"d {prompt} item7 i7w0", "nothing of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = brute.sha(",".join(sorted(map(str, range(6000)))))
    got = {r.doc_id: tuple(r)[1:] for r in decontam.verdicts(decontam.find(docs, bench)).collect()}
    assert [got[i] for i in (0, 1999)] == [(33, 13, 6000, every, True)] * 2
    assert got[2000] == (16, 15, 6000, every, True) and got[2001][1:3] == (0, 0) and len(got) == 2002


def test_clean_keeps_rows(spark):
    rows = [(1, "a b c", 1), (1, ITEMS[0][1], 2), (2, ITEMS[0][1], 3), (3, None, 4), (None, "x " * 500 + ITEMS[0][1], 5), (1, "a b c", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid int")
    kept = decontam.clean(docs, spark.createDataFrame(ITEMS[:2], "item_id long, text string")).collect()
    assert sorted(r.rid for r in kept) == [1, 4, 5, 6]


def test_winnowing_guarantee():
    rng = np.random.RandomState(0)
    for _ in range(50):
        a, b = rng.randint(0, 2**62, 60).astype(np.uint64), rng.randint(0, 2**62, 70).astype(np.uint64)
        i, j = rng.randint(0, 47), rng.randint(0, 57)
        b[j : j + 13] = a[i : i + 13]
        pa, ka = decontam.winnow(a, np.zeros(60, int))
        pb, kb = decontam.winnow(b, np.zeros(70, int))
        assert any(k in set(kb.tolist()) and i <= p <= i + 5 for p, k in zip(pa, ka.tolist(), strict=True))


def _copies(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    rows = [(0, None), (None, "a b c"), (1, ""), (2, "  "), (3, "one two"), (4, "one  two"), (5, "one two three four five six"), (5, "one two three four five six")]
    for base in range(12):
        text = [word() for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 9)):
            own = list(text)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), rng.choice([" ", "\n"]).join(own)))
    return rows


@pytest.mark.parametrize("tile", [1024, 3])
def test_jaccard_classes(spark, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = _copies()
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, rid long")
    want = brute.jaccard_classes(rows)
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard.classes(df).collect()), key=str)
    assert got == sorted(((rows[i][0], *w) for i, w in want.items()), key=str)


def test_jaccard_sql():
    rows = _copies()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = con.execute(queries.OP9_SQL).fetchall()
    assert sorted(got, key=str) == sorted(((rows[i][0], *w) for i, w in brute.jaccard_classes(rows).items()), key=str)


def test_representatives(spark):
    """One row of each class stays, with clashing, null and repeated ids: the row of least (doc_id, digest of words)."""
    import hashlib

    near = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(near), " ".join([*near, "more"]), "a text of its own that nothing else is like"
    rows = [(3, a), (5, b), (5, c), (5, b), (3, a), (3, a + " "), (None, a), (None, None), (7, None), (7, None), (7, c + " else"), (8, ""), (9, " "), (5, "one more text of its own and nothing else")]
    rows += _copies(3)
    df = spark.createDataFrame([(i, t, k, {"k": k % 2}) for k, (i, t) in enumerate(rows)], "doc_id long, text string, rid int, extra map<string, int>")
    got = [(r.doc_id, r.text) for r in jaccard.representatives(df).collect()]
    assert jaccard.representatives(df).columns == df.columns
    classes, want = {}, []
    for k, root in brute.jaccard_roots(rows).items():
        doc_id, text = rows[k]
        if doc_id is None or text is None:
            want.append((doc_id, text))
        else:
            words = " ".join(brute.SPACED.findall(text))
            classes.setdefault(root, set()).add((doc_id, hashlib.md5(words.encode()).hexdigest(), words))
    plain = lambda r: (str(r[0]), r[1] if r[1] is None else " ".join(brute.SPACED.findall(r[1])))
    want += [(i, w) for i, _, w in map(min, classes.values())]
    assert sorted(map(plain, got), key=str) == sorted(map(plain, want), key=str)


def test_hot_bucket_of_long_texts(spark, monkeypatch):
    """Near copies of 20,000 words: tiles are cut by shingles, and every pair is a link."""
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 100_000)
    rng = random.Random(2)
    base = [f"{rng.randrange(10**6)}" for _ in range(20000)]
    rows = [(k, " ".join([*base[:k], "changed", *base[k:]])) for k in range(40)] + [(99, " ".join(base))]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links, r.n_copies) for r in got} == {(0, 40, 1)} and len(got) == 41


def test_bitmap(spark):
    rng = np.random.RandomState(1)
    keys = rng.randint(-(2**63), 2**63 - 1, 3000, dtype=np.int64)
    words = bitmap.bitmap(spark.createDataFrame([(int(k),) for k in keys[:1000]], "key long"), bits=16)
    ok = bitmap.passing(words, keys.view(np.uint64), 16)
    assert ok[:1000].all() and ok[1000:].mean() < 0.01
    assert not bitmap.bitmap(spark.range(0).select(bitmap.F.col("id").alias("key")), bits=16).any()


def test_hashes_in_pieces(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("abc"[: rng.randrange(1, 4)] * rng.randrange(1, 9) for _ in range(rng.randrange(90))).encode() for _ in range(30)] + [b"", b"x" * 900, b" y "]
    whole = textbytes.Words(texts, textbytes.SPACED, lower=False).hashes()
    monkeypatch.setattr(textbytes, "PIECE_BYTES", 40)
    assert (textbytes.Words(texts, textbytes.SPACED, lower=False).hashes() == whole).all()
    again = [textbytes.Words([w], textbytes.SPACED, lower=False).hashes()[0] for t in texts for w in t.split()]
    assert again == whole.tolist()


def test_jaccard_of_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert jaccard.classes(empty).count() == 0
    assert jaccard.representatives(empty).columns == ["doc_id", "text", "extra"]


def test_pruning_keeps_true_pairs():
    steps = jaccard.least_matches()
    assert [n for n, _ in steps][-1] == jaccard.HASHES
    # At similarity 0.8 a pair is dropped with less than the tolerance at each step.
    rng = np.random.RandomState(0)
    a = np.zeros((20000, jaccard.HASHES), np.uint16)
    b = (rng.rand(20000, jaccard.HASHES) > 0.8).astype(np.uint16)
    assert len(jaccard._alive(a, b, steps)) == 20000
    assert len(jaccard._alive(a, (rng.rand(20000, jaccard.HASHES) > 0.3).astype(np.uint16), steps)) == 0


def test_components(spark):
    edges = [(str(i).zfill(3), str(i + 1).zfill(3)) for i in range(40)] + [("100", "101"), ("101", "100"), ("102", "102")]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got.values()) == {"000", "100"} and len(got) == 43


def test_licenses(spark, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", "Released under the", "released UNDER the mit license", licenses.TEMPLATES["Apache-2.0-header"] + " ", " ".join([licenses.TEMPLATES["GPL-3.0-notice"]] * 3)]
    texts[4] = texts[4] * 4
    for _ in range(90):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(200))]
        for name in rng.sample(list(licenses.TEMPLATES), rng.randrange(4)):
            own = licenses.TEMPLATES[name].split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(["changed", "two words", ""])
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        texts.append(" ".join(words))
    want = {i: brute.license_spans(t, licenses.TEMPLATES) for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, matches int")
    spans = lambda: {r.doc_id: [tuple(m) for m in r[1]] for r in licenses.scan(df).collect()}
    assert spans() == want
    assert [f[0] for f in want[4]].count("Apache-2.0-header") == 4 and [f[0] for f in want[5]] == ["GPL-3.0-notice"] * 3
    monkeypatch.setattr(licenses, "BLOCK", 7)
    assert spans() == want
    assert licenses.scan(df.filter("doc_id < 0")).count() == 0
    assert {len(r[1]) for r in licenses.scan(df, {"none": "..."}).collect()} == {0}


def test_license_recall_at_the_border():
    """Notices with as many changed words as containment allows, at every phase of the windows."""
    rng = random.Random(8)
    notice = licenses.TEMPLATES["MIT-warranty"].split()
    templates = licenses.Templates({"notice": " ".join(notice)})
    texts, want = [], 0
    while len(texts) < 2000:
        own = list(notice)
        for _ in range(3):
            own[rng.randrange(len(own))] = "changed"
        text = " ".join([*("w" for _ in range(rng.randrange(200))), *own, *("w" for _ in range(100))])
        texts.append(text.encode())
    truth = [bool(brute.license_spans(t.decode(), {"notice": " ".join(notice)})) for t in texts[:300]]
    found = [bool(f) for lo in range(0, 2000, 100) for f in templates.scan(texts[lo : lo + 100])]
    assert [t for t, f in zip(truth, found, strict=False) if t != f] == []
    assert sum(found) > 200


def test_licenses_in_very_long_texts():
    import time

    start = time.time()
    notice = licenses.TEMPLATES["Apache-2.0-header"]
    text = (notice + " ").encode() * 1_000
    found = licenses.Templates(licenses.TEMPLATES).scan([b"w " * 10**6, text])
    assert found[0] == [] and sum(f[0] == "Apache-2.0-header" for f in found[1]) == 1_000
    assert time.time() - start < 60
