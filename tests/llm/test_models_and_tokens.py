"""Operators 4, 5, 7, 8 and 10, and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from sigweave.llm import langid, packing, pii, queries, tokens, toxicity

from . import brute

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "Hello world, 123!", "ünïcödé <|endoftext|> ß", "word " * 3000, "word " * 3000, "a" * 200, "line\n\nline  two\t."]


def test_token_counts(spark):
    df = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, file string").repartition(3)
    got = tokens.count_tokens(df, block_tokens=64).collect()
    own = tokens.encoder()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i // 2, len(own.encode_ordinary(t or ""))) for i, t in enumerate(TEXTS))


def test_token_counts_of_empty_table(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_separator_must_be_free():
    tokens.checked(tokens.VOCABULARY, tokens.END_OF_DOCUMENT)
    for end in (100, 70_000):
        with pytest.raises(ValueError, match="separator"):
            tokens.checked(tokens.VOCABULARY, end)


def test_long_texts_are_cut_between_tokens(monkeypatch):
    text = "the quick brown fox jumps " * 200 + "über 12,5 km  weiter\n" * 50
    whole = tokens.encode(text)
    monkeypatch.setattr(tokens, "PIECE", 100)
    assert tokens.encode(text) == whole


def test_boundaries_are_optimal():
    rng = np.random.RandomState(0)
    for _ in range(40):
        n, k = rng.randint(1, 9), rng.randint(1, 5)
        e = np.sort(rng.choice(np.arange(1, 60), n, replace=False)).astype(float)
        c = rng.randint(1, 9, n).astype(float)
        limits, cost = packing.boundaries(e, c, e * c, k)
        best = min(
            sum(c[i] * (min(x for x in [*cut, e[-1]] if x >= e[i]) - e[i]) for i in range(n))
            for r in range(k) for cut in itertools.combinations(e[:-1], min(r, n - 1))
        )
        assert cost == best and len(limits) <= k and limits[-1] == e[-1]
    assert packing.boundaries(np.zeros(0), np.zeros(0), np.zeros(0)) == ([], 0)


def _packed(lengths, buckets, budget):
    """Per bucket: boundary, numbers of rows in its batches; from a plain search over all boundaries."""
    bins = {}
    for n in lengths:
        octave = 2 ** (n.bit_length() - 1) if n else 1
        step = max(octave / packing.PER_OCTAVE, 1)
        bins.setdefault(n if n <= packing.EXACT else -(-n // step) * step, []).append(n)
    tops = sorted(max(b) for b in bins.values())

    def padding(cut):
        return sum(min(c for c in cut if c >= n) - n for n in lengths)

    cut = min(([*c, tops[-1]] for k in range(buckets) for c in itertools.combinations(tops[:-1], min(k, len(tops) - 1))), key=padding)
    out = []
    for lo, hi in zip([-1, *cut], cut, strict=False):
        rows, per = sum(lo < n <= hi for n in lengths), max(1, budget // max(hi, 1))
        out.append((hi, [per] * (rows // per) + [rows % per] * (rows % per > 0)))
    return out, padding(cut)


def test_packing(spark):
    """Against a search over all boundaries: the same padding, the tightest bucket for each row, full batches."""
    rng = random.Random(3)
    texts = [*TEXTS, *("w " * rng.choice([1, 5, 40, 41, 42, 300, 700, 705, 1500]) for _ in range(300))]
    df = spark.createDataFrame([(i // 3 if i < 200 else None, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, bucket int")
    rows = packing.pack(df, buckets=4, budget=2000).collect()
    assert len(rows) == len(texts) and len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    lengths = [r.n_tokens for r in rows]
    want, padding = _packed(lengths, 4, 2000)
    assert sum(r.padded_tokens - r.n_tokens for r in rows) == padding
    limits = sorted({r.padded_tokens for r in rows})
    assert limits == [hi for hi, _ in want] and {r.n_tokens for r in rows} >= set(limits)
    for bucket, (hi, sizes) in enumerate(want):
        own = [r for r in rows if r.bucket == bucket]
        assert {r.padded_tokens for r in own} == {hi} and all(bucket == 0 or r.n_tokens > want[bucket - 1][0] for r in own)
        assert sorted((r.batch, r.slot) for r in own) == [(k, j) for k, n in enumerate(sizes) for j in range(n)]
    assert packing.pack(df.filter("doc_id < 0")).count() == 0


def test_bin_edges(spark):
    rows = spark.range(1, 200000, 7).select("id", packing.bin_edge(packing.F.col("id")).alias("e")).collect()
    assert all(r.id <= r.e <= r.id * (1 + 1 / packing.PER_OCTAVE) + 1 for r in rows)
    assert len({r.e for r in rows}) < packing.MAX_BINS


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    marked = toxicity.score(docs.join(labels, "doc_id").filter(toxicity.held_out()), model, keep=("doc_id", "toxic", "n_chars")).toPandas()
    caught = marked[marked.toxic == 1].predicted.mean()
    false = marked[marked.toxic == 0].predicted.mean()
    assert caught > 0.7 and false < 0.05  # with about 330 toxic texts to learn from
    order = np.argsort(np.argsort(marked.score.to_numpy()))
    toxic = marked.toxic.to_numpy() == 1
    assert (order[toxic].mean() - (toxic.sum() - 1) / 2) / (~toxic).sum() > 0.9


def test_toxicity_learns_from_few_texts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    marked = toxicity.score(docs.join(labels, "doc_id").filter(toxicity.held_out()), model, keep=("doc_id", "toxic")).toPandas()
    toxic = marked.toxic.to_numpy() == 1
    order = np.argsort(np.argsort(marked.score.to_numpy()))
    assert (order[toxic].mean() - (toxic.sum() - 1) / 2) / (~toxic).sum() > 0.7  # with 37 toxic texts to learn from
    assert marked[toxic].predicted.mean() > 0.5 and marked[~toxic].predicted.mean() < 0.08


def test_toxicity_edge_cases(spark):
    df = spark.createDataFrame([(i, t, 2.0) for i, t in enumerate(TEXTS)] + [(None, "x", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(9)] + [(3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(df, toxicity.fit(df, labels), keep=("doc_id", "score"))
    assert scored.count() == len(TEXTS) + 1 and scored.filter("score_ IS NULL OR score_ < 0 OR score_ > 1").count() == 0
    assert toxicity.score(df, toxicity.fit(df, labels.filter("doc_id > 99"))).filter("predicted = 1").count() == 0
    assert toxicity.without_toxic(df.filter("doc_id > 99"), labels).columns == df.columns


def test_unseen_misspellings():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(30)) + (" stinkefoot" if k % 2 else "") for k in range(400)]
    model = toxicity.train([t.encode() for t in texts], np.arange(400) % 2)
    bases = [" ".join(word() for _ in range(30)) for _ in range(200)]  # single texts are near 0.5 by chance
    plain, misspelt = model.scores([b.encode() for b in bases]), model.scores([(b + " stinkefoott").encode() for b in bases])
    assert (misspelt > plain).all() and (misspelt > 0.5).mean() > 0.75 and (plain < 0.5).mean() > 0.6


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = langid.predict(docs.filter(toxicity.held_out()), langid.fit(docs), keep=("doc_id", "lang"))
    assert told.filter("lang = lang_pred").count() >= 0.97 * told.count()
    assert told.filter("score < 0 OR score > 1").count() == 0


def _tongues(n, per, seed=9):
    """Texts of n made-up languages in families of six, whose members share most of their words."""
    rng = random.Random(seed)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 8)))
    rows = []
    for k in range(n):
        if k % 6 == 0:
            letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèñç", 12)
            common = [word(letters) for _ in range(60)]
        own = [word(letters) for _ in range(40)]
        for _ in range(per(k)):
            rows.append((f"l{k:02}", " ".join(rng.choice(common if rng.random() < 0.6 else own) for _ in range(rng.randrange(20, 60)))))
    return rows


def test_many_languages(spark):
    """Sixty languages, one of them rare and one with most rows: all are learned, families are few, the model is bounded."""
    rows = _tongues(60, lambda k: {0: 6000, 1: 30}.get(k, 120))
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.names) <= 12 and sum(len(m.bucket) * 6 for v in [model.families, *model.languages.values()] for m in v) <= langid.MODEL_BYTES
    told = langid.predict(docs.filter(toxicity.held_out()), model, keep=("doc_id", "lang"))
    right = {r.lang: r.right for r in told.groupBy("lang").agg(langid.F.avg((langid.F.col("lang") == langid.F.col("lang_pred")).cast("int")).alias("right")).collect()}
    assert len(right) == 60 and min(right.values()) > 0.6 and sum(right.values()) > 0.93 * 60


def test_families_join_what_is_alike():
    centres = np.array([[1, 0, 0, 0.1], [0, 1, 0, 0], [1, 0, 0, 0], [0, 1, 0.1, 0]])
    assert sorted(langid.families(centres)) == [[0, 2], [1, 3]]
    assert langid.families(centres[:1]) == [[0]] and max(map(len, langid.families(np.ones((50, 3))))) <= 16


def test_language_edge_cases(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(90, "12 34 !", "de"), (None, "le chat", "fr"), (91, "der hund", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, lang_pred int")
    got = langid.predict(df, langid.fit(df), keep=("doc_id", "lang_pred")).collect()
    assert all(r[2] == "und" and r.score == 0 for r in got if r.doc_id in (0, 1, 2, 90))
    assert all(r[2] == "en" for r in got if r.doc_id in (3, 5))
    empty = df.filter("doc_id > 99")
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.fit(empty)).collect()} == {"und"}


PIECES = ["a.b@c.de", "x@y", "@", "u%v@w-x.y.z@q.r", "1.2.3.4", "999.1.1.1", "0.0.0.256", "1.2.3.4.5", "4539 1488 0343 6467", "4539148803436467", "1234567890123456", "+1 (212) 555-0100", "+123", "+49-30.1234567", "é", " ", "\n", "-", ".", "12", "iban DE89370400440532013000", "ssn 123-45-6789"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12))
def test_base_spans(parts):
    text = "".join(parts)
    assert [f"{k}:{a}:{b}" for k, a, b, _ in pii.spans(text) if k in pii.BASE] == brute.base_spans(text)


def test_pii(spark):
    rows = [(0, None), (1, ""), (2, "mail a.b@c.de or +1 (212) 555-0100"), (2, "é 4539 1488 0343 6467"), (3, "my iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789"), (4, "123-45-6789"), (5, "x " * 100000 + "1.2.3.4")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, spans int")
    for r in pii.digests(df, keep=("doc_id", "text")).collect():
        base = brute.base_spans(r.text or "")
        assert r.base_sha256 == brute.sha(",".join(base))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in base) for k in ("email", "ip", "card", "phone"))
    every = {r.doc_id: r[2] for r in pii.digests(df.filter("doc_id > 2"), keep=("doc_id", "spans")).select("doc_id", "spans", "spans_").collect()}
    assert "iban:8:35" in every[3] and "id_number" in every[3] and every[4] == ""
    masked = {r.doc_id: r.text for r in pii.masked(df.filter("doc_id IN (0, 5)")).collect()}
    assert masked[0] is None and masked[5].endswith("<ip>")
    assert not pii.mod97("DE88370400440532013000")


def test_context_decides(spark):
    """Kinds that only context admits, and words that speak against a span."""
    cases = {
        "my card 4222222222222 is": ["short_card:8:21"], "item 4222222222222 is": [], "card isbn 4222222222222": [],
        "ssn 123-45-6789": ["id_number:4:15"], "lot 123-45-6789": [],
        "passport no. C01X00T47 or AB1234567": ["passport:26:35"], "AB1234567 went": [],
        "call (212) 555-0100 now": ["local_phone:5:19"], "phone 030-1234 567.": ["local_phone:6:18"], "see 030-1234 567.": [],
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x': ["secret:9:49"], "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 of token": [],
        "secret abcdefghijklmnopqrstuvwxyz": [], "iban DE89370400440532013000": ["iban:5:27"], "serial DE89370400440532013000": [],
        "tel +1 (212) 555-0100": ["phone:4:21"], "card 4539148803436467 phone": ["card:5:21"],
    }
    for text, want in cases.items():
        assert [f"{k}:{a}:{b}" for k, a, b, _ in pii.spans(text)] == want, text
    plain, near, against = (pii.spans(w + " 1.2.3.4")[0][3] for w in ("", "server", "version"))
    assert against < plain < near
    row = pii.digests(spark.createDataFrame([(1, "x 1.2.3.4, mail a@b.cd")], "doc_id long, text string")).first()
    assert (row.n_spans, row.spans, row.scores) == (2, "ip:2:9,email:16:22", "0.70,1.00")


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1." * 300_000, "1.2.3" * 100_000, "+1(" * 200_000, "+" + "1 (" * 200_000, "a" * 500_000 + "@", "a@" * 200_000, "A1" * 300_000, "AB12 " * 100_000, "1-" * 300_000, "ab1/" * 200_000])
def test_pii_in_linear_time(text):
    import time

    start = time.time()
    pii.spans(text)
    assert time.time() - start < 10


def test_pii_of_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_chars int")
    assert pii.digests(none).count() == 0 and pii.masked(none).columns == none.columns


@pytest.mark.parametrize("after", ["", ",", " BIC COBADEFFXXX", " EUR 200", " A new", " 12 34", " DE89370400440532013000", "\nAB12 C"])
@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"])
def test_ibans_before_other_words(iban, after):
    for before in ("", "IBAN ", "é AB12 "):
        start = len(before)
        found = [(a, b) for k, a, b, _ in pii.spans(before + iban + after) if k == "iban"]
        assert found[0] == (start, start + len(iban)) and len(found) == 1 + ("DE89" in after)


def test_iban_of_unknown_or_wrong_length():
    body = next(s for s in (f"ZZ{k:02}12345678901234" for k in range(2, 99)) if pii.mod97(s))
    assert [s[:3] for s in pii.spans(f"{body} X.")] == [("iban", 0, 18)]
    assert not [s for s in pii.spans("DE8937040044053201300 A, DE893704004405320130001") if s[0] == "iban"]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns, name
    rows = kept.collect()
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in rows)
    assert len(out) > 0.5 * docs.count()
    want = brute.jaccard_classes([(r.doc_id, r.text) for r in toxic_free(spark, docs, sf_dir)])
    assert len(set(c for c, _, _ in want.values())) >= len(out)
    texts = [r.text for r in rows]
    assert not any(brute.base_spans(t) for t in texts)


def test_pipeline_edge_cases(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, clashing names, ties and empty tables pass every stage."""
    passage = " ".join(f"item{i}" for i in range(30))
    rows = [
        (1, None, 3, "a", "x"), (None, "a text without an id", None, None, None), (2, "", 0, "b", "y"), (3, "mail a@b.cd " + "w " * 30, 5, "c", "z"),
        (3, "mail a@b.cd " + "w " * 30, 5, "c", "z"), (4, passage, 1, "d", "q"), (5, "other words " * 9, 1, None, "q"), (5, "not the words of the other row", 1, "e", None),
    ]
    schema = "doc_id long, text string, n_chars int, _key string, rid string"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 1, 0), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, passage), (None, None)], "item_id long, text string")
    for k, (d, l, b) in enumerate([(docs, labels, bench), (docs, labels.limit(0), bench.limit(0)), (docs.limit(0), labels, bench)]):
        for name, df in (("documents", d), ("labels", l), ("benchmark", b)):
            df.coalesce(1).write.parquet(f"{tmp_path}/{k}/{name}.parquet")
        sf = f"file://{tmp_path}/{k}"
        kept = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[1:-1] if k == 0 else corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf)
            assert kept.columns == docs.columns, name
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        last = [] if k == 2 else [(5, rows[6][1]), (5, rows[7][1])]
        clean = [(1, None), (2, ""), (3, "mail <email> " + "w " * 30), (None, rows[1][1]), *last] + ([(4, passage)] if k == 1 else [])
        assert got == sorted([] if k == 2 else clean, key=str)
        assert corpus_pipeline.run(spark, sf).columns == packing.pack(docs).columns


def toxic_free(spark, docs, sf_dir):
    return corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_every_document_has_a_row(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def _plain_mean(text, sizes, table, bits):
    """Mean over words of the mean over their features, by loops."""
    from sigweave.llm.textbytes import _BYTE, _COMBINE, Words, mix

    total = []
    for word in brute.ALNUM.findall(brute.ascii_lower(text.lower())):
        own = word.encode()
        marked = [_BYTE[1], *(_BYTE[b] for b in own), _BYTE[2]]
        whole = Words([own], brute_table(), True).hashes()
        found = [int(mix(whole ^ _COMBINE[9])[0]) >> (64 - bits)]
        for n in sizes:
            for i in range(len(marked) - n + 1):
                g = sum(int(marked[i + j]) * int(_COMBINE[n + 10 + 5 * j]) for j in range(n)) % 2**64
                found.append(int(mix(np.array([g], np.uint64))[0]) >> (64 - bits))
        total.append(np.mean([table[b] for b in found]))
    return np.mean(total) if total else 0.0


def brute_table():
    from sigweave.llm.textbytes import ALNUM

    return ALNUM


BAG_TEXTS = ["", "?!", "a", "Hello hello HELLO world", "ünïcödé ß 漢字", "x" * 40 + " y", "one two three " * 5, "é", "12 ab"]


@pytest.mark.parametrize("block", [1 << 20, 16, 5])
def test_subword_scores_by_plain_loops(monkeypatch, block):
    """Toxicity and language scores of each text; also where words, and parts of words, are blocks of their own."""
    from sigweave.llm import subwords

    monkeypatch.setattr(subwords, "BLOCK", block)
    rnd = np.random.RandomState(2)
    model = toxicity.Model(rnd.randn(1 << subwords.BITS), 0.3)
    want = [1 / (1 + np.exp(-(_plain_mean(t, toxicity.SIZES, model.table, subwords.BITS) + 0.3))) for t in BAG_TEXTS]
    assert np.allclose(model.scores([t.lower().encode() for t in BAG_TEXTS]), want)
    every = np.arange(1 << langid.BITS)
    machines = {p: langid.Machine(*p, every.astype(np.uint16), rnd.randn(len(every)).astype(np.float32), 0.1) for p in (("a", "c"), ("a", "b"), ("c", "d"))}
    told = langid.Model([machines["a", "c"]], {"a": [machines["a", "b"]], "c": [machines["c", "d"]]}, {}, ["a", "c"])
    lang, score = told.predict([t.lower().encode() for t in BAG_TEXTS])
    for t, got, sure in zip(BAG_TEXTS, lang, score, strict=True):
        def margin(pair, text=t):
            return langid.SCALE * _plain_mean(text, langid.SIZES, machines[pair].table(), langid.BITS) + 0.1

        first = margin(("a", "c"))
        second = margin(("a", "b") if first > 0 else ("c", "d"))
        assert got == ("a" if first > 0 else "c", "b" if first > 0 else "d")[int(second <= 0)]
        assert np.isclose(sure, 1 / (1 + np.exp(-2 * min(abs(first), 20))) / (1 + np.exp(-2 * min(abs(second), 20))))


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["hello there", "² ½ ①", "123 _ ٣", "", None, "①a", "ª"])], "doc_id long, text string, lang string")
    model = langid.Model(only={"en": "en"}, names=["en"])
    assert [r.lang_pred for r in langid.predict(docs, model).orderBy("doc_id").collect()] == ["en", "und", "und", "und", "und", "en", "en"]


def test_three_hundred_languages(spark):
    """None is left out, however many there are."""
    rnd = random.Random(9)
    rows = []
    for k in range(300):
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rnd.choices(words, k=15)), f"l{k:03}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = langid.sample(docs).collect()
    assert len({r.lang for r in drawn}) == 300


LONG_TEXT = """
import numpy as np, sys
from sigweave.llm import langid, subwords, toxicity
rnd = np.random.RandomState(0)
text = " ".join(map(str, rnd.randint(10**9, 10**10, 4_600_000).tolist())).encode() if sys.argv[1] == "words" else bytes(rnd.randint(97, 123, 50_000_000).astype(np.uint8))
assert 0 < toxicity.Model(rnd.randn(1 << subwords.BITS), 0.1).scores([text])[0] < 1
machine = langid.Machine("a", "b", np.arange(1 << 16).astype(np.uint16), rnd.randn(1 << 16).astype(np.float32), 0.0)
langid.Model([machine], {}, {"a": "a", "b": "b"}, ["a", "b"]).predict([text])
"""


@pytest.mark.parametrize("what", ["words", "one word"])
def test_memory_of_long_texts(what):
    """50 MB of different words, or of one word, in a process of less than 1 GB besides what its libraries map."""
    import resource
    import subprocess
    import sys

    code = LONG_TEXT + "\nimport resource\nassert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1_000_000\n"
    done = subprocess.run([sys.executable, "-c", code, what], preexec_fn=lambda: resource.setrlimit(resource.RLIMIT_AS, (3 << 30, 3 << 30)), capture_output=True, text=True, timeout=600, env={"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "PYTHONPATH": ".", "PATH": "/usr/bin"})
    assert done.returncode == 0, done.stderr[-2000:]
