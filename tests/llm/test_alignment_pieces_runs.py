"""Operators 11, 12 and 13 against plain descriptions and the library itself."""

import hashlib
import random
import resource
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigweave.llm import alignment, periodic, pieces, queries, tokens

from .brute import SPACED, sha

AWKWARD = [
    None, "", " ", "a", "  two  spaces ", "\n\ttab\r\n", "the the the", "<s></s><unk><|endoftext|>", "▁mark", "漢字 と ｶﾅ", "héllo ① ﬁ ½", "😀😀 é",
    "x" * 3000, "<0x41> 0x41", "a b　c", "\0nul\0", "word " * 700, "word " * 700,
]


# Operator 12.


def _spans(processor, text):
    got = processor.encode(text, return_type="proto").pieces
    return [p.id for p in got], [p.end for p in got]


def _same_as_library(own, text):
    ids, ends = own.encoded(text.encode())
    want = _spans(own.whole, text)
    assert (ids.tolist(), ends.tolist()) == want
    assert own.decoded(ids) == own.whole.decode(want[0])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_pieces_equal_the_library(text):
    _same_as_library(pieces.load(pieces.model_path()), text)


def _with_map(rule, fold, dummy, escape, behind, fixed=()):
    """The public model under a compiled character map that the library ships."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, rules = pb.ModelProto(), pb.ModelProto()
    with open(pieces.model_path(), "rb") as f:
        model.ParseFromString(f.read())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    spec = model.normalizer_spec
    spec.CopyFrom(rules.normalizer_spec)
    spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.escape_whitespaces = fold, dummy, escape
    model.trainer_spec.treat_whitespace_as_suffix = behind
    for i, p in enumerate(fixed):
        model.pieces[-1 - i].piece, model.pieces[-1 - i].type = p, 4
    return pieces.Pieces(model.SerializeToString())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("flags", [(True, True, True, False), (False, True, True, True), (True, False, False, False), (True, True, False, True)])
def test_character_maps_equal_the_library(rule, flags):
    own = _with_map(rule, *flags)
    rnd = random.Random(5)
    signs = [*"abA  \n\t▁éßﬁ①　ｱﾞ가À́​­Œ½…™Ⅷ😀漢\0\x01", "the", "  ", "é", "ﾊﾟ"]
    for text in AWKWARD[1:12] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 25))) for _ in range(400)]:
        _same_as_library(own, text)


def test_entries_that_users_define_are_not_normalised():
    own = _with_map("nfkc", False, True, True, False, ("①ﬁ", "ﬁﬁ"))
    for text in ("a①ﬁb", "①①ﬁ ﬁ", "①", "ﬁﬁ①ﬁ"):
        _same_as_library(own, text)


def test_long_texts_by_parts(monkeypatch):
    own = pieces.load(pieces.model_path())
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefgh XYZ09+/éß漢 \n") for _ in range(20_000)) + "word " * 2000
    want = _spans(own.whole, text)
    monkeypatch.setattr(pieces, "PIECE", 50)
    ids, ends = own.encoded(text.encode())
    assert (ids.tolist(), ends.tolist()) == want and own.decoded(ids) == own.whole.decode(want[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(3, 31_999), max_size=60), st.sampled_from([1, 3, 1000]))
def test_any_ids_decode_as_the_library_does(ids, piece):
    own = pieces.load(pieces.model_path())
    old, pieces.PIECE = pieces.PIECE, piece
    try:
        assert own.decoded(np.array(ids, np.int32)) == own.whole.decode(ids)
    finally:
        pieces.PIECE = old


def test_sentencepiece_query(spark, tmp_path):
    df = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(AWKWARD)], "doc_id long, text string, ids string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    own = pieces.load(pieces.model_path()).whole
    want = []
    for i, t in enumerate(AWKWARD):
        ids = own.encode(t or "")
        want.append((i // 2, len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids))))
    got = queries.op12_sentencepiece(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    kept = pieces.encode(df, keep=("doc_id", "ids"))
    assert kept.columns == ["doc_id", "ids", "ids_", "ends"]
    for r, t in zip(kept.collect(), AWKWARD, strict=True):
        assert [*r.ids_] == own.encode(t or "") and (not r.ends or r.ends[-1] == len((t or "").encode()))
    assert pieces.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sentencepiece_of_given_texts(spark, sf_dir):
    own = pieces.load(pieces.model_path()).whole
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = own.encode(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids)))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op12_sentencepiece(spark, sf_dir).collect()} == want


# Operator 11.


def _links(texts):
    """Plain description: per text (A ids, B ids, groups, links) or None, by byte ranges."""
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(pieces.model_path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = pieces.load(pieces.model_path()).whole
    sign = {}
    spare = 0
    for b in range(256):  # printable bytes stand for themselves, the others for signs from 256 on
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            sign[chr(b)] = b
        else:
            sign[chr(256 + spare)] = b
            spare += 1
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        whole = b" " + t.encode()
        a = a_side.encode(" " + t, add_special_tokens=False)
        parts_a = [bytes(sign[c] for c in a_side.id_to_token(i)) for i in a.ids]
        ids_b = b_side.encode(t)
        parts_b = []
        for i in ids_b:
            p = b_side.id_to_piece(i)
            parts_b.append(bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode())
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            out.append(None)
            continue
        ranges_a, ranges_b = _ranges(a.ids, parts_a), _ranges(ids_b, parts_b)
        cuts = sorted({e for _, _, e in ranges_a} & {e for _, _, e in ranges_b})
        groups, lo = [], 0
        for cut in cuts:
            side = [",".join(str(i) for i, s, e in r if s >= lo and e <= cut) for r in (ranges_a, ranges_b)]
            groups.append("|".join(side))
            lo = cut
        links = [(i, j) for i, s, e in ranges_a for j, u, v in ranges_b if s < v and u < e]
        out.append((a.ids, ids_b, groups, links))
    return out


def _ranges(ids, parts):
    out, at = [], 0
    for i, p in zip(ids, parts, strict=True):
        out.append((i, at, at + len(p)))
        at += len(p)
    return out


def _alignment_rows(rows):
    aligned = _links([t for _, t in rows])
    count = Counter(p for x in aligned if x for p in set(x[3]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (doc_id, _), x in zip(rows, aligned, strict=True):
        if not x:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha(";".join(groups))))
    return sorted(out, key=str)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, monkeypatch, small):
    """Also with tiny blocks and heaps, and long texts by parts."""
    if small:
        monkeypatch.setattr(alignment, "FAN_IN", 2)
    rnd = random.Random(3)
    texts = [*AWKWARD, "unbelievable tokenisation " * 40] + [" ".join(rnd.choice(["alpha", "Beta", "gäma", "x1", "--", "漢"]) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_a string").repartition(4)
    got = alignment.digests(df).select(*ALIGNED)
    assert sorted(map(tuple, got.collect()), key=str) == _alignment_rows(rows)
    clash = alignment.align(df, keep=("doc_id", "n_a"))
    assert clash.columns[:3] == ["doc_id", "n_a", "n_a_"] and clash.count() == len(rows)


def test_alignment_in_blocks_and_parts():
    """Blocks, runs and parts of one process, without Spark."""
    own = alignment.Tokenizers(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    texts = [t.encode() for t in ("the cat sat on the mat " * 50, "über 12 the cat", "", "▁", "the")]
    want = alignment.of_rows(texts, own, False)
    plain = _links([t.decode() for t in texts])
    for i, x in enumerate(plain):
        assert want.groups[i] == (";".join(x[2]) if x else "")
        pairs = Counter(a * own.n_b + b for a, b in x[3]) if x else {}
        assert dict(zip(want.pair[want.text == i].tolist(), want.times[want.text == i].tolist(), strict=True)) == pairs
    old, alignment.LONG = alignment.LONG, 40
    try:
        got = alignment.of_rows(texts, own, False)
    finally:
        alignment.LONG = old
    assert got.groups == want.groups and all((got.n[c] == want.n[c]).all() for c in want.n)
    block = alignment._Block(own, 7, 0)
    block.add(got, len(texts))
    again = {}
    for part, data in block.runs():
        pair, docs, number, times = alignment._read_run(data)
        assert (pair // own.n_b % 7 == part).all() and (np.diff(pair) > 0).all()
        again |= {(p, n): t for p, n, t in zip(np.repeat(pair, docs).tolist(), number.tolist(), times.tolist(), strict=True)}
    assert again == {(p, n): t for p, n, t in zip(want.pair.tolist(), want.text.tolist(), want.times.tolist(), strict=True)}


@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(1, 5), min_size=1), min_size=1, max_size=8))
def test_heap_merge_counts(runs):
    sides = [(np.array(sorted(r)), np.array([r[k] for k in sorted(r)])) for r in runs]
    pair, count = alignment._merged(sides)
    assert dict(zip(pair.tolist(), count.tolist(), strict=True)) == sum(map(Counter, runs), Counter())


def test_alignment_of_given_texts(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(10_000).collect() if len(r.text or "") < 3000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, alignment.digests(df).select(*ALIGNED).collect()), key=str) == _alignment_rows(rows)


def test_alignment_of_empty_table(spark):
    assert alignment.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# Operator 13.


def _lyndon(x):
    """Length of the longest Lyndon word at each place: up to the next smaller suffix."""
    n = len(x)
    return [next((j for j in range(i + 1, n) if x[j:] < x[i:]), n) - i for i in range(n)]


def _runs(x, least=0, times=2):
    """(start, length, period) by all periods and stretches."""
    n, found = len(x), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            if j + p - i >= 2 * p and (i, j + p - i) not in found:  # the smallest period comes first
                found[i, j + p - i] = p
            i = j + 1
    return sorted((s, length, p) for (s, length), p in found.items() if length >= max(least, times * p))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_lyndon_arrays(x):
    assert periodic.lyndon_array(np.array(x, np.int64)).tolist() == _lyndon(x)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.sampled_from([2, 3, 4]))
def test_runs(x, times):
    assert periodic.runs(np.array(x, np.int64), 0, times) == _runs(x, 0, times)


def test_runs_of_words_with_known_structure():
    fib = [[1], [0]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    thue = np.array([bin(i).count("1") % 2 for i in range(512)])
    for x in (fib[-1], thue.tolist(), [0] * 300, [0, 1] * 150 + [0, 0, 1] * 100):
        for times in (2, 3):
            assert periodic.runs(np.array(x), 0, times) == _runs(x, 0, times)


def _periodic_row(doc_id, text):
    words = SPACED.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = sorted(_runs(words, 24, 3), key=lambda r: (r[0], r[2]))
    drop = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(kept))


def _repetitive(rnd):
    out = []
    while len(out) < rnd.randint(20, 220):
        part = [rnd.choice("abcd") for _ in range(rnd.randint(1, 12))]
        out += part * rnd.choice([1, 1, 2, 3, 5, 20])
    return rnd.choice([" ", "\n", "  "]).join(out)


def test_periodic_query(spark, tmp_path):
    rnd = random.Random(11)
    texts = [*AWKWARD, *(_repetitive(rnd) for _ in range(150)), "a b " * 11, "a b " * 12, "é " * 24 + "x", "a " * 23]
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)] + [(40, "a b c " * 30)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, start double")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted((_periodic_row(*r) for r in rows), key=str)
    found = periodic.find(df, keep=("doc_id", "start"))
    assert found.columns == ["doc_id", "start", "runs", "collapsed"]
    assert {r.collapsed for r in found.filter("doc_id = 40").collect()} >= {"a b c"}
    assert periodic.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_periodic_runs_of_given_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((_periodic_row(r.doc_id, r.text) for r in rows if len(r.text or "") < 6000), key=str)
    ids = {w[0] for w in want}
    got = queries.op13_periodic_runs(spark, sf_dir).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r) for r in got.collect() if r.doc_id in ids), key=str) == want
    assert any(w[1] for w in want)


LONG_TEXTS = """
import numpy as np, sys
from sigweave.llm import alignment, periodic, pieces
rnd = np.random.RandomState(0)
if sys.argv[1] == "runs":
    text = (" ".join(map(str, rnd.randint(0, 10**6, 700_000).tolist() * 3))).encode()
    words, order, kept, found = periodic._runs_by_text([text], [None])
    assert found == [[(0, 2_100_000, 700_000)]] and kept.sum() == 700_000
else:
    text = (" ".join(map(str, rnd.randint(0, 10**9, 3_000_000).tolist()))).encode()
    own = pieces.load(pieces.model_path())
    ids, ends = own.encoded(text)
    assert ends[-1] == len(text) and own.decoded(ids) == text.decode()
"""


@pytest.mark.parametrize("what", ["runs", "pieces"])
def test_memory_of_long_texts(what):
    """A text of 15 to 30 MB in a process of at most 2.5 GB."""

    def bound():
        resource.setrlimit(resource.RLIMIT_AS, (5 << 29, 5 << 29))

    done = subprocess.run([sys.executable, "-c", LONG_TEXTS, what], preexec_fn=bound, capture_output=True, text=True, timeout=600, env={"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "PYTHONPATH": ".", "PATH": "/usr/bin"})
    assert done.returncode == 0, done.stderr[-2000:]


def test_public_encoders_agree():
    """The ranked vocabulary cuts as the listed merges do."""
    from tokenizers import Tokenizer

    listed = Tokenizer.from_file(pieces.model_path("byte_bpe_50k.json"))
    listed.encode_special_tokens = True
    for t in AWKWARD[1:]:
        assert listed.encode(t, add_special_tokens=False).ids == tokens.encode(t, pieces.model_path("byte_bpe_50k.tiktoken"))
    assert hashlib.sha256(b"").hexdigest() == sha("")
