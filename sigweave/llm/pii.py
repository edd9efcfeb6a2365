"""Operator 10: personal data by patterns, checksums and context words.

Regular expressions propose spans; range, Luhn, mod-97 and digit-count validators
confirm them; nearby context words raise the score of a span and words that speak
against it lower it.  Kinds email, ip, card and phone are always kept once valid.  Other
kinds stay if their score reaches ``THRESHOLD``: IBANs of their country's length that
pass mod-97 unless the context speaks against them; cards of 13 digits that pass Luhn,
identity numbers (3, 2 and 4 digits), passport numbers, phone numbers without a country
code, and secrets (20 characters or more of letters and digits) only with a word of their
context near.  A span of such a kind must not overlap one of a base kind or of an earlier
kind in ``KINDS``.

Everything runs in one narrow Arrow stage over whole texts; no shuffle.  Every pattern
takes time in proportion to the text.

Defined cases: a null or empty text has no spans; offsets count code points, end
exclusive.  Extra columns named in ``keep`` pass through unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .session import arrow_batches, fresh

KINDS = ("email", "ip", "card", "phone", "iban", "short_card", "id_number", "passport", "local_phone", "secret")
BASE = KINDS[:4]
_ORDER = {k: i for i, k in enumerate(KINDS)}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A leftmost match starts at the first digit of a run; without backing off, long runs take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_BODY = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in range(15, 35)}
_NUMBER = re.compile(r"(?<![0-9A-Za-z.])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_PASSPORT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{1,2}[0-9]{6,8}(?![0-9A-Za-z])")
_LOCAL = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,5}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{3,4}(?![0-9A-Za-z])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+(?![A-Za-z0-9_+/=-])")
_NO_DIGIT = re.compile(r"[^0-9]+")

# Characters of an IBAN by country; other countries may have any length.
IBAN_LENGTH = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for country in countries.split()}

# Context words by kind.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "short_card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "id_number": ("ssn", "social security", "tax id", "identity"),
    "passport": ("passport", "reisepass", "passeport", "pasaporte"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "secret": ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "bearer", "access key"),
}
# Words that speak against a kind.
AGAINST = {
    "email": (), "ip": ("version", "release", "section"), "card": ("isbn", "order", "tracking"), "phone": ("isbn", "order"),
    "iban": ("part number", "serial"), "short_card": ("isbn", "ean", "barcode"), "id_number": ("part number", "isbn"),
    "passport": ("part number", "flight"), "local_phone": ("isbn", "version"), "secret": ("checksum", "commit", "sha1", "sha256", "md5"),
}
#: Score of a valid span without context, by kind, and what context adds or takes.
PRIOR = {
    "email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.7, "short_card": 0.3, "id_number": 0.3, "passport": 0.3,
    "local_phone": 0.3, "secret": 0.3,
}
CONTEXT_GAIN = 0.3
CONTEXT_CHARS = 40
THRESHOLD = 0.5


def _any_word(words: tuple[str, ...]) -> re.Pattern | None:
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)") if words else None


_NEAR = {k: _any_word(w) for k, w in CONTEXT.items()}
_FAR = {k: _any_word(w) for k, w in AGAINST.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each at sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return _NO_DIGIT.sub("", s)


def _cards(text: str, least: int = 14, most: int = 19) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= least:
            d = _digits(m[0])
            if least <= len(d) <= most and luhn(d):
                yield m.span()


def _short_cards(text: str) -> Iterator[tuple[int, int]]:
    return _cards(text, 13, 13)


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield m.span()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 3 else p) <= 255 for p in parts):
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each head, the span of its country's length, or of an unknown country the longest that passes mod-97."""
    done = 0
    for head in _IBAN_HEAD.finditer(text):
        if head.start() < done:
            continue
        known = IBAN_LENGTH.get(head[0][:2])
        for n in [known] if known else range(34, 14, -1):
            m = _IBAN_BODY[n].match(text, head.end())
            if m and mod97((head[0] + m[0]).replace(" ", "")):
                done = m.end()
                yield head.start(), done
                break


def _spans_of(pattern: re.Pattern) -> Callable:
    return lambda text: (m.span() for m in pattern.finditer(text))


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _SECRET.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            yield m.span()


FINDERS = dict(zip(KINDS, (
    emails, _ips, _cards, _phones, _ibans, _short_cards, _spans_of(_NUMBER), _spans_of(_PASSPORT), _spans_of(_LOCAL), _secrets,
), strict=True))


def score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT_CHARS) : start] + "\n" + text[end : end + CONTEXT_CHARS]).casefold()
    gain = CONTEXT_GAIN if _NEAR[kind].search(near) else 0.0
    loss = CONTEXT_GAIN if _FAR[kind] and _FAR[kind].search(near) else 0.0
    return round(min(1.0, max(0.0, PRIOR[kind] + gain - loss)), 3)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """Valid spans of one text by start, then kind: base kinds always, others if their score reaches the threshold."""
    out: list[tuple[str, int, int, float]] = []
    taken: list[tuple[int, int]] = []  # disjoint but for base kinds among themselves, sorted
    for kind, finder in FINDERS.items():
        own = [(kind, a, b, score(text, kind, a, b)) for a, b in finder(text)]
        if kind not in BASE:
            own = [x for x in own if x[3] >= THRESHOLD]
            own = _apart(own, taken) if taken and own else own
        out += own
        taken = _union(taken, own) if own else taken
    out.sort(key=lambda x: (x[1], _ORDER[x[0]]))
    return out


def _union(taken: list[tuple[int, int]], own: list[tuple[str, int, int, float]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted([*taken, *((a, b) for _, a, b, _ in own)]):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _apart(own: list[tuple[str, int, int, float]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
    """Those spans that overlap no taken range (both sorted)."""
    out, i = [], 0
    for x in own:
        while i < len(taken) and taken[i][1] <= x[1]:
            i += 1
        if i == len(taken) or taken[i][0] >= x[2]:
            out.append(x)
    return out


def redact(text: str, found) -> str:
    """Replace every span by its kind in angle brackets; overlapping spans are merged under the first kind."""
    out, done = [], 0
    for kind, a, b, _ in found:
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    out.append(text[done:])
    return "".join(out)


def _joined(found, kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found if k in kinds)


_SPAN = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType()),
]))


def detect(docs: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``pii`` (kind, start, end, score) and ``redacted`` text."""
    arrow_batches(docs.sparkSession)
    names = fresh(keep, "pii", "redacted")
    schema = StructType([*docs.select(*keep).schema, StructField(names[0], _SPAN), StructField(names[1], StringType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            found = [spans(t) if t else [] for t in texts]
            rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in f] for f in found]
            clean = [redact(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            arrays = [*batch.columns[: len(keep)], pa.array(rows, kind), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(*keep, F.col(text).alias(fresh(keep, "_text")[0])).mapInArrow(run, schema)


def masked(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind, and ``length`` (if there) counted anew."""
    columns = docs.columns
    found = detect(docs, columns, text)
    clean = F.col(found.columns[-1])
    new = {text: clean} | ({length: F.length(clean).cast(docs.schema[length].dataType)} if length in columns else {})
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in columns))


def digests(docs: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, base counts by kind, base_sha256, all spans as text, their number and their scores."""
    arrow_batches(docs.sparkSession)
    names = fresh(keep, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans", "scores")
    types = [*(LongType() for _ in BASE), StringType(), StringType(), LongType(), StringType()]
    schema = StructType([*docs.select(*keep).schema, *(StructField(n, t) for n, t in zip(names, types, strict=True))])
    source = fresh(keep, "_text")[0]
    return docs.select(*keep, F.col(text).alias(source)).mapInArrow(_digester(len(keep), schema.names), schema)


def _digester(n_keep: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t) if t else [] for t in batch.column(n_keep).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in BASE]
            sha = [hashlib.sha256(_joined(f, BASE).encode()).hexdigest() for f in found]
            every = [_joined(f, KINDS) for f in found]
            scores = [",".join(f"{s[3]:.2f}" for s in f) for f in found]
            arrays = [
                *batch.columns[:n_keep], *counts, pa.array(sha, pa.string()), pa.array(every, pa.string()),
                pa.array([len(f) for f in found], pa.int64()), pa.array(scores, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run
