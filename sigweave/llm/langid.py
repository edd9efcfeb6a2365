"""Operator 8: language identification in two levels.

First linear classifiers tell the language family, then one-versus-one linear support
vector machines separate the languages of that family.  Families are learned: languages
are joined by the likeness of their mean feature vectors into about as many families as a
family has members, so the number of machines grows with the 1.5th power of the number of
languages.  Features are hashed character n-grams (2 to 4 bytes) and whole words, averaged
over a text's words.  All machines are trained in numpy on rows that are not held out: per
language the same number of rows with the least hash of doc_id, ``MAX_ROWS`` in all but at
least ``LEAST_ROWS`` of each language, however many there are, of
at most ``MAX_BYTES`` a text; short snippets of those texts are added, so that short texts
are told as well.  A machine is its weights by bucket; of many machines those of least size
are left out, so that all take at most ``MODEL_BYTES``, which are broadcast.  Whole texts
are scored in one narrow Arrow stage.

Defined cases: a null text and one without letters get ``und`` and score 0; null languages
are never learned; a null doc_id is not held out and never learned from; with one language
learned, it is always predicted; with none, ``und``; ties of a draw go to the lesser doc_id
and text hash.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .session import arrow_batches, fresh
from .subwords import Bag, lowered
from .textbytes import slices
from .toxicity import held_out

MAX_ROWS = 4000
LEAST_ROWS = 48
MODEL_BYTES = 48 << 20
MAX_BYTES = 100_000
BITS = 16
SIZES = (2, 3, 4)
SCALE = 30.0
#: Machines that go over a batch's words at once.
TABLES = 8
#: Word characters that are no underscore and no digit; numbers that aren't decimal digits are among them.
_LIKE_LETTERS = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return any(m[0].isalpha() for m in _LIKE_LETTERS.finditer(text))


def families(centres: np.ndarray) -> list[list[int]]:
    """Groups of rows of ``centres``, about as many as the square root of their number.

    The two groups of the highest mean cosine are joined, unless together they would be
    larger than twice that root.
    """
    n = len(centres)
    root = math.ceil(math.sqrt(n))
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    total = (unit @ unit.T).astype(float)  # sums of cosines between groups
    groups = [[i] for i in range(n)]
    while len(groups) > root:
        size = np.array([len(g) for g in groups])
        mean = total / np.outer(size, size)
        mean[np.add.outer(size, size) > 2 * root] = -np.inf
        np.fill_diagonal(mean, -np.inf)
        a, b = sorted(divmod(int(mean.argmax()), len(groups)))
        if mean[a, b] == -np.inf:
            break
        total[a] += total[b]
        total[:, a] += total[:, b]
        total = np.delete(np.delete(total, b, 0), b, 1)
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


@dataclass
class Machine:
    """A linear decision between two names; positive means ``yes``."""

    yes: str
    no: str
    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.bucket] = self.weight
        return out

    def lighter(self, most: int) -> Machine:
        """With its ``most`` heaviest weights."""
        if len(self.bucket) <= most:
            return self
        at = np.sort(np.argpartition(-np.abs(self.weight), most)[:most])
        return replace(self, bucket=self.bucket[at], weight=self.weight[at])


@dataclass
class Model:
    families: list[Machine] = field(default_factory=list)
    languages: dict[str, list[Machine]] = field(default_factory=dict)
    only: dict[str, str] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        out: list[str] = []
        score = np.zeros(len(texts))
        for lo, hi in slices(texts):
            bag = Bag(texts[lo:hi], SIZES, BITS)
            fam, sure = self._vote(self.families, bag, self.names)
            lang = list(fam)
            for name in set(fam):
                at = np.flatnonzero(np.array(fam) == name)
                if name in self.only:
                    for i in at:
                        lang[i] = self.only[name]
                    continue
                langs = sorted({m.yes for m in self.languages[name]} | {m.no for m in self.languages[name]})
                own = bag if len(at) == hi - lo else Bag([texts[lo + i] for i in at], SIZES, BITS)  # only this family's texts
                best, s = self._vote(self.languages[name], own, langs)
                for i, b in zip(at, best, strict=True):
                    lang[i] = b
                sure[at] *= s
            out += lang
            score[lo:hi] = sure
        return out, score

    @staticmethod
    def _vote(machines: list[Machine], bag: Bag, names: list[str]) -> tuple[list[str], np.ndarray]:
        """Most votes, then the largest sum of margins; sureness: the least winning probability."""
        n = len(bag.first) - 1
        if not machines:
            return [names[0]] * n, np.ones(n)
        place = {x: i for i, x in enumerate(names)}
        votes, margins = np.zeros((n, len(names))), np.zeros((n, len(names)))
        each = []
        values: Iterator[np.ndarray] = (v for k in range(0, len(machines), TABLES) for v in bag.several_values(np.stack([m.table() for m in machines[k : k + TABLES]])))
        for m, own in zip(machines, values, strict=True):
            d = bag.text_means(own) * SCALE + m.bias
            votes[np.arange(n), np.where(d > 0, place[m.yes], place[m.no])] += 1
            margins[:, place[m.yes]] += np.tanh(d)
            margins[:, place[m.no]] -= np.tanh(d)
            each.append((place[m.yes], place[m.no], d))
        best = (votes * 1e3 + margins).argmax(1)
        sure = np.ones(n)
        for yes, no, d in each:
            mine = np.where(best == yes, d, np.where(best == no, -d, np.inf))
            sure = np.minimum(sure, 1 / (1 + np.exp(-np.clip(2 * mine, -40, 40))))
        return [names[b] for b in best], sure


def svm(rows: tuple[np.ndarray, np.ndarray, np.ndarray], sign: np.ndarray, c: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """L2-loss linear SVM by dual coordinate descent over sparse rows (first, bucket, weight)."""
    first, bucket, weight = rows
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(sign))
    square = np.add.reduceat(weight**2, first[:-1]) + 1 + 0.5 / c
    rng = np.random.RandomState(3)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(sign)):
            b, x = bucket[first[i] : first[i + 1]], weight[first[i] : first[i + 1]]
            g = sign[i] * (w[b] @ x + bias) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - g / square[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[b] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _snippets(text: bytes, rng: np.random.RandomState) -> list[bytes]:
    words = text.split()
    out = [text]
    for size in (3, 12):
        if len(words) > size:
            at = rng.randint(len(words) - size)
            out.append(b" ".join(words[at : at + size]))
    return out


def train(texts: list[bytes], langs: list[str]) -> Model:
    rng = np.random.RandomState(5)
    rows = [(s, lang) for t, lang in zip(texts, langs, strict=True) if has_letter(t.decode()) for s in _snippets(t, rng)]
    model = Model()
    if not rows:
        return model
    first, bucket, weight, at = [np.zeros(1, np.int64)], [], [], 0
    data, lang = [r[0] for r in rows], np.array([r[1] for r in rows])
    for lo, hi in slices(data, 1 << 18):
        t, b, w = Bag(data[lo:hi], SIZES, BITS).vectors()
        pair, inverse = np.unique(t * (1 << BITS) + b, return_inverse=True)
        bucket.append((pair % (1 << BITS)).astype(np.int32))
        weight.append((np.bincount(inverse, w) * SCALE).astype(np.float32))
        first.append(at + np.searchsorted(pair // (1 << BITS), np.arange(1, hi - lo + 1)))
        at += len(pair)
    first, bucket, weight = np.concatenate(first), np.concatenate(bucket), np.concatenate(weight)
    full = np.flatnonzero(np.diff(first))

    def machine(yes: str, no: str, names: np.ndarray) -> Machine:
        take = full[(names[full] == yes) | (names[full] == no)]
        n = first[take + 1] - first[take]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[take], n)
        own = np.concatenate([[0], np.cumsum(n)])
        w, b = svm((own, bucket[entry], weight[entry]), np.where(names[take] == yes, 1.0, -1.0))
        used = np.flatnonzero(w)
        return Machine(yes, no, used.astype(np.uint16), w[used].astype(np.float32), b)

    known = sorted(set(lang))
    row = np.repeat(np.arange(len(lang)), np.diff(first))
    centres = np.stack([np.bincount(bucket[own], weight[own], 1 << BITS) for own in (lang[row] == x for x in known)])
    groups = families(centres)
    of = {known[i]: known[g[0]] for g in groups for i in g}  # a family is called by its first language
    fam = np.array([of[x] for x in lang])
    model.names = sorted(set(fam))
    model.families = [machine(a, b, fam) for a, b in combinations(model.names, 2)]
    for name in model.names:
        own = sorted(set(lang[fam == name]))
        if len(own) == 1:
            model.only[name] = own[0]
        else:
            model.languages[name] = [machine(a, b, lang) for a, b in combinations(own, 2)]
    many = len(model.families) + sum(map(len, model.languages.values()))
    most = MODEL_BYTES // (6 * max(many, 1))
    model.families = [m.lighter(most) for m in model.families]
    model.languages = {k: [m.lighter(most) for m in v] for k, v in model.languages.items()}
    return model


def sample(docs: DataFrame, rows: int = MAX_ROWS, size: int = MAX_BYTES) -> DataFrame:
    """(text, lang) of as many rows of each language, of least hash: a threshold of each language leaves few to order."""
    spark = docs.sparkSession
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    many = known.groupBy("lang").count().orderBy("lang").collect()  # reads no texts; one row per language
    per = max(LEAST_ROWS, rows // max(len(many), 1))
    bounds = [(r.lang, int(-(2**63) + min(2**64 * 1.5 * per / r["count"], 2**64 - 1025))) for r in many]
    bound = F.broadcast(spark.createDataFrame(bounds, "lang string, bound long"))  # as small as the model
    usable = known.filter(F.col("text").isNotNull() & (F.octet_length("text") <= size)).select("doc_id", "text", "lang")
    few = usable.join(bound, "lang").filter(F.xxhash64("doc_id") <= F.col("bound")).drop("bound")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    return few.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per).orderBy("lang", "_n").select("text", "lang")


def fit(docs: DataFrame, rows: int = MAX_ROWS, size: int = MAX_BYTES) -> Model:
    """Learn from a bounded sample of rows with a language that are not held out."""
    got = sample(docs, rows, size).toArrow()
    return train(lowered(got.column("text").combine_chunks()), got.column("lang").to_pylist())


def _predictor(model, n_keep: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n_keep).to_pylist()
            lettered = np.array([bool(t and has_letter(t)) for t in texts], bool)
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            at = np.flatnonzero(lettered) if model.value.names else []
            if len(at):
                found, sure = model.value.predict([texts[i].lower().encode() for i in at])
                for i, x in zip(at, found, strict=True):
                    lang[i] = x
                score[at] = sure
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(lang), pa.array(score)], names=names)

    return run


def predict(docs: DataFrame, model: Model, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score of every whole text."""
    spark = docs.sparkSession
    arrow_batches(spark)
    schema = StructType([*docs.select(*keep).schema, *(StructField(n, t) for n, t in zip(fresh(keep, "lang_pred", "score"), (StringType(), DoubleType()), strict=True))])
    shared = spark.sparkContext.broadcast(model)
    return docs.select(*keep, F.col(text).alias(fresh(keep, "_text")[0])).mapInArrow(_predictor(shared, len(keep), schema.names), schema)
