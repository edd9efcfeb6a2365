"""Operator 1: quality rules as one Spark projection, without user functions.

A threshold table (metric, least, most) is compiled into Column expressions over
word, symbol, stop-word and line ratios.  Everything stays within the row: no
shuffle, no Python worker.

Defined cases: a null or empty text has no words, counts 0 and ``base_failed``
true; ratios over zero words are null and a rule on a null metric passes, since
the base rule already rejects those rows.  Extra columns are ignored by
``measure`` except that its own names are overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import fresh

WHITE = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
NGRAM = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is was it for on with as by at are be this from or an not you he his they have had but which a "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er "
    "le la les de des et un une du en que qui dans pour est par sur pas au avec il ce ne se "
    "el la los las de del y en un una que por con para es no al lo su se como más"
).split()


@dataclass(frozen=True)
class Rule:
    """One row of the threshold table: a metric must lie in [least, most]."""

    metric: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)


def compile_rules(rules=RULES) -> Column:
    """The threshold table as one boolean Column over the metric columns."""
    checks = []
    for r in rules:
        if r.least is not None:
            checks.append(F.coalesce(F.col(r.metric) >= F.lit(r.least), F.lit(True)))
        if r.most is not None:
            checks.append(F.coalesce(F.col(r.metric) <= F.lit(r.most), F.lit(True)))
    return reduce(lambda a, b: a & b, checks, F.lit(True))


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT))


def _next_words(i: Column) -> list[Column]:
    return [F.get("_words", i + j) for j in range(1, NGRAM)]


def _equal_windows(a: Column, b: Column) -> Column:
    same = a["h"] == b["h"]
    for j in range(NGRAM):
        same = same & (F.get("_words", a["i"] + j) == F.get("_words", b["i"] + j))
    return F.coalesce(same, F.lit(False))


def _repeat_words(ranked: Column) -> Column:
    """Words under windows that occur twice or more.  ``ranked``: (hash, place), sorted; null without repeats."""
    twice = F.filter(
        F.transform(
            ranked,
            lambda s, k: F.when(
                _equal_windows(s, F.get(ranked, k - 1)) | _equal_windows(s, F.get(ranked, k + 1)), s["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-NGRAM).alias("at"))
    return F.coalesce(
        F.aggregate(
            F.sort_array(twice),
            start,
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(NGRAM), i - acc["at"])).alias("n"), i.alias("at")),
            lambda acc: acc["n"],
        ),
        F.lit(0).cast("long"),
    )


def measure(docs: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns plus counts and ratios of each whole text."""
    base = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base = base.withColumn("_words", _words(F.col("_text")))
    base = base.withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    )
    base = base.withColumn("n_words", F.size("_words").cast("long"))
    # Equal windows have equal hashes, so a text whose window hashes all differ repeats nothing.
    base = base.withColumn("_hashes", F.transform("_words", lambda w, i: F.xxhash64(w, *_next_words(i))))
    # The partition term is always true, but not deterministic; it keeps Spark from copying this array into filters on the
    # result, where lambda functions would sort it again for every element.
    base = base.withColumn(
        "_ranked",
        F.when(
            (F.col("n_words") > NGRAM) & (F.spark_partition_id() >= 0) & (F.size(F.array_distinct("_hashes")) < F.size("_hashes")),
            F.sort_array(
                F.transform(
                    F.slice("_hashes", 1, F.size("_words") - (NGRAM - 1)),
                    lambda h, i: F.struct(h.alias("h"), i.alias("i")),
                )
            ),
        ),
    )
    n = F.nullif(F.col("n_words"), F.lit(0))
    n_lines = F.nullif(F.size("_lines"), F.lit(0))
    out = base.select(
        *keep,
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_ranked")).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        n_lines.cast("long").alias("_n_lines"),
    )
    return out.select(
        "*",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("n_stop_words") / n).alias("stop_ratio"),
        (F.col("n_dup_lines") / F.col("_n_lines")).alias("dup_line_ratio"),
    ).drop("_n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules=RULES, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, then counts, ``base_failed`` and ``kept`` of each row of ``docs``.

    A column this operator makes gets underscores behind its name if it clashes with ``keep``.
    """
    places = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(p) for c, p in zip(keep, places, strict=True)), F.col(text).alias("text"))
    judged = measure(rows, "text", places).withColumn("base_failed", base_failed())
    judged = judged.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    made = judged.columns[len(keep) :]
    names = [*keep, *fresh(keep, *made)]
    return judged.select(*(F.col(c).alias(n) for c, n in zip(judged.columns, names, strict=True)))
