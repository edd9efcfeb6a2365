"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, jaccard, langid, licenses, packing, periodic, pieces, pii, quality, tokens, toxicity, warc
from .session import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(
        "doc_id", F.size("matches").alias("n_matches"), F.array_join(names, ",").alias("licenses"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])), ",").alias("spans"),
        F.array_max(F.transform("matches", lambda m: m["containment"])).alias("best_containment"),
    )


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.deduplicated(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op5_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.verdicts(found)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = langid.predict(docs, langid.fit(docs))
    return told.select("doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_token_counts": op4_token_counts,
    "op5_length_packing": op5_length_packing,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_pii": op10_pii,
    "op11_token_alignment": op11_token_alignment,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_periodic_runs": op13_periodic_runs,
}


def _stop_list() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(quality.STOP_WORDS)))


_WS = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{_WS}') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WS}')) AS lines FROM t
), g AS (
  SELECT rid, i, array_to_string(words[i:i+4], ' ') AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), r AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1
), rw AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM r) GROUP BY rid
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rw.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: x IN ({_stop_list()}))) AS n_stop
  FROM w LEFT JOIN rw USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1
         AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM m
"""

_B32 = " || ".join(
    "(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"((('0x' || substr(h, {1 + 5 * k}, 5))::INT >> (15 - 5 * j)) & 31) + 1, 1), '' ORDER BY j) FROM range(4) r(j))"
    for k in range(8)
)
OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM q
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), m AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN s USING (rid)
"""

#: Whole self-join on shingles; links are followed to the end.
OP9_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(text, '{_WS}') AS w FROM documents
), c AS (
  SELECT row_number() OVER () AS k, w, min(doc_id) AS least_id, count(*) AS n_copies
  FROM d WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY w
), g AS (
  SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM c WHERE len(w) > 0)
), s AS (SELECT k, count(*) AS n FROM g GROUP BY k), p AS (
  SELECT a.k AS x, b.k AS y, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.k < b.k GROUP BY a.k, b.k
), e AS (
  SELECT x, y FROM p JOIN s a ON a.k = x JOIN s b ON b.k = y WHERE 5 * p.n >= 4 * (a.n + b.n - p.n)
), l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), r AS (
  SELECT k, k AS z FROM c UNION SELECT r.k, l.y FROM r JOIN l ON l.x = r.z
), m AS (SELECT r.k, min(least_id) AS class_id FROM r JOIN c ON c.k = r.z GROUP BY r.k),
n AS (SELECT x AS k, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM d LEFT JOIN c ON d.doc_id IS NOT NULL AND d.text IS NOT NULL AND d.w = c.w
LEFT JOIN m ON m.k = c.k LEFT JOIN n ON n.k = c.k
"""

ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op3_warc_revisits": OP3_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op9_ngram_jaccard_join": OP9_SQL,
}
