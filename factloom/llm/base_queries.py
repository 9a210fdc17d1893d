"""The columns of operators 1, 6 and 10 that SQL can express, with their SQL: the same operators, fewer columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import fingerprints, katz, quality
from factloom.llm.common import documents


def edited_text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and edited texts of operator 1."""
    rows = fingerprints.edited_pairs(documents(spark, sf_dir))
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules of operator 6, without a forest."""
    return quality.judge(documents(spark, sf_dir), None).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def language_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and base scores of operator 10."""
    rows = katz.score(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda h, b: "
    "list_reduce(list_prepend(xor(h, b), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)), 4294967295::UBIGINT)"
)

QUERIES = {"edited_text_digests": edited_text_digests, "quality_base_counts": quality_base_counts, "language_base_scores": language_base_scores}

ORACLE_SQL = {
    "edited_text_digests": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nx FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(nx, 1, length(t) // 3)) AS edited_sha256 FROM n
""",
    "quality_base_counts": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM d, unnest(generate_series(1, len(w) - 7)) u(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM s) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 7)) AS k FROM twice) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
       coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id
""",
    "language_base_scores": rf"""
WITH d AS (SELECT doc_id, {_CRC} % 10 = 0 AS held_out, list_append({_WORDS.format(_LOWER.format("coalesce(text, '')"))}, chr(10)) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(max(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 3) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held_out
""",
}
