"""Line dedup on DataFrame functions alone.

Lines are exploded, normalised and hashed; a hash found in enough distinct documents loses its lines everywhere but in
the largest doc_id that holds it; what stays is joined again in its order.

Defined results: a null or empty text has one empty line; a null doc_id is a document of its own that never outranks
another; rows with the same doc_id are one document for the count, and each row is cleaned; an empty table gives an
empty one; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import SPACE, documents
from factloom.session import written

MIN_CHARS = 40
MIN_DOCS = 5


def ascii_lower(text: Column) -> Column:
    """A-Z only. Where every character is one byte, lower() does just that and is far cheaper than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def line_keys(lines: Column, min_chars: int) -> Column:
    """128-bit hashes of the normalised lines; null for lines too short to count."""
    stripped = F.transform(lines, lambda line: F.btrim(line, F.lit(SPACE)))
    return F.transform(
        F.transform(stripped, lambda line: F.when(F.char_length(line) >= min_chars, ascii_lower(line))),
        lambda key: F.when(key.isNotNull(), F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """docs with `text_col` cleaned, and, with `counts`, the columns n_lines and n_dropped in place of any that docs has under these names."""
    # All columns of docs ride in one, so that none can clash with those used here.
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = lambda c: F.col("row").getField(c)
    # Nulls don't count in count_distinct and max; they get a number below all others.
    doc = F.coalesce(row(id_col).cast("long"), F.lit(-(2**63))).alias("doc")
    # One row per document and key, so a line that fills one document doesn't count more than once.
    keyed = given.select(doc, F.split(row(text_col), "\n").alias("lines"))
    keyed = keyed.select("doc", F.explode(F.array_distinct(F.filter(line_keys(F.col("lines"), min_chars), lambda k: k.isNotNull()))).alias("key"))
    keyed = keyed.select("doc", F.col("key.a").alias("a"), F.col("key.b").alias("b"))
    often = keyed.groupBy("a", "b").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last")).filter(F.col("n") >= min_docs).drop("n")
    # Written, so that the join below reads nothing but its two sides and Spark can split a key that very many documents share.
    often = written(often)
    lost = keyed.join(often, ["a", "b"]).filter(F.col("doc") != F.col("last")).groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("lost"))
    rows = given.withColumn("doc", doc).join(lost, "doc", "left")
    rows = rows.withColumn("lines", F.split(F.coalesce(row(text_col), F.lit("")), "\n"))
    # Only rows that lose something need their keys again.
    drop = F.zip_with(F.col("lines"), line_keys(F.col("lines"), min_chars), lambda line, key: F.when(key.isNull() | ~F.array_contains(F.col("lost"), key), line))
    rows = rows.withColumn("kept", F.when(F.col("lost").isNotNull(), drop).otherwise(F.col("lines")))
    text = F.array_join("kept", "\n").alias(text_col)
    if not counts:
        return rows.select(*[text if c == text_col else row(c).alias(c) for c in docs.columns])
    return rows.select(
        *[row(c).alias(c) for c in docs.columns if c != text_col and c not in ("n_lines", "n_dropped")],
        text,
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("kept", lambda x: x.isNull())).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, often.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
