"""Scalar functions over the tables' names, and scanners over pages' scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scan, text
from factloom.operators import reports, similarity
from factloom.plans.base import FNV, query, table


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' (' || p_type || ')', '[^A-Za-z0-9_/-]+', '-', 'g'), '-{2,}', '-', 'g'), '-') AS slug, 'modules/' || p_partkey || '-' || trim(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_/-]+', '-', 'g'), '-{2,}', '-', 'g'), '-') || '.ts' AS path FROM part""")
def slug_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.slugify(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"), text.module_path(F.col("p_partkey"), F.col("p_name"), F.lit("ts")).alias("path"))


@query("""WITH t AS (SELECT p_partkey, [x FOR x IN string_split(lower(regexp_replace(p_type || '_' || p_name || '2', '[^A-Za-z0-9]+', ' ', 'g')), ' ') IF x <> '' AND NOT regexp_full_match(x, '[0-9]+')] AS t FROM part) SELECT p_partkey, array_to_string(t, ' ') AS tokens FROM t""")
def name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.name_tokens(F.concat("p_type", F.lit("_"), "p_name", F.lit("2"))), " ").alias("tokens"))


@query("""SELECT p_partkey, n, length(n) > 0 AND (length(n) <= 2 OR contains(n, '$') OR (length(n) <= 4 AND (NOT regexp_matches(n, '[aeiouAEIOU]') OR regexp_matches(n, '[0-9]')))) AS minified FROM (SELECT p_partkey, substr(p_name, 1, 1 + p_size % 6) AS n FROM part) WHERE n = trim(n)""")
def minified_names(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").select("p_partkey", F.expr("substring(p_name, 1, 1 + p_size % 6)").alias("n")).filter("n = trim(n)")
    return n.select("p_partkey", "n", text.is_minified(F.col("n")).alias("minified"))


@query("""SELECT s_suppkey, n_nationkey, CASE WHEN s_acctbal::BIGINT = 0 OR n_nationkey = 0 THEN 0.5 ELSE round(greatest(1 - abs(abs(s_acctbal)::BIGINT - n_nationkey) / (abs(s_acctbal)::BIGINT + n_nationkey), 0.1), 6) END AS prior FROM (SELECT s_suppkey, abs(s_acctbal)::BIGINT AS s_acctbal, s_nationkey AS n_nationkey FROM supplier)""")
def size_prior(spark: SparkSession, sf: str) -> DataFrame:
    # Halves go to the even number, as they do when SQL casts to whole numbers.
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), F.rint(F.abs("s_acctbal")).cast("long").alias("a"))
    return s.select("s_suppkey", "n_nationkey", F.round(text.size_prior(F.col("a"), F.col("n_nationkey")), 6).alias("prior"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(string_split(regexp_replace(url, '^https?://[^/]+/?', ''), '/')) AS depth, len(regexp_extract_all(html, 'href="/[^"]*"')) AS links FROM pages""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Local references of a page, extracted natively."""
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.size(F.split(F.regexp_replace("url", "^https?://[^/]+/?", ""), "/")).cast("long").alias("depth"), F.size(F.regexp_extract_all("html", F.lit('href="/[^"]*"'), F.lit(0))).cast("long").alias("links"))


@query("""WITH w AS (SELECT item_id, [x FOR x IN string_split_regex(lower(text), '[^a-z]+') IF x <> ''] AS t FROM benchmark), g AS (SELECT item_id, unnest([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN generate_series(1, len(t) - 2)]) AS g FROM w) SELECT g AS ngram, count(DISTINCT item_id) AS items, count(*) AS n FROM g GROUP BY 1""")
def sequence_windows(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    g = table(spark, sf, "benchmark").select("item_id", F.explode(similarity.sequence_windows(words, 3)).alias("ngram"))
    return g.groupBy("ngram").agg(F.count_distinct("item_id").alias("items"), F.count(F.lit(1)).alias("n"))


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, source): the script text of each page."""
    return table(spark, sf, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n").alias("source"))


@query()
def script_literals(spark: SparkSession, sf: str) -> DataFrame:
    """Strings, specifiers and members of page scripts. (Scanners; tested on fixtures.)"""
    s = scripts(spark, sf)
    return s.select("page_id", F.array_join(scan.string_literals("source"), "|").alias("literals"), F.array_join(scan.import_specifiers("source"), "|").alias("specifiers"), F.array_join(scan.property_names("source"), "|").alias("properties"))


@query()
def script_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts in their common form, and the passes that changed them. (Tested on fixtures.)"""
    n = scripts(spark, sf).select("page_id", scan.normalize("source").alias("n"))
    return n.select("page_id", F.col("n.source").alias("source"), F.array_join("n.passes", ",").alias("passes"))


@query("""SELECT page_id, CASE WHEN contains(html, '__webpack_require__') THEN 'webpack' WHEN regexp_matches(html, 'function\\s*\\(') THEN 'script' ELSE 'plain' END AS kind FROM pages""")
def wrapper_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Bundle marks in whole pages, folded to three kinds."""
    k = reports.wrapper_kind(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.when(k == "webpack", "webpack").when(F.col("html").rlike(r"function\s*\("), "script").otherwise("plain").alias("kind"))


@query(f"SELECT p_partkey, {FNV.format('p_name')} AS fnv FROM part")
def fnv_names(spark: SparkSession, sf: str) -> DataFrame:
    """FNV-1a of part names."""
    return table(spark, sf, "part").select("p_partkey", scan.fnv1a_hex("p_name").alias("fnv"))
