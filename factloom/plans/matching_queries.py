"""Similarity joins and record linkage: documents against benchmark items by words, suppliers and parts by what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import matching, similarity
from factloom.plans.base import query, table
from factloom.session import written

#: Words of a text as features, in both dialects: letters and figures, lower-cased.
_DOC = "d AS (SELECT DISTINCT doc_id AS doc, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS feature FROM documents), l AS (SELECT * FROM d WHERE length(feature) >= 6)"
_BENCH = "b AS (SELECT DISTINCT item_id AS doc, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS feature FROM benchmark), r AS (SELECT * FROM b WHERE length(feature) >= 6)"
_SIM = f"""WITH {_DOC}, {_BENCH}, ls AS (SELECT doc, count(*) AS n FROM l GROUP BY 1), rs AS (SELECT doc, count(*) AS n FROM r GROUP BY 1),
  m AS (SELECT l.doc AS "left", r.doc AS "right", count(*) AS shared FROM l JOIN r USING (feature) GROUP BY ALL),
  s AS (SELECT "left", "right", shared, ls.n AS ln, rs.n AS rn, shared / (ls.n + rs.n - shared) AS jaccard FROM m JOIN ls ON "left" = ls.doc JOIN rs ON "right" = rs.doc)"""


def words(df: DataFrame, key: str) -> DataFrame:
    """(doc, feature), each once."""
    w = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")))
    return df.select(F.col(key).alias("doc"), w.alias("feature")).filter(F.length("feature") >= 6).distinct()


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return words(table(spark, sf, "documents"), "doc_id"), words(table(spark, sf, "benchmark"), "item_id")


@query(f"""{_SIM}, k AS (SELECT "left", "right", jaccard, lead(jaccard) OVER w AS next, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY "left" ORDER BY jaccard DESC, "right"))
  SELECT "left" AS doc_id, "right" AS item_id, round(jaccard, 6) AS score, round(next, 6) AS runner_up, round(jaccard - coalesce(next, 0), 6) AS margin,
  CASE WHEN jaccard < 0.05 THEN 'no_match' WHEN jaccard - coalesce(next, 0) >= 0.3 THEN 'accepted' WHEN jaccard - coalesce(next, 0) >= 0.1 THEN 'caveat' ELSE 'ambiguous' END AS verdict FROM k WHERE n = 1""")
def jaccard_best_match(spark: SparkSession, sf: str) -> DataFrame:
    """Near copies of benchmark items: best match, runner-up, margin and verdict."""
    left, right = sides(spark, sf)
    best = similarity.best_two(similarity.set_similarity(left, right), "left", "right", "jaccard")
    v = similarity.verdict(F.col("jaccard"), F.col("margin"), floor=0.05)
    return best.select(F.col("left").alias("doc_id"), F.col("best").alias("item_id"), F.round("jaccard", 6).alias("score"), F.round("runner_up", 6).alias("runner_up"), F.round("margin", 6).alias("margin"), v.alias("verdict"))


@query(f"WITH {_DOC} SELECT feature, count(*) AS df FROM l GROUP BY 1")
def doc_token_df(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.document_frequency(sides(spark, sf)[0])


@query(f"WITH {_DOC}, n AS (SELECT count(*) AS total FROM documents) SELECT feature, count(*) AS df, round(greatest(ln(max(total) / count(*)), 0), 6) AS weight FROM l, n GROUP BY 1")
def idf_weights(spark: SparkSession, sf: str) -> DataFrame:
    total = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("total"))
    df = similarity.document_frequency(sides(spark, sf)[0]).crossJoin(F.broadcast(total))  # one row
    return similarity.idf(df, F.col("total")).select("feature", "df", F.round("weight", 6).alias("weight"))


@query(f"""{_SIM} SELECT "left" AS doc_id, "right" AS item_id, shared, round(shared / least(ln, rn), 6) AS overlap, round(shared / ln, 6) AS containment FROM s WHERE shared >= 3""")
def overlap_coefficient(spark: SparkSession, sf: str) -> DataFrame:
    s = similarity.set_similarity(*sides(spark, sf)).filter("shared >= 3")
    return s.select(F.col("left").alias("doc_id"), F.col("right").alias("item_id"), F.col("shared").cast("long").alias("shared"), F.round("overlap", 6).alias("overlap"), F.round("containment", 6).alias("containment"))


@query(f"""WITH {_DOC}, {_BENCH}, df AS (SELECT feature, count(*) AS n FROM r GROUP BY 1 HAVING count(*) <= 4), m AS (SELECT l.doc AS "left", r.doc AS "right", count(*) AS shared FROM l JOIN r USING (feature) JOIN df USING (feature) GROUP BY ALL)
  SELECT "left" AS doc_id, "right" AS item_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY "left" ORDER BY shared DESC, "right") AS k FROM m) WHERE k = 1""")
def rare_anchor_pin(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.anchor_pins(*sides(spark, sf)).select(F.col("left").alias("doc_id"), F.col("right").alias("item_id"), "shared")


@query(f"""WITH {_DOC}, {_BENCH}, df AS (SELECT feature, ln((SELECT count(*) FROM benchmark) / count(*)) AS w FROM r GROUP BY 1 HAVING count(*) <= 24),
  m AS (SELECT l.doc AS "left", r.doc AS "right", count(*) AS shared, sum(greatest(w, 0)) AS weight FROM l JOIN r USING (feature) JOIN df USING (feature) GROUP BY ALL),
  k AS (SELECT *, weight - coalesce(lead(weight) OVER o, 0) AS margin, row_number() OVER o AS n FROM m WINDOW o AS (PARTITION BY "left" ORDER BY round(weight, 9) DESC, "right"))
  SELECT "left" AS doc_id, "right" AS item_id, shared, round(weight, 6) AS weight FROM k WHERE n = 1 AND shared >= 2 AND weight >= 4 AND margin >= 2""")
def idf_weighted_anchor_join(spark: SparkSession, sf: str) -> DataFrame:
    left, right = sides(spark, sf)
    items = table(spark, sf, "benchmark").count()
    return similarity.idf_anchor_join(left, right, F.lit(items)).select(F.col("left").alias("doc_id"), F.col("right").alias("item_id"), "shared", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_BENCH}, df AS (SELECT feature, greatest(ln((SELECT count(*) FROM benchmark) / count(*)), 0) AS w FROM r GROUP BY 1), x AS (SELECT r.*, w FROM r JOIN df USING (feature)), mass AS (SELECT doc, sum(w) AS m FROM x GROUP BY 1),
  p AS (SELECT a.doc AS "left", b.doc AS "right", sum(a.w) AS shared FROM x a JOIN x b ON a.feature = b.feature AND a.doc < b.doc GROUP BY ALL)
  SELECT "left" AS item_id, "right" AS other_id, round(shared / (a.m + b.m - shared), 6) AS score FROM p JOIN mass a ON "left" = a.doc JOIN mass b ON "right" = b.doc""")
def idf_weighted_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    r = sides(spark, sf)[1]
    items = table(spark, sf, "benchmark").count()
    w = r.join(similarity.idf(similarity.document_frequency(r), F.lit(items)).select("feature", "weight"), "feature")
    return similarity.set_similarity(w, w, "weight").filter(F.col("left") < F.col("right")).select(F.col("left").alias("item_id"), F.col("right").alias("other_id"), F.round("jaccard", 6).alias("score"))


@query("""WITH v AS (SELECT l_suppkey AS doc, l_returnflag || l_linestatus AS feature, count(*) AS n FROM lineitem GROUP BY ALL), norm AS (SELECT doc, sqrt(sum(n * n)) AS x FROM v GROUP BY 1),
  c AS (SELECT a.s_suppkey AS "left", b.s_suppkey AS "right" FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey),
  dot AS (SELECT "left", "right", sum(a.n * b.n) AS d FROM c JOIN v a ON a.doc = "left" JOIN v b ON b.doc = "right" AND b.feature = a.feature GROUP BY ALL)
  SELECT "left", "right", round(d / (p.x * q.x), 6) AS cosine FROM dot JOIN norm p ON p.doc = "left" JOIN norm q ON q.doc = "right" """)
def keyword_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of histograms of candidate pairs: suppliers of one nation by their kinds of lines."""
    v = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("doc"), F.concat("l_returnflag", "l_linestatus").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, sf, "supplier")
    pairs = s.select("s_nationkey", F.col("s_suppkey").alias("left")).join(s.select("s_nationkey", F.col("s_suppkey").alias("right")), "s_nationkey").filter(F.col("left") < F.col("right"))
    return similarity.cosine_join(v, v, pairs).select("left", "right", F.round("cosine", 6).alias("cosine"))


@query("""WITH w AS (SELECT item_id, list_sort(list_distinct([x FOR x IN regexp_split_to_array(lower(text), '[^a-z0-9]+') IF length(x) >= 6])) AS a FROM benchmark), s AS (SELECT item_id, a[1:48] AS a FROM w),
  p AS (SELECT item_id, x.i AS i, y.j AS j, a[x.i] || '|' || a[y.j] AS pair FROM s, (SELECT unnest(generate_series(1, 48)) AS i) x, (SELECT unnest(generate_series(1, 48)) AS j) y WHERE x.i < y.j AND y.j <= len(a))
  SELECT pair, count(*) AS items FROM p GROUP BY 1 HAVING count(*) > 1""")
def anchor_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    from factloom.functions.text import cooccurring_pairs

    anchors = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) >= 6)
    pairs = table(spark, sf, "benchmark").select("item_id", F.explode(cooccurring_pairs(anchors, most=48 * 47 // 2)).alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("items")).filter("items > 1")


@query("""WITH i AS (SELECT p_brand AS identity, p_partkey AS fn_id, p_size, p_type FROM part),
  q AS (SELECT s_suppkey AS fn, 1 + s_suppkey % 50 AS p_size, t AS p_type FROM supplier, (SELECT DISTINCT p_type AS t FROM part)),
  m AS (SELECT DISTINCT fn, q.p_type, identity, fn_id FROM q JOIN i USING (p_size, p_type)) SELECT fn, p_type, min(identity) AS identity, min(fn_id) AS fn_id FROM m GROUP BY ALL HAVING count(*) = 1""")
def exact_hash_unique_owner(spark: SparkSession, sf: str) -> DataFrame:
    """A match only where all candidates are one."""
    part, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    kinds = part.select("p_type").distinct()  # a handful of types
    asked = s.select(F.col("s_suppkey").alias("fn"), (1 + F.col("s_suppkey") % 50).cast("int").alias("p_size")).crossJoin(F.broadcast(kinds))
    index = part.select("p_size", "p_type", F.col("p_brand").alias("identity"), F.col("p_partkey").alias("fn_id"))
    return matching.unique_owner(asked.withColumn("_k", F.struct("fn", "p_type")), index, ["p_size", "p_type"], "_k").select("_k.fn", "_k.p_type", "identity", "fn_id")


@query("""WITH h AS (SELECT l_suppkey AS fn, p_brand AS identity, l_partkey AS fn_id, CASE WHEN l_returnflag = 'A' AND l_quantity > 49 THEN 'exact' WHEN l_returnflag = 'R' THEN 'feature' ELSE 'structural' END AS tier FROM lineitem JOIN part ON l_partkey = p_partkey),
  t AS (SELECT DISTINCT * FROM h) SELECT fn, tier, count(*) AS candidates FROM t WHERE tier = 'exact' OR fn NOT IN (SELECT fn FROM t WHERE tier = 'exact') GROUP BY ALL""")
def cascade_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Exact matches shut out the weaker tiers of their function."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tier = lambda c: rows.filter(c).select(F.col("l_suppkey").alias("fn"), F.col("p_brand").alias("identity"), F.col("l_partkey").alias("fn_id")).distinct()
    exact = (F.col("l_returnflag") == "A") & (F.col("l_quantity") > 49)
    feature = ~exact & (F.col("l_returnflag") == "R")
    out = matching.cascade({"exact": tier(exact), "feature": tier(feature), "structural": tier(~exact & ~feature)})
    return out.groupBy("fn", "tier").agg(F.count(F.lit(1)).alias("candidates"))


@query("""SELECT l_suppkey AS ref, p_brand AS subject, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, p_brand) AS k FROM (SELECT l_suppkey, p_brand, count(DISTINCT l_orderkey) AS votes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE k = 1""")
def vote_majority(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("ref"), F.col("l_orderkey").alias("fn"), F.col("p_brand").alias("subject"))
    return matching.votes(rows, "fn", "subject", ["ref"])


@query("""WITH x AS (SELECT l_suppkey AS ref, p_brand AS subject, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
  SELECT ref, subject, CAST((q >= 26)::INT + (d >= 0.05)::INT + (t >= 0.04)::INT + (n >= 10)::INT AS BIGINT) AS signals FROM x WHERE (q >= 26)::INT + (d >= 0.05)::INT + (t >= 0.04)::INT + (n >= 10)::INT >= 3""")
def signal_agreement_3of4(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that three of four signals name. A mean at its threshold is decided by the sum in the order of the table's rows, however they are dealt."""
    l = table(spark, sf, "lineitem").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = l.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("ref"), F.col("p_brand").alias("subject"), "_file", "_row", "l_quantity", "l_discount", "l_tax")
    x = rows.groupBy("ref", "subject").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.count(F.lit(1)).alias("n"))
    near = lambda c, threshold: F.abs(F.col(c) - threshold) < 1e-9
    x = written(x.withColumn("close", F.coalesce(near("d", 0.05) | near("t", 0.04) | near("q", 26), F.lit(False))))
    of = ("ref", "subject")
    w = Window.partitionBy(*of).orderBy("_file", "_row")
    close = rows.join(x.filter("close").select(*of), [*of], "left_semi")
    sums = [F.avg(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(name) for name, c in (("q", "l_quantity"), ("d", "l_discount"), ("t", "l_tax"))]
    ordered = close.select(*of, *sums, F.row_number().over(w).alias("n"), F.lead(F.lit(1)).over(w).alias("_more")).filter("_more is null").select(*of, "q", "d", "t", F.col("n").cast("long").alias("n"))
    x = x.filter("not close").drop("close").unionByName(ordered)
    of = lambda c: x.select("ref", "subject", F.col(c).alias("score"))
    return matching.agreement({"q": (of("q"), 26), "d": (of("d"), 0.05), "t": (of("t"), 0.04), "n": (of("n"), 10)})


@query("""WITH s AS (SELECT l_suppkey, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_partkey) AS a, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, l_suppkey) AS b FROM s) SELECT l_suppkey, l_partkey, score FROM r WHERE a = 1 AND b = 1""")
def reciprocal_best(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("score"))
    return similarity.reciprocal_best(s, "l_suppkey", "l_partkey", "score")


@query("""WITH g AS (SELECT l_suppkey AS k, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY k) AS t FROM g), x AS (SELECT k, c, n / t AS score FROM s), r AS (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS i FROM x WINDOW w AS (PARTITION BY k ORDER BY score DESC, c))
  SELECT k AS l_suppkey, c AS best, round(score, 6) AS score, round(greatest(0, least(1, score - coalesce(next, 0))), 6) AS margin, CASE WHEN score - coalesce(next, 0) >= 0.3 THEN 'accepted' WHEN score - coalesce(next, 0) >= 0.1 THEN 'caveat' ELSE 'ambiguous' END AS verdict FROM r WHERE i = 1""")
def margin_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    s = n.withColumn("score", F.col("n") / F.sum("n").over(Window.partitionBy("l_suppkey")))
    best = similarity.best_two(s, "l_suppkey", "l_returnflag", "score")
    return best.select("l_suppkey", "best", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), similarity.verdict(F.col("score"), F.col("margin")).alias("verdict"))


_VERSIONS = "v AS (SELECT p_brand AS package, p_partkey % 7 || '.' || p_size || '.' || p_partkey % 11 AS version, [p_partkey % 7, p_size, p_partkey % 11] AS k FROM part)"


@query(f"""WITH {_VERSIONS}, r AS (SELECT s_suppkey AS request, 'Brand#' || (11 + s_suppkey % 40) AS package, s_suppkey % 7 AS a, s_suppkey % 50 AS b, ['^', '~', '<', ''][1 + s_suppkey % 4] AS op FROM supplier),
  q AS (SELECT *, op || a || '.' || b || '.0' AS requirement, CASE WHEN op = '<' THEN [0, 0, 0] ELSE [a, b, 0] END AS lo,
    CASE op WHEN '^' THEN CASE WHEN a > 0 THEN [a + 1, 0, 0] WHEN b > 0 THEN [0, b + 1, 0] ELSE [0, 0, 1] END WHEN '~' THEN [a, b + 1, 0] WHEN '<' THEN [a, b, 0] ELSE [a, b, 1] END AS hi FROM r)
  SELECT request, package, requirement, arg_max(version, k) AS version FROM q JOIN v USING (package) WHERE k >= lo AND k < hi GROUP BY ALL""")
def semver_range_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest version that each requirement admits."""
    text = lambda c: c.cast("string")
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    versions = table(spark, sf, "part").select(F.col("p_brand").alias("package"), F.concat_ws(".", text(p % 7), text(F.col("p_size")), text(p % 11)).alias("version"))
    op = F.element_at(F.array(*map(F.lit, ["^", "~", "<", ""])), (1 + s % 4).cast("int"))
    requests = table(spark, sf, "supplier").select(s.alias("request"), F.concat(F.lit("Brand#"), text(11 + s % 40)).alias("package"), F.concat(op, text(s % 7), F.lit("."), text(s % 50), F.lit(".0")).alias("requirement"))
    return matching.range_join(requests, versions)


@query("""WITH h AS (SELECT l_suppkey AS module, p_brand AS package, CAST(p_size AS VARCHAR) || '.0.0' AS version, p_size AS v, count(*) FILTER (WHERE l_returnflag = 'A') AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS w, count(*) FILTER (WHERE l_linestatus = 'O') AS a, count(*) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  x AS (SELECT *, 10000 * s + 1000 * w + 10 * a + t AS score FROM h), r AS (SELECT *, row_number() OVER o AS n, lead(package) OVER o AS np, lead(score) OVER o AS ns FROM x WINDOW o AS (PARTITION BY module ORDER BY score DESC, s DESC, w DESC, v DESC, package, version))
  SELECT module, package, CASE WHEN NOT coalesce(np = package AND ns = score, false) THEN version END AS version, score, CASE WHEN coalesce(np = package AND ns = score, false) THEN 'aggregate' ELSE 'version' END AS strategy FROM r WHERE n = 1""")
def version_score_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    hits = rows.groupBy(F.col("l_suppkey").alias("module"), F.col("p_brand").alias("package"), F.concat(F.col("p_size").cast("string"), F.lit(".0.0")).alias("version")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("sources"), F.count_if(F.col("l_returnflag") == "R").alias("windows"), F.count_if(F.col("l_linestatus") == "O").alias("anchors"), F.count(F.lit(1)).alias("tokens")
    )
    return matching.version_ranking(hits)


@query("""WITH b AS (SELECT p_brand AS package, CAST(p_size AS VARCHAR) AS version, p_type AS family, p_name AS hint, max(p_retailprice) AS score, max(p_retailprice > 1000) AS importable FROM part GROUP BY ALL), t AS (SELECT package, version, family, round(sum(score), 2) AS score, bool_or(importable) AS importable FROM b GROUP BY ALL)
  SELECT package, version, family, score, importable FROM (SELECT *, row_number() OVER (PARTITION BY package, version ORDER BY score DESC, importable DESC, family) AS n FROM t) WHERE n = 1""")
def build_variant_family(spark: SparkSession, sf: str) -> DataFrame:
    hints = table(spark, sf, "part").select(F.col("p_brand").alias("package"), F.col("p_size").cast("string").alias("version"), F.col("p_type").alias("family"), F.col("p_name").alias("hint"), F.col("p_retailprice").alias("score"), (F.col("p_retailprice") > 1000).alias("importable"))
    return matching.build_variant(hints).withColumn("score", F.round("score", 2))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), c AS (SELECT label, list(vec_id) AS ids FROM e GROUP BY 1), m AS (SELECT e.label AS center, i, avg(v[i]) AS x FROM e, (SELECT unnest(generate_series(1, (SELECT max(len(embedding)) FROM embeddings))) AS i) GROUP BY ALL), cv AS (SELECT center, list(x ORDER BY i) AS v FROM m GROUP BY 1),
  s AS (SELECT vec_id, label, center, list_cosine_similarity(e.v, cv.v) AS cosine FROM e, cv), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(cosine, 9) DESC, center) AS k FROM s)
  SELECT vec_id, label, center, k AS rank, round(cosine, 5) AS cosine FROM r WHERE k <= 3""")
def embedding_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The three label centres nearest to each vector; centres are as few as labels."""
    from factloom.functions.text import cosine

    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    each = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centers = each.groupBy(F.col("label").alias("center")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    scored = e.crossJoin(F.broadcast(centers)).withColumn("cosine", cosine(F.col("v"), F.col("c")))  # a row for each label
    top = similarity.top_k(scored, "vec_id", [F.round("cosine", 9).desc(), F.col("center")], 3)
    return top.select("vec_id", "label", "center", F.col("rank").cast("long").alias("rank"), F.round("cosine", 5).alias("cosine"))
