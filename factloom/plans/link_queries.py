"""Record linkage tiers, graph rules and merges, bound to the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import assign, dml, graph, matching, similarity
from factloom.plans.base import query, table

_LINES = "lineitem JOIN part ON l_partkey = p_partkey"
_FN = "l_orderkey * 10 + l_linenumber"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))


def fn() -> Column:
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fn")


@query("""WITH i AS (SELECT p_brand AS identity, p_partkey AS fn_id, p_size % 10 AS params, p_partkey % 20 AS statements, p_partkey % 13 AS ast FROM part), q AS (SELECT l_orderkey AS fn, l_linenumber AS pos, CAST(l_quantity AS BIGINT) % 10 AS params, l_partkey % 20 AS statements, l_partkey % 13 AS ast FROM lineitem),
  w AS (SELECT fn, pos, min(identity) AS identity, min(fn_id) AS fn_id FROM q JOIN i USING (params, statements, ast) GROUP BY ALL HAVING count(DISTINCT (identity, fn_id)) = 1) SELECT fn, identity, fn_id FROM (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY pos) AS n FROM w) WHERE n = 1""")
def exact_alternates(spark: SparkSession, sf: str) -> DataFrame:
    """The first pass of a function that has one winner."""
    p = F.col("p_partkey")
    index = table(spark, sf, "part").select(F.col("p_brand").alias("identity"), p.alias("fn_id"), (F.col("p_size") % 10).cast("long").alias("params"), (p % 20).alias("statements"), (p % 13).alias("ast"))
    l = F.col("l_partkey")
    asked = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity").cast("long") % 10).alias("params"), (l % 20).alias("statements"), (l % 13).alias("ast"))
    return matching.exact_alternates(asked, index)


def _axes(rows: DataFrame, keys: list, axes: dict) -> DataFrame:
    """(keys..., axis, hash) of several columns as axes."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), h.cast("string").alias("hash")) for a, h in axes.items()]))
    return rows.select(*keys, each.alias("x")).select(*[k for k in rows.select(*keys).columns], "x.*")


@query(f"""WITH q AS (SELECT DISTINCT {_FN} AS fn, p_size, p_type, p_brand, p_name FROM {_LINES}), few AS (SELECT p_size, p_type FROM part GROUP BY ALL HAVING count(*) <= 250),
  m AS (SELECT DISTINCT fn, i.p_brand AS identity, i.p_partkey AS fn_id FROM q JOIN few USING (p_size, p_type) JOIN part i USING (p_size, p_type) WHERE EXISTS (SELECT 1 FROM q x WHERE x.fn = q.fn AND (x.p_brand = i.p_brand OR x.p_name = i.p_name)))
  SELECT fn, min(identity) AS identity, min(fn_id) AS fn_id FROM m GROUP BY 1 HAVING count(*) = 1""")
def structural_anchored(spark: SparkSession, sf: str) -> DataFrame:
    """Equal parameters and flow, and an anchor axis in common with the same candidate."""
    rows, part = lines(spark, sf), table(spark, sf, "part")
    asked = rows.select(fn(), F.col("p_size").alias("params"), F.col("p_type").alias("cfg")).distinct()
    index = part.select(F.col("p_brand").alias("identity"), F.col("p_partkey").alias("fn_id"), F.col("p_size").alias("params"), F.col("p_type").alias("cfg"))
    axes = {"literal_anchor": F.col("p_brand"), "callee_set": F.col("p_name")}
    return matching.anchored(asked, index, _axes(rows, [fn()], axes), _axes(part, [F.col("p_brand").alias("identity"), F.col("p_partkey").alias("fn_id")], axes))


@query("""WITH q AS (SELECT o_orderkey AS fn, i.* FROM orders JOIN part i ON p_partkey = o_orderkey % (SELECT count(*) FROM part)), a AS (SELECT fn, p_brand || '/' || p_size AS la, p_name AS cs, p_type AS ap, fn % 5 AS ef FROM q), i AS (SELECT p_brand AS identity, p_partkey AS fn_id, p_brand || '/' || p_size AS la, p_name AS cs, p_type AS ap, p_partkey % 5 AS ef FROM part),
  few AS (SELECT la FROM i GROUP BY 1 HAVING count(*) <= 250), s AS (SELECT a.fn, identity, fn_id, ((a.cs IN (SELECT cs FROM i x WHERE x.fn_id = i.fn_id))::INT + (a.ap = i.ap)::INT + (a.ef = i.ef)::INT) / 3 AS score FROM a JOIN few USING (la) JOIN i USING (la)),
  r AS (SELECT *, row_number() OVER w AS n, coalesce(lead(score) OVER w = score, false) AS tied FROM s WINDOW w AS (PARTITION BY fn ORDER BY score DESC, identity, fn_id)) SELECT fn, identity, fn_id, round(score, 6) AS score FROM r WHERE n = 1 AND score >= 0.6 AND NOT tied""")
def feature_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by the most telling axis, scored by the rest of the axes."""
    part = table(spark, sf, "part")
    n = part.count()
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("fn"), (F.col("o_orderkey") % n).alias("p_partkey")).join(part.hint("merge"), "p_partkey")
    axes = lambda x: {"literal_anchor": F.concat_ws("/", "p_brand", F.col("p_size").cast("string")), "callee_set": F.col("p_name"), "access_pattern": F.col("p_type"), "effect_pattern": x % 5}
    out = matching.feature_similarity(_axes(rows, [F.col("fn")], axes(F.col("fn"))), _axes(part, [F.col("p_brand").alias("identity"), F.col("p_partkey").alias("fn_id")], axes(F.col("p_partkey"))))
    return out.select("fn", "identity", "fn_id", F.round("score", 6).alias("score"))


@query(f"""WITH i AS (SELECT p_brand AS identity, p_partkey AS fn_id, p_size || p_type || p_name AS h FROM part), f AS (SELECT h, min(identity) AS identity, min(fn_id) AS fn_id FROM i GROUP BY 1 HAVING count(*) <= 50 AND count(DISTINCT identity) = 1) SELECT {_FN} AS fn, identity, fn_id FROM {_LINES} JOIN f ON h = p_size || p_type || p_name""")
def structural_only(spark: SparkSession, sf: str) -> DataFrame:
    """One rare axis that one identity alone holds."""
    axes = {"structural_anchor": F.concat(F.col("p_size").cast("string"), "p_type", "p_name")}
    part = table(spark, sf, "part")
    return matching.structural(_axes(lines(spark, sf), [fn()], axes), _axes(part, [F.col("p_brand").alias("identity"), F.col("p_partkey").alias("fn_id")], axes))


@query(f"""WITH n AS (SELECT l_suppkey AS ref, count(DISTINCT l_orderkey) AS functions FROM lineitem GROUP BY 1), c AS (SELECT l_suppkey AS ref, p_type AS subject, count(DISTINCT l_orderkey) AS k FROM {_LINES} GROUP BY ALL), x AS (SELECT ref, subject, k / functions AS coverage FROM c JOIN n USING (ref)),
  r AS (SELECT *, row_number() OVER w AS n, coalesce(lead(coverage) OVER w, 0) AS second FROM x WINDOW w AS (PARTITION BY ref ORDER BY coverage DESC, subject)) SELECT ref, subject, round(coverage, 6) AS coverage, round(greatest(coverage, 0.85 * (coverage + second)), 6) AS score FROM r WHERE n = 1 AND coverage >= 0.1""")
def majority_pin(spark: SparkSession, sf: str) -> DataFrame:
    """Every function votes once for a subject; coverage alone or with the runner-up."""
    hits = lines(spark, sf).select(F.col("l_suppkey").alias("ref"), F.col("l_orderkey").alias("fn"), F.col("p_type").alias("subject"))
    out = matching.majority_pin(hits, hits.groupBy("ref").agg(F.count_distinct("fn").alias("functions")))
    return out.select("ref", "subject", F.round("coverage", 6).alias("coverage"), F.round("score", 6).alias("score"))


_FAMILIES = """SELECT l_suppkey AS doc, 'part' AS family, CAST(l_partkey AS VARCHAR) AS feature FROM lineitem WHERE {0} UNION SELECT l_suppkey, 'price', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '/' || l_linenumber FROM lineitem WHERE {0} UNION SELECT l_suppkey, 'order', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE {0}"""


@query(f"""WITH l AS ({_FAMILIES.format("l_linestatus = 'O'")}), r AS ({_FAMILIES.format("l_linestatus = 'F'")}), d AS (SELECT family, feature, greatest(ln(1000 / count(*)), 0) AS w FROM r GROUP BY ALL),
  s AS (SELECT l.doc AS a, r.doc AS b, l.family, count(*) AS n, sum(w * w) AS mass FROM l JOIN r USING (family, feature) JOIN d USING (family, feature) GROUP BY ALL),
  lm AS (SELECT doc AS a, family, count(*) AS ln_, sum(coalesce(w, ln(1000)) ** 2) AS m FROM l LEFT JOIN d USING (family, feature) GROUP BY ALL), rm AS (SELECT doc AS b, family, count(*) AS rn, sum(coalesce(w, ln(1000)) ** 2) AS m FROM r LEFT JOIN d USING (family, feature) GROUP BY ALL),
  x AS (SELECT a, b, sum((n / least(ln_, rn) + n / (ln_ + rn - n) + n / ln_ + coalesce(mass / nullif(sqrt(lm.m * rm.m), 0), 0)) / 4) AS score FROM s JOIN lm USING (a, family) JOIN rm USING (b, family) GROUP BY ALL)
  SELECT a AS "left", b AS "right", a.n_ = b.n_ AS same_source, round(score, 5) AS score FROM x JOIN (SELECT s_suppkey AS a, s_nationkey AS n_ FROM supplier) a USING (a) JOIN (SELECT s_suppkey AS b, s_nationkey AS n_ FROM supplier) b USING (b)""")
def source_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-source hashes and three families of features: overlap, Jaccard, containment and weighted mass of each."""
    l = table(spark, sf, "lineitem")
    text = lambda c: F.col(c).cast("string")
    families = {"part": text("l_partkey"), "price": F.concat_ws("/", F.col("l_quantity").cast("long").cast("string"), text("l_linenumber")), "order": text("l_orderkey")}
    of = lambda status: _axes(l.filter(F.col("l_linestatus") == status), [F.col("l_suppkey").alias("doc")], families).select("doc", F.col("axis").alias("family"), F.col("hash").alias("feature"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc"), F.col("s_nationkey").alias("hash"))
    hashes = s.withColumn("side", F.lit("left")).unionByName(s.withColumn("side", F.lit("right")))
    # There may be billions of pairs, and round() goes by way of decimals.
    return similarity.source_evidence(of("O"), of("F"), hashes, F.lit(1000.0)).select("left", "right", "same_source", (F.floor(F.col("score") * 1e5 + 0.5) / 1e5).alias("score"))





@query("""WITH x AS (SELECT DISTINCT l_suppkey AS doc, 'part' AS axis, CAST(l_partkey AS VARCHAR) AS feature FROM lineitem UNION SELECT DISTINCT l_suppkey, 'order', CAST(l_orderkey AS VARCHAR) FROM lineitem), r AS (SELECT * FROM x WHERE doc % 2 = 1), l AS (SELECT * FROM x WHERE doc % 2 = 0),
  d AS (SELECT axis, feature, greatest(ln(100 / count(*)), 0) AS w FROM r GROUP BY ALL), lw AS (SELECT l.*, coalesce(w, ln(100)) AS w FROM l LEFT JOIN d USING (axis, feature)), rw AS (SELECT r.*, w FROM r JOIN d USING (axis, feature)),
  s AS (SELECT a.doc AS a, b.doc AS b, axis, sum(a.w) AS shared FROM lw a JOIN rw b USING (axis, feature) GROUP BY ALL), lm AS (SELECT doc AS a, axis, sum(w) AS m FROM lw GROUP BY ALL), rm AS (SELECT doc AS b, axis, sum(w) AS m FROM rw GROUP BY ALL), ax AS (SELECT doc AS a, count(DISTINCT axis) AS k FROM l GROUP BY 1)
  SELECT a AS "left", b AS "right", round(sum(CASE WHEN lm.m + rm.m - shared <= 0 THEN 0 ELSE shared / (lm.m + rm.m - shared) END) / max(k), 6) AS score FROM s JOIN lm USING (a, axis) JOIN rm USING (b, axis) JOIN ax USING (a) GROUP BY ALL""")
def axis_mass(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over axes of similarity by weighted mass: even suppliers against odd ones."""
    x = _axes(table(spark, sf, "lineitem"), [F.col("l_suppkey").alias("doc")], {"part": F.col("l_partkey"), "order": F.col("l_orderkey")}).select("doc", "axis", F.col("hash").alias("feature")).distinct()
    return similarity.multi_axis(x.filter("doc % 2 = 0"), x.filter("doc % 2 = 1"), F.lit(100.0)).withColumn("score", F.round("score", 6))


_NEXT = "(SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY {}, o_orderkey) AS dst FROM orders)"


@query(f"""WITH l AS (SELECT * FROM {_NEXT.format('o_orderdate')} WHERE dst IS NOT NULL), r AS (SELECT * FROM {_NEXT.format('o_totalprice')} WHERE dst IS NOT NULL), s AS (SELECT o_orderkey AS a, o_orderkey AS b FROM orders WHERE o_orderstatus <> 'P'),
  k AS (SELECT src AS "left", b, 's' AS way FROM l JOIN s ON a = dst UNION ALL SELECT dst, b, 'd' FROM l JOIN s ON a = src), m AS (SELECT src AS "right", dst AS b, 's' AS way FROM r UNION ALL SELECT dst, src, 'd' FROM r),
  n AS (SELECT "left", count(*) AS known FROM k GROUP BY 1) SELECT "left", "right", count(*) AS matched, known FROM k JOIN m USING (b, way) JOIN n USING ("left") GROUP BY ALL""")
def neighbourhood_support(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours by date that are mirrored by neighbours by price, by way of seeds."""
    o = table(spark, sf, "orders")
    near = lambda c: o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy(c, "o_orderkey")).alias("dst")).filter("dst is not null")
    seeds = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("left"), F.col("o_orderkey").alias("right"))
    return graph.neighbourhood_support(near("o_orderdate"), near("o_totalprice"), seeds)


@query("""WITH c AS (SELECT o_custkey AS parent, o_orderpriority AS candidate, count(DISTINCT o_orderkey) AS children FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderkey) >= 2) SELECT parent, candidate, children FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY children DESC, candidate) AS n FROM c) WHERE n = 1""")
def promote_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Parents named by what two children or more agree on."""
    return graph.promote_parents(table(spark, sf, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"), F.col("o_orderpriority").alias("candidate")))


@query("""WITH a AS (SELECT o_custkey, o_orderkey AS "left", row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderkey AS "right", row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders WHERE o_orderstatus = 'O') SELECT "left", "right" FROM a JOIN b USING (o_custkey, i)""")
def positional_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """The i-th filled order of a customer with the i-th open one."""
    o = table(spark, sf, "orders")
    listed = lambda status, name: o.filter(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("x")).select("o_custkey", F.posexplode("x").alias("i", "x")).select("o_custkey", "i", F.col("x.o_orderkey").alias(name))
    return listed("F", "left").join(listed("O", "right"), ["o_custkey", "i"]).select("left", "right")


@query("""WITH c AS (SELECT l_suppkey AS r, p_brand AS c, CASE WHEN l_returnflag = 'A' THEN 'exact' WHEN l_returnflag = 'R' THEN 'feature' ELSE 'structural' END AS tier, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS rank FROM lineitem JOIN part ON l_partkey = p_partkey), d AS (SELECT DISTINCT * FROM c),
  w AS (SELECT *, (row_number() OVER (PARTITION BY r ORDER BY rank, c) - 1) AS place FROM d) SELECT r AS "row", c AS col, round(max(CASE tier WHEN 'exact' THEN 10000 WHEN 'feature' THEN 100 ELSE 10 END * (1 - 0.1 * least(place, 4))), 6) AS weight FROM w GROUP BY ALL""")
def edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of an assignment by tier and place in the list."""
    flag = F.col("l_returnflag")
    rank = F.when(flag == "A", 0).when(flag == "R", 1).otherwise(2)
    tier = F.when(flag == "A", "exact").when(flag == "R", "feature").otherwise("structural")
    c = lines(spark, sf).select(F.col("l_suppkey").alias("row"), F.col("p_brand").alias("col"), tier.alias("tier"), rank.alias("rank")).distinct()
    return matching.edge_weights(c, "row", "col").withColumn("weight", F.round("weight", 6))


@query("""WITH n AS (SELECT o_custkey AS c_custkey, max(o_orderdate) AS latest, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END) AS evidence FROM orders GROUP BY 1)
  SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN c_name ELSE strftime(latest, '%Y-%m-%d') END AS c_name, coalesce(evidence, c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN n ON n.c_custkey = c.c_custkey""")
def upsert_keeps_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """New values replace old ones, but for evidence that the new rows lack."""
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    urgent = F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("c_name"), urgent.alias("c_mktsegment"))
    return dml.upsert(old, new, ["c_custkey"], keep_if_null=("c_mktsegment",))


@query("""SELECT c_custkey, c_name FROM customer UNION ALL SELECT k, 'Customer ' || k FROM (SELECT DISTINCT o_custkey + 500 AS k FROM orders) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = k)""")
def insert_where_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose key isn't there yet."""
    key = (F.col("o_custkey") + 500).alias("c_custkey")
    new = table(spark, sf, "orders").select(key).withColumn("c_name", F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")))
    return dml.insert_missing(table(spark, sf, "customer").select("c_custkey", "c_name"), new, ["c_custkey"])


@query("""WITH RECURSIVE p AS (SELECT CAST(o_custkey AS VARCHAR) AS reference, CAST(o_orderkey AS VARCHAR) AS subject, o_orderpriority AS name, o_totalprice AS score FROM orders) SELECT reference, subject, name, score FROM (SELECT *, row_number() OVER (PARTITION BY reference, name ORDER BY score DESC, subject) AS n FROM p) WHERE n = 1""")
def distinct_names(spark: SparkSession, sf: str) -> DataFrame:
    """Of a reference's proposals, strongest first, those whose name is still free."""
    o = table(spark, sf, "orders")
    return assign.distinct_names(o.select(F.col("o_custkey").cast("string").alias("reference"), F.col("o_orderkey").cast("string").alias("subject"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("score")))
