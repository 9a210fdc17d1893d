"""More of the inventory: pinned and exact-source joins, data dependences, lattices, bags, diagnostics, caches and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fingerprint, text
from factloom.operators import graph, matching, reports, similarity
from factloom.plans.base import query, table
from factloom.plans.graph_queries import _CHAINS, _FACTS, chains, facts
from factloom.plans.text_queries import scripts


@query("""WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), u AS (SELECT h, count(DISTINCT doc_id) AS n, min(doc_id) AS owner FROM h GROUP BY 1) SELECT doc_id, h AS source_hash, n AS holders, owner FROM h JOIN u USING (h) WHERE n > 1""")
def exact_source_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose whole text others have too, by hash, with the least of them."""
    h = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))
    u = h.groupBy("source_hash").agg(F.count_distinct("doc_id").alias("holders"), F.min("doc_id").alias("owner")).filter("holders > 1")
    return h.join(u, "source_hash").select("doc_id", "source_hash", "holders", "owner")


@query(f"""WITH {_FACTS}, r AS (SELECT DISTINCT module_id, binding FROM facts WHERE kind = 'read') SELECT module_id, binding, CASE WHEN bool_or(kind = 'definition') THEN 'definition' ELSE 'import' END AS source FROM r JOIN (SELECT DISTINCT * FROM facts WHERE kind IN ('definition', 'import')) USING (module_id, binding) GROUP BY ALL""")
def data_dependences(spark: SparkSession, sf: str) -> DataFrame:
    return graph.data_dependences(facts(spark, sf))


@query(f"WITH {_FACTS} SELECT module_id, binding, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'unknown' END AS type FROM facts GROUP BY ALL")
def type_join(spark: SparkSession, sf: str) -> DataFrame:
    return graph.type_join(facts(spark, sf).withColumnRenamed("kind", "type"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS module_id, l_partkey AS binding, l_returnflag AS shape FROM lineitem) SELECT x.module_id, x.binding, x.shape AS a, y.shape AS b FROM s x JOIN s y ON x.module_id = y.module_id AND x.binding = y.binding AND x.shape < y.shape WHERE (x.shape, y.shape) IN (('A', 'R'), ('N', 'R'))""")
def constraint_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Bindings seen in shapes that don't go together."""
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("module_id"), F.col("l_partkey").alias("binding"), F.col("l_returnflag").alias("shape"))
    return graph.constraint_conflicts(s, spark.createDataFrame([("A", "R"), ("N", "R")], "a string, b string")).select("module_id", "binding", "a", "b")


@query(f"WITH RECURSIVE {_CHAINS}, step AS (SELECT src, dst FROM edges UNION SELECT e.src, r.dst FROM edges e JOIN edges r ON e.dst = r.src), paths AS (SELECT src, dst FROM step UNION SELECT paths.src, step.dst FROM paths JOIN step ON paths.dst = step.src) SELECT src, dst FROM paths")
def alias_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Closure of aliases and of calls followed by what they return."""
    e = chains(spark, sf)
    return graph.alias_closure(e, e, e)


@query("""WITH p AS (SELECT p_partkey AS module, p_brand AS package, p_type AS version, p_retailprice AS score FROM part), r AS (SELECT package AS module, version AS package, CAST(count(*) AS VARCHAR) AS version, round(sum(score), 2) AS score FROM p GROUP BY ALL),
  k AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM r WINDOW w AS (PARTITION BY module ORDER BY score DESC, package, version))
  SELECT module, package, version, score, rank, CASE WHEN rank > 1 THEN 'alternative' WHEN next IS NULL OR score >= 1.5 * next THEN 'use' ELSE 'check' END AS advice FROM k WHERE rank <= 3""")
def version_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("module"), F.col("p_type").alias("package")).agg(F.count(F.lit(1)).cast("string").alias("version"), F.round(F.sum("p_retailprice"), 2).alias("score"))
    return matching.version_diagnostics(p).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH b AS (SELECT l_suppkey AS doc, l_returnflag AS feature, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT p_brand AS doc, l_returnflag AS feature, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), w AS (SELECT doc, sum(least(n, 25)) AS a FROM b GROUP BY 1)
  SELECT b.doc AS "left", r.doc AS "right", CAST(2.0 * sum(least(b.n, r.n, 25)) AS DOUBLE) AS score, round(sum(least(b.n, r.n, 25)) / max(a), 6) AS coverage FROM b JOIN r USING (feature) JOIN w ON w.doc = b.doc GROUP BY ALL""")
def structural_bag(spark: SparkSession, sf: str) -> DataFrame:
    """Bags compared by capped common counts."""
    l = table(spark, sf, "lineitem")
    bag = lambda df, key: df.groupBy(F.col(key).alias("doc"), F.lit("flag").alias("axis"), F.col("l_returnflag").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    right = bag(l.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")), "p_brand")
    return matching.bag_scores(bag(l, "l_suppkey"), right, {"flag": 2.0}).select("left", "right", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


@query("""WITH i AS (SELECT l_orderkey AS fn_id, l_suppkey AS subject, l_linenumber AS hash, 's' || l_suppkey AS identity FROM lineitem WHERE l_returnflag = 'A'), q AS (SELECT l_orderkey AS fn, l_partkey AS ref, l_linenumber AS hash FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT DISTINCT p_partkey AS ref, p_size AS subject FROM part),
  m AS (SELECT DISTINCT fn, identity, fn_id FROM q JOIN p USING (ref) JOIN i USING (subject, hash)) SELECT fn, min(identity) AS identity, min(fn_id) AS fn_id FROM m GROUP BY fn HAVING count(*) = 1""")
def pinned_join(spark: SparkSession, sf: str) -> DataFrame:
    """Exact matches only inside paired buckets."""
    l = table(spark, sf, "lineitem")
    index = l.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("fn_id"), F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("hash"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("identity"))
    queries = l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("fn"), F.col("l_partkey").alias("ref"), F.col("l_linenumber").alias("hash"))
    pins = table(spark, sf, "part").select(F.col("p_partkey").alias("ref"), F.col("p_size").cast("long").alias("subject")).distinct()
    return matching.pinned(queries, index, pins)


@query("""SELECT event_type AS package_name, props AS source, CASE WHEN user_id = 1 THEN CAST(event_id AS VARCHAR) END AS export_specifier FROM events WHERE trim(coalesce(props, '')) <> '' AND event_type IN ('click', 'view')""")
def cached_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A cache scan with a list of names and policy-gated columns."""
    cache = table(spark, sf, "events").select(F.col("event_type").alias("package_name"), F.col("props").alias("source"), F.col("event_id").cast("string").alias("export_specifier"), F.col("user_id").alias("policy_version"))
    return matching.cached_sources(cache, spark.createDataFrame([("click",), ("view",)], "package_name string")).select("package_name", "source", "export_specifier")


@query("""SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01'""")
def stale_versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderstatus = 'P' and o_orderdate < timestamp '1998-01-01'").select("o_custkey", "o_orderpriority").distinct()


@query("""WITH c AS (SELECT p_brand, p_type, p_name, count(*) OVER (PARTITION BY p_brand, p_name) AS same, p_partkey FROM part) SELECT p_partkey, p_brand || '/' || p_name AS path FROM c WHERE same = 1""")
def unique_clean_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths given only where they are unique and safe."""
    path = F.concat("p_brand", F.lit("/"), "p_name")
    p = table(spark, sf, "part").select("p_partkey", path.alias("path"))
    single = p.groupBy("path").count().filter("count = 1").select("path")
    return p.join(single, "path", "left_semi").filter(text.is_safe_path(F.col("path"))).select("p_partkey", "path")


@query("""SELECT url, regexp_replace(url, '^https?://[^/]+', '') LIKE '%/en/%' AS english, contains(url, 'utm_') AS tracked FROM pages""")
def path_hints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("url", F.regexp_replace("url", "^https?://[^/]+", "").contains("/en/").alias("english"), F.col("url").contains("utm_").alias("tracked"))


@query("""SELECT c_mktsegment AS module, CASE WHEN c_acctbal > 5000 THEN 'public' ELSE 'declarations' END AS tier, count(*) AS open, string_agg(n, ', ' ORDER BY n) AS names FROM (SELECT DISTINCT c_mktsegment, c_acctbal, c_name AS n FROM customer WHERE c_acctbal > 0 AND c_nationkey >= 20) GROUP BY ALL""")
def naming_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """Open names by module and tier."""
    tier = F.when(F.col("c_acctbal") > 5000, "public").when(F.col("c_acctbal") > 0, "declarations").otherwise("full")
    b = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("module"), F.col("c_name").alias("name"), tier.alias("tier"), (F.col("c_nationkey") < 20).alias("named"))
    return reports.naming_worklist(b, "declarations", ["public", "declarations", "full"])


@query("""WITH w AS (SELECT doc_id AS doc, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+'))) AS feature FROM documents), d AS (SELECT feature, count(*) AS df FROM w WHERE length(feature) >= 8 GROUP BY 1), r AS (SELECT w.feature, doc FROM w JOIN d USING (feature) WHERE df BETWEEN 2 AND 3)
  SELECT a.doc AS "left", b.doc AS "right", count(*) AS shared FROM r a JOIN r b ON a.feature = b.feature AND a.doc < b.doc GROUP BY ALL HAVING count(*) >= 8""")
def blocked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs by rare words alone: fan-out is bounded by the frequency ceiling."""
    w = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), w.alias("feature")).filter(F.length("feature") >= 8)
    rare = similarity.rare_only(rows, similarity.document_frequency(rows).filter("df >= 2"), 3)
    other = rare.select(F.col("doc").alias("right"), "feature")
    return rare.select(F.col("doc").alias("left"), "feature").join(other, "feature").filter(F.col("left") < F.col("right")).groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared")).filter("shared >= 8")


@query()
def function_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Axes of the functions in page scripts, each page wrapping its own. (A scanner; tested by metamorphic pairs.)"""
    s = scripts(spark, sf).select(F.col("page_id").alias("doc"), F.concat(F.lit("function page() {"), "source", F.lit("}")).alias("source"))
    return fingerprint.fingerprints(s)


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 ELSE 2 END AS bucket, count(*) OVER (PARTITION BY p_brand, p_type) AS peers FROM part""")
def peer_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bucketed sizes and peers of a group, joined back instead of windowed over hot groups."""
    p = table(spark, sf, "part")
    n = p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("peers"))
    return p.join(n, ["p_brand", "p_type"]).select("p_partkey", F.when(F.col("p_size") <= 10, 0).when(F.col("p_size") <= 25, 1).otherwise(2).alias("bucket"), "peers")


@query()
def function_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Names, parameters, references and call edges of the functions in page scripts. (A parser; tested on fixtures.)"""
    s = scripts(spark, sf).select(F.col("page_id").alias("doc"), F.concat(F.lit("function page() {"), "source", F.lit("}")).alias("source"))
    f = fingerprint.function_facts(s)
    return f.select("doc", "fn", "name", "form", *[F.array_join(c, ",").alias(c) for c in ("params", "callees", "reads", "writes")], F.size("calls").alias("calls"))
