"""Reports, bound to the star schema, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import reports
from factloom.plans.base import query, table

_STATE = "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' ELSE 'blocked' END"


@query(f"""SELECT kind, total, complete, pending, blocked, is_total, CASE WHEN blocked > 0 THEN 'blocked' WHEN pending > 0 THEN 'open' ELSE 'complete' END AS status FROM (SELECT o_orderpriority AS kind, count(*) AS total, count(*) FILTER (WHERE s = 'complete') AS complete, count(*) FILTER (WHERE s = 'pending') AS pending, count(*) FILTER (WHERE s = 'blocked') AS blocked, CAST(grouping(o_orderpriority) AS TINYINT) AS is_total FROM (SELECT *, {_STATE} AS s FROM orders) GROUP BY ROLLUP (o_orderpriority))""")
def coverage_ledger(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "pending").otherwise("blocked")
    return reports.ledger(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), state.alias("state")))


@query("""WITH n AS (SELECT p_brand AS package, CAST(p_size AS VARCHAR) AS version, count(*) FILTER (WHERE l_returnflag = 'A') AS accepted, count(*) FILTER (WHERE l_returnflag = 'R') AS rejected, count(*) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT package, version, accepted, rejected, total, round(accepted / total, 6) AS ratio, CASE WHEN accepted = 0 THEN 'unproven' WHEN accepted / total >= 0.4 THEN 'trusted' ELSE 'contested' END AS verdict FROM n""")
def verdict_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return reports.verdicts(_attributions(spark, sf), 0.4).withColumn("ratio", F.round("ratio", 6))


def _attributions(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected").otherwise("proposed")
    evidence = F.when(F.col("l_linestatus") == "O", F.lit('{"by":"closure"}')).otherwise(F.lit('{"by":"rollup"}'))
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("p_brand").alias("package"), F.col("p_size").cast("string").alias("version"), status.alias("status"), evidence.alias("evidence"))


@query("""WITH r AS (SELECT p_brand AS package, CAST(p_size AS VARCHAR) AS version, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'proposed' END AS status, l_linestatus = 'O' AS closure FROM lineitem JOIN part ON l_partkey = p_partkey),
  v AS (SELECT package, version, CASE WHEN count(*) FILTER (WHERE status = 'accepted') = 0 THEN 'unproven' WHEN count(*) FILTER (WHERE status = 'accepted') / count(*) >= 0.4 THEN 'trusted' ELSE 'contested' END AS verdict FROM r GROUP BY ALL)
  SELECT CASE WHEN status = 'rejected' AND verdict = 'trusted' AND closure THEN 'promote' WHEN status = 'accepted' AND NOT closure AND verdict <> 'trusted' THEN 'revoke' WHEN status = 'accepted' THEN 'keep' ELSE 'leave' END AS outcome, count(*) AS n FROM r JOIN v USING (package, version) GROUP BY 1""")
def projection_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _attributions(spark, sf)
    out = reports.projection(rows, reports.verdicts(rows, 0.4), '"closure"')
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN grouping(event_type) = 0 THEN 'category' WHEN grouping(k) = 0 THEN 'code' ELSE 'module' END AS cluster, coalesce(event_type, k, CAST(user_id AS VARCHAR)) AS value, count(*) AS n FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) GROUP BY GROUPING SETS ((event_type), (k), (user_id))""")
def finding_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return reports.finding_clusters(table(spark, sf, "events").select(F.col("event_type").alias("category"), F.get_json_object("props", "$.k").alias("code"), F.col("user_id").alias("module")))


@query("""WITH x AS (SELECT c_mktsegment, CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal > 0 THEN 2 ELSE 3 END AS p, c_nationkey < 20 AS done FROM customer), t AS (SELECT unnest([1, 2, 3]) AS i, unnest(['public', 'declarations', 'full']) AS tier)
  SELECT c_mktsegment, tier, count(*) AS total, count(*) FILTER (WHERE done) AS complete, round(100.0 * count(*) FILTER (WHERE done) / count(*), 6) AS percent FROM x JOIN t ON p <= i GROUP BY ALL""")
def cumulative_tiers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    tier = F.when(F.col("c_acctbal") > 5000, "public").when(F.col("c_acctbal") > 0, "declarations").otherwise("full")
    return reports.cumulative_tiers(c, tier, ["public", "declarations", "full"], F.col("c_nationkey") < 20, ["c_mktsegment"]).withColumn("percent", F.round("percent", 6))


@query("""SELECT n_name, count(c_custkey) AS total, count(c_custkey) FILTER (WHERE c_acctbal > 9000) AS done, CASE WHEN count(c_custkey) = 0 THEN 100.0 ELSE round(100.0 * count(c_custkey) FILTER (WHERE c_acctbal > 9000) / count(c_custkey), 6) END AS percent FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 8000 GROUP BY n_name""")
def percent_empty_universe(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' and c_acctbal > 8000")
    n = table(spark, sf, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("total"), F.count_if(F.col("c_acctbal") > 9000).alias("done"))
    return n.withColumn("percent", F.round(reports.percent(F.col("done"), F.col("total")), 6))


@query("""SELECT p_brand, array_to_string(list_sort(list_distinct(flatten(list([p_type, CAST(p_size AS VARCHAR)])))), ',') AS members FROM part GROUP BY p_brand""")
def array_union_members(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_brand", F.array("p_type", F.col("p_size").cast("string")).alias("members"))
    return reports.array_members(p, ["p_brand"], "members").select("p_brand", F.array_join("members", ",").alias("members"))


@query("""WITH s AS (SELECT o_custkey, max(o_totalprice) / 500000.0 AS score FROM orders GROUP BY 1), a AS (SELECT score FROM customer LEFT JOIN s ON c_custkey = o_custkey) SELECT count(*) AS subjects, count(*) FILTER (WHERE score >= 0.1) AS at_10, count(*) FILTER (WHERE score >= 0.3) AS at_30, count(*) FILTER (WHERE score >= 0.5) AS at_50, count(*) FILTER (WHERE score >= 0.7) AS at_70, count(*) FILTER (WHERE score >= 0.9) AS at_90, count(*) FILTER (WHERE score >= 0.3) AS matched FROM a""")
def recall_histogram(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "orders").groupBy("o_custkey").agg((F.max("o_totalprice") / 500000.0).alias("score"))
    return reports.recall(table(spark, sf, "customer").join(s, F.col("c_custkey") == F.col("o_custkey"), "left").select("score"))


@query("""WITH p AS (SELECT doc_id AS id, CAST(n_chars > 400 AS INT) AS pick, least(1, n_chars / 2000.0) AS score FROM documents) SELECT count(*) AS baseline, count(*) FILTER (WHERE p.pick = quality) AS correct, count(*) FILTER (WHERE p.pick <> quality) AS mispaired, count(*) FILTER (WHERE p.pick IS NULL) AS unranked, count(*) FILTER (WHERE p.pick = quality AND score >= 0.3) AS verified FROM labels LEFT JOIN p ON id = doc_id""")
def precision_vs_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    predicted = d.select(F.col("doc_id").alias("id"), (F.col("n_chars") > 400).cast("int").alias("pick"), F.least(F.lit(1.0), F.col("n_chars") / 2000.0).alias("score"))
    return reports.precision(predicted, table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("pick")))


@query("""WITH g AS (SELECT p_partkey, p_name AS gold, lead(p_name) OVER (ORDER BY p_partkey) AS pred FROM part), t AS (SELECT *, [x FOR x IN string_split(lower(gold), ' ') IF x <> ''] AS a, [x FOR x IN string_split(lower(pred), ' ') IF x <> ''] AS b FROM g),
  m AS (SELECT CASE WHEN pred IS NULL THEN 'unmatched' WHEN lower(gold) = lower(pred) THEN 'exact' WHEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.5 THEN 'fuzzy' ELSE 'miss' END AS m FROM t)
  SELECT m AS match, count(*) AS n FROM m GROUP BY 1""")
def exact_fuzzy_miss(spark: SparkSession, sf: str) -> DataFrame:
    """Names against the next part's name."""
    from factloom.functions.text import name_match

    # The next key by a self-join on consecutive numbers, not by a window over all rows.
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("pred"))
    m = F.when(F.col("pred").isNull(), "unmatched").otherwise(name_match(F.col("p_name"), F.col("pred")))
    return p.join(after, "p_partkey", "left").groupBy(m.alias("match")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT p_partkey AS doc, unnest(['brand', 'type', 'size']) AS axis, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS hash FROM part WHERE p_size > 25), i AS (SELECT DISTINCT unnest(['brand', 'type', 'size']) AS axis, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS hash FROM part WHERE p_size <= 30),
  h AS (SELECT q.*, i.hash IS NOT NULL AS hit FROM q LEFT JOIN i USING (axis, hash)) SELECT axis, count(DISTINCT doc) FILTER (WHERE hit) AS covered, count(DISTINCT doc) AS total FROM h GROUP BY axis UNION ALL SELECT NULL, count(DISTINCT doc) FILTER (WHERE hit), count(DISTINCT doc) FROM h""")
def hash_floor_coverage(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    axes = lambda df: df.select(F.col("p_partkey").alias("doc"), F.explode(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))).alias("axis", "hash"))
    return reports.hash_floor(axes(p.filter("p_size > 25")), axes(p.filter("p_size <= 30")))


@query("""SELECT p_brand AS package, count(*) AS modules, round(sum(p_retailprice), 2) AS lines, CAST(grouping(p_brand) AS TINYINT) AS is_total FROM part GROUP BY ROLLUP (p_brand)""")
def package_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.rolled_up(table(spark, sf, "part").withColumnRenamed("p_brand", "package"), "package", [F.count(F.lit(1)).alias("modules"), F.round(F.sum("p_retailprice"), 2).alias("lines")])
    return out.select("package", "modules", "lines", "is_total")


@query("""SELECT o_orderstatus AS reason, o_orderpriority AS package, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL""")
def blocker_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderstatus <> 'F'").groupBy(F.col("o_orderstatus").alias("reason"), F.col("o_orderpriority").alias("package")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, string_agg(event_type, ', ' ORDER BY event_type) AS owners FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1""")
def owner_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ", ").alias("owners"))


@query("""WITH t AS (SELECT p_brand, count(*) AS total, count(*) FILTER (WHERE p_size < 48) AS a, count(*) FILTER (WHERE p_size < 48 AND p_retailprice < 1900) AS b FROM part GROUP BY 1) SELECT p_brand, CASE WHEN a = total THEN 'sized' WHEN b = total THEN 'priced' END AS highest FROM t""")
def highest_complete_tier(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.expr("p_size < 48")).alias("a"), F.count_if(F.expr("p_size < 48 and p_retailprice < 1900")).alias("b"))
    long = n.select("p_brand", F.col("t").alias("total"), F.explode(F.create_map(F.lit("priced"), F.col("b"), F.lit("sized"), F.col("a"))).alias("tier", "complete"))
    return reports.highest_complete(long, ["priced", "sized"], ["p_brand"])


@query("""SELECT count(*) AS entries, count(*) FILTER (WHERE trim(coalesce(props, '')) = '') AS blank_sources, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-02') AS expired, count(*) FILTER (WHERE event_type = 'error') AS stale, count(*) FILTER (WHERE user_id <> 1) AS other_policy, CAST(0 AS BIGINT) AS without_specifier, count(*) FILTER (WHERE event_id > 65536) AS oversize FROM events""")
def cache_health(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("props").alias("source"), F.col("ts").alias("expires_at"), (F.col("event_type") == "error").alias("stale"), F.col("user_id").alias("policy_version"), F.col("event_type").alias("export_specifier"), F.col("event_id").alias("source_size"))
    return reports.cache_audit(e, F.lit("2024-01-02").cast("timestamp"))
