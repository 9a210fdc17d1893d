"""Loaders, joins, set operations and merges, bound to the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import blank_to_null
from factloom.operators import dml, graph, reports
from factloom.plans.base import query, table
from factloom.sources.facts import first_per


@query("""SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'""")
def project_scope_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one scope by way of a bridge."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r.filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P') WHERE n = 1""")
def top1_override(spark: SparkSession, sf: str) -> DataFrame:
    """The latest accepted row of each key, with a full tie-break."""
    o = table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    return first_per(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderpriority").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")


@query("""SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')""")
def unattributed_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without any attribution of a kind."""
    return table(spark, sf, "part").join(table(spark, sf, "lineitem").filter("l_returnflag = 'R'"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey", "p_name")


@query("""SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def left_sum_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.sum_per(table(spark, sf, "customer"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_totalprice")
    return out.select("c_custkey", F.round("total", 2).alias("total"))


@query("""SELECT unnest(['orders', 'open_orders', 'urgent', 'large', 'blank_status']) AS metric, unnest([count(*), count(*) FILTER (WHERE o_orderstatus = 'O'), count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), count(*) FILTER (WHERE o_totalprice > 100000), count(*) FILTER (WHERE trim(coalesce(o_orderstatus, '')) = '')]) AS n FROM orders""")
def inventory_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Many counts in one pass."""
    return reports.scalar_inventory(table(spark, sf, "orders"), {
        "orders": F.lit(True), "open_orders": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority") == "1-URGENT",
        "large": F.col("o_totalprice") > 100000, "blank_status": blank_to_null(F.col("o_orderstatus")).isNull(),
    })


@query("""SELECT coalesce(max(v), 0) AS max_id FROM (SELECT max(c_custkey) AS v FROM customer UNION ALL SELECT max(o_orderkey) FROM orders)""")
def max_id_space(spark: SparkSession, sf: str) -> DataFrame:
    return reports.greatest_id((table(spark, sf, "customer"), "c_custkey"), (table(spark, sf, "orders"), "o_orderkey"))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_event_wins(spark: SparkSession, sf: str) -> DataFrame:
    return dml.latest_events(table(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type", "value")


@query("""SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0""")
def distinct_scope(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf, "lineitem").join(s, "l_suppkey", "left_semi").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("""SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)""")
def both_ends_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose two ends both lie in scope."""
    part, supplier = table(spark, sf, "part").filter("p_size <= 25"), table(spark, sf, "supplier").filter("s_nationkey < 10")
    edges = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    return edges.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").distinct()


@query("""SELECT o_orderkey, CASE WHEN bad THEN 'rejected' ELSE o_orderstatus END AS status, CASE WHEN NOT bad THEN o_orderpriority END AS priority, CASE WHEN bad THEN 'policy is stale' END AS reason FROM (SELECT *, o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1997-01-01' AS bad FROM orders)""")
def policy_downgrade(spark: SparkSession, sf: str) -> DataFrame:
    """Several columns change at once where a row was accepted under an old policy."""
    bad = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"))
    return table(spark, sf, "orders").select("o_orderkey", F.when(bad, "rejected").otherwise(F.col("o_orderstatus")).alias("status"), F.when(~bad, F.col("o_orderpriority")).alias("priority"), F.when(bad, "policy is stale").alias("reason"))


@query("""SELECT user_id, event_type, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 60 GROUP BY ALL)) WHERE kinds = 1""")
def unambiguous_owner(spark: SparkSession, sf: str) -> DataFrame:
    """Keys whose rows all name one owner."""
    n = table(spark, sf, "events").filter("value > 60").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).filter("_k = 1").drop("_k")


@query("""SELECT p_partkey, asked FROM (SELECT p_partkey, asked, row_number() OVER (PARTITION BY asked ORDER BY (p_brand = asked) DESC, length(p_name), p_partkey) AS n FROM part JOIN (SELECT unnest(['Brand#11', 'Brand#23', 'Brand#45']) AS asked) ON p_brand = asked OR p_name LIKE '%' || asked || '%') WHERE n = 1""")
def fuzzy_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Exact matches first, then the shortest; the alternatives are united, so none is a nested loop over all."""
    asked = spark.createDataFrame([("Brand#11",), ("Brand#23",), ("Brand#45",)], "asked string")
    p = table(spark, sf, "part")
    exact = p.join(F.broadcast(asked), p["p_brand"] == asked["asked"]).withColumn("_e", F.lit(1))
    near = p.join(F.broadcast(asked), F.col("p_name").contains(F.col("asked"))).withColumn("_e", (F.col("p_brand") == F.col("asked")).cast("int"))
    return first_per(exact.union(near).distinct(), ["asked"], [F.col("_e").desc(), F.length("p_name"), F.col("p_partkey")]).select("p_partkey", "asked")


@query("""SELECT c_mktsegment AS category, count(*) AS n FROM (SELECT CASE WHEN lower(trim(c_mktsegment)) IN ('building', 'machinery') THEN lower(trim(c_mktsegment)) ELSE 'unclassified' END AS c_mktsegment FROM customer) GROUP BY 1""")
def category_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return reports.by_category(table(spark, sf, "customer"), F.col("c_mktsegment"), ["building", "machinery"])


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'rejected' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000000, 'new', c_acctbal FROM customer WHERE c_nationkey = 0""")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Changed and new rows merged into a table."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    change = c.filter("c_acctbal < 0").withColumn("c_mktsegment", F.lit("rejected"))
    fresh = table(spark, sf, "customer").filter("c_nationkey = 0").select((F.col("c_custkey") + 1000000000).alias("c_custkey"), F.lit("new").alias("c_mktsegment"), "c_acctbal")
    return dml.upsert(c, change.union(fresh), ["c_custkey"])


@query("""SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value > 50) UNION SELECT user_id, event_type FROM events WHERE value <= 50""")
def insert_ignore_distinct(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    old, new = (e.filter(c).select("user_id", "event_type").distinct() for c in ("value > 50", "value <= 50"))
    return dml.insert_missing(old, new, ["user_id", "event_type"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'H' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def guarded_update(spark: SparkSession, sf: str) -> DataFrame:
    """Only rows in the expected state change."""
    debtors = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return dml.guarded_update(table(spark, sf, "orders"), debtors, ["o_custkey"], F.col("o_orderstatus") == "O", {"o_orderstatus": F.lit("H")}).select("o_orderkey", "o_orderstatus")


@query("""SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey IN (1, 2, 3) THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier""")
def replace_scope(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return dml.replaced_scope(s, s.filter("s_nationkey in (1, 2, 3)").withColumn("s_acctbal", F.lit(0.0)), ["s_nationkey"])


@query("""SELECT event_id, user_id FROM events WHERE NOT coalesce(event_type = 'error' OR value < 10, false)""")
def prune_by_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return dml.pruned(table(spark, sf, "events"), (F.col("event_type") == "error") | (F.col("value") < 10)).select("event_id", "user_id")


@query("""SELECT s_suppkey, 'update' AS action FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_suppkey + 1000000000, 'insert' FROM supplier WHERE s_nationkey = 0""")
def planned_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What a merge would do, before it is applied."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    new = s.filter("s_acctbal < 0").withColumn("s_acctbal", F.lit(0.0)).union(table(spark, sf, "supplier").filter("s_nationkey = 0").select(F.col("s_suppkey") + 1000000000, "s_acctbal"))
    return dml.planned_changes(s, dml.upsert(s, new, ["s_suppkey"]), ["s_suppkey"])


@query("""SELECT count(*) AS changes FROM supplier WHERE false""")
def idempotent_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Merging the same change twice plans nothing the second time."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    new = s.filter("s_acctbal < 0").withColumn("s_acctbal", F.lit(0.0))
    once = dml.upsert(s, new, ["s_suppkey"])
    return dml.planned_changes(once, dml.upsert(once, new, ["s_suppkey"]), ["s_suppkey"]).agg(F.count(F.lit(1)).alias("changes"))


@query("""WITH d AS (SELECT * FROM events WHERE event_type IN ('purchase', 'error')) SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM d) WHERE n = 1 AND event_type = 'purchase'""")
def accepted_name_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The standing decision of each key in a ledger of accepting and clearing events."""
    status = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "cleared").otherwise("proposed")
    return dml.accepted_names(table(spark, sf, "events").withColumn("status", status), ["user_id"], "event_id").select("user_id", "event_id")


@query("""SELECT conv_id, CAST(run AS BIGINT) AS run, role, run_length FROM (SELECT conv_id, role, run, count(*) AS run_length FROM (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AND turn <> min(turn) OVER (PARTITION BY conv_id) THEN 0 ELSE 1 END AS f FROM conversations)) GROUP BY ALL)""")
def gaps_and_islands_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal stretches of one role in a conversation."""
    out = graph.runs(table(spark, sf, "conversations"), ["conv_id"], [F.col("turn")], "role")
    return out.select("conv_id", "run", "role", "run_length").distinct()


@query("""SELECT CAST(count(*) AS BIGINT) AS violations, rule FROM (SELECT 'line without an order' AS rule FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'quantity out of its domain' FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 45 UNION ALL SELECT 'order is repeated' FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) GROUP BY rule""")
def validation_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules as anti-joins and filters, their violations united."""
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"], "left_anti").select(F.lit("line without an order").alias("rule"))
    rows = rows.union(l.filter(~F.col("l_quantity").between(1, 45)).select(F.lit("quantity out of its domain")))
    rows = rows.union(o.groupBy("o_orderkey").count().filter("count > 1").select(F.lit("order is repeated")))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query("""SELECT event_id, props, json_extract_string(props, '$.k') AS k FROM events WHERE props LIKE '%1%'""")
def json_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Substring predicates and paths on JSON evidence."""
    return table(spark, sf, "events").filter(F.col("props").contains("1")).select("event_id", "props", F.get_json_object("props", "$.k").alias("k"))
