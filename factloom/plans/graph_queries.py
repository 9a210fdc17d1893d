"""Graph operators, bound to two graphs over whole tables and to def-use facts made of line items.

edges: parts that follow each other in orders; one giant component full of cycles. chains: each order leads to its customer's next one, and
back to the last one of the same priority; many small components with cycles, for what puts out paths or pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import assign, graph
from factloom.plans.base import FNV, query, table

_EDGES = """edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"""
_CHAINS = """edges AS (SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders
  UNION SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) FROM orders) WHERE dst IS NOT NULL)"""
_BOTH = "pair AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
_CC_OF = lambda edges: f"""WITH RECURSIVE {edges}, {_BOTH}, reach AS (SELECT src AS node, src AS seen FROM pair UNION SELECT reach.node, pair.dst FROM reach JOIN pair ON reach.seen = pair.src),
  cc AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""
_CC = _CC_OF(_EDGES)
_CLOSURE_OF = lambda edges: f"WITH RECURSIVE {edges}, paths AS (SELECT src, dst FROM edges UNION SELECT paths.src, edges.dst FROM paths JOIN edges ON paths.dst = edges.src)"
_CLOSURE = _CLOSURE_OF(_EDGES)
#: The facts of a module (an order): its lines define, import, read or write parts.
_FACTS = """facts AS (SELECT l_orderkey AS module_id, l_partkey AS binding, CASE WHEN l_returnflag = 'A' THEN 'definition' WHEN l_returnflag = 'R' THEN 'read' WHEN l_linestatus = 'O' THEN 'import' ELSE 'write' END AS kind FROM lineitem)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).filter("dst is not null").distinct()


def chains(spark: SparkSession, sf: str) -> DataFrame:
    by_date = [F.col("o_orderdate"), F.col("o_orderkey")]
    o = table(spark, sf, "orders")
    after = o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy(*by_date)).alias("dst"))
    before = o.select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy(*by_date)).alias("dst"))
    return after.union(before).filter("dst is not null").distinct()


def facts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "definition").when(F.col("l_returnflag") == "R", "read").when(F.col("l_linestatus") == "O", "import").otherwise("write")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("module_id"), F.col("l_partkey").alias("binding"), kind.alias("kind"))


def _ends(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


@query(f"{_CLOSURE_OF(_CHAINS)} SELECT src, dst FROM paths")
def transitive_closure(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closure(chains(spark, sf))


@query(f"WITH RECURSIVE {_EDGES}, seen AS (SELECT DISTINCT src AS node FROM edges JOIN part ON src = p_partkey WHERE p_size <= 10 UNION SELECT dst FROM seen JOIN edges ON node = src) SELECT node FROM seen")
def reachable_from_root(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    small = table(spark, sf, "part").filter("p_size <= 10")
    return graph.reachable(e, e.join(small, F.col("src") == F.col("p_partkey"), "left_semi").select(F.col("src").alias("node")))


@query(f"{_CC} SELECT node, component FROM cc")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(edges(spark, sf))


@query(f"{_CLOSURE} SELECT DISTINCT src AS node FROM paths WHERE src = dst")
def cyclic_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cyclic_nodes(edges(spark, sf))


@query(f"{_CLOSURE} SELECT n.node, least(n.node, coalesce(min(a.dst), n.node)) AS component FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n LEFT JOIN (SELECT a.src, a.dst FROM paths a JOIN paths b ON a.src = b.dst AND a.dst = b.src) a ON a.src = n.node GROUP BY n.node")
def strong_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.strong_components(edges(spark, sf))


@query(f"{_CC} SELECT node, max(p_size) OVER (PARTITION BY component) AS rank FROM cc JOIN part ON node = p_partkey")
def lattice_fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    shapes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("rank"))
    return graph.lattice_fixpoint(e, shapes.join(_ends(e), "node", "left_semi"))


@query(None)
def label_propagation_unanimous(spark: SparkSession, sf: str) -> DataFrame:
    """Labels spread where all labelled neighbours agree. (Rounds of a fixpoint; tested on fixtures.)"""
    labels = table(spark, sf, "part").filter("p_size < 25").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("label"))
    return graph.propagate_unanimous(edges(spark, sf), labels)


@query(f"""{_CC_OF(_CHAINS)}, counts AS (SELECT component, o_orderpriority AS label, count(*) AS n FROM cc JOIN orders ON node = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL),
  ranked AS (SELECT *, CAST(sum(n) OVER (PARTITION BY component) AS BIGINT) AS labelled, row_number() OVER (PARTITION BY component ORDER BY n DESC, label) AS k FROM counts)
  SELECT component, label, n, labelled FROM ranked WHERE k = 1 AND labelled >= 3 AND n >= 0.4 * labelled""")
def component_dominance(spark: SparkSession, sf: str) -> DataFrame:
    """Priorities that dominate a customer's decided orders; open ones are the unlabelled nodes."""
    labels = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("label"))
    return graph.dominant_labels(graph.components(chains(spark, sf)), labels, 3, 0.4)


@query(f"WITH {_EDGES}, ends AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), i AS (SELECT dst AS node, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT src AS node, count(*) AS n FROM edges GROUP BY 1), d AS (SELECT ends.node, coalesce(i.n, 0) AS indegree, coalesce(o.n, 0) AS outdegree FROM ends LEFT JOIN i USING (node) LEFT JOIN o USING (node)) SELECT *, CASE WHEN indegree = 0 THEN '0' WHEN indegree = 1 THEN '1' WHEN indegree <= 4 THEN 'few' ELSE 'many' END || '/' || CASE WHEN outdegree = 0 THEN '0' WHEN outdegree = 1 THEN '1' WHEN outdegree <= 4 THEN 'few' ELSE 'many' END AS role FROM d")
def degree_roles(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return graph.degree_roles(e, _ends(e))


@query(None)
def dead_node_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes without users go again and again; roots are the small parts. (A greatest fixpoint; tested on fixtures.)"""
    e = edges(spark, sf)
    roots = table(spark, sf, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("node"))
    return graph.prune_dead(_ends(e), e, roots)


@query(f"WITH RECURSIVE {_EDGES}, seen AS (SELECT p_partkey AS node FROM part WHERE p_size <= 10 UNION SELECT dst FROM seen JOIN edges ON node = src) SELECT node FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) WHERE node IN (SELECT node FROM seen)")
def orphan_prune(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    roots = table(spark, sf, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("node"))
    return graph.prune_orphans(_ends(e), e, roots)


@query(f"WITH RECURSIVE {_CHAINS}, ends AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), bad AS (SELECT o_orderkey AS node FROM orders WHERE o_totalprice > 450000), paths AS (SELECT src, dst FROM edges UNION SELECT paths.src, edges.dst FROM paths JOIN edges ON paths.dst = edges.src), looped AS (SELECT DISTINCT src AS node FROM paths WHERE src = dst) SELECT node FROM ends WHERE node NOT IN (SELECT node FROM bad) AND node NOT IN (SELECT node FROM looped) AND NOT EXISTS (SELECT 1 FROM paths WHERE src = ends.node AND (dst IN (SELECT node FROM bad) OR dst IN (SELECT node FROM looped)))")
def all_deps_safe(spark: SparkSession, sf: str) -> DataFrame:
    e = chains(spark, sf)
    return graph.all_deps_safe(_ends(e), e, table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_orderkey").alias("node")))


@query(f"WITH {_EDGES}, m AS (SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS target FROM part) SELECT DISTINCT a.target AS src, b.target AS dst FROM edges JOIN m a ON src = a.node JOIN m b ON dst = b.node WHERE a.target <> b.target")
def dedupe_edge_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").withColumnRenamed("p_partkey", "node")
    return graph.merge_duplicates(nodes, edges(spark, sf), ["p_brand", "p_type", "p_size"])[1]


@query(f"WITH {_EDGES} SELECT src, dst FROM edges JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_type = b.p_type")
def strip_cross_group(spark: SparkSession, sf: str) -> DataFrame:
    return graph.strip_across(edges(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("group")))


@query(f"WITH {_FACTS} SELECT DISTINCT module_id, binding FROM facts r WHERE kind = 'read' AND NOT EXISTS (SELECT 1 FROM facts d WHERE d.module_id = r.module_id AND d.binding = r.binding AND d.kind IN ('definition', 'import'))")
def unresolved_reads_anti(spark: SparkSession, sf: str) -> DataFrame:
    return graph.unresolved(facts(spark, sf))


@query(f"WITH {_FACTS} SELECT DISTINCT module_id, binding FROM facts w WHERE kind = 'write' AND EXISTS (SELECT 1 FROM facts d WHERE d.module_id = w.module_id AND d.binding = w.binding AND d.kind = 'import') AND NOT EXISTS (SELECT 1 FROM facts d WHERE d.module_id = w.module_id AND d.binding = w.binding AND d.kind = 'definition')")
def imported_writes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.imported_writes(facts(spark, sf))


@query(f"""WITH {_FACTS}, m AS (SELECT o_orderkey AS module_id, o_custkey AS file_id, count(*) OVER (PARTITION BY o_custkey) > 1 AS many FROM orders),
  reads AS (SELECT DISTINCT module_id, binding FROM facts r WHERE kind = 'read' AND NOT EXISTS (SELECT 1 FROM facts d WHERE d.module_id = r.module_id AND d.binding = r.binding AND d.kind IN ('definition', 'import'))),
  owners AS (SELECT reads.module_id AS src, reads.binding, d.module_id AS dst FROM reads JOIN m s ON s.module_id = reads.module_id JOIN (SELECT DISTINCT module_id, binding FROM facts WHERE kind = 'definition') d ON d.binding = reads.binding AND d.module_id <> reads.module_id JOIN m t ON t.module_id = d.module_id WHERE NOT s.many OR s.file_id = t.file_id)
  SELECT src, min(dst) AS dst, binding FROM owners GROUP BY src, binding HAVING count(DISTINCT dst) = 1""")
def edge_synthesis_single_owner(spark: SparkSession, sf: str) -> DataFrame:
    modules = table(spark, sf, "orders").select(F.col("o_orderkey").alias("module_id"), F.col("o_custkey").alias("file_id"))
    return graph.synthesized_edges(facts(spark, sf), modules, spark.createDataFrame([], "src long, dst long"))


@query(f"WITH {_CHAINS}, l AS (SELECT src, count(*) AS known FROM edges GROUP BY 1) SELECT a.src AS left_node, b.src AS right_node, count(*) AS matched FROM edges a JOIN edges b ON a.dst = b.dst AND a.src <> b.src GROUP BY ALL")
def shared_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbourhood support with every node as its own seed, out-edges only."""
    e = chains(spark, sf)
    other = e.select(F.col("src").alias("right_node"), "dst")
    return e.select(F.col("src").alias("left_node"), "dst").join(other, "dst").filter("left_node <> right_node").groupBy("left_node", "right_node").agg(F.count(F.lit(1)).alias("matched"))


@query("""WITH s AS (SELECT o_custkey AS file_id, o_orderkey AS id, CAST(epoch(o_orderdate) / 86400 AS BIGINT) AS b FROM orders),
  spans AS (SELECT o_custkey AS file_id, o_orderpriority AS label, min(CAST(epoch(o_orderdate) / 86400 AS BIGINT)) AS b, max(CAST(epoch(o_orderdate) / 86400 AS BIGINT)) + 1 AS e FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
  SELECT s.id, (SELECT string_agg(label, ' + ' ORDER BY label) FROM (SELECT DISTINCT label FROM spans WHERE spans.file_id = s.file_id AND s.b < spans.e AND spans.b < s.b + 7)) AS owner FROM s""")
def interval_overlap_owner(spark: SparkSession, sf: str) -> DataFrame:
    """Owners of date ranges: labels of all spans of the same customer that overlap them."""
    from factloom.operators.matching import overlapping_owners

    o = table(spark, sf, "orders").withColumn("d", F.floor(F.unix_timestamp("o_orderdate") / 86400).cast("long"))
    spans = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("label")).agg(F.min("d").alias("start"), (F.max("d") + 1).alias("end"))
    return overlapping_owners(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"), F.col("d").alias("start"), (F.col("d") + 7).alias("end")), spans)


@query(f"""SELECT p_brand, {FNV.format('names')} AS fingerprint FROM (SELECT p_brand, string_agg(p_name, chr(0) ORDER BY p_name) AS names FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY 1)""")
def cluster_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cluster_fingerprint(table(spark, sf, "part"), "p_brand", "p_name")


@query(None)
def louvain_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of orders. (Greedy modularity; tested on fixtures.)"""
    return assign.louvain(chains(spark, sf).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(1.0).alias("weight")))


@query(None)
def hungarian_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Priorities and years of each customer's orders, one to one, by total price. (Tested against all permutations of small blocks.)"""
    o, key = table(spark, sf, "orders"), F.col("o_custkey").cast("string")
    row, col = F.concat_ws("/", key, "o_orderpriority"), F.concat_ws("/", key, F.year("o_orderdate").cast("string"))
    return assign.assign(o.groupBy(row.alias("row"), col.alias("col")).agg(F.round(F.sum("o_totalprice"), 2).alias("weight")))


@query("""WITH RECURSIVE t AS (SELECT conv_id AS scope, turn AS place, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
  p AS (SELECT scope, place, k, 0 AS bin, size AS held FROM t WHERE k = 1 UNION ALL SELECT t.scope, t.place, t.k, CASE WHEN held > 0 AND held + t.size > 2000 THEN bin + 1 ELSE bin END, CASE WHEN held > 0 AND held + t.size > 2000 THEN t.size ELSE held + t.size END FROM p JOIN t ON t.scope = p.scope AND t.k = p.k + 1)
  SELECT CAST(scope AS VARCHAR) AS scope, place, bin FROM p""")
def pack_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation packed in order. (A running reset; tested on fixtures.)"""
    items = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("scope"), F.col("turn").alias("place"), F.char_length("text").cast("long").alias("size"))
    return assign.pack_in_order(items, 2000)


@query("""WITH RECURSIVE t AS (SELECT o_custkey AS scope, o_orderkey AS item, CAST(trunc(o_totalprice) AS BIGINT) AS size, CAST(epoch(o_orderdate) AS BIGINT) AS rank, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS k FROM orders),
  p AS (SELECT scope, item, rank, size, k, size <= 500000 AS taken, CASE WHEN size <= 500000 THEN size ELSE 0 END AS held FROM t WHERE k = 1 UNION ALL SELECT t.scope, t.item, t.rank, t.size, t.k, held + t.size <= 500000, CASE WHEN held + t.size <= 500000 THEN held + t.size ELSE held END FROM p JOIN t ON t.scope = p.scope AND t.k = p.k + 1)
  SELECT CAST(scope AS VARCHAR) AS scope, CAST(item AS VARCHAR) AS item, rank, size FROM p WHERE taken""")
def ranked_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer taken by date as long as they fit a budget. (Skip and go on; tested on fixtures.)"""
    rank = F.unix_timestamp("o_orderdate").cast("long")
    items = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("scope"), F.col("o_orderkey").cast("string").alias("item"), rank.alias("rank"), F.col("o_totalprice").cast("long").alias("size"))
    return assign.within_budget(items, 500_000)
