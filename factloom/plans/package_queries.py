"""Package evidence, inventories and audits, bound to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import graph, packages, reports
from factloom.plans.base import query, table
from factloom.plans.graph_queries import _FACTS, facts

#: Letters and figures alone; path segments without extensions and build folders.
_HINT = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_SKIPPED = "('', '.', '..', 'dist', 'lib', 'build', 'src', 'esm', 'cjs', 'umd', 'es', 'index', 'node_modules')"
_TOKENS = "[x FOR x IN [regexp_replace(y, '\\.(?:d\\.)?[cm]?[jt]sx?$', '') FOR y IN string_split(lower({}), '/')] IF x NOT IN " + _SKIPPED + "]"


@query(f"""WITH p AS (SELECT page_id, html, contains(html, '</html>') AS parses, regexp_extract(url, '^https?://([^/]+)', 1) AS package, regexp_replace(regexp_replace(url, '^https?://[^/]+/?', ''), '[?#].*$', '') AS path FROM pages),
  t AS (SELECT *, [y FOR y IN [{_HINT.format('x')} FOR x IN {_TOKENS.format('path')}] IF y <> '' AND y <> {_HINT.format('package')}] AS tokens, {_HINT.format('html')} AS told FROM p)
  SELECT page_id, CASE WHEN trim(html) = '' OR NOT parses THEN 'invalid' WHEN len(tokens) = 0 OR len([y FOR y IN tokens IF contains(told, y)]) > 0 THEN 'trusted' ELSE 'weak' END AS quality FROM t""")
def source_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as sources of their host's package, by the tokens of their path."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+/?", ""), "[?#].*$", "")
    q = packages.source_quality(F.col("html"), F.contains("html", F.lit("</html>")), F.regexp_extract("url", "^https?://([^/]+)", 1), path)
    return table(spark, sf, "pages").select("page_id", q.alias("quality"))


@query(f"""WITH s AS (SELECT lang, doc_id, source || '/' || doc_id AS path, coalesce(text, '') AS text, doc_id % 97 = 0 AS public FROM documents), n AS (SELECT lang, count(*) AS n FROM s GROUP BY 1), h AS (SELECT * FROM (VALUES ('en', 'tion'), ('fr', 'eaux')) h(lang, hint))
  SELECT s.lang, doc_id FROM s JOIN n USING (lang) LEFT JOIN h USING (lang) WHERE n <= 256 OR hint IS NULL OR public OR contains({_HINT.format("path")} || '/' || {_HINT.format("text")}, hint)""")
def relevant_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of languages with many of them, kept where a hint points to them."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("package"), F.lit("1.0.0").alias("version"), "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("source"), (F.col("doc_id") % 97 == 0).alias("public"))
    hints = spark.createDataFrame([("en", "1.0.0", "src/tion"), ("fr", "1.0.0", "lib/eaux/")], "package string, version string, hint string")
    return packages.relevant_sources(d, hints).select(F.col("package").alias("lang"), "doc_id")


_NAMED = "n AS (SELECT p_partkey, '@' || p_type || '/' || p_name AS package, p_size FROM part)"


@query(f"""WITH RECURSIVE {_NAMED}, d AS (SELECT package, max(p_size % 3) || '.' || min(p_size) || '.0' AS version, max(p_size % 3) AS major FROM n GROUP BY 1), v AS (SELECT regexp_extract(package, '^(@[^/]+)/', 1) AS scope, major, count(*) AS k FROM d GROUP BY ALL),
  w AS (SELECT scope, arg_max(major, [k, major]) AS wins FROM v GROUP BY 1 HAVING sum(k) >= 2), x AS (SELECT d.*, coalesce(wins <> major, false) AS off FROM d LEFT JOIN w ON scope = regexp_extract(package, '^(@[^/]+)/', 1)),
  l AS (SELECT package AS src, arg_min(needs, p_partkey) AS dst FROM (SELECT package, p_partkey, lead(package) OVER (ORDER BY p_partkey) AS needs FROM n) WHERE needs IS NOT NULL GROUP BY 1),
  r AS (SELECT package AS node FROM x WHERE NOT off UNION SELECT dst FROM r JOIN l ON src = node)
  SELECT package, version FROM x WHERE NOT off OR package NOT IN (SELECT dst FROM l WHERE src IN (SELECT node FROM r))""")
def coherent_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Scoped names off their scope's major go where another package brings them along."""
    n = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("@"), "p_type", F.lit("/"), "p_name").alias("package"), "p_size")
    d = n.groupBy("package").agg(F.concat_ws(".", F.max(F.col("p_size") % 3).cast("string"), F.min("p_size").cast("string"), F.lit("0")).alias("version"))
    # The next row's name by the dense key, without a window over the whole table.
    after = n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("package").alias("needs"))
    listed = n.join(after, "p_partkey").groupBy("package").agg(F.min_by("needs", "p_partkey").alias("needs"))
    return packages.coherent_dependencies(d, listed)


@query("""SELECT event_type AS package, user_id AS version, event_id AS path FROM events WHERE trim(coalesce(props, '')) <> '' AND event_type IN ('click', 'view') ORDER BY 1, 2, 3 LIMIT 100""")
def hint_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred candidates in order: the limit is the feature."""
    cache = table(spark, sf, "events").select(F.col("event_type").alias("package"), F.col("user_id").alias("version"), F.col("event_id").alias("path"), F.col("props").alias("source"))
    return packages.hint_candidates(cache, spark.createDataFrame([("click",), ("view",)], "package string"), 100).select("package", "version", "path")


_KINDS = ("property", "object", "class", "switch")


@query("""WITH c AS (SELECT l_suppkey AS module, p_brand AS package, p_type AS version, p_name AS path, count(*) FILTER (WHERE l_returnflag = 'R') - 1 AS functions, count(*) AS strings, count(*) FILTER (WHERE l_linestatus = 'O') AS axes, count(*) FILTER (WHERE l_quantity > 25) AS jsx,
    count(*) FILTER (WHERE l_discount = 0) AS property_shapes, count(*) FILTER (WHERE l_discount < 0.02) AS property_anchors, count(*) FILTER (WHERE l_tax = 0) AS object_shapes, count(*) FILTER (WHERE l_tax < 0.02) AS object_anchors,
    count(*) FILTER (WHERE l_linenumber = 1) AS class_shapes, count(*) FILTER (WHERE l_linenumber < 3) AS class_anchors, count(*) FILTER (WHERE l_linenumber = 7) AS switch_shapes, count(*) FILTER (WHERE l_linenumber > 5) AS switch_anchors, min(l_linenumber) = 1 AS subset, max(p_size) > 25 AS importable
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  s AS (SELECT *, CASE WHEN functions >= 1 AND strings >= 1 THEN 0 WHEN property_shapes >= 1 AND strings >= 4 THEN 1 WHEN object_shapes >= 1 AND strings >= 5 THEN 2 WHEN class_shapes >= 1 AND strings >= 4 THEN 3 WHEN switch_shapes >= 1 AND strings >= 4 THEN 4
    WHEN axes >= 4 AND strings >= 1 THEN 0 WHEN jsx >= 3 AND (strings >= 1 OR axes >= 4) THEN 0 END AS s, greatest(functions, axes, jsx, property_anchors, object_anchors, class_anchors, switch_anchors) AS hits,
    (functions >= 1 AND strings >= 1) OR (property_shapes >= 1 AND strings >= 4) OR (object_shapes >= 1 AND strings >= 5) OR (class_shapes >= 1 AND strings >= 4) OR (switch_shapes >= 1 AND strings >= 4) AS d FROM c),
  r AS (SELECT *, row_number() OVER w AS n, lead(hits) OVER w = hits AND lead(strings) OVER w = strings AND lead(s) OVER w = s AS tied FROM s WHERE s IS NOT NULL WINDOW w AS (PARTITION BY module, package, version ORDER BY hits DESC, strings DESC, importable DESC, s, path))
  SELECT module, package, version, path, ['function_signature', 'property_shape', 'object_shape', 'class_shape', 'switch_shape'][s + 1] AS strategy, hits AS functions, strings, subset AND d AND importable AS direct FROM r WHERE n = 1 AND NOT coalesce(tied, false)""")
def qualified_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The seven qualifying rules of a version's sources, on counts of line items."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.count_if
    c = rows.groupBy(F.col("l_suppkey").alias("module"), F.col("p_brand").alias("package"), F.col("p_type").alias("version"), F.col("p_name").alias("path")).agg(
        (n(F.col("l_returnflag") == "R") - 1).alias("functions"), F.count(F.lit(1)).alias("strings"), n(F.col("l_linestatus") == "O").alias("axes"), n(F.col("l_quantity") > 25).alias("jsx"),
        n(F.col("l_discount") == 0).alias("property_shapes"), n(F.col("l_discount") < 0.02).alias("property_anchors"), n(F.col("l_tax") == 0).alias("object_shapes"), n(F.col("l_tax") < 0.02).alias("object_anchors"),
        n(F.col("l_linenumber") == 1).alias("class_shapes"), n(F.col("l_linenumber") < 3).alias("class_anchors"), n(F.col("l_linenumber") == 7).alias("switch_shapes"), n(F.col("l_linenumber") > 5).alias("switch_anchors"),
        (F.min("l_linenumber") == 1).alias("subset"), (F.max("p_size") > 25).alias("importable"),
    )
    return packages.qualified_sources(c)


_BAG = """SELECT {doc} AS doc, {fn} AS fn, 'axis' AS kind, l_returnflag || l_quantity::INT AS key, 3 AS weight, l_returnflag <> 'N' AS strong FROM {rows} UNION ALL SELECT {doc}, {fn}, 'pair', l_quantity::INT || '/' || l_linenumber, 4, false FROM {rows}
  UNION ALL SELECT {doc}, {fn}, 'shape', l_linenumber || '/' || round(100 * l_discount)::INT || '/' || round(100 * l_tax)::INT, 1, false FROM {rows}"""


@query(f"""WITH m AS ({_BAG.format(doc="'s' || l_suppkey", fn="l_orderkey", rows="lineitem")}), pr AS ({_BAG.format(doc="p_brand", fn="l_partkey", rows="lineitem JOIN part ON l_partkey = p_partkey")}), f AS (SELECT doc, count(DISTINCT fn) AS fns FROM pr GROUP BY 1),
  held AS (SELECT doc, kind, key, count(*) AS n, count(DISTINCT fn) AS f FROM pr GROUP BY ALL), t AS (SELECT doc AS r, kind, key, n FROM held JOIN f USING (doc) WHERE fns < 8 OR f <= CASE kind WHEN 'axis' THEN greatest(3, least(50, ceil(fns / 5))) ELSE greatest(2, least(40, ceil(fns / 4))) END),
  own AS (SELECT doc AS l, kind, key, count(*) AS m, max(weight) AS w, bool_or(strong) AS s FROM m GROUP BY ALL),
  sums AS (SELECT l, r, coalesce(sum(least(m, n) * w) FILTER (WHERE kind = 'axis'), 0) AS a, coalesce(sum(least(m, n) * w) FILTER (WHERE kind = 'pair'), 0) AS p, coalesce(sum(least(m, n)) FILTER (WHERE kind = 'shape'), 0) AS h,
    coalesce(sum(least(m, n)) FILTER (WHERE kind = 'axis' AND s), 0) AS ah, coalesce(sum(least(m, n)) FILTER (WHERE kind = 'pair'), 0) AS ph FROM own JOIN t USING (kind, key) GROUP BY ALL),
  whole AS (SELECT l, sum(m * w) FILTER (WHERE kind = 'axis') AS wa, sum(m * w) FILTER (WHERE kind = 'pair') AS wp, sum(m) FILTER (WHERE kind = 'shape') AS wh FROM own GROUP BY 1), size AS (SELECT doc AS l, count(DISTINCT fn) AS functions FROM m GROUP BY 1),
  ks AS (SELECT DISTINCT doc AS l, fn, kind, key, strong FROM m), few AS (SELECT l, fn, count(*) AS c FROM ks WHERE kind = 'axis' GROUP BY ALL),
  hit AS (SELECT l, r, fn, bool_or(kind = 'axis' AND (strong OR c <= 3)) AS a, bool_or(kind = 'pair') AS p, bool_or(kind = 'shape') AS s FROM ks JOIN t USING (kind, key) JOIN few USING (l, fn) GROUP BY ALL),
  g AS (SELECT l, r, count(*) FILTER (WHERE a OR p OR s) AS fa, count(*) FILTER (WHERE p) AS fp, count(*) FILTER (WHERE s) AS fs FROM hit GROUP BY ALL),
  x AS (SELECT l, r, functions, a / wa AS ac, p / wp AS pc, h / wh AS hc, fa / functions AS af, fp / functions AS pf, fs / functions AS hf, ah, ph, h AS hh, fa FROM sums JOIN whole USING (l) JOIN size USING (l) JOIN g USING (l, r)),
  y AS (SELECT *, 900 * ac + 450 * pc + 180 * hc + 150 * af + 220 * pf + 300 * hf + 4 * least(25, ah) + 5 * least(25, ph) + 6 * least(25, hh) AS score FROM x),
  z AS (SELECT *, row_number() OVER o AS k, coalesce(lead(score) OVER o, 0) AS nx FROM y WINDOW o AS (PARTITION BY l ORDER BY round(score, 6) DESC, r)), mg AS (SELECT *, greatest(0, least(1, CASE WHEN score > 0 THEN (score - nx) / score ELSE 0 END)) AS margin FROM z WHERE k = 1)
  SELECT l AS "left", r AS "right", functions, round(ac, 6) AS axis_coverage, round(pc, 6) AS pair_coverage, round(hc, 6) AS shape_coverage, CAST(ah AS BIGINT) AS axis_hits, fa AS matched_functions, round(score, 4) AS score,
    fa > 0 AND ah + ph + hh >= 2 AND CASE WHEN functions = 1 THEN ac >= 0.75 AND ah >= 3 AND margin >= 0.5 ELSE margin >= 0.3 AND ((ac >= 0.35 AND af >= 0.5 AND ah >= 2) OR (pc >= 0.35 AND pf >= 0.5 AND ph >= 2) OR (hc >= 0.25 AND hf >= 0.6 AND hh >= 2 AND (ph >= 1 OR ah >= 1 OR ac >= 0.15 OR pc >= 0.15))) END AS accepted FROM mg""")
def composite_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers against brands by bags of axes, pairs and shapes of line items: six coverages, distinctive keys alone, margin and verdict."""
    l = table(spark, sf, "lineitem")
    whole = lambda c: F.round(100 * F.col(c)).cast("int").cast("string")
    text_of = lambda c: F.col(c).cast("int").cast("string")

    def bag(rows: DataFrame, doc, fn: str) -> DataFrame:
        keys = {"axis": (F.concat("l_returnflag", text_of("l_quantity")), 3, F.col("l_returnflag") != "N"), "pair": (F.concat_ws("/", text_of("l_quantity"), text_of("l_linenumber")), 4, F.lit(False)), "shape": (F.concat_ws("/", text_of("l_linenumber"), whole("l_discount"), whole("l_tax")), 1, F.lit(False))}
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), key.alias("key"), F.lit(w).alias("weight"), s.alias("strong")) for k, (key, w, s) in keys.items()]))
        return rows.select(doc.alias("doc"), F.col(fn).alias("fn"), each.alias("x")).select("doc", "fn", "x.*")

    right = bag(l.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")), F.col("p_brand"), "l_partkey")
    out = packages.composite_scores(bag(l, F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), "l_orderkey"), right)
    return out.select("left", "right", "functions", *[F.round(f"{k}_coverage", 6).alias(f"{k}_coverage") for k in ("axis", "pair", "shape")], "axis_hits", "matched_functions", F.round("score", 4).alias("score"), "accepted")


@query("""WITH m AS (SELECT s_suppkey AS module, s_nationkey % 5 AS package, s_nationkey % 2 AS version FROM supplier), s AS (SELECT p_partkey AS path, p_size % 5 AS package, p_partkey % 2 AS version FROM part), q AS (SELECT l_suppkey AS module, l_partkey AS path, sum(l_quantity) AS score FROM lineitem GROUP BY ALL),
  x AS (SELECT module, path, score, package || chr(31) || version || chr(31) || path AS k FROM q JOIN m USING (module) JOIN s USING (path, package, version)), r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, k) AS a, row_number() OVER (PARTITION BY k ORDER BY score DESC, module) AS b FROM x)
  SELECT module, path, score FROM r WHERE a = 1 AND b = 1""")
def owned_source_names(spark: SparkSession, sf: str) -> DataFrame:
    """Each other's best within one package and version."""
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("module"), (F.col("s_nationkey") % 5).alias("package"), (F.col("s_nationkey") % 2).cast("long").alias("version"))
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), (F.col("p_size") % 5).alias("package"), (F.col("p_partkey") % 2).alias("version"))
    q = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("path")).agg(F.sum("l_quantity").alias("score"))
    return packages.owned_source_names(m, s, q)


@query("""WITH v AS (SELECT p_brand AS package, p_partkey % 3 || '.' || p_size || '.' || p_partkey % 4 AS version, [p_partkey % 3, p_size, p_partkey % 4] AS k FROM part),
  r AS (SELECT s_suppkey AS request, 'Brand#' || (1 + s_suppkey % 30) AS package, ['', '^', '~'][1 + s_suppkey % 3] AS op, s_suppkey % 4 AS a, s_suppkey % 53 AS b, s_suppkey % 5 AS c FROM supplier),
  q AS (SELECT *, op || a || '.' || b || '.' || c AS requirement, [a, b, c] AS lo, CASE op WHEN '^' THEN CASE WHEN a > 0 THEN [a + 1, 0, 0] WHEN b > 0 THEN [0, b + 1, 0] ELSE [0, 0, c + 1] END WHEN '~' THEN [a, b + 1, 0] ELSE [a, b, c + 1] END AS hi FROM r),
  e AS (SELECT request, any_value(version) AS exact FROM q JOIN v ON v.package = q.package AND version = requirement GROUP BY 1), g AS (SELECT request, arg_max(version, k) AS ranged FROM q JOIN v USING (package) WHERE k >= lo AND k < hi GROUP BY 1), t AS (SELECT package, arg_max(version, k) AS latest FROM v GROUP BY 1)
  SELECT request, package, requirement, coalesce(exact, ranged, latest) AS version, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN ranged IS NOT NULL THEN 'satisfies' WHEN latest IS NOT NULL THEN 'nearest' ELSE 'unavailable' END AS reason FROM q LEFT JOIN e USING (request) LEFT JOIN g USING (request) LEFT JOIN t USING (package)""")
def resolved_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with the version that answers them and why."""
    s, p, of = F.col("s_suppkey"), F.col("p_partkey"), lambda c: c.cast("string")
    available = table(spark, sf, "part").select(F.col("p_brand").alias("package"), F.concat_ws(".", of(p % 3), of(F.col("p_size")), of(p % 4)).alias("version"))
    op = F.element_at(F.array(*map(F.lit, ["", "^", "~"])), (1 + s % 3).cast("int"))
    asked = table(spark, sf, "supplier").select(s.alias("request"), F.concat(F.lit("Brand#"), of(1 + s % 30)).alias("package"), F.concat(op, F.concat_ws(".", of(s % 4), of(s % 53), of(s % 5))).alias("requirement"))
    return packages.resolved_requests(asked, available)


@query("""WITH f AS (SELECT l_suppkey AS module, l_partkey AS token, max(l_quantity) AS weight FROM lineitem GROUP BY ALL), c AS (SELECT DISTINCT p_brand AS package, p_size AS version, p_partkey // 3 AS token FROM part), rare AS (SELECT token FROM c GROUP BY 1 HAVING count(*) <= 20),
  m AS (SELECT module, package, version, sum(weight) AS score FROM f JOIN rare USING (token) JOIN c USING (token) GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS k, score - coalesce(lead(score) OVER w, 0) AS margin FROM m WINDOW w AS (PARTITION BY module ORDER BY score DESC, package, version))
  SELECT module, package, version, score, margin FROM r WHERE k = 1 AND score >= 12 AND margin >= 8""")
def axis_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that few versions have, summed by weight, with a clear margin."""
    f = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("token")).agg(F.max("l_quantity").alias("weight"))
    c = table(spark, sf, "part").select(F.col("p_brand").alias("package"), F.col("p_size").alias("version"), F.floor(F.col("p_partkey") / 3).alias("token"))
    return packages.axis_tokens(f, c)


@query("""WITH f AS (SELECT o_orderkey AS path, 60 AS lines FROM orders), i AS (SELECT l_orderkey AS path, l_linenumber * 5 AS first, l_linenumber * 5 + CAST(l_quantity AS BIGINT) % 9 - 1 AS last, l_returnflag AS kind, 'p' || l_suppkey % 10 AS package FROM lineitem), s AS (SELECT * FROM i WHERE last >= first),
  c AS (SELECT count(*) AS c FROM (SELECT DISTINCT path, unnest(generate_series(first, last)) AS line FROM s)), t AS (SELECT count(*) AS n, sum(lines) AS t FROM f)
  SELECT 'kind' AS bucket, kind AS name, count(*) AS items, CAST(sum(last - first + 1) AS BIGINT) AS lines FROM s GROUP BY ALL UNION ALL SELECT 'package', package, count(*), CAST(sum(last - first + 1) AS BIGINT) FROM s GROUP BY ALL
  UNION ALL SELECT 'all', 'attributed', n, c FROM t, c UNION ALL SELECT 'all', 'unattributed', n, CAST(greatest(0, t - c) AS BIGINT) FROM t, c""")
def line_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by kind and package, and how many are covered at all."""
    files = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.lit(60).cast("long").alias("lines"))
    first = F.col("l_linenumber").cast("long") * 5
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), first.alias("first"), (first + F.col("l_quantity").cast("long") % 9 - 1).alias("last"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("p"), (F.col("l_suppkey") % 10).cast("string")).alias("package"))
    return packages.line_attribution(files, items)


_SITE = "['binding', 'reference', 'static_member', 'property_key', 'import', 'export']"


@query(f"""WITH s AS (SELECT l_suppkey AS file, {_SITE}[1 + l_linenumber % 6] AS kind, l_returnflag = 'N' AS named FROM lineitem) SELECT file, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in packages.SITES)}, count(*) AS total, count(*) FILTER (WHERE kind = 'binding' AND NOT named) AS pending FROM s GROUP BY ROLLUP(file)""")
def identifier_inventory(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, packages.SITES)), 1 + F.col("l_linenumber") % 6)
    return packages.identifier_inventory(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), kind.alias("kind"), (F.col("l_returnflag") == "N").alias("named")))


@query("""SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS "references", bool_or(p_size <= 25) AS present FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def asset_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Assets referred to, and whether they are there."""
    refs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("module"), F.col("l_partkey").alias("path"))
    return packages.asset_audit(refs, table(spark, sf, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("path")))


@query("""WITH s AS (SELECT l_orderkey AS module, CASE WHEN l_suppkey % 3 > 0 THEN 'f' || l_suppkey % 3 END AS scope, l_linenumber AS place, CASE l_returnflag WHEN 'A' THEN 'return' WHEN 'R' THEN 'throw' ELSE 'expression' END AS kind FROM lineitem),
  a AS (SELECT DISTINCT module, scope FROM (SELECT *, lag(kind) OVER (PARTITION BY module, scope ORDER BY place, kind) AS last FROM s) WHERE last IN ('return', 'throw'))
  SELECT CASE WHEN scope IS NULL THEN 'error' ELSE 'warning' END AS severity, CASE WHEN scope IS NULL THEN 'unreachable_top_level_code' ELSE 'unreachable_function_code' END AS code, CAST(module AS VARCHAR) AS module, scope AS binding FROM a""")
def unreachable_code(spark: SparkSession, sf: str) -> DataFrame:
    """What follows a return or throw, at the top and in functions."""
    scope = F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("f"), (F.col("l_suppkey") % 3).cast("string")))
    kind = F.when(F.col("l_returnflag") == "A", "return").when(F.col("l_returnflag") == "R", "throw").otherwise("expression")
    return packages.unreachable_code(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("module"), scope.alias("scope"), F.col("l_linenumber").alias("place"), kind.alias("kind")))


@query(f"""WITH {_FACTS}, w AS (SELECT DISTINCT module_id, binding FROM facts w WHERE kind = 'write' AND EXISTS (SELECT 1 FROM facts d WHERE d.module_id = w.module_id AND d.binding = w.binding AND d.kind = 'import') AND NOT EXISTS (SELECT 1 FROM facts d WHERE d.module_id = w.module_id AND d.binding = w.binding AND d.kind = 'definition')),
  o AS (SELECT binding, string_agg(module_id, ', ' ORDER BY module_id) AS owners FROM (SELECT DISTINCT binding, module_id FROM facts WHERE kind = 'definition') GROUP BY 1)
  SELECT 'warning' AS severity, 'cross_module_imported_write' AS code, CAST(module_id AS VARCHAR) AS module, CAST(w.binding AS VARCHAR) AS binding, coalesce(owners, '') AS owners FROM w LEFT JOIN o ON o.binding = w.binding""")
def imported_write_owners(spark: SparkSession, sf: str) -> DataFrame:
    return packages.imported_write_owners(facts(spark, sf))


@query(f"""WITH {_FACTS}, d AS (SELECT DISTINCT module_id, binding, kind FROM facts), u AS (SELECT module_id, binding FROM d r WHERE kind = 'read' AND NOT EXISTS (SELECT 1 FROM d x WHERE x.module_id = r.module_id AND x.binding = r.binding AND x.kind IN ('definition', 'import')))
  SELECT 'error' AS severity, 'missing_definition' AS code, module_id AS module, binding FROM u UNION ALL SELECT 'warning', 'duplicate_definition', module_id, binding FROM facts WHERE kind = 'definition' GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT 'error', 'imported_write', module_id, binding FROM d w WHERE kind = 'write' AND EXISTS (SELECT 1 FROM d x WHERE x.module_id = w.module_id AND x.binding = w.binding AND x.kind = 'import') AND NOT EXISTS (SELECT 1 FROM d x WHERE x.module_id = w.module_id AND x.binding = w.binding AND x.kind = 'definition')""")
def def_use_audit(spark: SparkSession, sf: str) -> DataFrame:
    return reports.def_use_audit(facts(spark, sf))


@query("""WITH RECURSIVE a AS (SELECT o_custkey AS m, o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders), e AS (SELECT * FROM a WHERE dst IS NOT NULL), r AS (SELECT o_custkey AS m, o_orderkey AS b FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e.m, dst FROM r JOIN e ON src = b)
  SELECT 'warning' AS severity, 'unprotected_nullable_member_read' AS code, CAST(o_custkey AS VARCHAR) AS module, CAST(o_orderkey AS VARCHAR) AS binding FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT b FROM r)""")
def unguarded_nullable_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Nullable bindings of which an alias is read without a guard."""
    o = table(spark, sf, "orders")
    of = lambda df: df.select(F.col("o_custkey").alias("module"), F.col("o_orderkey").alias("binding"))
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    aliases = o.select(F.col("o_custkey").alias("module"), F.col("o_orderkey").alias("src"), after.alias("dst")).filter("dst is not null")
    return packages.unguarded_nullable_reads(of(o.filter("o_orderstatus = 'P'")), of(o.filter("o_orderpriority = '1-URGENT'")), aliases)


@query("SELECT page_id, length(html) - length(translate(html, ';{},[]', '')) AS lines FROM pages")
def estimated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", packages.estimated_lines(F.col("html")).alias("lines"))


@query("""WITH b AS (SELECT l_suppkey AS module, l_linenumber AS file, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'N') AS named FROM lineitem GROUP BY ALL), s AS (SELECT p_partkey % 100 AS module, count(*) AS surfaces, count(*) FILTER (WHERE p_size > 25) AS accepted FROM part GROUP BY 1)
  SELECT b.module, file, total, named, total - named AS pending, round(CASE WHEN total = 0 THEN 100 ELSE 100.0 * named / total END, 6) AS percent, coalesce(surfaces, 0) AS surfaces, coalesce(accepted, 0) AS accepted_surfaces FROM b LEFT JOIN s USING (module)""")
def progress_groups(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("module"), F.col("l_linenumber").alias("file"), (F.col("l_returnflag") == "N").alias("named"))
    s = table(spark, sf, "part").select((F.col("p_partkey") % 100).alias("module"), (F.col("p_size") > 25).alias("accepted"))
    return packages.progress_groups(b, s).withColumn("percent", F.round("percent", 6))


@query("""WITH m AS (SELECT o_custkey, o_orderdate, o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS m, unnest([0, 1]) AS i FROM orders), f AS (SELECT o_custkey, m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, i) AS n FROM m), g AS (SELECT o_custkey, m, min(n) AS n FROM f GROUP BY ALL)
  SELECT o_custkey, string_agg(m, '|' ORDER BY n) AS members FROM g GROUP BY 1""")
def members_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct members of a key's arrays as they were first seen."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("members"))
    out = packages.members_in_order(o, "o_custkey", "members", ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", F.array_join("members", "|").alias("members"))


_REASON = "CASE o_orderpriority WHEN '1-URGENT' THEN 'package, keeps its source' WHEN '2-HIGH' THEN 'source-preserved vendor code' WHEN '5-LOW' THEN NULL ELSE 'rejected ' || o_orderpriority END"


@query(f"""SELECT o_orderkey, coalesce(regexp_matches({_REASON}, 'source[- ]preserv|keeps? (?:its )?source|application source'), false) AS preserved, o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_totalprice > 100000 AS providable FROM orders""")
def ownership_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Owners by their reasons, and attributions that an import can stand for."""
    p = F.col("o_orderpriority")
    reason = F.when(p == "1-URGENT", "package, keeps its source").when(p == "2-HIGH", "source-preserved vendor code").when(p != "5-LOW", F.concat(F.lit("rejected "), p))
    ok = packages.providable(F.when(F.col("o_orderstatus") == "F", "accepted"), F.when(p != "5-LOW", "external_import"), F.when(F.col("o_totalprice") > 100000, "1.0.0").otherwise(" "), F.lit("pkg"))
    return table(spark, sf, "orders").select("o_orderkey", packages.source_preserved(reason).alias("preserved"), ok.alias("providable"))


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS doc, l_partkey // 2 AS feature FROM lineitem WHERE l_linestatus = 'O'), r AS (SELECT DISTINCT l_orderkey % 500 AS doc, l_partkey // 2 AS feature FROM lineitem WHERE l_linestatus = 'F'), d AS (SELECT feature, ln((SELECT count(DISTINCT doc) FROM r) / count(*)) AS w FROM r GROUP BY 1 HAVING count(*) <= 64)
  SELECT l.doc AS "left", r.doc AS "right", count(*) AS shared, round(sum(w), 6) AS weight FROM l JOIN r USING (feature) JOIN d USING (feature) WHERE w >= 1 GROUP BY ALL""")
def telling_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by features that few have: the fan-out and the weight bound them."""
    l = table(spark, sf, "lineitem")
    of = lambda status, doc: l.filter(F.col("l_linestatus") == status).select(doc.alias("doc"), F.floor(F.col("l_partkey") / 2).alias("feature"))
    return packages.blocked_pairs(of("O", F.col("l_suppkey")), of("F", F.col("l_orderkey") % 500)).withColumn("weight", F.round("weight", 6))


@query("""WITH s AS (SELECT l_suppkey AS l, l_partkey AS r, least(1.0, sum(l_quantity) / 100) AS score FROM lineitem GROUP BY ALL), x AS (SELECT *, row_number() OVER w AS a, score - coalesce(lead(score) OVER w, 0) AS margin, row_number() OVER (PARTITION BY r ORDER BY score DESC, l) AS b FROM s WINDOW w AS (PARTITION BY l ORDER BY score DESC, r)),
  t AS (SELECT *, CASE WHEN score >= 1 THEN 'exact' WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.5 AND margin >= 0.1 THEN 'fair' WHEN score >= 0.3 AND margin >= 0.2 THEN 'weak' END AS tier FROM x WHERE a = 1 AND b = 1)
  SELECT l AS "left", r AS "right", round(score, 6) AS score, round(margin, 6) AS margin, tier FROM t WHERE tier IS NOT NULL""")
def linkage_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Each other's best in tiers of score and margin."""
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("left"), F.col("l_partkey").alias("right")).agg(F.least(F.lit(1.0), F.sum("l_quantity") / 100).alias("score"))
    return packages.linkage_tiers(s).withColumn("score", F.round("score", 6)).withColumn("margin", F.round("margin", 6))


@query("""WITH s AS (SELECT l_suppkey AS k, l_returnflag AS axis, sum(l_quantity) / 10000.0 AS score FROM lineitem GROUP BY ALL) SELECT axis, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, axis) AS i FROM s) WHERE i = 1 AND score >= 0.05 GROUP BY 1""")
def winning_axes(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("axis")).agg((F.sum("l_quantity") / 10000.0).alias("score"))
    return reports.winning_axes(s, "k", "axis", "score", 0.05)


@query("""WITH c AS (SELECT c_mktsegment, o_orderpriority AS tier, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS named FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT c_mktsegment, tier, n, named, CAST(sum(n) OVER (PARTITION BY c_mktsegment ORDER BY tier) AS BIGINT) AS cumulative FROM c""")
def tier_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", F.col("o_orderpriority").alias("tier"), (F.col("o_orderstatus") == "F").alias("named"))
    return reports.tier_breakdown(m, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "c_mktsegment")


@query("""WITH m AS (SELECT p_partkey AS id, p_type || '/' || p_name AS path, CASE WHEN p_size % 2 = 0 THEN 'application' ELSE 'package' END AS kind, CASE WHEN p_size % 7 = 0 THEN 'vendor/' ELSE '' END AS pre FROM part), a AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'application_source' ELSE 'external_import' END AS mode FROM part WHERE p_size % 5 = 0)
  SELECT m.id, pre || path AS path FROM m LEFT JOIN a USING (id) WHERE m.id % 11 <> 0 AND pre = '' AND CASE WHEN mode IS NOT NULL THEN mode = 'application_source' ELSE kind = 'application' END""")
def first_party(spark: SparkSession, sf: str) -> DataFrame:
    """The project's own modules."""
    p, size = table(spark, sf, "part"), F.col("p_size")
    path = F.concat(F.when(size % 7 == 0, "vendor/").otherwise(""), "p_type", F.lit("/"), "p_name")
    m = p.select(F.col("p_partkey").alias("id"), path.alias("path"), F.when(size % 2 == 0, "application").otherwise("package").alias("kind"))
    a = p.filter(size % 5 == 0).select(F.col("p_partkey").alias("module_id"), F.lit("accepted").alias("status"), F.when(size % 3 == 0, "application_source").otherwise("external_import").alias("emission_mode"))
    return reports.first_party(m, a, p.filter(F.col("p_partkey") % 11 == 0).select(F.col("p_partkey").alias("id"))).select("id", "path")


@query("""WITH e AS (SELECT p_brand, list(DISTINCT string_split(p_name, ' ')[1]) AS known FROM part WHERE p_size <= 10 GROUP BY 1), n AS (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS t FROM part)
  SELECT p_partkey, array_to_string([x FOR x IN t IF NOT list_contains(list_concat(coalesce(known, []), ['ring', 'bolt']), x)], ',') AS unknown FROM n LEFT JOIN e USING (p_brand)""")
def vocabulary_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Words of proposed names that nothing vouches for."""
    p = table(spark, sf, "part")
    evidence = p.filter("p_size <= 10").select(F.col("p_brand").alias("module"), F.split("p_name", " ")[0].alias("token"))
    out = reports.vocabulary_gate(p.select("p_partkey", F.col("p_brand").alias("module"), F.col("p_name").alias("name")), evidence, ["ring", "bolt"])
    return out.select("p_partkey", F.array_join("unknown", ",").alias("unknown"))


_SPECIFIERS = """s AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '@' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '/lib/a' WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN './' || p_name WHEN 3 THEN 'node:fs' WHEN 4 THEN 'fs/promises' WHEN 5 THEN replace(p_name, ' ', '-') || '/sub/' || p_size
  WHEN 6 THEN '@' || lower(p_type) || '/' || replace(p_name, ' ', '-') ELSE '/abs/' || p_size END AS s FROM part)"""


def specifiers(spark: SparkSession, sf: str) -> DataFrame:
    k, name, kind, size = F.col("p_partkey") % 8, F.replace("p_name", F.lit(" "), F.lit("-")), F.concat(F.lit("@"), F.lower("p_type"), F.lit("/")), F.col("p_size").cast("string")
    s = F.when(k == 0, F.concat(kind, name, F.lit("/lib/a"))).when(k == 1, name).when(k == 2, F.concat(F.lit("./"), "p_name")).when(k == 3, "node:fs").when(k == 4, "fs/promises").when(k == 5, F.concat(name, F.lit("/sub/"), size)).when(k == 6, F.concat(kind, name)).otherwise(F.concat(F.lit("/abs/"), size))
    return table(spark, sf, "part").select("p_partkey", s.alias("s"))


@query(f"""WITH {_SPECIFIERS} SELECT p_partkey, CASE WHEN s[1] IN ('.', '/') OR contains(s, ':') THEN NULL WHEN s[1] = '@' THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE string_split(s, '/')[1] END AS package,
  CASE WHEN s[1] IN ('.', '/') OR contains(s, ':') THEN NULL WHEN s[1] = '@' THEN nullif(array_to_string(string_split(s, '/')[3:], '/'), '') ELSE nullif(array_to_string(string_split(s, '/')[2:], '/'), '') END AS subpath, s IN ('node:fs', 'fs/promises') AS builtin FROM s""")
def specifier_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Packages, subpaths and built-in modules of import specifiers."""
    s = F.col("s")
    return specifiers(spark, sf).select("p_partkey", text.specifier_package(s).alias("package"), text.specifier_subpath(s).alias("subpath"), text.is_node_builtin(s).alias("builtin"))


@query(f"""WITH {_SPECIFIERS}, p AS (SELECT DISTINCT s, CASE WHEN s[1] IN ('.', '/') OR contains(s, ':') THEN NULL WHEN s[1] = '@' THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE string_split(s, '/')[1] END AS package FROM s), f AS (SELECT DISTINCT package, s AS e FROM p JOIN s USING (s) WHERE p_partkey % 3 = 0 AND package IS NOT NULL)
  SELECT p_partkey AS importer, s AS specifier, CASE WHEN s IN (SELECT e FROM f) THEN 'exact' WHEN package IN (SELECT package FROM f) THEN CASE WHEN s = package THEN 'package' ELSE 'deep_import' END ELSE 'unresolved' END AS resolution FROM s JOIN p USING (s)""")
def surface_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Imports against the surfaces that every third part's package exports."""
    from factloom.operators.matching import surface_resolution as resolve

    s = specifiers(spark, sf)
    surfaces = s.filter("p_partkey % 3 = 0").select(text.specifier_package(F.col("s")).alias("package_name"), F.col("s").alias("export_specifier")).filter("package_name is not null").distinct()
    return resolve(s.select(F.col("p_partkey").alias("importer"), F.col("s").alias("specifier")), surfaces)


@query("""WITH n AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'semanticFunction' || (1 + p_partkey) WHEN 1 THEN 'module' || p_partkey || 'SemanticSymbol1' WHEN 2 THEN 'class' WHEN 3 THEN p_size || p_name WHEN 4 THEN '' ELSE p_name END AS n FROM part)
  SELECT p_partkey, p_partkey IN (SELECT p_partkey FROM part WHERE p_size % 6 IN (0, 1)) AS placeholder, CASE WHEN n = '' THEN '_' WHEN n = 'class' THEN '_class' WHEN regexp_matches(n, '^[0-9]') THEN '_' || replace(n, ' ', '_') ELSE replace(n, ' ', '_') END AS identifier, n = 'class' AS keyword FROM n""")
def identifier_names(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up names, and names made into identifiers."""
    k, key = F.col("p_size") % 6, F.col("p_partkey").cast("string")
    n = F.when(k == 0, F.concat(F.lit("semanticFunction"), (F.col("p_partkey") + 1).cast("string"))).when(k == 1, F.concat(F.lit("module"), key, F.lit("SemanticSymbol1"))).when(k == 2, "class").when(k == 3, F.concat(F.col("p_size").cast("string"), "p_name")).when(k == 4, "").otherwise(F.col("p_name"))
    rows = table(spark, sf, "part").select("p_partkey", n.alias("n"))
    return rows.select("p_partkey", text.is_placeholder(F.col("n")).alias("placeholder"), text.sanitized_identifier(F.col("n")).alias("identifier"), text.is_keyword(F.col("n")).alias("keyword"))


_PATHS = "p AS (SELECT p_partkey, ['src/', 'node_modules/', 'a/./vendor/', 'dist/esm/', 'x/../y/'][1 + p_size % 5] || lower(p_type) || '/' || replace(p_name, ' ', '_') || ['.ts', '.d.ts', '.wasm', '.node', '.json', '.png', '.mjs'][1 + p_partkey % 7] AS p FROM part)"


@query(f"""WITH {_PATHS} SELECT p_partkey, regexp_replace(replace(p, '/./', '/'), '^x/\\.\\./', '') AS normal, array_to_string({_TOKENS.format('p')}, '/') AS tokens, starts_with(p, 'node_modules/') OR contains(p, '/vendor/') AS vendored,
  CASE p_partkey % 7 WHEN 2 THEN 'wasm' WHEN 3 THEN 'native' WHEN 4 THEN 'data' WHEN 5 THEN 'media' ELSE 'other' END AS asset, regexp_replace(regexp_replace(replace(p, '/./', '/'), '^x/\\.\\./', ''), '[^/]*$', '') || 'b.js' AS candidate FROM p""")
def path_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Normal paths, tokens, vendored code, kinds of assets, and where ./b leads."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (1 + i).cast("int"))
    path = F.concat(pick(["src/", "node_modules/", "a/./vendor/", "dist/esm/", "x/../y/"], F.col("p_size") % 5), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), pick([".ts", ".d.ts", ".wasm", ".node", ".json", ".png", ".mjs"], F.col("p_partkey") % 7))
    p = table(spark, sf, "part").select("p_partkey", path.alias("p"))
    c = F.col("p")
    return p.select("p_partkey", text.normalized_path(c).alias("normal"), F.array_join(text.path_tokens(c), "/").alias("tokens"), text.is_vendored(c).alias("vendored"), text.asset_kind(c).alias("asset"), text.resolution_candidates(c, F.lit("./b"))[1].alias("candidate"))


@query("""SELECT n_name, CASE n_nationkey % 6 WHEN 0 THEN 'package' WHEN 1 THEN 'asset' WHEN 2 THEN 'runtime' ELSE 'application' END AS kind FROM nation""")
def module_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Known categories as they are; null, blank and unknown ones are application code."""
    k = F.col("n_nationkey") % 6
    category = F.when(k == 0, "Package").when(k == 1, " asset ").when(k == 2, "runtime").when(k == 3, " ").when(k == 4, "unheard of")
    return table(spark, sf, "nation").select("n_name", text.module_kind(category).alias("kind"))


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS node, p_partkey + 1 AS target FROM part WHERE p_size % 5 = 0), e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem), f AS (SELECT node, target FROM t UNION SELECT f.node, t.target FROM f JOIN t ON t.node = f.target), last AS (SELECT node, max(target) AS target FROM f GROUP BY 1)
  SELECT DISTINCT src, coalesce(target, dst) AS dst FROM e LEFT JOIN last ON node = dst""")
def contract_pass_through(spark: SparkSession, sf: str) -> DataFrame:
    """Edges to nodes that only pass on lead to where these end."""
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    t = table(spark, sf, "part").filter("p_size % 5 = 0").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") + 1).alias("target"))
    return graph.contract_pass_through(e, t)
