"""Record linkage by fingerprints: unique winners, tier cascades, votes, version ranking and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import range_bounds, semver
from factloom.session import written
from factloom.sources.facts import first_per

#: Weights of the tiers, strongest first (fixed values).
TIERS = {"exact": 10000, "exact_alternate": 5000, "structural_anchored": 1000, "structural_anchored_alternate": 500, "feature": 100, "feature_alternate": 50, "structural": 10, "structural_alternate": 5}
#: How many fingerprints of the index may share a hash before it says nothing (fixed values).
CEILINGS = {"cfg": 250, "primary": 250, "structural": 50}
#: Axes that block feature similarity, the most telling first.
PRIORITY = ["literal_anchor", "callee_set", "access_pattern", "throw_set", "structural_anchor", "literal_shape", "access_shape", "expression_shape", "binding_pattern", "effect_pattern", "return_pattern"]


def unique_winner(candidates: DataFrame, key: str = "fn") -> DataFrame:
    """Of (key, identity, fn_id) rows, the winner of each key whose candidates are all one; others have no match."""
    return candidates.groupBy(key).agg(F.count_distinct(F.struct("identity", "fn_id")).alias("_n"), F.min("identity").alias("identity"), F.min("fn_id").alias("fn_id")).filter("_n = 1").drop("_n")


def sole_owners(index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., owners, identity, fn_id): for each key of an index, 1 and its only candidate, or 2 where there are several. Asking it costs one row a query, however many share a key."""
    several = (F.min("identity").eqNullSafe(F.max("identity"))) & (F.min("fn_id").eqNullSafe(F.max("fn_id"))) & F.count("identity").isin(F.lit(0), F.count(F.lit(1))) & F.count("fn_id").isin(F.lit(0), F.count(F.lit(1)))
    return index.groupBy(*keys).agg(F.when(several, 1).otherwise(2).alias("owners"), F.min("identity").alias("identity"), F.min("fn_id").alias("fn_id"))


def unique_owner(queries: DataFrame, index: DataFrame, keys: list[str], key: str = "fn") -> DataFrame:
    """unique_winner() of queries joined with an index by keys, without their pairs: what several share is met once, and looked at again only for queries that found a sole owner too."""
    hits = queries.select(key, *keys).join(sole_owners(index, keys), keys)
    sole = written(unique_winner(hits.filter("owners = 1"), key))
    spoilt = hits.filter("owners = 2").select(key).join(sole.select(key), key, "left_semi").distinct()
    return sole.join(spoilt, key, "left_anti")


def exact(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Queries (fn, params, statements, ast) against an index (identity, fn_id, params, statements, ast)."""
    return unique_owner(queries, index, ["params", "statements", "ast"])


def exact_alternates(queries: DataFrame, index: DataFrame) -> DataFrame:
    """As exact(), for queries with a pass number `pos`; the first pass with a winner counts."""
    asked = queries.withColumn("_key", F.struct("fn", "pos"))
    winners = unique_owner(asked, index, ["params", "statements", "ast"], "_key").select("_key.fn", "_key.pos", "identity", "fn_id")
    return first_per(winners, ["fn"], [F.col("pos")]).drop("pos")


def anchored(queries: DataFrame, index: DataFrame, q_axes: DataFrame, i_axes: DataFrame, ceiling: int = CEILINGS["cfg"]) -> DataFrame:
    """Equal (params, cfg) and at least one of the anchor axes equal with the same candidate. Axes are (fn | identity, fn_id; axis, hash)."""
    few = index.groupBy("params", "cfg").count().filter(F.col("count") <= ceiling).drop("count")
    pairs = queries.join(few, ["params", "cfg"], "left_semi").join(index, ["params", "cfg"]).select("fn", "identity", "fn_id").distinct()
    anchors = ["literal_anchor", "callee_set", "throw_set"]
    # Anchors are looked at for candidate pairs alone, so a common one joins nothing by itself.
    asked = pairs.join(q_axes.filter(F.col("axis").isin(anchors)), "fn")
    shared = asked.join(i_axes, ["identity", "fn_id", "axis", "hash"], "left_semi").select("fn", "identity", "fn_id").distinct()
    return unique_winner(shared)


def feature_similarity(q_axes: DataFrame, i_axes: DataFrame, least: float = 0.6, ceiling: int = CEILINGS["primary"]) -> DataFrame:
    """Candidates share a query's most telling axis; the score is the share of its other axes that match too. Exact ties are no match."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("axis")), F.lit(0))
    told = F.when(F.col("hash").isNotNull(), F.concat_ws("\x1f", "axis", "hash"))
    few = i_axes.groupBy("axis", "hash").count().filter(F.col("count") <= ceiling).drop("count")
    first = q_axes.withColumn("_r", rank).filter("_r > 0").groupBy("fn").agg(F.min(F.struct("_r", "axis", "hash")).alias("x")).select("fn", F.col("x.axis").alias("_block"), F.col("x.hash").alias("_hash"))
    first = written(first.join(few.select(F.col("axis").alias("_block"), F.col("hash").alias("_hash")), ["_block", "_hash"], "left_semi"))
    asked = q_axes.join(first, "fn").filter("axis <> _block").groupBy("fn", "_block", "_hash").agg(F.count(F.lit(1)).alias("n"), F.collect_set(told).alias("_want"))
    # A candidate carries all its axes along, so that a pair is scored where it meets and no pair is joined again. The index is never
    # sent to all: its files are far smaller than its rows, so Spark takes it for small.
    each = i_axes.groupBy("identity", "fn_id").agg(F.collect_set(F.struct("axis", "hash")).alias("_axes"), F.collect_set(told).alias("_have"))
    blocks = each.select("identity", "fn_id", "_have", F.explode("_axes").alias("x")).select("identity", "fn_id", "_have", F.col("x.axis").alias("_block"), F.col("x.hash").alias("_hash"))
    blocks = blocks.join(first.select("_block", "_hash").distinct(), ["_block", "_hash"], "left_semi")
    axis = lambda x: F.substring_index(x, "\x1f", 1)
    hit = F.size(F.array_distinct(F.transform(F.array_intersect("_want", "_have"), axis)))
    scored = asked.join(blocks.hint("merge"), ["_block", "_hash"]).select("fn", "identity", "fn_id", (hit / F.col("n")).alias("score")).filter(F.col("score") >= least)
    alike = scored.groupBy("fn", "score").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("identity", "fn_id")).alias("x"))
    best = alike.groupBy("fn").agg(F.max(F.struct("score", "_n", "x")).alias("b")).filter("b._n = 1")
    return best.select("fn", "b.x.identity", "b.x.fn_id", "b.score")


def structural(q_axes: DataFrame, i_axes: DataFrame, axis: str = "structural_anchor", ceiling: int = CEILINGS["structural"]) -> DataFrame:
    """One axis alone: its hash must be rare and all who hold it one identity."""
    hashes = i_axes.filter(F.col("axis") == axis)
    few = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("identity").alias("ids"), F.min("identity").alias("identity"), F.min("fn_id").alias("fn_id")).filter((F.col("n") <= ceiling) & (F.col("ids") == 1))
    return q_axes.filter(F.col("axis") == axis).join(few.select("hash", "identity", "fn_id"), "hash").select("fn", "identity", "fn_id")


def cascade(tiers: dict[str, DataFrame]) -> DataFrame:
    """(fn, identity, fn_id, tier, rank) of all tiers, strongest first; a function with an exact match keeps that alone."""
    out = None
    for rank, name in enumerate(t for t in TIERS if t in tiers):
        rows = tiers[name].select("fn", "identity", "fn_id", F.lit(name).alias("tier"), F.lit(rank).alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    best = F.min(F.when(F.col("tier").isin("exact", "exact_alternate"), F.col("rank"))).over(Window.partitionBy("fn"))
    return out.withColumn("_exact", best).filter(F.col("_exact").isNull() | (F.col("rank") == F.col("_exact"))).drop("_exact")


def edge_weights(candidates: DataFrame, row: str, col: str) -> DataFrame:
    """Weights of an assignment: a tier's weight, less a tenth for each of up to four places in a function's list; the best of each pair."""
    tier = F.create_map(*[x for k, v in TIERS.items() for x in (F.lit(k), F.lit(float(v)))])
    place = F.row_number().over(Window.partitionBy(row).orderBy("rank", col)) - 1
    return candidates.withColumn("_w", tier[F.col("tier")] * (1 - 0.1 * F.least(place, F.lit(4)))).groupBy(row, col).agg(F.max("_w").alias("weight"))


def votes(hits: DataFrame, voter: str, subject: str, key: list[str]) -> DataFrame:
    """Each voter's hits count once for a subject; (key..., subject, votes) with most votes, then the least subject."""
    counted = hits.select(*key, voter, subject).distinct().groupBy(*key, subject).agg(F.count(F.lit(1)).alias("votes"))
    return first_per(counted, key, [F.col("votes").desc(), F.col(subject)])


def majority_pin(hits: DataFrame, sizes: DataFrame, least: float = 0.1) -> DataFrame:
    """(ref, subject, coverage, score): subjects hit by functions of a reference; score is the best coverage or 0.85 of the best two together."""
    counted = hits.select("ref", "fn", "subject").distinct().groupBy("ref", "subject").agg(F.count(F.lit(1)).alias("n")).join(sizes, "ref")
    rows = counted.withColumn("coverage", F.col("n") / F.col("functions"))
    w = Window.partitionBy("ref").orderBy(F.col("coverage").desc(), "subject")
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_second", F.coalesce(F.lead("coverage").over(w), F.lit(0.0)))
    return rows.filter((F.col("_n") == 1) & (F.col("coverage") >= least)).select("ref", "subject", "coverage", F.greatest(F.col("coverage"), 0.85 * (F.col("coverage") + F.col("_second"))).alias("score"))


def agreement(signals: dict[str, tuple[DataFrame, float]], least: int = 3) -> DataFrame:
    """(ref, subject, signals) that at least `least` signals name with a score of their own threshold."""
    out = None
    for name, (rows, threshold) in signals.items():
        rows = rows.filter(F.col("score") >= threshold).select("ref", "subject", F.lit(name).alias("signal"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("ref", "subject").agg(F.count_distinct("signal").alias("signals")).filter(F.col("signals") >= least)


def version_ranking(hits: DataFrame) -> DataFrame:
    """Of (module, package, version, sources, windows, anchors, tokens) counts, the best version of each module with its score; a tie between versions leaves the package and no version."""
    scored = hits.withColumn("score", 10000 * F.col("sources") + 1000 * F.col("windows") + 10 * F.col("anchors") + F.col("tokens"))
    parsed = semver(F.col("version"))
    w = Window.partitionBy("module").orderBy(F.col("score").desc(), F.col("sources").desc(), F.col("windows").desc(), parsed.desc_nulls_last(), "package", "version")
    rows = scored.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(F.struct("package", "score")).over(w)).filter("_n = 1")
    tied = F.coalesce((F.col("_next.package") == F.col("package")) & (F.col("_next.score") == F.col("score")), F.lit(False))
    return rows.select("module", "package", F.when(~tied, F.col("version")).alias("version"), "score", F.when(tied, "aggregate").otherwise("version").alias("strategy"))


def range_join(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """The greatest version of each request (request, package, requirement) that its range admits; pre-releases only where named."""
    keys = ["package", "requirement"]
    # Versions and requirements count once; the greatest release below an upper bound is the last before it in the order of both.
    parsed = versions.select("package", "version").distinct().withColumn("_v", semver(F.col("version"))).filter("_v is not null")
    asked = requests.select(*keys).distinct().withColumn("_b", range_bounds(F.col("requirement")))
    triple = F.struct(F.col("_v.major").alias("major"), F.col("_v.minor").alias("minor"), F.col("_v.patch").alias("patch"))
    releases = parsed.filter("_v.rank = 1").groupBy("package", triple.alias("_at")).agg(F.max_by("version", "_v").alias("version"), F.max("_v").alias("_v"))
    line = releases.withColumn("requirement", F.lit(None).cast("string")).withColumn("_low", F.lit(None).cast(releases.schema["_at"].dataType)).withColumn("_asks", F.lit(0))
    bounds = asked.filter("_b is not null").select("package", F.col("_b.high").alias("_at"), F.lit(None).cast("string").alias("version"), F.lit(None).cast(releases.schema["_v"].dataType).alias("_v"), "requirement", F.col("_b.low").alias("_low"), F.lit(-1).alias("_asks"))
    last = F.last(F.when(F.col("_asks") == 0, F.struct("_at", "version", "_v")), ignorenulls=True).over(Window.partitionBy("package").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0))
    ranged = line.unionByName(bounds).withColumn("_last", last).filter((F.col("_asks") == -1) & (F.col("_last._at") >= F.col("_low"))).select(*keys, "_last.version", "_last._v")
    named = asked.select(*keys, F.regexp_replace("requirement", "^[=v]+", "").alias("version")).join(parsed, ["package", "version"]).select(*keys, "version", "_v")
    best = ranged.unionByName(named).groupBy(*keys).agg(F.max_by("version", "_v").alias("version"))
    return requests.select("request", *keys).distinct().join(best, keys).select("request", *keys, "version")


def overlapping_owners(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, owner) of ranges (id, file_id, start, end): the labels of all spans (file_id, start, end, label) of the file that they overlap, joined; null where none does."""
    spans = spans.select("file_id", F.col("start").alias("_s"), F.col("end").alias("_e"), "label")
    met = ranges.join(spans, "file_id").filter((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")))
    owners = met.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("label")), " + ").alias("owner"))
    return ranges.select("id").join(owners, "id", "left")


def build_variant(hints: DataFrame) -> DataFrame:
    """Of (package, version, family, hint, score, importable), the family with the greatest sum of best scores; on ties an importable one, then by name."""
    best = hints.groupBy("package", "version", "family", "hint").agg(F.max("score").alias("score"), F.max("importable").alias("importable"))
    total = best.groupBy("package", "version", "family").agg(F.sum("score").alias("score"), F.max("importable").alias("importable"))
    return first_per(total, ["package", "version"], [F.col("score").desc(), F.col("importable").desc(), F.col("family")])


def surface_resolution(imports: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(importer, specifier, resolution): exact surface, its package with a deeper path, the package alone, or none."""
    from factloom.functions.text import specifier_package

    asked = imports.withColumn("package", specifier_package(F.col("specifier")))
    exact_rows = surfaces.select(F.col("export_specifier").alias("specifier"), F.lit(1).alias("_exact")).distinct()
    packages = surfaces.groupBy(F.col("package_name").alias("package")).agg(F.count(F.lit(1)).alias("_n"))
    out = asked.join(exact_rows, "specifier", "left").join(packages, "package", "left")
    return out.select("importer", "specifier", F.when(F.col("_exact") == 1, "exact").when(F.col("_n") > 0, F.when(F.col("specifier") == F.col("package"), "package").otherwise("deep_import")).otherwise("unresolved").alias("resolution"))


def accepted(score: Column, least: Column | float) -> Column:
    return score >= least


def pinned(queries: DataFrame, index: DataFrame, pins: DataFrame) -> DataFrame:
    """Exact matches inside paired buckets only: queries (fn, ref, hash), index (identity, fn_id, subject, hash), pins (ref, subject)."""
    return unique_winner(queries.join(pins, "ref").join(index, ["subject", "hash"]))


def bag_scores(left: DataFrame, right: DataFrame, weights: dict[str, float], cap: int = 25) -> DataFrame:
    """(left, right, score, coverage) of bags (doc, axis, feature, n): common counts up to `cap`, weighted by axis, and their share of the left bag."""
    weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    common = F.least(F.col("ln"), F.col("rn"), F.lit(cap)) * F.coalesce(weight[F.col("axis")], F.lit(1.0))
    met = left.select(F.col("doc").alias("left"), "axis", "feature", F.col("n").alias("ln")).join(right.select(F.col("doc").alias("right"), "axis", "feature", F.col("n").alias("rn")), ["axis", "feature"])
    whole = left.groupBy(F.col("doc").alias("left")).agg(F.sum(F.least("n", F.lit(cap)) * F.coalesce(weight[F.col("axis")], F.lit(1.0))).alias("_all"))
    out = met.groupBy("left", "right").agg(F.sum(common).alias("score")).join(whole, "left")
    return out.select("left", "right", "score", (F.col("score") / F.col("_all")).alias("coverage"))


def version_diagnostics(ranked: DataFrame, top: int = 3) -> DataFrame:
    """(module, package, version, score, rank, advice) of scored versions: use a clear first one, check a close one."""
    w = Window.partitionBy("module").orderBy(F.col("score").desc(), "package", "version")
    rows = ranked.withColumn("rank", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w))
    advice = F.when(F.col("rank") > 1, "alternative").when(F.col("_next").isNull() | (F.col("score") >= 1.5 * F.col("_next")), "use").otherwise("check")
    return rows.withColumn("advice", advice).filter(F.col("rank") <= top).select("module", "package", "version", "score", "rank", "advice")


def cached_sources(cache: DataFrame, names: DataFrame, policy: int = 1) -> DataFrame:
    """Usable cache rows of the named packages (package_name), with specifiers only where accepted under the policy."""
    usable = cache.filter(F.btrim("source") != "").join(names.select("package_name").distinct(), "package_name", "left_semi")
    return usable.withColumn("export_specifier", F.when(F.coalesce("policy_version", F.lit(-1)) == policy, F.col("export_specifier")))
