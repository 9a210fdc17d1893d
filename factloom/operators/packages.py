"""Package evidence: source quality, relevance, coherent dependencies, qualifying rules of version matches, composite bag scores, inventories and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import blank_to_null, path_tokens, semver
from factloom.operators.graph import reachable
from factloom.sources.facts import first_per

#: Sources of a version from which on only those that a hint points to are kept (fixed value).
MANY_SOURCES = 256
#: Points of the composite score for each of its six coverages, then for up to CAP hits of each kind (fixed values).
COVERAGES = {"axis": 900.0, "pair": 450.0, "shape": 180.0, "axis_functions": 150.0, "pair_functions": 220.0, "shape_functions": 300.0}
HITS, CAP = {"axis": 4.0, "pair": 5.0, "shape": 6.0}, 25
#: Least and greatest number of functions that may share a key of a package, and the share of its functions (fixed values).
DISTINCT = {"axis": (3, 50, 5), "pair": (2, 40, 4), "shape": (2, 40, 4)}
#: Sets that shape rules need of a kind, and of string anchors (fixed values).
SHAPE_RULES = {"property": (1, 4), "object": (1, 5), "class": (1, 4), "switch": (1, 4)}
AXIS_FLOOR, JSX_FLOOR = 4, 3


def hint_text(c: Column) -> Column:
    """Letters and figures alone, in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def source_quality(source: Column, parses: Column, package: Column, semantic_path: Column) -> Column:
    """invalid where blank or unparseable; trusted where no package or no hint token says otherwise, or a token is in the text; weak else."""
    tokens = F.filter(F.transform(path_tokens(semantic_path), hint_text), lambda t: (t != "") & (t != hint_text(package)))
    text = hint_text(source)
    hit = F.exists(tokens, lambda t: F.contains(text, t))
    return F.when(blank_to_null(source).isNull() | ~parses, "invalid").when(package.isNull() | (F.size(tokens) == 0) | hit, "trusted").otherwise("weak")


def relevant_sources(sources: DataFrame, hints: DataFrame, many: int = MANY_SOURCES) -> DataFrame:
    """sources (package, version, path, source, public) of versions with more than `many` of them go unless a hint (package, version, hint) of theirs points to path or text; manifests and public entries stay."""
    key = ["package", "version"]
    large = sources.groupBy(*key).count().filter(F.col("count") > many).select(*key)
    hinted = hints.select(*key).distinct()
    judged = large.join(hinted, key, "left_semi")
    last = hint_text(F.regexp_extract("hint", r"([^/]+)/*$", 1))
    # Hints of a version are few, so each source meets its version's as one array.
    told = hints.filter(F.length(last) >= 4).groupBy(*key).agg(F.collect_set(last).alias("_hints"))
    rows = sources.join(judged.withColumn("_judged", F.lit(True)), key, "left").join(told, key, "left")
    text = F.concat(hint_text(F.col("path")), F.lit("/"), hint_text(F.col("source")))
    kept = F.col("_judged").isNull() | (F.col("path") == "package.json") | F.col("public") | F.coalesce(F.exists("_hints", lambda h: F.contains(text, h)), F.lit(False))
    return rows.filter(kept).drop("_judged", "_hints")


def coherent_dependencies(dependencies: DataFrame, listed: DataFrame) -> DataFrame:
    """dependencies (package, version) without scoped ones off the major that most packages of their scope landed on, where another kept one brings them along; listed (package, needs) are manifests' dependencies."""
    scope = F.nullif(F.regexp_extract("package", "^(@[^/]+)/", 1), F.lit(""))
    rows = dependencies.withColumn("_scope", scope).withColumn("_major", semver(F.col("version")).major)
    votes = rows.filter("_scope is not null and _major is not null").groupBy("_scope", "_major").agg(F.count_distinct("package").alias("_n"))
    totals = votes.groupBy("_scope").agg(F.sum("_n").alias("_all")).filter("_all >= 2")
    winners = first_per(votes.join(totals, "_scope"), ["_scope"], [F.col("_n").desc(), F.col("_major").desc()]).select("_scope", F.col("_major").alias("_wins"))
    rows = rows.join(winners, "_scope", "left").withColumn("_off", F.coalesce(F.col("_wins") != F.col("_major"), F.lit(False)))
    kept = rows.filter(~F.col("_off"))
    edges = listed.select(F.col("package").alias("src"), F.col("needs").alias("dst"))
    roots = kept.select(F.col("package").alias("node")).distinct()
    # What is brought along is what some reached package lists.
    provided = edges.join(reachable(edges, roots).withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("package")).distinct()
    return kept.unionByName(rows.filter("_off").join(provided, "package", "left_anti")).select("package", "version")


def hint_candidates(cache: DataFrame, packages: DataFrame, limit: int | None = None) -> DataFrame:
    """Non-blank cache rows (package, version, path, source) of the wanted packages in order; the first `limit` of them."""
    rows = cache.filter(blank_to_null(F.col("source")).isNotNull()).join(packages.select("package").distinct(), "package", "left_semi").orderBy("package", "version", "path")
    return rows if limit is None else rows.limit(limit)


def qualified_sources(counts: DataFrame, least_functions: int = 1, least_strings: int = 1) -> DataFrame:
    """(module, package, version, path, strategy, functions, strings, direct) of sources that pass one of seven rules over what they share with a module.

    counts: module, package, version, path, functions, strings, axes, jsx, {property,object,class,switch}_shapes and _anchors, subset (the module has no
    function that the source lacks), importable. Of several the best by functions, strings, importable, strategy, path; equal ones but for path are no match.
    """
    strings = F.col("strings")
    by_function = (F.col("functions") >= least_functions) & (strings >= least_strings)
    by_axis = (F.col("axes") >= AXIS_FLOOR) & (strings >= least_strings)
    by_jsx = (F.col("jsx") >= JSX_FLOOR) & ((strings >= least_strings) | (F.col("axes") >= AXIS_FLOOR))
    shapes = {kind: (F.col(f"{kind}_shapes") >= a) & (strings >= b) for kind, (a, b) in SHAPE_RULES.items()}
    strategy = F.when(by_function, 0)
    for i, rule in enumerate(shapes.values()):
        strategy = strategy.when(rule, i + 1)
    strategy = strategy.when(by_axis | by_jsx, 0)
    direct = by_function
    for rule in shapes.values():
        direct = direct | rule
    hits = F.greatest("functions", "axes", "jsx", *[f"{kind}_anchors" for kind in SHAPE_RULES])
    rows = counts.withColumn("_s", strategy).filter("_s is not null").withColumn("_hits", hits).withColumn("_direct", F.col("subset") & direct & F.col("importable"))
    w = Window.partitionBy("module", "package", "version").orderBy(F.col("_hits").desc(), strings.desc(), F.col("importable").desc(), F.col("_s"), "path")
    here = F.struct("_hits", "strings", "_s")
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_tied", F.coalesce(F.lead(here).over(w) == here, F.lit(False))).filter("_n = 1 and not _tied")
    names = F.array(*[F.lit(x) for x in ("function_signature", *[f"{k}_shape" for k in SHAPE_RULES])])
    return rows.select("module", "package", "version", "path", F.get(names, F.col("_s")).alias("strategy"), F.col("_hits").alias("functions"), "strings", F.col("_direct").alias("direct"))


def composite_scores(modules: DataFrame, packages: DataFrame) -> DataFrame:
    """Composite structural scores of modules against packages, with margin and verdict.

    Both are (doc, fn, kind, key, weight, strong) rows, kind being axis, pair or shape; a key that too many functions of a package have says nothing
    there. Counts of common keys, weighted, give three coverages; functions that any common key touches give three more.
    """
    kinds = list(HITS)
    functions = packages.groupBy("doc").agg(F.count_distinct("fn").alias("_fns"))
    held = packages.groupBy("doc", "kind", "key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fn").alias("_f")).join(functions, "doc")
    limit = F.when(F.lit(False), 0)
    for kind, (least, most, share) in DISTINCT.items():
        limit = limit.when(F.col("kind") == kind, F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("_fns") / share))))
    telling = held.filter((F.col("_fns") < 8) | (F.col("_f") <= limit)).select(F.col("doc").alias("right"), "kind", "key", "n")
    own = modules.groupBy(F.col("doc").alias("left"), "kind", "key").agg(F.count(F.lit(1)).alias("m"), F.max("weight").alias("weight"), F.max("strong").alias("strong"))
    met = own.join(telling, ["kind", "key"])
    common = F.least("m", "n")
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0))
    sums = met.groupBy("left", "right").agg(*[of(k, common * (F.lit(1) if k == "shape" else F.col("weight"))).alias(f"_{k}") for k in kinds], of("axis", F.when(F.col("strong"), common).otherwise(0)).alias("axis_hits"), of("pair", common).alias("pair_hits"), of("shape", common).alias("shape_hits"))
    whole = own.groupBy("left").agg(*[of(k, F.col("m") * (F.lit(1) if k == "shape" else F.col("weight"))).alias(f"_all_{k}") for k in kinds])
    keys = modules.select(F.col("doc").alias("left"), "fn", "kind", "key", "strong").distinct()
    size = modules.groupBy(F.col("doc").alias("left")).agg(F.count_distinct("fn").alias("functions"))
    few = keys.filter("kind = 'axis'").groupBy("left", "fn").agg(F.count(F.lit(1)).alias("_keys"))
    hit = keys.join(telling.drop("n"), ["kind", "key"]).join(few, ["left", "fn"], "left").groupBy("left", "right", "fn").agg(
        F.max(F.coalesce((F.col("kind") == "axis") & (F.col("strong") | (F.col("_keys") <= 3)), F.lit(False))).alias("a"), *[F.max(F.col("kind") == k).alias(k[0]) for k in ("pair", "shape")]
    )
    touched = hit.groupBy("left", "right").agg(F.count_if(F.col("a") | F.col("p") | F.col("s")).alias("f_axis"), F.count_if("p").alias("f_pair"), F.count_if("s").alias("f_shape"))
    rows = sums.join(whole, "left").join(size, "left").join(touched, ["left", "right"])
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    score = F.lit(0.0)
    for kind in kinds:
        rows = rows.withColumn(f"{kind}_coverage", share(f"_{kind}", f"_all_{kind}")).withColumn(f"{kind}_functions", share(f"f_{kind}", "functions"))
        score = score + F.col(f"{kind}_coverage") * COVERAGES[kind] + F.col(f"{kind}_functions") * COVERAGES[f"{kind}_functions"] + F.least(F.col(f"{kind}_hits"), F.lit(CAP)) * HITS[kind]
    rows = rows.withColumn("score", score)
    w = Window.partitionBy("left").orderBy(F.col("score").desc(), "right")
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("score").over(w), F.lit(0.0))).filter("_n = 1")
    rows = rows.withColumn("margin", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("score") > 0, (F.col("score") - F.col("_next")) / F.col("score")).otherwise(0.0))))
    return rows.select("left", "right", "functions", *[f"{k}_{x}" for k in kinds for x in ("coverage", "functions", "hits")], F.col("f_axis").alias("matched_functions"), "score", "margin", _accepted().alias("accepted"))


def _accepted() -> Column:
    c = F.col
    hits = c("axis_hits") + c("pair_hits") + c("shape_hits")
    single = (c("axis_coverage") >= 0.75) & (c("axis_hits") >= 3) & (c("margin") >= 0.5)
    by_axis = (c("axis_coverage") >= 0.35) & (c("axis_functions") >= 0.5) & (c("axis_hits") >= 2)
    by_pair = (c("pair_coverage") >= 0.35) & (c("pair_functions") >= 0.5) & (c("pair_hits") >= 2)
    backed = (c("pair_hits") >= 1) | (c("axis_hits") >= 1) | (c("axis_coverage") >= 0.15) | (c("pair_coverage") >= 0.15)
    by_shape = (c("shape_coverage") >= 0.25) & (c("shape_functions") >= 0.6) & (c("shape_hits") >= 2) & backed
    return (c("f_axis") > 0) & (hits >= 2) & F.when(c("functions") == 1, single).otherwise((c("margin") >= 0.3) & (by_axis | by_pair | by_shape))


def owned_source_names(modules: DataFrame, sources: DataFrame, scored: DataFrame) -> DataFrame:
    """(module, path, score) within a package and version alone: modules (module, package, version), sources (path, package, version); each other's best by score."""
    from factloom.operators.similarity import reciprocal_best

    pairs = scored.join(modules, "module").join(sources, ["path", "package", "version"]).select("module", F.concat_ws("\x1f", "package", "version", "path").alias("_source"), "path", "score")
    return reciprocal_best(pairs, "module", "_source", "score").select("module", "path", "score")


def resolved_requests(requests: DataFrame, available: DataFrame) -> DataFrame:
    """(request, package, requirement, version, reason): the version asked for, else the greatest that the range admits, else the greatest there is, else none."""
    from factloom.operators.matching import range_join

    available = available.select("package", "version").distinct()
    there = available.select(F.col("package").alias("_p"), F.col("version").alias("_exact"))
    exact = requests.join(there, (F.col("requirement") == F.col("_exact")) & (F.col("package") == F.col("_p")), "left").drop("_p")
    ranged = range_join(requests, available).select("request", F.col("version").alias("_ranged"))
    latest = available.withColumn("_v", semver(F.col("version"))).filter("_v is not null").groupBy("package").agg(F.max_by("version", "_v").alias("_latest"))
    rows = exact.join(ranged, "request", "left").join(latest, "package", "left")
    reason = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_ranged").isNotNull(), "satisfies").when(F.col("_latest").isNotNull(), "nearest").otherwise("unavailable")
    return rows.select("request", "package", "requirement", F.coalesce("_exact", "_ranged", "_latest").alias("version"), reason.alias("reason"))


def axis_tokens(features: DataFrame, corpus: DataFrame, most_versions: int = 20, least: float = 12.0, margin: float = 8.0) -> DataFrame:
    """(module, package, version, score, margin) by function-axis tokens (module, token, weight) that few versions (package, version, token) have."""
    rare = corpus.select("package", "version", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most_versions).select("token")
    met = features.join(rare, "token", "left_semi").join(corpus.select("package", "version", "token").distinct(), "token").groupBy("module", "package", "version").agg(F.sum("weight").alias("score"))
    w = Window.partitionBy("module").orderBy(F.col("score").desc(), "package", "version")
    rows = met.withColumn("_k", F.row_number().over(w)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return rows.filter((F.col("_k") == 1) & (F.col("score") >= least) & (F.col("margin") >= margin)).drop("_k")


def line_attribution(files: DataFrame, items: DataFrame) -> DataFrame:
    """(bucket, name, items, lines) by kind and by package, and of all lines how many an item covers; files (path, lines), items (path, first, last, kind, package)."""
    sound = items.filter("last >= first").withColumn("lines", F.col("last") - F.col("first") + 1)
    per = lambda c: sound.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("items"), F.sum("lines").alias("lines")).select(F.lit(c).alias("bucket"), "name", "items", "lines")
    # Lines covered by several items count once: islands of overlapping ranges, without a row for every line.
    w = Window.partitionBy("path").orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    covered = sound.withColumn("_from", F.greatest(F.col("first"), F.coalesce(reach + 1, F.col("first")))).agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("last") - F.col("_from") + 1)), F.lit(0)).alias("c"))
    total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("lines"), F.lit(0)).alias("t"))
    row = lambda name, lines: total.join(covered, F.lit(True)).select(F.lit("all").alias("bucket"), F.lit(name).alias("name"), F.col("n").alias("items"), lines.alias("lines"))
    return per("kind").unionByName(per("package")).unionByName(row("attributed", F.col("c"))).unionByName(row("unattributed", F.greatest(F.lit(0), F.col("t") - F.col("c"))))


SITES = ("binding", "reference", "static_member", "property_key", "import", "export")


def identifier_inventory(sites: DataFrame) -> DataFrame:
    """(file, six counters, total, pending) of sites (file, kind, named) for each file, and for all files in the row without one; pending are bindings without a name."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in SITES]
    pending = F.count_if((F.col("kind") == "binding") & ~F.col("named")).alias("pending")
    return sites.rollup("file").agg(*counts, F.count(F.lit(1)).alias("total"), pending)


def asset_audit(references: DataFrame, assets: DataFrame) -> DataFrame:
    """(path, references, present) of all assets that modules (module, path) refer to."""
    asked = references.groupBy("path").agg(F.count_distinct("module").alias("references"))
    return asked.join(assets.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left").select("path", "references", F.coalesce("_there", F.lit(False)).alias("present"))


FINDING = ("severity", "code", "module", "binding")


def _finding(df: DataFrame, severity: str, code: str) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("module").cast("string").alias("module"), F.col("binding").cast("string").alias("binding"))


def unreachable_code(statements: DataFrame) -> DataFrame:
    """Findings for statements (module, scope, place, kind) that follow a return or throw in their scope: errors at the top (a null scope), else warnings; one for each scope."""
    w = Window.partitionBy("module", "scope").orderBy("place", "kind")
    after = statements.withColumn("_last", F.lag("kind").over(w)).filter(F.col("_last").isin("return", "throw"))
    each = after.select("module", F.col("scope").alias("binding")).distinct()
    return _finding(each.filter("binding is null"), "error", "unreachable_top_level_code").union(_finding(each.filter("binding is not null"), "warning", "unreachable_function_code"))


def imported_write_owners(facts: DataFrame) -> DataFrame:
    """Findings, with the modules that define the binding, for writes to what a module only imports; facts (module_id, binding, kind)."""
    from factloom.operators.graph import imported_writes

    owners = facts.filter("kind = 'definition'").groupBy("binding").agg(F.array_join(F.transform(F.sort_array(F.collect_set("module_id")), lambda x: x.cast("string")), ", ").alias("owners"))
    rows = imported_writes(facts).join(owners, "binding", "left").select(F.col("module_id").alias("module"), "binding", F.coalesce("owners", F.lit("")).alias("owners"))
    return rows.select(F.lit("warning").alias("severity"), F.lit("cross_module_imported_write").alias("code"), F.col("module").cast("string").alias("module"), F.col("binding").cast("string").alias("binding"), "owners")


def unguarded_nullable_reads(nullable: DataFrame, reads: DataFrame, aliases: DataFrame) -> DataFrame:
    """Findings for bindings written from a call's or await's member chain (module, binding) of which an alias (module, src, dst: src stands for dst) or the binding itself is member-read (module, binding) without a guard."""
    from factloom.operators.graph import closure

    end = lambda m, b: F.concat_ws("\x1f", F.col(m).cast("string"), F.col(b).cast("string"))
    paths = closure(aliases.select(end("module", "src").alias("src"), end("module", "dst").alias("dst")))
    read = reads.select(end("module", "binding").alias("src")).distinct()
    reached = read.join(paths, "src").select(F.col("dst").alias("_k")).union(read.select(F.col("src").alias("_k"))).distinct()
    return _finding(nullable.withColumn("_k", end("module", "binding")).join(reached, "_k", "left_semi").select("module", "binding").distinct(), "warning", "unprotected_nullable_member_read")


def estimated_lines(source: Column) -> Column:
    """Terminators, braces, commas and brackets: how many lines a formatter would make of packed text."""
    return F.coalesce(F.char_length(source) - F.char_length(F.translate(source, ";{},[]", "")), F.lit(0))


def progress_groups(bindings: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(module, file, total, named, pending, percent, surfaces, accepted_surfaces) of bindings (module, file, named) and surfaces (module, accepted)."""
    from factloom.operators.reports import percent

    per = surfaces.groupBy("module").agg(F.count(F.lit(1)).alias("surfaces"), F.count_if("accepted").alias("accepted_surfaces"))
    rows = bindings.groupBy("module", "file").agg(F.count(F.lit(1)).alias("total"), F.count_if("named").alias("named")).join(per, "module", "left").na.fill(0, ["surfaces", "accepted_surfaces"])
    return rows.select("module", "file", "total", "named", (F.col("total") - F.col("named")).alias("pending"), percent(F.col("named"), F.col("total")).alias("percent"), "surfaces", "accepted_surfaces")


def members_in_order(rows: DataFrame, key: str, members: str, order: list[str]) -> DataFrame:
    """(key, members): the distinct members of a key's rows, in the order in which they were first seen."""
    each = rows.select(key, F.struct(*order).alias("_row"), F.posexplode(members).alias("_place", "_m"))
    first = each.groupBy(key, "_m").agg(F.min(F.struct("_row", "_place")).alias("_first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_m"))), lambda x: x["_m"]).alias(members))


def source_preserved(reason: Column) -> Column:
    """Reasons that say a module keeps its source whatever package owns it (fixed values)."""
    return F.coalesce(reason.rlike("source[- ]preserv|keeps? (?:its )?source|application source"), F.lit(False))


def providable(status: Column, mode: Column, version: Column, specifier: Column) -> Column:
    """Accepted external attributions that an import can stand for."""
    return F.coalesce((status == "accepted") & (mode == "external_import") & blank_to_null(version).isNotNull() & blank_to_null(specifier).isNotNull(), F.lit(False))


def blocked_pairs(left: DataFrame, right: DataFrame, fan_out: int = 64, least_idf: float = 1.0) -> DataFrame:
    """(left, right, shared, weight) of documents (doc, feature) that share a telling feature: one that at most `fan_out` on the right have, with an IDF of `least_idf` or more."""
    total = right.agg(F.count_distinct("doc").alias("_total"))
    df = right.distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("_df")).filter(F.col("_df") <= fan_out).join(F.broadcast(total), F.lit(True)).withColumn("_w", F.log(F.col("_total") / F.col("_df"))).filter(F.col("_w") >= least_idf)
    rows = right.distinct().join(df.select("feature", "_w"), "feature").select(F.col("doc").alias("right"), "feature", "_w")
    return left.select(F.col("doc").alias("left"), "feature").distinct().join(rows, "feature").groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared"), F.sum("_w").alias("weight"))


def linkage_tiers(scored: DataFrame, strong: float = 0.8, fair: float = 0.5, weak: float = 0.3, margin: float = 0.1) -> DataFrame:
    """(left, right, score, margin, tier) of each other's best: exact for a score of 1, strong, fair with a margin, weak with twice that margin; others are no link."""
    w = Window.partitionBy("left").orderBy(F.col("score").desc(), "right")
    rows = scored.withColumn("_l", F.row_number().over(w)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("right").orderBy(F.col("score").desc(), "left"))).filter("_l = 1 and _r = 1")
    s, m = F.col("score"), F.col("margin")
    tier = F.when(s >= 1, "exact").when(s >= strong, "strong").when((s >= fair) & (m >= margin), "fair").when((s >= weak) & (m >= 2 * margin), "weak")
    return rows.withColumn("tier", tier).filter("tier is not null").select("left", "right", "score", "margin", "tier")
