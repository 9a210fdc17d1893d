"""Reports: inventories, ledgers, verdicts, coverage, precision and recall, audits as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import blank_to_null, name_match


def percent(done: Column, total: Column, empty: float = 100.0) -> Column:
    """Of an empty universe, `empty`."""
    return F.when(total == 0, F.lit(empty)).otherwise(100.0 * done / total)


def scalar_inventory(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, n): all conditions counted in one pass."""
    one = df.agg(*[F.count_if(c).alias(name) for name, c in metrics.items()])
    return one.select(F.expr(f"stack({len(metrics)}, {', '.join(f'{name!r}, `{name}`' for name in metrics)}) as (metric, n)"))


def by_category(df: DataFrame, category: Column, known: list[str]) -> DataFrame:
    """(category, n); null, blank and unknown categories are unclassified."""
    c = F.lower(blank_to_null(category))
    return df.groupBy(F.when(c.isin(known), c).otherwise("unclassified").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def sum_per(parent: DataFrame, child: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total): 0 where a parent has no child."""
    sums = child.groupBy(key).agg(F.sum(value).alias("_s"))
    return parent.select(key).join(sums, key, "left").select(key, F.coalesce("_s", F.lit(0)).alias("total"))


def greatest_id(*columns: tuple[DataFrame, str]) -> DataFrame:
    """The greatest value of several columns, 0 if there is none."""
    rows = None
    for df, c in columns:
        x = df.agg(F.max(c).cast("long").alias("v"))
        rows = x if rows is None else rows.union(x)
    return rows.agg(F.coalesce(F.max("v"), F.lit(0)).alias("max_id"))


def cumulative_tiers(df: DataFrame, tier: Column, tiers: list[str], done: Column, keys: list[str]) -> DataFrame:
    """(keys..., tier, total, complete, percent): each tier holds the ones before it."""
    place = F.array_position(F.array(*map(F.lit, tiers)), tier)
    rows = df.select(*keys, done.cast("int").alias("_d"), F.explode(F.sequence(place.cast("int"), F.lit(len(tiers)))).alias("_t"))
    out = rows.groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("total"), F.sum("_d").cast("long").alias("complete"))
    return out.select(*keys, F.element_at(F.array(*map(F.lit, tiers)), F.col("_t")).alias("tier"), "total", "complete", percent(F.col("complete"), F.col("total")).alias("percent"))


def highest_complete(tiers_report: DataFrame, tiers: list[str], keys: list[str]) -> DataFrame:
    """(keys..., highest): the last tier that is complete; none for an empty universe."""
    place = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    top = F.max(F.when((F.col("total") > 0) & (F.col("complete") == F.col("total")), place))
    return tiers_report.groupBy(*keys).agg(top.alias("_p")).select(*keys, F.when(F.col("_p").isNotNull(), F.element_at(F.array(*map(F.lit, tiers)), F.col("_p").cast("int"))).alias("highest"))


def verdicts(rows: DataFrame, floor: float = 0.5) -> DataFrame:
    """(package, version, accepted, rejected, total, ratio, verdict) of attribution rows (package, version, status)."""
    n = rows.groupBy("package", "version").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count(F.lit(1)).alias("total"))
    ratio = F.col("accepted") / F.col("total")
    return n.withColumn("ratio", ratio).withColumn("verdict", F.when(F.col("accepted") == 0, "unproven").when(ratio >= floor, "trusted").otherwise("contested"))


def projection(rows: DataFrame, verdict: DataFrame, closure_evidence: str) -> DataFrame:
    """rows and what the verdict makes of them: promote, keep, revoke, leave or unknown; only rows that earlier promotions marked are revoked."""
    both = rows.join(verdict.select("package", "version", "verdict"), ["package", "version"], "left")
    promoted = F.coalesce(F.col("evidence").contains("rollup"), F.lit(False))
    outcome = (
        F.when(F.col("verdict").isNull(), "unknown")
        .when((F.col("status") == "rejected") & (F.col("verdict") == "trusted") & F.coalesce(F.col("evidence").contains(closure_evidence), F.lit(False)), "promote")
        .when((F.col("status") == "accepted") & promoted & (F.col("verdict") != "trusted"), "revoke")
        .when(F.col("status") == "accepted", "keep")
        .otherwise("leave")
    )
    return both.withColumn("outcome", outcome)


def array_members(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """All members of the arrays of a key, each once, sorted."""
    return df.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(column)))).alias(column))


def rolled_up(df: DataFrame, key: str, metrics: list[Column]) -> DataFrame:
    """Per key and, with a null key, for all."""
    return df.rollup(key).agg(*metrics, F.grouping(key).alias("is_total"))


def ledger(items: DataFrame) -> DataFrame:
    """(kind, total, complete, pending, blocked, status) of items (kind, state), with the grand total under a null kind."""
    out = rolled_up(items, "kind", [F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("complete", "pending", "blocked")]])
    status = F.when(F.col("blocked") > 0, "blocked").when(F.col("pending") > 0, "open").otherwise("complete")
    return out.withColumn("status", status)


def recall(scores: DataFrame, bounds: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9), threshold: float = 0.3) -> DataFrame:
    """(subjects, at_10, at_30, ..., matched) of best scores; null scores are subjects without a candidate."""
    return scores.agg(F.count(F.lit(1)).alias("subjects"), *[F.count_if(F.col("score") >= b).alias(f"at_{round(100 * b)}") for b in bounds], F.count_if(F.col("score") >= threshold).alias("matched"))


def precision(predicted: DataFrame, truth: DataFrame, least: float = 0.3) -> DataFrame:
    """(baseline, correct, mispaired, unranked, verified) of predictions (id, pick, score) against truth (id, pick)."""
    both = truth.select("id", F.col("pick").alias("_t")).join(predicted, "id", "left")
    right = F.col("pick") == F.col("_t")
    return both.agg(F.count(F.lit(1)).alias("baseline"), F.count_if(right).alias("correct"), F.count_if(F.col("pick").isNotNull() & ~right).alias("mispaired"), F.count_if(F.col("pick").isNull()).alias("unranked"), F.count_if(right & (F.col("score") >= least)).alias("verified"))


def hash_floor(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(axis, covered, total): queries (doc, axis, hash) whose hash the index has, per axis and, as a null axis, by any."""
    hit = queries.join(index.select("axis", "hash").distinct().withColumn("_h", F.lit(1)), ["axis", "hash"], "left")
    covered = F.count_distinct(F.when(F.col("_h") == 1, F.col("doc")))
    each = hit.groupBy("axis").agg(covered.alias("covered"), F.count_distinct("doc").alias("total"))
    return each.union(hit.agg(covered, F.count_distinct("doc")).select(F.lit(None).cast("string"), "*"))


def finding_clusters(findings: DataFrame) -> DataFrame:
    """(cluster, value, n) of findings by category, code and module in one pass."""
    sets = findings.groupingSets([["category"], ["code"], ["module"]], "category", "code", "module").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    which = F.when(F.col("_g") == 3, "category").when(F.col("_g") == 5, "code").otherwise("module")
    return sets.select(which.alias("cluster"), F.when(F.col("_g") == 3, F.col("category")).when(F.col("_g") == 5, F.col("code")).otherwise(F.col("module").cast("string")).alias("value"), "n")


def gate(findings: DataFrame) -> bool:
    """Whether nothing of severity error was found."""
    return findings.filter("severity = 'error'").isEmpty()


def cache_audit(cache: DataFrame, now: Column) -> DataFrame:
    """Seven health counts of a source cache."""
    source, policy = blank_to_null(F.col("source")), F.coalesce("policy_version", F.lit(-1))
    return cache.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(source.isNull()).alias("blank_sources"), F.count_if(F.col("expires_at") < now).alias("expired"), F.count_if(F.col("stale")).alias("stale"),
        F.count_if(policy != 1).alias("other_policy"), F.count_if(blank_to_null(F.col("export_specifier")).isNull()).alias("without_specifier"), F.count_if(F.col("source_size") > 65536).alias("oversize"),
    )


def name_evaluation(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(total, exact, fuzzy, miss, unmatched) of predicted (file, key, loose_key, name) against gold (file, key, loose_key, name): by the strict key, else by the loose one."""
    strict = predicted.select("file", "key", F.col("name").alias("_a"))
    loose = predicted.groupBy("file", "loose_key").agg(F.min("name").alias("_b"))
    both = gold.join(strict, ["file", "key"], "left").join(loose, ["file", "loose_key"], "left").withColumn("_p", F.coalesce("_a", "_b"))
    m = name_match(F.col("_p"), F.col("name"))
    return both.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(m == x).alias(x) for x in ("exact", "fuzzy")], F.count_if(F.col("_p").isNotNull() & (m == "miss")).alias("miss"), F.count_if(F.col("_p").isNull()).alias("unmatched"))


def first_party(modules: DataFrame, attributions: DataFrame, excluded: DataFrame) -> DataFrame:
    """Modules (id, path, kind) that are the project's own: not excluded, vendored or owned by a package; an accepted attribution's mode decides before the kind."""
    from factloom.functions.text import is_vendored

    a = attributions.filter("status = 'accepted'").select(F.col("module_id").alias("id"), "emission_mode")
    rows = modules.join(excluded.select("id"), "id", "left_anti").filter(~F.coalesce(is_vendored(F.col("path")), F.lit(False))).join(a, "id", "left")
    own = F.when(F.col("emission_mode").isNotNull(), F.col("emission_mode") == "application_source").otherwise(F.col("kind") == "application")
    return rows.filter(own).drop("emission_mode")


def missing_imports(imports: DataFrame, files: DataFrame, exports: DataFrame) -> DataFrame:
    """Findings (severity, code, module, binding, message) for imports (module, target, binding) of files or names that aren't there."""
    gone = imports.join(files.select(F.col("path").alias("target")), "target", "left_anti")
    there = imports.join(files.select(F.col("path").alias("target")), "target", "left_semi")
    unnamed = there.filter("binding is not null").join(exports.select(F.col("path").alias("target"), "binding"), ["target", "binding"], "left_anti")
    row = lambda df, code, message: df.select(F.lit("error").alias("severity"), F.lit(code).alias("code"), "module", "binding", message.alias("message"))
    return row(gone, "missing_import_target", F.concat(F.lit("no file "), F.col("target"))).union(row(unnamed, "missing_export", F.concat(F.col("target"), F.lit(" exports no "), F.col("binding"))))


def oversize(files: DataFrame, most: int = 10_000) -> DataFrame:
    """Findings for files (path, source) of more lines than allowed."""
    lines = F.size(F.split("source", "\n"))
    return files.filter(lines > most).select(F.lit("warning").alias("severity"), F.lit("oversize_file").alias("code"), F.col("path").alias("module"), F.lit(None).cast("string").alias("binding"), F.concat(lines.cast("string"), F.lit(" lines")).alias("message"))


def def_use_audit(facts: DataFrame) -> DataFrame:
    """Findings for reads without a definition and for bindings defined more than once in a module."""
    from factloom.operators.graph import imported_writes, unresolved

    row = lambda df, severity, code: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("module_id").alias("module"), "binding")
    twice = facts.filter("kind = 'definition'").groupBy("module_id", "binding").count().filter("count > 1")
    return row(unresolved(facts), "error", "missing_definition").union(row(twice, "warning", "duplicate_definition")).union(row(imported_writes(facts), "error", "imported_write"))


def wrapper_kind(source: Column) -> Column:
    """What kind of bundle a text looks like, by the marks bundlers leave."""
    return (
        F.when(source.rlike(r"__webpack_require__|webpackChunk"), "webpack")
        .when(source.rlike(r"__commonJS\s*\(|__esm\s*\(|__toESM\s*\("), "esbuild")
        .when(source.rlike(r"getDefaultExportFromCjs|commonjsGlobal"), "rollup")
        .when(source.rlike(r"parcelRequire"), "parcel")
        .when(source.rlike(r"(?s)^\s*[!;]?\(?\s*(?:function\s*\(|\(\)\s*=>)"), "iife")
        .otherwise("plain")
    )


def naming_worklist(bindings: DataFrame, tier: str, tiers: list[str]) -> DataFrame:
    """(module, tier, open, names) of bindings (module, name, tier, named) up to a tier that have no name yet."""
    place = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    rows = bindings.filter(~F.col("named") & (place > 0) & (place <= tiers.index(tier) + 1))
    return rows.groupBy("module", "tier").agg(F.count(F.lit(1)).alias("open"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))


def vocabulary_gate(proposals: DataFrame, evidence: DataFrame, technical: list[str]) -> DataFrame:
    """proposals (module, name) and the tokens that neither the module's evidence (module, token) nor the technical vocabulary holds."""
    from factloom.functions.text import name_tokens

    known = evidence.groupBy("module").agg(F.collect_set("token").alias("_known"))
    allowed = F.array_union(F.coalesce("_known", F.array().cast("array<string>")), F.array(*map(F.lit, technical)))
    return proposals.join(known, "module", "left").withColumn("unknown", F.array_except(name_tokens(F.col("name")), allowed)).drop("_known")


def ranked_within(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def winning_axes(scored: DataFrame, key: str, axis: str, score: str, least: float) -> DataFrame:
    """(axis, n): how many keys each axis wins by its score, of those with a score of `least` or more; ties go to the first axis by name."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), axis)
    best = scored.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) & (F.col(score) >= least))
    return best.groupBy(F.col(axis).alias("axis")).agg(F.count(F.lit(1)).alias("n"))


def tier_breakdown(matches: DataFrame, tiers: list[str], group: str) -> DataFrame:
    """(group, tier, n, named, cumulative) of matches (group, tier, named), tiers in their order and cumulated over it."""
    place = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    counts = matches.filter(place > 0).groupBy(group, "tier").agg(F.count(F.lit(1)).alias("n"), F.count_if("named").alias("named"))
    return counts.withColumn("cumulative", F.sum("n").over(Window.partitionBy(group).orderBy(place)))
