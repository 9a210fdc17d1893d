"""The package-match pipeline: ordered passes that only add to a state of DataFrames, each seeing what none before it decided."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph, matching
from factloom.session import written

#: What every match says.
MATCH = ["module", "package", "version", "strategy", "score"]


@dataclass
class State:
    """modules (module, file_id, byte_start, source_hash, package_hint, version_hint), corpus features and edges; matches grow pass by pass."""

    modules: DataFrame
    corpus: DataFrame  # (package, version, source_hash, kind, feature)
    features: DataFrame  # (module, kind, feature)
    edges: DataFrame  # (src, dst) of modules
    matches: DataFrame
    counts: dict[str, int] = field(default_factory=dict)

    def open(self) -> DataFrame:
        return self.modules.join(self.matches.select("module").distinct(), "module", "left_anti")


Pass = Callable[[State], DataFrame]


def exact_source(state: State) -> DataFrame:
    """The same normalised source in one package only."""
    hashes = state.corpus.filter("source_hash is not null").select("source_hash", "package", "version").distinct()
    hits = state.open().filter("source_hash is not null").join(hashes, "source_hash")
    one = hits.groupBy("module").agg(F.count_distinct("package").alias("_p"), F.count_distinct("version").alias("_v"), F.min("package").alias("package"), F.min("version").alias("version"))
    return one.filter("_p = 1").select("module", "package", F.when(F.col("_v") == 1, F.col("version")).alias("version"), F.lit("exact_source").alias("strategy"), F.lit(1.0).alias("score"))


def anchor_axis(kind: str, max_df: int = 24, least_shared: int = 2, least_weight: float = 4.0, least_margin: float = 2.0) -> Pass:
    """Rare features of one kind, weighted by how few packages have them."""

    def run(state: State) -> DataFrame:
        from factloom.operators.similarity import idf_anchor_join

        corpus = state.corpus.filter(F.col("kind") == kind).select(F.col("package").alias("doc"), "feature").distinct()
        asked = state.features.filter(F.col("kind") == kind).join(state.open().select("module"), "module", "left_semi").select(F.col("module").alias("doc"), "feature").distinct()
        total = state.corpus.select("package").distinct().count()
        found = idf_anchor_join(asked, corpus, F.lit(total), max_df, least_shared, least_weight, least_margin)
        return found.select(F.col("left").alias("module"), F.col("right").alias("package"), F.lit(None).cast("string").alias("version"), F.lit(f"anchor:{kind}").alias("strategy"), F.col("weight").alias("score"))

    return run


def exact_hint(state: State) -> DataFrame:
    """Hints of a version that the corpus has, unless the source is known to be another package's."""
    there = state.corpus.select(F.col("package").alias("package_hint"), F.col("version").alias("version_hint")).distinct()
    other = state.corpus.filter("source_hash is not null").select("source_hash", F.col("package").alias("_owner")).distinct()
    hinted = state.open().join(there, ["package_hint", "version_hint"])
    contradicted = hinted.join(other, "source_hash").filter("_owner <> package_hint").select("module")
    return hinted.join(contradicted, "module", "left_anti").select("module", F.col("package_hint").alias("package"), F.col("version_hint").alias("version"), F.lit("exact_hint").alias("strategy"), F.lit(0.5).alias("score"))


def dependency_closure(state: State) -> DataFrame:
    """Hinted modules among neighbours of their package."""
    owned = state.matches.filter("version is not null").select(F.col("module").alias("node"), "package", "version")
    hints = state.open().filter("package_hint is not null").select(F.col("module").alias("node"), F.col("package_hint").alias("package"), F.col("version_hint").alias("version"))
    found = graph.dependency_closure(state.edges, owned, hints).join(owned.select("node"), "node", "left_anti")
    return found.select(F.col("node").alias("module"), "package", "version", F.lit("dependency_closure").alias("strategy"), F.lit(0.4).alias("score"))


def dependency_cluster(state: State) -> DataFrame:
    """Components where most owned modules are of one package on one version: their hinted modules follow."""
    parts = graph.components(state.edges)
    owned = state.matches.filter("version is not null").select(F.col("module").alias("node"), "package", "version").join(parts, "node")
    hinted = state.modules.filter("package_hint is not null").select(F.col("module").alias("node"), F.col("package_hint").alias("package")).join(parts, "node")
    named = hinted.groupBy("component").agg(F.count(F.lit(1)).alias("named"))
    total = owned.groupBy("component").agg(F.count(F.lit(1)).alias("all"))
    same = owned.groupBy("component", "package").agg(F.count(F.lit(1)).alias("same"))
    versions = owned.groupBy("component", "package", "version").agg(F.count(F.lit(1)).alias("v"))
    fit = versions.join(same, ["component", "package"]).join(total, "component").join(named, "component")
    fit = fit.filter("named >= 4 and all >= 3 and same >= 3 and same >= 0.7 * all and same >= 0.1 * named and v >= 0.7 * same").select("component", "package", "version")
    open_hints = hinted.join(state.open().select(F.col("module").alias("node")), "node", "left_semi")
    return open_hints.join(fit, ["component", "package"]).select(F.col("node").alias("module"), "package", "version", F.lit("dependency_cluster").alias("strategy"), F.lit(0.3).alias("score"))


def file_graph(state: State) -> DataFrame:
    """Long runs of one hinted package in a file."""
    owned = state.matches.filter("version is not null").select("module", "package", "version")
    rows = state.modules.select("module", "file_id", "byte_start", F.col("package_hint").alias("package"))
    found = graph.label_runs(rows, owned).join(state.open().select("module"), "module", "left_semi")
    return found.select("module", "package", "version", F.lit("file_graph").alias("strategy"), F.lit(0.3).alias("score"))


def attribution_precision(state: State, many: int = 24) -> DataFrame:
    """The matches to withdraw: of packages with many matched modules, those that rest on hints alone."""
    crowded = state.matches.groupBy("package").count().filter(F.col("count") >= many).select("package")
    return state.matches.join(crowded, "package", "left_semi").filter(F.col("version").isNull() & (F.col("score") < 0.5)).select("module")


PASSES: list[tuple[str, Pass]] = [
    ("exact_source", exact_source), ("anchors", anchor_axis("literal")), ("function_axes", anchor_axis("axis", 20, 2, 12.0, 8.0)), ("exact_hint", exact_hint),
    ("dependency_closure", dependency_closure), ("dependency_cluster", dependency_cluster), ("file_graph", file_graph),
]


def run(state: State, passes: list[tuple[str, Pass]] = PASSES) -> State:
    """All passes in order; a module keeps its first match."""
    for name, step in passes:
        found = written(step(state).select(*MATCH).dropDuplicates(["module"]))
        state.counts[name] = found.count()
        state.matches = written(state.matches.select(*MATCH).unionByName(found))
    withdrawn = attribution_precision(state)
    state.matches = written(state.matches.join(withdrawn, "module", "left_anti"))
    return state


def function_coverage(owned: DataFrame, functions: DataFrame) -> DataFrame:
    """(module, package, version, covered, total): the package version that covers most of a module's function spans (module, span); owned is (module, span, package, version)."""
    total = functions.groupBy("module").agg(F.count_distinct("span").alias("total"))
    covered = owned.groupBy("module", "package", "version").agg(F.count_distinct("span").alias("covered"))
    from factloom.sources.facts import first_per

    return first_per(covered, ["module"], [F.col("covered").desc(), F.col("package"), F.col("version")]).join(total, "module").select("module", "package", "version", "covered", "total")


def global_assignment(candidates: DataFrame) -> DataFrame:
    """Cascade candidates (fn, identity, fn_id, tier, rank) to a one-to-one assignment of functions to index entries."""
    from factloom.operators.assign import assign

    named = candidates.select(F.col("fn").cast("string").alias("row"), F.concat_ws("#", "identity", F.col("fn_id").cast("string")).alias("col"), "tier", "rank")
    return assign(matching.edge_weights(named, "row", "col"))
