"""Graph operators on edges(src, dst): closures, components and fixpoints as driver loops over DataFrames.

A loop's frontier is written to the shared folder each round, so lineage stays short and a lost executor costs one round; the driver only learns
whether anything is left. Rules that look at a neighbourhood see the whole round before (all labels are published at once). Loops to a fixpoint
raise where they don't reach it within ROUNDS rounds; none returns what is only half done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scan import fnv1a_hex
from factloom.operators import components as stars
from factloom.session import written

ROUNDS = 10_000


def unsettled(what: str, rounds: int = ROUNDS) -> RuntimeError:
    return RuntimeError(f"{what} still changes after {rounds} rounds")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that the roots (node) lead to, the roots included."""
    edges = edges.select("src", "dst").distinct()
    seen = written(roots.select("node").distinct())
    frontier = seen
    for _ in range(ROUNDS):
        new = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = written(new.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = written(seen.union(frontier))
    else:
        raise unsettled("reachable")
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of every path of one edge or more; a node on a cycle reaches itself. Path lengths double each round.

    Only pairs that a round found are continued: a shortest path of more than 2^k edges begins with one of 2^k, which round k found.
    """
    seen = new = written(edges.select("src", "dst").distinct())
    for _ in range(64):
        longer = new.join(seen.select(F.col("src").alias("dst"), F.col("dst").alias("_to")), "dst").select("src", F.col("_to").alias("dst")).distinct()
        new = written(longer.join(seen, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            break
        seen = written(seen.union(new))
    else:
        raise unsettled("closure", 64)
    return seen


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) with the least node as the component; of `nodes` too, where given, which may have no edges."""
    found = stars.components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumnRenamed("root", "component")
    every = _ends(edges) if nodes is None else _ends(edges).union(nodes.select("node")).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def _flowed(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, color): the least color that reaches a node along edges (src, dst), of those it starts with."""
    colors = written(start)
    for _ in range(ROUNDS):
        near = edges.join(colors, edges["src"] == colors["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("_c"))
        after = written(colors.join(near, "node", "left").select("node", F.least("color", F.coalesce("_c", "color")).alias("color"), (F.col("_c") < F.col("color")).alias("_moved")))
        colors = after.select("node", "color")
        if after.filter("_moved").isEmpty():
            return colors
    raise unsettled("a color")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other, named by the least; a node on no cycle is its own.

    Trimming and colouring, without a closure: nodes without ways in or out go; the least node that reaches a node colours it; what reaches
    the colour's own node within the colour is a component. Each turn settles at least one component of every colour.
    """
    nodes, live, found = written(_ends(edges)), written(edges.filter("src <> dst").select("src", "dst").distinct()), []
    for _ in range(ROUNDS):
        n = live.count()
        while n:
            into, out = live.select(F.col("dst").alias("src")).distinct(), live.select(F.col("src").alias("dst")).distinct()
            live = written(live.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
            before, n = n, live.count()
            if n == before:
                break
        if not n:
            break
        colors = _flowed(live, _ends(live).withColumn("color", F.col("node")))
        of = lambda end: colors.select(F.col("node").alias(end), F.col("color").alias(f"_{end}"))  # noqa: E731, B023
        inner = written(live.join(of("src"), "src").join(of("dst"), "dst").filter("_src = _dst").select("src", "dst"))
        back = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reached = reachable(back, colors.filter("node = color").select("node"))
        done = written(colors.join(reached, "node", "left_semi"))
        found.append(done)
        live = written(live.join(done, live["src"] == done["node"], "left_anti").join(done, live["dst"] == done["node"], "left_anti"))
    else:
        raise unsettled("strong_components")
    for df in found:
        nodes = nodes.join(df.select("node", F.col("color").alias(f"_{id(df)}")), "node", "left")
    return nodes.select("node", F.coalesce(*[F.col(f"_{id(df)}") for df in found], F.col("node")).alias("component"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: of components of two or more, or with an edge to themselves."""
    parts = strong_components(edges)
    large = parts.groupBy("component").count().filter("count > 1").select("component")
    loops = edges.filter("src = dst").select(F.col("src").alias("node"))
    return parts.join(large, "component", "left_semi").select("node").union(loops).distinct()


def edges_of_kind(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """All edges (src, dst, kind), or those of one kind (read, call): what components and closures are taken of."""
    return (edges if kind is None else edges.filter(F.col("kind") == kind)).select("src", "dst").distinct()


def alias_closure(aliases: DataFrame, calls: DataFrame, returns: DataFrame) -> DataFrame:
    """Closure of identity edges and of calls followed by what the callee returns."""
    through = calls.join(returns.select(F.col("src").alias("dst"), F.col("dst").alias("_r")), "dst").select("src", F.col("_r").alias("dst"))
    return closure(aliases.select("src", "dst").union(through))


def lattice_fixpoint(edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """(node, rank): along alias edges both ways the greatest rank wins, hence one for each component."""
    parts = components(edges, shapes.select("node"))
    ranked = parts.join(shapes, "node", "left")
    return parts.join(ranked.groupBy("component").agg(F.max("rank").alias("rank")), "component").select("node", "rank")


def constraint_conflicts(constraints: DataFrame, matrix: DataFrame) -> DataFrame:
    """(module_id, binding, a, b) of shapes that the matrix (a, b) holds to be incompatible; matrix is a fixed small table."""
    one, two = constraints.select("module_id", "binding", F.col("shape").alias("a")).distinct(), constraints.select("module_id", "binding", F.col("shape").alias("b")).distinct()
    return one.join(two, ["module_id", "binding"]).filter("a < b").join(F.broadcast(matrix), ["a", "b"], "left_semi")


def neighbourhood_support(left: DataFrame, right: DataFrame, seeds: DataFrame) -> DataFrame:
    """(left, right, matched, known): edges of a left node to seeded nodes, and how many of them a right node mirrors; both directions."""
    rows = None
    for a, b in (("src", "dst"), ("dst", "src")):
        l = left.select(F.col(a).alias("left"), F.col(b).alias("_ln"))
        r = right.select(F.col(a).alias("right"), F.col(b).alias("_rn"), F.lit(a).alias("way"))
        known = l.join(seeds.select(F.col("left").alias("_ln"), F.col("right").alias("_rn")), "_ln").withColumn("way", F.lit(a))
        rows = (known, r) if rows is None else (rows[0].unionByName(known), rows[1].unionByName(r))
    known, mirror = rows
    total = known.groupBy("left").agg(F.count(F.lit(1)).alias("known"))
    matched = known.join(mirror, ["way", "_rn"]).groupBy("left", "right").agg(F.count(F.lit(1)).alias("matched"))
    return matched.join(total, "left").select("left", "right", "matched", "known")


def promote_by_neighbours(left: DataFrame, right: DataFrame, seeds: DataFrame, least: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """seeds and the pairs that follow: all known edges mirrored, at least `least` of them, and strictly more than for any other; whole rounds at a time."""
    known = written(seeds.select("left", "right"))
    for _ in range(rounds):
        s = neighbourhood_support(left, right, known).join(known, "left", "left_anti").join(known, "right", "left_anti")
        w = Window.partitionBy("left").orderBy(F.col("matched").desc(), "right")
        best = s.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("matched").over(w), F.lit(0)))
        best = best.filter((F.col("_n") == 1) & (F.col("matched") >= least) & (F.col("matched") == F.col("known")) & (F.col("matched") > F.col("_next")))
        claims = F.row_number().over(Window.partitionBy("right").orderBy(F.col("matched").desc(), "left"))
        new = written(best.withColumn("_c", claims).filter("_c = 1").select("left", "right"))
        if new.isEmpty():
            break
        known = written(known.union(new))
    else:
        raise unsettled("promote_by_neighbours", rounds)
    return known


def propagate_unanimous(edges: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, label): unlabelled nodes all of whose labelled neighbours agree take that label; whole rounds at a time."""
    both = written(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    known = written(labels.select("node", "label"))
    for _ in range(rounds):
        near = both.join(known, both["dst"] == known["node"]).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("label"), F.max("label").alias("_hi"))
        new = written(near.filter("label = _hi").select("node", "label").join(known, "node", "left_anti"))
        if new.isEmpty():
            break
        known = written(known.union(new))
    else:
        raise unsettled("propagate_unanimous", rounds)
    return known


def dominant_labels(parts: DataFrame, labels: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """(component, label) where at least `least` labelled nodes of a component are `share` of one label."""
    counts = parts.join(labels, "node").groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("component")
    rows = counts.withColumn("_all", F.sum("n").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.col("n").desc(), "label")))
    return rows.filter((F.col("_n") == 1) & (F.col("_all") >= least) & (F.col("n") >= share * F.col("_all"))).select("component", "label", "n", F.col("_all").alias("labelled"))


def dependency_closure(edges: DataFrame, owned: DataFrame, hints: DataFrame, least: int = 2, share: float = 0.7, rounds: int = ROUNDS) -> DataFrame:
    """(node, package, version): hinted nodes join the package that most of their owned neighbours have, on most of one version, unless their own hint says otherwise."""
    both = written(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    known = written(owned.select("node", "package", "version"))
    for _ in range(rounds):
        near = both.join(known, both["dst"] == known["node"]).select(F.col("src").alias("node"), "package", "version")
        total = near.groupBy("node").agg(F.count(F.lit(1)).alias("_all"))
        by_package = near.groupBy("node", "package").agg(F.count(F.lit(1)).alias("_same"))
        by_version = near.groupBy("node", "package", "version").agg(F.count(F.lit(1)).alias("_v"))
        top = by_version.withColumn("_n", F.row_number().over(Window.partitionBy("node", "package").orderBy(F.col("_v").desc(), "version"))).filter("_n = 1")
        open_hints = hints.select("node", "package", F.col("version").alias("_hint")).join(known, "node", "left_anti")
        rows = open_hints.join(by_package, ["node", "package"]).join(total, "node").join(top, ["node", "package"])
        rows = rows.filter((F.col("_same") >= least) & (F.col("_same") >= share * F.col("_all")) & (F.col("_v") >= share * F.col("_same")) & (F.col("_hint").isNull() | (F.col("_hint") == F.col("version"))))
        new = written(rows.select("node", "package", "version"))
        if new.isEmpty():
            break
        known = written(known.union(new))
    else:
        raise unsettled("dependency_closure", rounds)
    return known


def runs(rows: DataFrame, partition: list[str], order: list[Column], value: str) -> DataFrame:
    """rows with `run`, the number of the maximal stretch of equal values they lie in, and `run_length`."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = (~F.coalesce(F.lag(value).over(w).eqNullSafe(F.col(value)), F.lit(False))).cast("int")
    out = rows.withColumn("_first", changed).withColumn("_first", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("_first")))
    out = out.withColumn("run", F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")
    return out.withColumn("run_length", F.count(F.lit(1)).over(Window.partitionBy(*partition, "run")))


def label_runs(modules: DataFrame, owned: DataFrame, least_run: int = 3, least_seeds: int = 2, share: float = 0.7) -> DataFrame:
    """(module, package, version) for the unowned modules of long runs of one hinted package in a file, where enough of the run is owned by it on one version."""
    spans = runs(modules, ["file_id"], [F.col("byte_start"), F.col("module")], "package").filter("package is not null")
    rows = spans.join(owned.select("module", F.col("package").alias("_own"), F.col("version").alias("_ver")), "module", "left")
    key = ["file_id", "run"]
    per = rows.groupBy(*key).agg(F.count("_own").alias("_owned"), F.count_if(F.col("_own") == F.col("package")).alias("_same"))
    versions = rows.filter(F.col("_own") == F.col("package")).groupBy(*key, "_ver").agg(F.count(F.lit(1)).alias("_v"))
    top = versions.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("_v").desc(), "_ver"))).filter("_n = 1").select(*key, F.col("_ver").alias("version"), "_v")
    fit = per.join(top, key).filter((F.col("_same") >= least_seeds) & (F.col("_same") >= share * F.col("_owned")) & (F.col("_v") >= share * F.col("_same")))
    return rows.filter(F.col("_own").isNull() & (F.col("run_length") >= least_run)).join(fit, key).select("module", "package", "version")


def residual_pairs(left: DataFrame, right: DataFrame, known: DataFrame, rounds: int = 8) -> DataFrame:
    """known and pairs that are left over: where matched parents have exactly one unmatched child on each side, these match if all parents agree."""
    known = written(known.select("left", "right"))
    for _ in range(rounds):
        one = lambda edges, side: (
            edges.select(F.col("src").alias(f"_p_{side}"), F.col("dst").alias(side)).join(known, side, "left_anti")
            .groupBy(f"_p_{side}").agg(F.min(side).alias(side), F.count_distinct(side).alias("_n")).filter("_n = 1").drop("_n")
        )
        parents = known.select(F.col("left").alias("_p_left"), F.col("right").alias("_p_right"))
        votes = parents.join(one(left, "left"), "_p_left").join(one(right, "right"), "_p_right")
        agreed = votes.groupBy("left").agg(F.min("right").alias("right"), F.max("right").alias("_hi")).filter("right = _hi").select("left", "right")
        new = written(agreed.withColumn("_n", F.row_number().over(Window.partitionBy("right").orderBy("left"))).filter("_n = 1").drop("_n"))
        if new.isEmpty():
            break
        known = written(known.union(new))
    return known


def positional_pairs(left: DataFrame, right: DataFrame, known: DataFrame, similarity: DataFrame, least: float = 0.6, rounds: int = 6) -> DataFrame:
    """known and the i-th dependencies of matched nodes, from ordered (node, place, dep) on both sides, where their similarity is enough."""
    known = written(known.select("left", "right"))
    for _ in range(rounds):
        l, r = left.select(F.col("node").alias("_l"), "place", F.col("dep").alias("left")), right.select(F.col("node").alias("_r"), "place", F.col("dep").alias("right"))
        pairs = known.select(F.col("left").alias("_l"), F.col("right").alias("_r")).join(l, "_l").join(r, ["_r", "place"]).select("left", "right").distinct()
        scored = pairs.join(similarity, ["left", "right"]).filter(F.col("score") >= least).join(known, "left", "left_anti").join(known, "right", "left_anti")
        best = scored.withColumn("_a", F.row_number().over(Window.partitionBy("left").orderBy(F.col("score").desc(), "right"))).filter("_a = 1")
        new = written(best.withColumn("_b", F.row_number().over(Window.partitionBy("right").orderBy(F.col("score").desc(), "left"))).filter("_b = 1").select("left", "right"))
        if new.isEmpty():
            break
        known = written(known.union(new))
    return known


def promote_parents(children: DataFrame, least: int = 2) -> DataFrame:
    """(parent, candidate, children) where at least `least` accepted children (parent, child, candidate) agree; most children, then the least candidate."""
    counts = children.groupBy("parent", "candidate").agg(F.count_distinct("child").alias("children")).filter(F.col("children") >= least)
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy("parent").orderBy(F.col("children").desc(), "candidate"))).filter("_n = 1").drop("_n")


def cluster_fingerprint(members: DataFrame, cluster: str, member: str) -> DataFrame:
    """(cluster, fingerprint): FNV-1a of the sorted distinct names, whatever order they come in; null for a cluster without names."""
    names = members.groupBy(cluster).agg(F.sort_array(F.collect_set(member)).alias("_names"))
    return names.select(cluster, F.when(F.size("_names") > 0, fnv1a_hex(F.array_join("_names", "\x00"))).alias("fingerprint"))


def degree_roles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, indegree, outdegree, role) with degrees in buckets 0, 1, few (to 4) and many."""
    ins, outs = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("indegree")), edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outdegree"))
    bucket = lambda c: F.when(c == 0, "0").when(c == 1, "1").when(c <= 4, "few").otherwise("many")
    rows = nodes.select("node").join(ins, "node", "left").join(outs, "node", "left").na.fill(0, ["indegree", "outdegree"])
    return rows.withColumn("role", F.concat_ws("/", bucket(F.col("indegree")), bucket(F.col("outdegree"))))


def prune_dead(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """What stays of the nodes when those without users, other than roots, go again and again."""
    alive = written(nodes.select("node").distinct())
    for _ in range(ROUNDS):
        used = edges.join(alive.withColumnRenamed("node", "src"), "src", "left_semi").filter("src <> dst").select(F.col("dst").alias("node")).union(roots.select("node")).distinct()
        after = written(alive.join(used, "node", "left_semi"))
        gone = alive.join(after, "node", "left_anti")
        alive = after
        if gone.isEmpty():
            break
    else:
        raise unsettled("prune_dead")
    return alive


def prune_orphans(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that some root reaches; unlike prune_dead, cycles that nothing reaches go too."""
    return nodes.join(reachable(edges, roots), "node", "left_semi")


def all_deps_safe(nodes: DataFrame, edges: DataFrame, unsafe: DataFrame) -> DataFrame:
    """The least set of nodes all of whose dependencies are in it already; nodes on or behind a cycle, and unsafe ones, aren't."""
    open_nodes = nodes.select("node").join(unsafe.select("node"), "node", "left_anti")
    needs = written(edges.select("src", "dst").distinct())
    n = needs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("needs"))
    safe = written(open_nodes.join(n, "node", "left_anti"))
    for _ in range(ROUNDS):
        met = needs.join(safe.withColumnRenamed("node", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("met"))
        new = written(open_nodes.join(safe, "node", "left_anti").join(n, "node").join(met, "node").filter("needs = met").select("node"))
        if new.isEmpty():
            break
        safe = written(safe.union(new))
    else:
        raise unsettled("all_deps_safe")
    return safe


def dominated(edges: DataFrame, root: DataFrame, barrel: DataFrame) -> DataFrame:
    """Nodes that the root reaches only by way of the barrel (node)."""
    without = edges.join(barrel.withColumnRenamed("node", "src"), "src", "left_anti")
    return reachable(edges, root).join(reachable(without, root), "node", "left_anti")


def merge_duplicates(nodes: DataFrame, edges: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes with the same key become the least of them, and edges follow."""
    mapping = nodes.select("node", F.min("node").over(Window.partitionBy(*key)).alias("to"))
    to = lambda c: mapping.select(F.col("node").alias(c), F.col("to").alias(f"_{c}"))
    moved = edges.join(to("src"), "src").join(to("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).filter("src <> dst").distinct()
    return nodes.join(mapping.filter("node = to").select("node"), "node", "left_semi"), moved


def strip_across(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges whose ends are of one group (node, group)."""
    of = lambda c: groups.select(F.col("node").alias(c), F.col("group").alias(f"_{c}"))
    return edges.join(of("src"), "src").join(of("dst"), "dst").filter("_src = _dst").drop("_src", "_dst")


def contract_pass_through(edges: DataFrame, pass_through: DataFrame) -> DataFrame:
    """Edges to nodes that only pass on (node, target) go straight to where they lead; chains are followed."""
    for _ in range(ROUNDS):
        hop = pass_through.select(F.col("node").alias("dst"), F.col("target").alias("_t")).filter("dst <> _t")
        moved = edges.join(hop, "dst", "left").select("src", F.coalesce("_t", "dst").alias("dst"), F.col("_t").isNotNull().alias("_moved"))
        moved = written(moved)
        edges = moved.select("src", "dst").distinct()
        if moved.filter("_moved and src <> dst").isEmpty():
            break
    else:
        raise unsettled("contract_pass_through")
    return edges


def unresolved(facts: DataFrame, kind: str = "read") -> DataFrame:
    """(module_id, binding) read or written but neither defined nor imported in the module; facts are (module_id, kind, binding)."""
    of = lambda *kinds: facts.filter(F.col("kind").isin(*kinds)).select("module_id", "binding").distinct()
    return of(kind).join(of("definition", "import"), ["module_id", "binding"], "left_anti")


def imported_writes(facts: DataFrame) -> DataFrame:
    of = lambda kind: facts.filter(F.col("kind") == kind).select("module_id", "binding").distinct()
    return of("write").join(of("import"), ["module_id", "binding"], "left_semi").join(of("definition"), ["module_id", "binding"], "left_anti")


def synthesized_edges(facts: DataFrame, modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, binding): unresolved reads to their single defining module; in files of several modules, only to modules of the same file; edges that exist are left out."""
    defs = facts.filter("kind = 'definition'").select(F.col("module_id").alias("dst"), "binding").distinct()
    files = modules.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy("file_id")) > 1)
    reads = unresolved(facts).select(F.col("module_id").alias("src"), "binding").join(files.select(F.col("module_id").alias("src"), F.col("file_id").alias("_sf"), "_many"), "src")
    owners = reads.join(defs, "binding").filter("src <> dst").join(files.select(F.col("module_id").alias("dst"), F.col("file_id").alias("_df")), "dst").filter("not _many or _sf = _df")
    single = owners.groupBy("src", "binding").agg(F.count_distinct("dst").alias("_n"), F.min("dst").alias("dst")).filter("_n = 1")
    return single.select("src", "dst", "binding").join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def type_join(shapes: DataFrame) -> DataFrame:
    """(module_id, binding, type): what all observations of a binding agree on; unknown where they differ."""
    return shapes.groupBy("module_id", "binding").agg(F.when(F.count_distinct("type") == 1, F.min("type")).otherwise("unknown").alias("type"))


def data_dependences(facts: DataFrame) -> DataFrame:
    """(module_id, binding, source): where each read of a module comes from, its own definition before an import."""
    of = lambda kind, name: facts.filter(F.col("kind") == kind).select("module_id", "binding", F.lit(name).alias(f"_{name}")).distinct()
    rows = facts.filter("kind = 'read'").select("module_id", "binding").distinct().join(of("definition", "definition"), ["module_id", "binding"], "left").join(of("import", "import"), ["module_id", "binding"], "left")
    return rows.select("module_id", "binding", F.coalesce("_definition", "_import").alias("source")).filter("source is not null")


def topology_reinforcement(left: DataFrame, right: DataFrame, known: DataFrame, least: int = 3, rounds: int = 6) -> DataFrame:
    """known and pairs with at least `least` confirmed shared references, strictly more than for any other; (node, ref) on both sides."""
    known = written(known.select("left", "right"))
    for _ in range(rounds):
        l = left.select(F.col("node").alias("left"), F.col("ref").alias("_l")).join(known.select(F.col("left").alias("_l"), F.col("right").alias("_r")), "_l")
        shared = l.join(right.select(F.col("node").alias("right"), F.col("ref").alias("_r")), "_r").groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))
        shared = shared.join(known, "left", "left_anti").join(known, "right", "left_anti")
        w = Window.partitionBy("left").orderBy(F.col("n").desc(), "right")
        best = shared.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("n").over(w), F.lit(0))).filter((F.col("_k") == 1) & (F.col("n") >= least) & (F.col("n") > F.col("_next")))
        new = written(best.withColumn("_c", F.row_number().over(Window.partitionBy("right").orderBy(F.col("n").desc(), "left"))).filter("_c = 1").select("left", "right"))
        if new.isEmpty():
            break
        known = written(known.union(new))
    return known
