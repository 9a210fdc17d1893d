"""Operators without an SQL twin, and those with one on cases that the tables don't hold."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators import assign, graph, matching, reports, similarity


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def edges(spark):
    return lambda *pairs: spark.createDataFrame(list(pairs), "src string, dst string")


@pytest.fixture
def nodes(spark):
    return lambda *names: spark.createDataFrame([(n,) for n in names], "node string")


def test_closure_and_cycles(edges):
    e = edges(("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))
    assert rows(graph.cyclic_nodes(e)) == [("a",), ("b",), ("c",)]
    assert len(rows(graph.closure(e))) == 12
    assert dict(rows(graph.strong_components(e))) == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert rows(graph.closure(edges())) == []


def test_components_of_a_long_chain(edges, nodes):
    names = [f"n{k:03}" for k in range(120)]
    got = dict(rows(graph.components(edges(*zip(names[1:], names)), nodes("alone"))))
    assert got == {n: "n000" for n in names} | {"alone": "alone"}


def test_reachability_and_pruning(edges, nodes):
    e = edges(("entry", "a"), ("a", "b"), ("dead", "b"), ("x", "y"), ("y", "x"))
    all_nodes = nodes("entry", "a", "b", "dead", "x", "y")
    assert rows(graph.reachable(e, nodes("entry"))) == [("a",), ("b",), ("entry",)]
    assert rows(graph.prune_orphans(all_nodes, e, nodes("entry"))) == [("a",), ("b",), ("entry",)]
    assert rows(graph.prune_dead(all_nodes, e, nodes("entry"))) == [("a",), ("b",), ("entry",), ("x",), ("y",)]
    assert rows(graph.dominated(edges(("r", "barrel"), ("barrel", "p"), ("r", "q"), ("p", "q")), nodes("r"), nodes("barrel"))) == [("p",)]


def test_least_fixpoint_leaves_cycles_out(edges, nodes):
    e = edges(("a", "b"), ("c", "d"), ("d", "c"), ("e", "bad"), ("f", "a"))
    assert rows(graph.all_deps_safe(nodes("a", "b", "c", "d", "e", "f", "bad"), e, nodes("bad"))) == [("a",), ("b",), ("f",)]


def test_neighbourhood_support(spark, edges):
    left = edges(("subject", "dep"), ("parent", "subject"))
    right = edges(("candidate", "ref_dep"), ("ref_parent", "candidate"), ("unrelated", "ref_dep"))
    seeds = spark.createDataFrame([("dep", "ref_dep"), ("parent", "ref_parent")], "left string, right string")
    got = {r["right"]: (r["matched"], r["known"]) for r in graph.neighbourhood_support(left, right, seeds).filter("left = 'subject'").collect()}
    assert got == {"candidate": (2, 2), "unrelated": (1, 2)}
    assert ("subject", "candidate") in rows(graph.promote_by_neighbours(left, right, seeds))


def test_unanimous_labels(spark, edges):
    labels = spark.createDataFrame([("a", "x"), ("b", "x"), ("e", "y")], "node string, label string")
    got = dict(rows(graph.propagate_unanimous(edges(("a", "c"), ("b", "c"), ("c", "d"), ("d", "e")), labels)))
    assert got == {"a": "x", "b": "x", "e": "y", "c": "x", "d": "y"}


def test_dependency_closure(spark, edges):
    e = edges(*[(f"o{k}", "m") for k in range(3)], ("m", "n"), ("o0", "n"))
    owned = spark.createDataFrame([(f"o{k}", "p", "1") for k in range(3)], "node string, package string, version string")
    hints = spark.createDataFrame([("m", "p", None), ("n", "p", "2")], "node string, package string, version string")
    assert ("m", "p", "1") in rows(graph.dependency_closure(e, owned, hints)) and len(rows(graph.dependency_closure(e, owned, hints))) == 4


def test_run_labelling(spark):
    modules = spark.createDataFrame([(1, k, k * 10, p) for k, p in enumerate(["p", "p", "p", "p", "q", "p"])], "file_id long, module long, byte_start long, package string")
    owned = spark.createDataFrame([(0, "p", "1"), (1, "p", "1")], "module long, package string, version string")
    assert rows(graph.label_runs(modules, owned)) == [(2, "p", "1"), (3, "p", "1")]


def test_residual_and_positional_pairs(spark, edges):
    known = spark.createDataFrame([("r", "R")], "left string, right string")
    assert ("b", "B") in rows(graph.residual_pairs(edges(("r", "a"), ("a", "b")), edges(("R", "A"), ("A", "B")), known))
    ordered = "node string, place int, dep string"
    left, right = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b")], ordered), spark.createDataFrame([("R", 0, "A"), ("R", 1, "B")], ordered)
    sim = spark.createDataFrame([("a", "A", 0.9), ("b", "B", 0.5)], "left string, right string, score double")
    assert rows(graph.positional_pairs(left, right, known, sim)) == [("a", "A"), ("r", "R")]


def test_pass_through_chains(spark, edges):
    through = spark.createDataFrame([("a", "b"), ("b", "c")], "node string, target string")
    assert rows(graph.contract_pass_through(edges(("x", "a"), ("y", "c")), through)) == [("x", "c"), ("y", "c")]


@pytest.mark.parametrize("seed", range(6))
def test_assignment_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    w = np.where(rng.random((n, m)) < 0.3, 0, rng.integers(1, 50, (n, m))).astype(float)
    wide = np.pad(w, ((0, 0), (0, n)))
    best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(int(m + n)), int(n)))
    got = assign.best_assignment(w)
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
    assert sum(w[i, j] for i, j in got) == best


def test_assignment_beats_greedy_and_uses_columns_once(spark):
    e = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 9.0), ("b", "x", 9.0), ("c", "z", 1.0)], "row string, col string, weight double")
    assert rows(assign.assign(e)) == [("a", "y", 9.0), ("b", "x", 9.0), ("c", "z", 1.0)]
    assert assign.greedy_assignment(["a", "a", "b"], ["x", "y", "x"], [10, 9, 9]) == [("a", "x", 10)]


@pytest.mark.parametrize("seed", range(3))
def test_large_components_get_the_greedy_assignment_in_rounds(spark, seed, monkeypatch):
    monkeypatch.setattr(assign, "DENSE", 2)
    rng = np.random.default_rng(seed)
    pairs = [(f"r{i}", f"c{j}", float(rng.integers(0, 6))) for i in range(12) for j in range(9) if rng.random() < 0.4]
    lone = [("p", "q", 2.0), ("p", "q", 5.0), ("p", "z", None), ("y", "q", float("nan"))]
    got = rows(assign.assign(spark.createDataFrame(pairs + lone, "row string, col string, weight double")))
    assert got == sorted([*assign.greedy_assignment(*map(list, zip(*pairs, strict=True))), ("p", "q", 5.0)], key=repr)


def test_components_of_a_table_go_on_over_blocks():
    rng = np.random.default_rng(5)
    edges = pd.DataFrame([(k, f"r{k}{i}", f"c{k}{j}", float(rng.integers(1, 50))) for k in range(20) for i in range(3) for j in range(4)], columns=["component", "row", "col", "weight"])
    for size in (1, 7, 12, 100, 240):
        blocks = (edges[i : i + size].reset_index(drop=True) for i in range(0, len(edges), size))
        got = pd.concat([b for b in assign._assign_sorted(blocks) if len(b)])
        assert len(got) == 60 and set(got["row"]) == set(edges["row"]) and got["col"].is_unique
        best = sum(assign._assign(*(b[c].to_numpy() for c in ("row", "col", "weight")))[i][2] for _, b in edges.groupby("component") for i in range(3))
        assert got["weight"].sum() == best
    assert list(assign._assign_sorted(iter([]))) == []


def test_assignment_of_nothing_is_empty(spark):
    assert rows(assign.assign(spark.createDataFrame([("a", "b", 0.0)], "row string, col string, weight double"))) == []


def test_louvain_finds_two_cliques(spark):
    pairs = [(a, b, 1.0) for group in ("abcd", "wxyz") for a, b in itertools.combinations(group, 2)] + [("d", "w", 1.0)]
    got = dict(rows(assign.louvain(spark.createDataFrame(pairs, "src string, dst string, weight double"))))
    assert {got[c] for c in "abcd"} == {"a"} and {got[c] for c in "wxyz"} == {"w"}


def test_packing_budget_and_distinct_names(spark):
    items = spark.createDataFrame([("s", k, n) for k, n in enumerate([4, 5, 3, 9, 1])], "scope string, place long, size long")
    assert [r[2] for r in rows(assign.pack_in_order(items, 10))] == [0, 0, 1, 2, 2]
    ranked = spark.createDataFrame([("s", f"i{k}", k, n) for k, n in enumerate([4, 9, 5, 3, 1])], "scope string, item string, rank long, size long")
    assert [r[1] for r in rows(assign.within_budget(ranked, 10))] == ["i0", "i2", "i4"]
    names = spark.createDataFrame([("r", "a", "n", 0.9), ("r", "b", "n", 0.8), ("r", "c", "m", 0.7)], "reference string, subject string, name string, score double")
    assert [r[1] for r in rows(assign.distinct_names(names))] == ["a", "c"]


def test_unique_winners_and_alternates(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "a", 1), (2, "b", 1), (3, "c", 2)], "fn long, identity string, fn_id long")
    assert [(r["fn"], r["identity"]) for r in matching.unique_winner(hits).orderBy("fn").collect()] == [(1, "a"), (3, "c")]
    key = "params int, statements int, ast long"
    index = spark.createDataFrame([("a", 1, 1, 2, 10), ("b", 1, 1, 2, 11), ("c", 1, 1, 2, 11), ("d", 1, 1, 2, 12)], f"identity string, fn_id long, {key}")
    queries = spark.createDataFrame([(7, 0, 1, 2, 11), (7, 1, 1, 2, 12), (8, 0, 1, 2, 10)], f"fn long, pos int, {key}")
    assert [(r["fn"], r["identity"]) for r in matching.exact_alternates(queries, index).orderBy("fn").collect()] == [(7, "d"), (8, "a")]


def test_feature_similarity_rejects_ties(spark):
    axes = lambda *r: spark.createDataFrame(list(r), "fn long, axis string, hash long")
    index = spark.createDataFrame([("a", 1, "literal_anchor", 5), ("a", 1, "cfg", 6), ("b", 1, "literal_anchor", 5), ("b", 1, "cfg", 7)], "identity string, fn_id long, axis string, hash long")
    assert [r["identity"] for r in matching.feature_similarity(axes((1, "literal_anchor", 5), (1, "cfg", 6)), index).collect()] == ["a"]
    assert matching.feature_similarity(axes((1, "literal_anchor", 5), (1, "cfg", 8)), index).count() == 0


def test_anchored_needs_the_same_candidate(spark):
    index = spark.createDataFrame([("a", 1, 2, 9), ("b", 1, 2, 9)], "identity string, fn_id long, params int, cfg long")
    q = spark.createDataFrame([(1, 2, 9)], "fn long, params int, cfg long")
    i_axes = spark.createDataFrame([("b", 1, "throw_set", 3), ("c", 1, "throw_set", 3)], "identity string, fn_id long, axis string, hash long")
    q_axes = spark.createDataFrame([(1, "throw_set", 3)], "fn long, axis string, hash long")
    assert [r["identity"] for r in matching.anchored(q, index, q_axes, i_axes).collect()] == ["b"]


@pytest.mark.parametrize(("requirement", "want"), [("^1.2.0", "1.9.0"), ("~1.2.0", "1.2.5"), ("1.2.3", "1.2.3"), ("=1.2.3", "1.2.3"), ("*", "2.0.0"), ("latest", "2.0.0"), ("<1.9.0", "1.2.5"), ("<=1.9.0", "1.9.0"), ("^0.3.1", "0.3.4"), ("~1", "1.9.0"), (">=3.0.0", None), ("2.1.0-beta", "2.1.0-beta")])
def test_range_join(spark, requirement, want):
    versions = spark.createDataFrame([("p", v) for v in ["1.2.3", "1.2.5", "1.9.0", "2.0.0", "0.3.1", "0.3.4", "2.1.0-beta", "odd"]], "package string, version string")
    got = matching.range_join(spark.createDataFrame([(1, "p", requirement)], "request long, package string, requirement string"), versions).first()
    assert (got and got["version"]) == want


def test_overlapping_owners(spark):
    spans = spark.createDataFrame([(1, 0, 10, "b"), (1, 8, 20, "a"), (2, 0, 5, "c")], "file_id long, start long, end long, label string")
    asked = spark.createDataFrame([(1, 1, 9, 10), (2, 1, 20, 30), (3, 2, 4, 5), (4, 1, 10, 12)], "id long, file_id long, start long, end long")
    assert dict(rows(matching.overlapping_owners(asked, spans))) == {1: "a + b", 2: None, 3: "c", 4: "a"}


def test_majority_pin_and_edge_weights(spark):
    hits = spark.createDataFrame([("r", f, s) for f, s in [(1, "x"), (2, "x"), (2, "x"), (3, "y")]], "ref string, fn long, subject string")
    got = matching.majority_pin(hits, spark.createDataFrame([("r", 4)], "ref string, functions long")).first()
    assert (got["subject"], got["coverage"]) == ("x", 0.5) and abs(got["score"] - 0.6375) < 1e-9
    c = spark.createDataFrame([("f", "a", "exact", 0), ("f", "b", "feature", 4)], "fn string, col string, tier string, rank int")
    assert dict((r[1], r[2]) for r in rows(matching.edge_weights(c, "fn", "col"))) == {"a": 10000.0, "b": 90.0}


def test_surface_resolution(spark):
    surfaces = spark.createDataFrame([("lodash", "lodash/fp")], "package_name string, export_specifier string")
    imports = spark.createDataFrame([(1, s) for s in ("lodash", "lodash/fp", "lodash/map", "left-pad")], "importer long, specifier string")
    assert {r[1]: r[2] for r in rows(matching.surface_resolution(imports, surfaces))} == {"lodash": "package", "lodash/fp": "exact", "lodash/map": "deep_import", "left-pad": "unresolved"}


@pytest.mark.parametrize("combine", ["max", "mean", "agreement"])
def test_multi_axis(spark, combine):
    schema = "doc long, axis string, feature string"
    left = spark.createDataFrame([(1, "s", "a"), (1, "s", "b"), (1, "p", "c")], schema)
    right = spark.createDataFrame([(10, "s", "a"), (10, "s", "b"), (11, "p", "c"), (11, "p", "d")], schema)
    got = {r["right"]: r["score"] for r in similarity.multi_axis(left, right, F.lit(2), combine=combine).collect()}
    assert got[10] == {"max": 1.0, "mean": 0.5, "agreement": 0.5}[combine]


def test_source_evidence_prefers_the_same_source(spark):
    schema = "doc long, family string, feature string"
    left = spark.createDataFrame([(1, "s", "a"), (1, "s", "b")], schema)
    right = spark.createDataFrame([(10, "s", "a"), (10, "s", "b"), (11, "s", "a")], schema)
    hashes = spark.createDataFrame([("left", 1, "h"), ("right", 10, "h")], "side string, doc long, hash string")
    got = {r["right"]: (r["same_source"], r["score"]) for r in similarity.source_evidence(left, right, hashes, F.lit(3)).collect()}
    assert got[10][0] and not got[11][0] and got[10][1] > got[11][1]


def test_reports_on_fixtures(spark):
    names = spark.createDataFrame([("f", "k1", "k", "getName"), ("f", "k2", "l", "x")], "file string, key string, loose_key string, name string")
    gold = spark.createDataFrame([("f", "k1", "k", "getName"), ("f", "k9", "l", "y"), ("f", "k8", "zz", "q")], "file string, key string, loose_key string, name string")
    assert tuple(reports.name_evaluation(names, gold).first()) == (3, 1, 0, 1, 1)
    imports = spark.createDataFrame([("a", "b.js", "x"), ("a", "b.js", "y"), ("a", "gone.js", None)], "module string, target string, binding string")
    found = reports.missing_imports(imports, spark.createDataFrame([("b.js",)], "path string"), spark.createDataFrame([("b.js", "x")], "path string, binding string"))
    assert sorted(r["code"] for r in found.collect()) == ["missing_export", "missing_import_target"]
    assert not reports.gate(found) and reports.gate(found.filter("false"))
    mods = spark.createDataFrame([(1, "src/a.js", "application"), (2, "node_modules/x.js", "application"), (3, "b.js", "package"), (4, "c.js", "application")], "id long, path string, kind string")
    attributions = spark.createDataFrame([(3, "accepted", "application_source"), (4, "accepted", "external_import")], "module_id long, status string, emission_mode string")
    assert [r["id"] for r in reports.first_party(mods, attributions, mods.filter("false")).orderBy("id").collect()] == [1, 3]


def test_vocabulary_and_worklist(spark):
    proposals = spark.createDataFrame([(1, "parseHeader"), (1, "magicWand")], "module long, name string")
    got = {r["name"]: r["unknown"] for r in reports.vocabulary_gate(proposals, spark.createDataFrame([(1, "header")], "module long, token string"), ["parse"]).collect()}
    assert got == {"parseHeader": [], "magicWand": ["magic", "wand"]}
    bindings = spark.createDataFrame([(1, "a", "public", False), (1, "b", "full", False), (1, "c", "public", True)], "module long, name string, tier string, named boolean")
    assert [tuple(r) for r in reports.naming_worklist(bindings, "public", ["public", "full"]).collect()] == [(1, "public", 1, "a")]


def test_findings(spark):
    facts = spark.createDataFrame([(1, "read", "x"), (1, "definition", "y"), (1, "definition", "y"), (1, "import", "z"), (1, "write", "z")], "module_id long, kind string, binding string")
    assert sorted(r["code"] for r in reports.def_use_audit(facts).collect()) == ["duplicate_definition", "imported_write", "missing_definition"]


@pytest.mark.parametrize(("source", "want"), [("var a = __commonJS((exports) => {})", "esbuild"), ("(()=>{})()", "iife"), ("__webpack_require__(1)", "webpack"), ("getDefaultExportFromCjs(x)", "rollup"), ("const a = 1", "plain")])
def test_wrapper_kind(spark, source, want):
    assert spark.createDataFrame([(source,)], "s string").select(reports.wrapper_kind(F.col("s"))).first()[0] == want


def test_promotions_can_be_taken_back(spark):
    schema = "package string, version string, status string, evidence string"
    attributions = spark.createDataFrame([("p", "1", "rejected", "closure"), ("p", "1", "accepted", "proof"), ("q", "1", "accepted", "rollup")], schema)
    verdict = spark.createDataFrame([("p", "1", "trusted"), ("q", "1", "contested")], "package string, version string, verdict string")
    assert {r["evidence"]: r["outcome"] for r in reports.projection(attributions, verdict, "closure").collect()} == {"closure": "promote", "proof": "keep", "rollup": "revoke"}
