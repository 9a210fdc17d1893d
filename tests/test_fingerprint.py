"""Pairs of functions: renaming changes no axis, edits do; and the pass pipeline on a small project."""

import pytest

from factloom.functions import fingerprint as fp
from factloom.operators import passes

BASE = 'function f(a, b) { let sum = 0; for (const x of a) { if (x > b) { sum += x.size; } } if (!sum) throw new RangeError("empty list"); return sum; }'


def axes(source):
    (_, _, params, body), *_ = fp.functions(source)
    return fp.fingerprint(params, body)[2]


def test_renaming_changes_nothing():
    renamed = 'function g(p, q) { let total = 0; for (const y of p) { if (y > q) { total += y.size; } } if (!total) throw new RangeError("empty list"); return total; }'
    assert axes(BASE) == axes(renamed)


@pytest.mark.parametrize(("old", "new", "axis"), [("x > b", "x < b", "expression_shape"), ("x.size", "x.length", "access_pattern"), ("for (const x of a)", "while (a)", "cfg"), ("RangeError", "TypeError", "throw_set"), ("empty list", "other text", "literal_anchor"), ("return sum", "return", "return_pattern")])
def test_edits_change_their_axis(old, new, axis):
    assert axes(BASE)[axis] != axes(BASE.replace(old, new))[axis]


def test_loops_are_alike_when_normalised():
    assert axes("function f() { for (;;) { g(); } }")["cfg_normalized"] == axes("function f() { while (1) { g(); } }")["cfg_normalized"]


def test_arrows_and_nesting():
    found = fp.functions("const f = (a, {b, c}) => { return () => { b(); }; }; const g = x => { x(); };")
    assert [fp.fingerprint(p, b)[0] for _, _, p, b in found] == [2, 0, 1]


def test_alternates_follow_normalisation(spark):
    rows = fp.fingerprints(spark.createDataFrame([(1, 'function f() { return a["b"] === void 0; }'), (2, "function f() { return a.b === undefined; }"), (3, None)], "doc long, source string")).collect()
    by = {(r["doc"], r["pass"] == "primary"): r["ast"] for r in rows}
    assert by[1, False] == by[2, True] != by[1, True]
    assert fp.axis_rows(fp.fingerprints(spark.createDataFrame([(2, BASE)], "doc long, source string"))).count() > 10


def test_passes_add_up(spark):
    modules = spark.createDataFrame([(k, 1, k * 10, h, hint, v) for k, h, hint, v in [(0, "h0", None, None), (1, None, "p", "1.0.0"), (2, None, "p", None), (3, None, "q", "9.9.9"), (4, "h1", "p", "1.0.0")]], "module long, file_id long, byte_start long, source_hash string, package_hint string, version_hint string")
    corpus = spark.createDataFrame([("p", "1.0.0", "h0", "literal", "a"), ("r", "2.0.0", "h1", "literal", "b"), ("q", "1.0.0", None, "literal", "c")], "package string, version string, source_hash string, kind string, feature string")
    features = spark.createDataFrame([(0, "literal", "a")], "module long, kind string, feature string")
    edges = spark.createDataFrame([(0, 2), (1, 2)], "src long, dst long")
    empty = spark.createDataFrame([], "module long, package string, version string, strategy string, score double")
    state = passes.run(passes.State(modules, corpus, features, edges, empty))
    got = {r["module"]: (r["package"], r["version"], r["strategy"]) for r in state.matches.collect()}
    assert got == {0: ("p", "1.0.0", "exact_source"), 4: ("r", "2.0.0", "exact_source"), 1: ("p", "1.0.0", "exact_hint"), 2: ("p", "1.0.0", "dependency_closure")}
    assert state.counts["dependency_closure"] == 1


def test_function_coverage(spark):
    owned = spark.createDataFrame([(1, s, "p", v) for s, v in [(1, "1"), (2, "1"), (1, "2")]], "module long, span long, package string, version string")
    got = passes.function_coverage(owned, spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "module long, span long")).first()
    assert tuple(got) == (1, "p", "1", 2, 3)


def test_tree_grams():
    assert fp.pq_grams("") == ["* root * * *"]
    assert fp.pq_grams("a b", 1, 2) == ["name * *", "name * *", "root * name", "root name *", "root name name"]
    one, renamed, edited = (fp.pq_grams(s) for s in ("f(a, [b])", "g(x, [y])", "f(a, {b})"))
    assert one == renamed != edited
    assert fp.wl_hashes("f(a, [b])") == fp.wl_hashes("g(x, [y])") != fp.wl_hashes("f(a, {b})")
