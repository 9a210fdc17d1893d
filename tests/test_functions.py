import pytest
from pyspark.sql import functions as F

from factloom.functions import scan, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [("", "module"), (None, "module"), ("a b//c", "a-b//c"), ("--x--", "x"), ("Ünï", "n"), ("@scope/pkg", "scope/pkg")])
def test_slugify(spark, name, want):
    assert one(spark, text.slugify(F.col("n")), n=name) == want


@pytest.mark.parametrize(("spec", "package", "subpath"), [("lodash", "lodash", None), ("lodash/fp", "lodash", "fp"), ("@a/b/c/d", "@a/b", "c/d"), ("./x", None, None), ("/x", None, None), ("http://x/y", None, None)])
def test_specifiers(spark, spec, package, subpath):
    assert one(spark, text.specifier_package(F.col("s")), s=spec) == package
    if package:
        assert one(spark, text.specifier_subpath(F.col("s")), s=spec) == subpath


@pytest.mark.parametrize(("name", "want"), [("a", True), ("U$", True), ("Whr", True), ("m3A", True), ("Map", False), ("get", False), ("emitClose", False), ("  ", False), ("a$longname", True)])
def test_minified(spark, name, want):
    assert one(spark, text.is_minified(F.col("n")), n=name) is want


@pytest.mark.parametrize(("name", "want"), [("semanticFunction", True), ("semanticClass12", True), ("semanticClass012", False), ("module3SemanticSymbol4", True), ("moduleSemanticSymbol4", False), ("other", False)])
def test_placeholder(spark, name, want):
    assert one(spark, text.is_placeholder(F.col("n")), n=name) is want


@pytest.mark.parametrize(("name", "want"), [("camelCaseName", ["camel", "case", "name"]), ("HTTPServer2x", ["http", "server2x"]), ("a_1_b", ["a", "b"]), ("", [])])
def test_name_tokens(spark, name, want):
    assert one(spark, text.name_tokens(F.col("n")), n=name) == want


@pytest.mark.parametrize(("path", "want"), [("a/./b//c", "a/b/c"), ("a/b/../c", "a/c"), ("../x", "../x"), ("a/../../x", "../x"), ("", "")])
def test_normalized_path(spark, path, want):
    assert one(spark, text.normalized_path(F.col("p")), p=path) == want


@pytest.mark.parametrize(("path", "want"), [("a/b.ts", True), ("/a", False), ("a/../b", False), ("C:x", False), ("a\\b", False), ("", False)])
def test_safe_path(spark, path, want):
    assert one(spark, text.is_safe_path(F.col("p")), p=path) is want


def test_semver_order(spark):
    rows = [("1.2.3",), ("1.10.0",), ("1.2.3-beta",), ("x",), ("2.0.0",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").orderBy(text.semver(F.col("v")).desc_nulls_last()).collect()]
    assert got == ["2.0.0", "1.10.0", "1.2.3", "1.2.3-beta", "x"]


@pytest.mark.parametrize(("source", "want"), [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8"), (None, None)])
def test_fnv1a(spark, source, want):
    assert one(spark, scan.fnv1a_hex(F.col("s")), s=source) == want
    if source is not None:
        assert f"{scan.fnv1a(source.encode()):016x}" == want


def test_import_specifiers(spark):
    source = """import a from "foo"; export * from './bar'; const x = require("baz"); require.resolve('qux'); import("dyn"); // import z from "no"
    const y = import(name); import "side";"""
    assert one(spark, scan.import_specifiers(F.col("s")), s=source) == ["foo", "./bar", "baz", "qux", "dyn", "side"]


def test_string_literals_and_properties(spark):
    source = """const o = {longKey: 1, "quoted": 2}; o.member.call(); /* "hidden" */ x["computed"]; f("literal", 'abc', `plain text`, `no ${x}`); o.length;"""
    assert one(spark, scan.string_literals(F.col("s")), s=source) == ["computed", "literal", "plain text", "quoted"]
    assert one(spark, scan.property_names(F.col("s")), s=source) == ["call", "computed", "longKey", "member", "quoted"]


def test_normalize_is_idempotent():
    once, used = scan.normalized('if (a["b"] === void 0) { return !0 } else {} x = "a" + "b" + "c"; for (;;) {}')
    assert once == 'if (a.b === undefined) { return true }  x = "abc"; while (true) {}'
    assert scan.normalized(once) == (once, [])
    assert "void_zero_to_undefined" in used


def test_set_measures(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"], [], [])], "a array<string>, b array<string>, c array<string>, d array<string>")
    j, k, o, e = df.select(text.jaccard(F.col("a"), F.col("b")), text.containment(F.col("a"), F.col("b")), text.overlap(F.col("a"), F.col("b")), text.jaccard(F.col("c"), F.col("d"))).first()
    assert (j, round(k, 6), round(o, 6), e) == (0.5, 0.666667, 0.666667, 0.0)
