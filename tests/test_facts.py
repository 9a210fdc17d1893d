import pytest
from pyspark.sql import functions as F

from factloom.operators import dml
from factloom.sources import facts, files


def df(spark, table, *rows, columns=None):
    schema = facts.SCHEMAS[table]
    names = [c.split()[0] for c in schema.split(", ")]
    return facts.with_defaults(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema), facts.schema(table))


@pytest.fixture
def small(spark):
    return {
        "projects": df(spark, "projects", {"id": 7, "name": "p"}),
        "source_files": df(spark, "source_files", {"id": 101, "file_path": "a.js"}),
        "project_files": df(spark, "project_files", {"project_id": 7, "file_id": 101}),
        "modules": df(spark, "modules", {"id": 10, "file_id": 101, "original_name": "m10", "module_category": "application", "byte_start": 0, "byte_end": 4}, {"id": 11, "file_id": 101, "original_name": "m11", "module_category": "package", "package_name": "x", "byte_start": 4, "byte_end": 9}),
        "symbols": df(spark, "symbols", *[{"id": i, "module_id": 10, "original_name": "a", "semantic_name": "Alpha", "scope_level": s} for i, s in ((1, "module"), (2, "module"), (3, "local"))]),
        "module_dependencies": df(spark, "module_dependencies", {"module_id": 10, "dependency_id": 11}, {"module_id": 10, "dependency_id": 11}),
        "package_attributions": df(spark, "package_attributions", {"module_id": 11, "package_name": "x", "package_version": "1.0.0", "export_specifier": "x", "emission_mode": "external_import", "status": "accepted", "external_import_policy_version": 1}),
    }


def test_sound_facts_have_no_violations(small):
    assert facts.violations(small).count() == 0
    assert facts.validated(small) is small


def test_violations_stop_the_analysis(spark, small):
    small["module_dependencies"] = df(spark, "module_dependencies", {"module_id": 10, "dependency_id": 99})
    with pytest.raises(ValueError, match="dependency_id names no row of modules"):
        facts.validated(small)


def test_missing_project(small):
    with pytest.raises(LookupError):
        facts.project(small["projects"], 8)
    assert facts.project(small["projects"], 7).first()["name"] == "p"


def test_symbols_are_distinct_and_scoped(spark, small):
    mods = facts.modules(small["modules"], small["project_files"], df(spark, "module_path_overrides"), 7)
    assert facts.module_symbols(small["symbols"], mods).count() == 1
    assert facts.module_dependencies(small["module_dependencies"], mods).count() == 1
    assert {r["id"]: r["kind"] for r in mods.collect()} == {10: "application", 11: "package"}


def test_latest_accepted_override_wins(spark, small):
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d)
    overrides = df(spark, "module_path_overrides", {"module_id": 10, "semantic_path": "old", "origin": "a", "status": "accepted", "updated_at": at(1)}, {"module_id": 10, "semantic_path": "new", "origin": "a", "status": "accepted", "updated_at": at(2)}, {"module_id": 10, "semantic_path": "no", "origin": "a", "status": "rejected", "updated_at": at(3)}, {"module_id": 10, "semantic_path": " ", "origin": "a", "status": "accepted", "updated_at": at(4)})
    mods = facts.modules(small["modules"], small["project_files"], overrides, 7)
    assert {r["id"]: r["path"] for r in mods.collect()} == {10: "new", 11: "m11"}


@pytest.mark.parametrize(("change", "status", "reason"), [
    ({}, "accepted", None), ({"external_import_policy_version": None}, "rejected", "stale"), ({"external_import_policy_version": 2}, "rejected", "stale"),
    ({"export_specifier": "x/y.ts"}, "rejected", "x/y.ts"), ({"export_specifier": "x/y.cts"}, "rejected", "x/y.cts"), ({"emission_mode": "application_source", "external_import_policy_version": None}, "accepted", None),
])
def test_policy(spark, change, status, reason):
    row = {"module_id": 11, "package_name": "x", "package_version": "1", "export_specifier": "x", "emission_mode": "external_import", "status": "accepted", "external_import_policy_version": 1} | change
    got = facts.attributions(df(spark, "package_attributions", row)).first()
    assert got["status"] == status
    assert (got["export_specifier"] is None) == (status == "rejected")
    assert reason is None or reason in got["rejection_reason"]


def test_ambiguous_function_ownership_is_left_out(spark):
    rows = [{"module_id": 1, "package_name": "a", "package_version": "1"}, {"module_id": 1, "package_name": "a", "package_version": "2"}, {"module_id": 1, "package_name": "a", "package_version": "2"}, {"module_id": 2, "package_name": "a"}, {"module_id": 2, "package_name": "b"}, {"module_id": 3, "package_name": " "}]
    got = facts.ownership_from_functions(df(spark, "package_function_attributions", *rows)).collect()
    assert [(r["module_id"], r["package_version"]) for r in got] == [(1, "2")]


def test_older_tables_are_filled_in_and_missing_ones_empty(spark, tmp_path):
    spark.range(2).withColumnRenamed("id", "module_id").write.parquet(f"{tmp_path}/package_attributions.parquet")
    got = facts.read(spark, str(tmp_path), "package_attributions")
    assert got.schema == facts.schema("package_attributions") and got.count() == 2
    assert facts.read(spark, str(tmp_path), "project_assets").count() == 0


def test_text_slices_cut_bytes(spark, small):
    contents = spark.createDataFrame([(101, bytearray("añbcdefg".encode()))], "file_id long, content binary")
    got = {r["id"]: r["source"] for r in facts.text_slices(small["modules"], contents).select("id", "source").collect()}
    assert got == {10: "añb", 11: "cdefg"}


def test_tsv(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("module_id\tclass\n# note\n1\tvendor\tseen\n\n2\n3\t \n4\ta\tb\tc\n")
    got = {r["line"]: (r["module_id"], r["error"]) for r in files.tsv(spark, f"{tmp_path}/x.tsv", ["module_id", "class", "evidence"], 2, "module_id").collect()}
    assert got[3] == ("1", None) and set(got) == {3, 5, 6, 7}
    assert "line 5" in got[5][1] and "class is blank" in got[6][1] and "4 fields" in got[7][1]


def test_manifest_folder(spark, tmp_path):
    import hashlib
    import json

    root = tmp_path / "u"
    (root / "src").mkdir(parents=True)
    sources = {"src/a.js": 'import "./b"; import "lodash";', "src/b.js": "x"}
    for path, source in sources.items():
        (root / path).write_text(source)
    listed = [{"path": p, "sha256": hashlib.sha256(s.encode()).hexdigest()} for p, s in sources.items()] + [{"path": "../evil.js"}, {"path": "src/gone.js"}]
    listed[1]["sha256"] = "00"
    (root / "manifest.json").write_text(json.dumps({"files": listed}))
    got = files.unpacked(spark, str(root))
    assert {r["path"]: r["error"] for r in got.collect()} == {"src/a.js": None, "src/b.js": "hash differs", "../evil.js": "unsafe path", "src/gone.js": "missing"}
    assert [tuple(r) for r in files.dependencies(got).collect()] == [("src/a.js", "src/b.js")]


def test_memo_computes_misses_only(spark):
    contents = spark.createDataFrame([("a",), ("b",), ("b",)], "content string")
    known = contents.limit(1).select(F.sha2("content", 256).alias("content_hash"), F.lit('{"n":1}').alias("fingerprint_json"))
    memo = known.union(spark.createDataFrame([("zz", "{broken")], "content_hash string, fingerprint_json string"))
    whole, fresh = files.memoized(contents, memo, lambda x: x.withColumn("fingerprint_json", F.lit('{"n":2}')))
    assert whole.count() == 2 and fresh.count() == 1


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "e"), (2, "b", None)], "k long, v string, evidence string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "f")], "k long, v string, evidence string")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(dml.upsert(old, new, ["k"])) == [(1, "a", "e"), (2, "c", None), (3, "d", "f")]
    again = spark.createDataFrame([(1, "z", None)], "k long, v string, evidence string")
    assert rows(dml.upsert(old, again, ["k"], ("evidence",)))[0] == (1, "z", "e")
    assert rows(dml.insert_missing(old, new, ["k"]))[-1] == (3, "d", "f")
    assert rows(dml.guarded_update(old, new.select("k"), ["k"], F.col("v") == "b", {"v": F.lit("x")})) == [(1, "a", "e"), (2, "x", None)]
    once = dml.upsert(old, new, ["k"])
    assert dml.planned_changes(old, once, ["k"]).count() == 2
    assert dml.planned_changes(once, dml.upsert(once, new, ["k"]), ["k"]).count() == 0


def test_standing_names(spark):
    ledger = spark.createDataFrame([(1, "m", "a", "accepted"), (2, "m", "b", "proposed"), (3, "m", "c", "accepted"), (4, "n", "d", "accepted"), (5, "n", "", "cleared")], "id long, key string, name string, status string")
    assert [tuple(r)[1:3] for r in dml.accepted_names(ledger, ["key"]).collect()] == [("m", "c")]
