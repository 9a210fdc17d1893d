"""Queries on small tables made for one odd case each, against their SQL twins."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.llm.common import shuffle_buckets
from factloom.operators import matching, packages, similarity
from factloom.plans import registry
from tests.compare import SMALL, comparable, database


@pytest.fixture
def equal(spark, tmp_path):
    """Writes tables (or files of one) and holds a query against its SQL, which reads on one thread; returns the query's rows."""

    def run(name: str, **tables: pd.DataFrame | list[pd.DataFrame]) -> pd.DataFrame:
        for t, parts in tables.items():
            (tmp_path / f"{t}.parquet").mkdir()
            for i, part in enumerate(parts if isinstance(parts, list) else [parts]):
                part.to_parquet(tmp_path / f"{t}.parquet" / f"{i}.parquet", index=False)
        got, db = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), database(str(tmp_path))
        db.sql("SET threads = 1")
        want = db.sql(registry.ORACLE_SQL[name]).df()
        pd.testing.assert_frame_equal(comparable(got)[sorted(want.columns)], comparable(want))
        return got

    return run


def small(name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{SMALL}/{name}.parquet")


def test_half_balances_round_to_even(equal):
    s = small("supplier").head(4).assign(s_acctbal=[48.5, -47.5, 0.5, 1.5], s_nationkey=[11, 11, 3, 3])
    assert sorted(equal("size_prior", supplier=s)["prior"]) == [0.372881, 0.372881, 0.5, 0.8]


def test_means_at_a_threshold_are_summed_in_order(equal):
    # Many means are 0.05 and 0.04 but for the last bit; the order of addition decides, and the files' order must not.
    n = 24000
    i = pd.Series(range(n))
    part = small("part").head(1).assign(p_partkey=1, p_brand="Brand#1")
    l = pd.DataFrame({"l_orderkey": i * 7919 % n, "l_linenumber": 1, "l_partkey": 1, "l_suppkey": i % 1000, "l_quantity": 30.0, "l_discount": (i * i // 7 + i // 1000) % 11 / 100, "l_tax": i * 5 // 3 % 9 / 100})
    equal("signal_agreement_3of4", part=part, lineitem=[l[a : a + 1500] for a in range(0, n, 1500)])


def most_rows(df) -> int:
    """The most rows that any part of the plan put out."""
    df.collect()

    def walk(plan) -> int:
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(plan.plan())
        rows = plan.metrics().get("numOutputRows")
        children = plan.children()
        return max([rows.get().value() if rows.isDefined() else 0, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


KEYS = ["params", "statements", "ast"]


def test_hashes_that_many_share_meet_once(spark):
    index = spark.createDataFrame([("a", i, 1, 1, 1) for i in range(300)] + [("b", 900, 2, 2, 2), ("b", 900, 2, 2, 2)], ["identity", "fn_id", *KEYS])
    queries = spark.createDataFrame([(i, 1, 1, 1, 1) for i in range(300)] + [(7, 2, 2, 2, 2), (8, 1, 2, 2, 2)], ["fn", "pos", *KEYS])
    # 8 has a sole owner in its first pass by one hash, but that pass has also a hash of many.
    out = matching.exact_alternates(queries, index)
    assert [tuple(r) for r in out.collect()] == [(7, "b", 900)]
    assert [r["fn"] for r in matching.exact(queries, index).collect()] == []
    assert most_rows(out) <= 1000


def test_one_requirement_is_answered_once(spark):
    versions = spark.createDataFrame([("p", f"{i % 5}.{i % 20}.0") for i in range(400)] + [("p", "3.0.0-rc.1")], "package string, version string")
    requests = spark.createDataFrame([(i, "p", ["^1.2.0", "~2.7.0", "3.0.0-rc.1", "<0.5.0", "9.9.9"][i % 5]) for i in range(400)], "request long, package string, requirement string")
    out = matching.range_join(requests, versions)
    assert {(r["request"] % 5, r["version"]) for r in out.collect()} == {(0, "1.16.0"), (1, "2.7.0"), (2, "3.0.0-rc.1"), (3, "0.0.0")}
    assert out.count() == 320 and most_rows(out) <= 1000


def test_requests_and_versions_count_once(spark):
    available = spark.createDataFrame([("p", f"{i % 5}.{i % 20}.0") for i in range(400)], "package string, version string")
    requests = spark.createDataFrame([(i, "p", ["1.1.0", "^1.2.0", "7.0.0"][i % 3]) for i in range(400)], "request long, package string, requirement string")
    out = packages.resolved_requests(requests, available)
    assert {(r["request"] % 3, r["version"], r["reason"]) for r in out.collect()} == {(0, "1.1.0", "exact"), (1, "1.16.0", "satisfies"), (2, "4.19.0", "nearest")}
    assert most_rows(out) <= 1000


def test_candidates_carry_their_axes(spark):
    axes = lambda key, x: [(*key, "literal_anchor", str(x % 3)), (*key, "callee_set", str(x)), (*key, "throw_set", str(x % 7))]
    index = spark.createDataFrame([r for x in range(90) for r in axes(("a", x), x)], "identity string, fn_id long, axis string, hash string")
    queries = spark.createDataFrame([r for x in range(90) for r in axes((x,), x)] + [(99, "literal_anchor", None)], "fn long, axis string, hash string")
    out = matching.feature_similarity(queries, index)
    assert sorted(tuple(r) for r in out.collect()) == [(x, "a", x, 1.0) for x in range(90)]
    # 90 * 30 pairs meet by their first axis, and none is joined with an axis of its own again.
    assert most_rows(out) <= 90 * 30
    assert sorted(r["fn"] for r in matching.feature_similarity(queries, index, ceiling=29).collect()) == []


def test_many_parts_of_a_kind_meet_a_supplier_once(spark, tmp_path):
    small("supplier").head(1).merge(pd.DataFrame({"n": range(400)}), how="cross").assign(s_suppkey=lambda x: x["n"] * 50).to_parquet(tmp_path / "supplier.parquet")
    part = small("part").head(1).merge(pd.DataFrame({"n": range(400)}), how="cross").assign(p_size=1, p_type="A").assign(p_partkey=lambda x: x["n"])
    pd.concat([part, part.head(1).assign(p_type="B")]).to_parquet(tmp_path / "part.parquet")
    out = registry.QUERIES["exact_hash_unique_owner"](spark, str(tmp_path))
    assert {(r["p_type"], r["fn_id"]) for r in out.collect()} == {("B", 0)} and out.count() == 400
    assert most_rows(out) <= 1000


def test_features_of_all_documents_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SPAN", 64, raising=False)
    side = lambda step: spark.createDataFrame([(d, "price", f"p{k}") for d in range(250) for k in range(40) if (d * step + k) % 3] + [(d, "part", f"x{d // step}") for d in range(250)], "doc long, family string, feature string")
    hashes = spark.createDataFrame([(s, d, d % 7) for s in ("left", "right") for d in range(250)], "side string, doc long, hash long")
    of = lambda **k: similarity.source_evidence(side(2), side(5), hashes, F.lit(200.0), **k)
    out = of()
    got = {(r["left"], r["right"]): (r["same_source"], round(r["score"], 9)) for r in out.collect()}
    assert most_rows(out) <= 250 * 250 + 2000
    pairs = {(r["left"], r["right"]): (r["same_source"], round(r["score"], 9)) for r in of(hot=1 << 40).collect()}
    assert len(got) == 250 * 250 and got == pairs


def test_pairs_of_rare_features_are_not_shuffled(spark):
    side = lambda step: spark.createDataFrame([(d, f"f{k % 2}", f"p{k}") for d in range(240) for k in range(40) if (d * step + k) % 3 == 0] + [(None, "f0", "p0")], "doc long, family string, feature string")
    hashes = spark.createDataFrame([("left", d, d % 7) for d in range(200)] + [("right", d, d % 7) for d in range(240)] + [("right", 3, 1)], "side string, doc long, hash long")
    l, r = side(2), side(5)
    out = similarity.source_evidence(l, r, hashes, F.lit(200.0))
    got = sorted((x["left"], x["right"], x["same_source"], round(x["score"], 9)) for x in out.collect())
    # 40 features make 6,400 pairs each, more than there are pairs of documents; document 3 is there under two hashes.
    assert most_rows(out) <= 240 * 241 + 2000
    held = lambda step: {d: {(f"f{k % 2}", f"p{k}") for k in range(40) if (d * step + k) % 3 == 0} for d in range(240)}
    features = [held(2), held(5)]
    df = {k: sum(k in x for x in features[1].values()) + (k == ("f0", "p0")) for x in features[1].values() for k in x}
    square = lambda k: max(math.log(200 / df[k]), 0) ** 2 if k in df else math.log(200) ** 2
    want = []
    for a, x in features[0].items():
        for b, y in features[1].items():
            score = 0
            for f in ("f0", "f1"):
                u, v = ({k for k in z if k[0] == f} for z in (x, y))
                if n := len(u & v):
                    score += (n / min(len(u), len(v)) + n / len(u | v) + n / len(u) + sum(map(square, u & v)) / math.sqrt(sum(map(square, u)) * sum(map(square, v)))) / 4
            if score:
                want += [(a, b, a < 200 and a % 7 == h, round(score, 9)) for h in ([b % 7, 1] if b == 3 else [b % 7])]
    assert got == sorted(want)


def test_buckets_grow_with_the_files_read(spark, tmp_path):
    small("documents").to_parquet(tmp_path / "d.parquet")
    docs = spark.read.parquet(str(tmp_path / "d.parquet"))
    with open(tmp_path / "d.parquet", "r+b") as f:
        f.truncate(2_000_000_000)  # only its size is looked at
    docs = spark.read.schema(docs.schema).parquet(str(tmp_path / "d.parquet"))
    assert shuffle_buckets(spark, docs.select("doc_id", "text")) == 200 > shuffle_buckets(spark)
