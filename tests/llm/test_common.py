"""Helpers that the operators share."""

import random

from pyspark.sql import functions as F

from factloom.llm import fingerprints
from factloom.llm.common import attach, filtered
from factloom.session import written


def test_attach_is_a_join_however_many_rows_share_a_key(spark):
    random.seed(5)
    keys = [7] * 3000 + [None] * 20 + [random.randrange(200) for _ in range(2000)]
    rows = written(spark.createDataFrame(list(enumerate(keys)), "n long, key long"))
    values = written(spark.createDataFrame([(k, f"v{k}") for k in range(150)], "key long, value string"))
    for how in ("inner", "left"):
        want = sorted(map(repr, rows.join(values, "key", how).select("n", "key", "value").collect()))
        assert sorted(map(repr, attach(rows, values, "key", how).select("n", "key", "value").collect())) == want
    assert attach(rows.filter("false"), values, "key").count() == 0


def test_filtered_keeps_rows_as_they_are(spark):
    df = spark.createDataFrame([(1, "keep", [1, 2], None), (1, "go", [3], "x"), (None, None, None, "y")], "doc_id long, text string, c0 array<int>, judged string")
    out = filtered(df, "text", lambda: lambda texts: [t != "go" for t in texts])
    assert out.dtypes == df.dtypes
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.filter("text is null or text <> 'go'").collect()))


def test_unions_of_sketches_hold_only_what_lies_below_the_threshold(spark):
    df = fingerprints.with_sketch(spark.createDataFrame([(1, f"only {k} words") for k in range(40)], "g int, text string"), F.col("text"), "s")
    kept = {h for r in df.collect() for h in r["s"]}
    assert all(len(r["s"]) == 1 for r in df.collect())
    below = sorted(h for h in kept if 0 <= h < 2**61)
    assert 0 < len(below) < 40
    assert fingerprints.merged(df, ["g"], "s").first()["s"] == below
