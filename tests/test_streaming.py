from factloom.streaming import ledger

SCHEMA = "id long, key string, decision string"


def test_ledger_stream_folds_batches(spark, tmp_path):
    source = f"{tmp_path}/in"
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    go = lambda: ledger.maintain(ledger.read_events(spark, source, SCHEMA), f"{tmp_path}/out", f"{tmp_path}/cp", ["key"], "id").awaitTermination()
    batch((1, "a", "x"), (2, "a", "y"), (3, "b", "x"))
    go()
    batch((5, "b", "z"), (0, "a", "late"))
    go()
    got = {r["key"]: (r["id"], r["decision"]) for r in spark.read.parquet(f"{tmp_path}/out/v1").collect()}
    assert got == {"a": (2, "y"), "b": (5, "z")}


def test_fold_is_idempotent(spark):
    events = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], SCHEMA)
    once = ledger.fold(None, events, ["key"], "id")
    assert sorted(ledger.fold(once, events, ["key"], "id").collect()) == sorted(once.collect())
