from factloom import session


def test_written_tables_cut_lineage_and_can_be_dropped(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    out = session.written(df)
    assert out.count() == 10 and "Range" not in out._jdf.queryExecution().toString()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "500"
    session.drop_written(spark)
    assert session.written(df).count() == 10


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    import pytest

    from factloom.session import shared_dir

    made = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(made(master))
