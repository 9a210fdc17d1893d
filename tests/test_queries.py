"""Every registered query of the library runs, and equals its SQL twin where it has one."""

import pandas as pd
import pytest

from factloom.plans import registry
from tests.compare import SMALL, comparable, database


@pytest.fixture(scope="module")
def db():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    if name in registry.ORACLE_SQL:
        want = db.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        pd.testing.assert_frame_equal(comparable(got), comparable(want))
    else:
        assert len(got) > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
