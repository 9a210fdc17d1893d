"""Queries with SQL twins against DuckDB."""

import pandas as pd
import pytest

from factloom.llm import registry
from tests.compare import SMALL, comparable, database


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), database(SMALL).sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(comparable(got), comparable(want))
