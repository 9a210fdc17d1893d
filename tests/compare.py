"""Spark results against DuckDB's."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return c


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    def text(v) -> str:
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "~"
        # Whole numbers, ids among them, are compared to the last figure; a column with nulls comes as floats.
        if isinstance(v, (int, np.integer)) or isinstance(v, (float, np.floating)) and abs(v) < 2**53 and v == int(v):
            return str(int(v))
        return f"{float(v):.6g}" if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and hasattr(v, "__float__") or type(v).__name__ == "Decimal" else str(v)

    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)
