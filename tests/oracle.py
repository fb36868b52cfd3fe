"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    """Sorted rows, columns by name, with floats and nulls in one form."""
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "NULL"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{round(float(v), 6):.6f}"
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None))
