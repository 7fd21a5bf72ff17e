"""Comparing a Spark result with DuckDB SQL over the same Parquet files."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "float32", "float64", "int32", "int64", "int8", "int16"):
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    names = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in r) for r in frame[names].astype(object).itertuples(index=False, name=None))


def compare(spark_df, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    mine, theirs = spark_df.toPandas(), c.sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) == len(theirs)
    wrong = [(x, y) for x, y in zip(rows(mine), rows(theirs), strict=True) if x != y]
    assert not wrong, f"{len(wrong)} rows differ, first {wrong[0]}"
