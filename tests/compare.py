"""Comparing result frames with the oracle engine."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as text in a fixed order; columns by name."""
    frame = frame[sorted(frame.columns)]
    columns = []
    for name in frame.columns:
        column = frame[name]
        if pd.api.types.is_datetime64_any_dtype(column):
            column = column.astype("datetime64[us]")
        columns.append(["NULL" if pd.isna(v) else repr(v) for v in column.tolist()])
    return sorted(zip(*columns)) if columns else []


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def differences(ours: pd.DataFrame, oracle: pd.DataFrame) -> str | None:
    """None if both hold the same rows, else what differs first."""
    if sorted(ours.columns) != sorted(oracle.columns):
        return f"columns {sorted(ours.columns)} / {sorted(oracle.columns)}"
    if len(ours) != len(oracle):
        return f"rows {len(ours)} / {len(oracle)}"
    for mine, theirs in zip(canonical(ours), canonical(oracle)):
        if mine != theirs:
            return f"{sorted(ours.columns)}\n  {mine}\n  {theirs}"
    return None
