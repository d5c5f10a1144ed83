"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows_of(columns: dict[str, list]) -> tuple[list[str], list[tuple]]:
    names = sorted(columns)
    plain = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    rows = [tuple(plain(v) for v in r) for r in zip(*(columns[n] for n in names), strict=True)]
    return names, sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if both have the same columns and rows."""
    con = connect(sf_dir)
    want = con.execute(sql).to_arrow_table() if hasattr(con, "to_arrow_table") else con.sql(sql).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    names, expected = rows_of(want.to_pydict())
    own, got = rows_of(df.toArrow().to_pydict())
    if names != own:
        return f"columns {own}, not {names}"
    if len(got) != len(expected):
        return f"{len(got)} rows, not {len(expected)}"
    wrong = [(a, b) for a, b in zip(got, expected, strict=True) if a != b]
    return f"{len(wrong)} rows differ: {wrong[:3]}" if wrong else ""
