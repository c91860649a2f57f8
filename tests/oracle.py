"""Compare a registered query with its SQL text on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(value) -> str:
    return type(value).__name__


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)


def _equal(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and _kind(a) == _kind(b)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str, limit: int = 3) -> list[str]:
    """What differs, empty if nothing. Columns are taken by name and rows in any order."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    columns = sorted(df.columns)
    if columns != sorted(names):
        return [f"columns {columns} != {sorted(names)}"]
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=_key)
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in expected), key=_key)
    out = []
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    for g, w in zip(got, want):
        if not all(_equal(a, b) for a, b in zip(g, w)):
            out.append(f"{dict(zip(columns, g))} != {dict(zip(columns, w))}")
            if len(out) >= limit:
                break
    return out
