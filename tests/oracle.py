"""Compares registered queries with their SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def expected(sf: str, sql: str):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    return sorted(columns), rows_of(columns, got.fetchall())


def actual(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])
