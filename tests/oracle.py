"""Comparison of Spark with DuckDB over the same Parquet tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return ("d", str(value.normalize() if value else Decimal(0)))
    if hasattr(value, "isoformat"):
        return ("t", value.isoformat())
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, con, sql: str) -> tuple[bool, str]:
    ours = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    theirs = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        return False, f"{len(ours)} and {len(theirs)} rows; first difference {next(((a, b) for a, b in zip(ours, theirs) if a != b), None)}"
    return True, f"{len(ours)} rows"
