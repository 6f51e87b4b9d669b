"""Run a check in both engines and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_key)


def compare(df, con, sql: str) -> tuple[int, str]:
    """Number of rows, and what differs (blank when nothing does)."""
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = rows_of([c[0] for c in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return len(left[1]), f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        only = [r for r in left[1] if r not in right[1]][:2], [r for r in right[1] if r not in left[1]][:2]
        return len(left[1]), f"rows {len(left[1])} != {len(right[1])}; only spark {only[0]}; only sql {only[1]}"
    for a, b in zip(*(left[1], right[1])):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return len(left[1]), f"{left[0]}\n  spark {a}\n  sql   {b}"
    return len(left[1]), ""
