"""Compares a query with its SQL twin: rows, column names, kinds of types and values, whatever the order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        where = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{where}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


def rows(table) -> Counter:
    columns = sorted(table.column_names)
    return Counter(zip(*([_plain(v) for v in table[c].to_pylist()] for c in columns), strict=True)) if columns else Counter()


def _kind(t) -> str:
    import pyarrow.types as p

    return "int" if p.is_integer(t) else "float" if p.is_floating(t) or p.is_decimal(t) else "bool" if p.is_boolean(t) else "text" if p.is_string(t) or p.is_large_string(t) else str(t)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    mine, theirs = spark_df.toArrow(), con.sql(sql).to_arrow_table()
    out = []
    a, b = ({n: _kind(t.schema.field(n).type) for n in t.column_names} for t in (mine, theirs))
    if a != b:
        out.append(f"columns {a} and {b}")
        if set(a) != set(b):
            return out
    x, y = rows(mine), rows(theirs)
    if x != y:
        out.append(f"{mine.num_rows} and {theirs.num_rows} rows; only here {list((x - y).items())[:3]}, only there {list((y - x).items())[:3]}")
    return out
