"""Row count, schema and order-free value comparison of a Spark result with its DuckDB twin."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
FAMILY = {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "string": "text",
          "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "text",
          "boolean": "bool", "BOOLEAN": "bool", "date": "date", "DATE": "date"}


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _key(value):
    if value is None:
        return "\0null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def compare(df: DataFrame, sql: str | None, con) -> str:
    cols = sorted(df.columns)
    types = dict(df.dtypes)
    got = sorted(tuple(_key(v) for v in r) for r in df.select(*cols).collect())
    if sql is None:
        return f"rows-only {len(got)}"
    con.execute(sql)
    names = [d[0] for d in con.description]
    if sorted(names) != cols:
        return f"columns differ: spark {cols} duck {sorted(names)}"
    duck_types = {d[0]: str(d[1]) for d in con.description}
    odd = {c: (types[c], duck_types[c]) for c in cols
           if FAMILY.get(types[c], types[c]) != FAMILY.get(duck_types[c], duck_types[c])}
    at = [names.index(c) for c in cols]
    want = sorted(tuple(_key(r[i]) for i in at) for r in con.fetchall())
    if odd:
        return f"types differ: {odd}"
    if len(got) != len(want):
        a, b = set(got), set(want)
        return f"rows differ: spark {len(got)} duck {len(want)}\n {cols}\n  only spark {sorted(a - b)[:3]}\n  only duck {sorted(b - a)[:3]}"
    if got != want:
        a, b = set(got), set(want)
        return (f"values differ in {len(a - b)} of {len(got)} rows\n  {cols}\n"
                f"  spark {sorted(a - b)[:3]}\n  duck  {sorted(b - a)[:3]}")
    return f"ok {len(got)}"
