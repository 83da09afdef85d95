"""Compares a registered query with its SQL, run by DuckDB on the same tables."""

import decimal
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(path=DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(path):
        at = f"{path}/{f}" + ("/*.parquet" if os.path.isdir(f"{path}/{f}") else "")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{at}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(str, map(plain, v))) + "]"
    return str(v)


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, path=DATA):
    df = query(spark, path)
    rel = con.execute(sql)
    theirs = canon(rel.fetchall(), [d[0] for d in rel.description])
    ours = canon([tuple(r) for r in df.collect()], df.columns)
    assert ours == theirs
