"""Comparison of a Spark result with DuckDB's, as multisets of rows, columns sorted by name."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return str(v) if v is not None else None


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, sql, con):
    """(columns equal, only in Spark, only in SQL), the last two as samples with their sizes."""
    from collections import Counter

    c1, a = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    c2, b = rows([d[0] for d in rel.description], rel.fetchall())
    x, y = Counter(a), Counter(b)
    return c1 == c2, list((x - y).elements()), list((y - x).elements()), len(a)
