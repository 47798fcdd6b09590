"""Compares a Spark result with DuckDB's on the same Parquet tables."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value if isinstance(value, (int, bool, str)) else str(value)


def rows_of(rows):
    return sorted([tuple(plain(v) for v in row) for row in rows], key=repr)


def assert_same(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = rows_of(tuple(r[c] for c in order) for r in df.collect())
    want = rows_of(tuple(dict(zip(names, r, strict=True))[c] for c in order) for r in expected)
    assert got == want
