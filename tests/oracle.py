"""Compares a query with its SQL in DuckDB: columns, rows, values."""

import glob
import os

import duckdb


def connection(root):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW \"{name}\" AS SELECT * FROM '{path}'")
    return con


def rows(arrow):
    names = sorted(arrow.column_names)
    return names, sorted(map(repr, zip(*[[_plain(v) for v in arrow.column(n).to_pylist()] for n in names], strict=True)))


def _plain(value):
    return float(value) if isinstance(value, float) else value


def assert_same(spark, con, root, function, sql):
    got_names, got = rows(function(spark, root).toArrow())
    want_names, want = rows(con.sql(sql).to_arrow_table())
    assert got_names == want_names
    assert got == want
