"""A query's rows against its SQL, column by column, in any order of rows."""

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def sql_rows(sql: str, sf_dir: str = SMALL):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    out = con.sql(sql)
    return sorted(out.columns), sorted((tuple(plain(dict(zip(out.columns, r))[c]) for c in sorted(out.columns)) for r in out.fetchall()), key=repr)


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else 0.0 if x == 0 else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def differences(df, sql: str, sf_dir: str = SMALL) -> list:
    """The first rows that only one side has."""
    (names, mine), (columns, theirs) = spark_rows(df), sql_rows(sql, sf_dir)
    if names != columns:
        return [("columns", names, columns)]
    if len(mine) != len(theirs):
        return [("rows", len(mine), len(theirs), mine[:1], theirs[:1])]
    return [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b][:3]
