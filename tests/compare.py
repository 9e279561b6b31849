"""Spark rows against DuckDB's over the same tables."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _plain(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


def check(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = con.execute(sql)
    names, kinds = [x[0] for x in got.description], {x[0]: str(x[1]) for x in got.description}
    want = sorted((tuple(str(_plain(r[names.index(c)])) for c in sorted(names)) for r in got.fetchall()))
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds
    assert sorted(tuple(str(_plain(r[c])) for c in sorted(names)) for r in df.collect()) == want
