"""Runs a query and its SQL twin over the same tables and compares the rows as bags."""

import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return tuple(map(_plain, x)) if isinstance(x, list) else x


def connection():
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        path = f"{DATA}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def compare(spark, con, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    ours = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    assert ours == theirs
