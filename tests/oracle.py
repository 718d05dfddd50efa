"""Compares a query with its DuckDB form on the driver's tables."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, values):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(v[i]) for i in at) for v in values), key=repr)


def compare(spark, con, query, sql):
    df = query(spark, SF)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    expected = rows(names, got.fetchall())
    assert expected, "the oracle gives no rows"
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected
