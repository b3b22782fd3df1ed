"""Spark against DuckDB: equal columns, and equal rows in any order."""

import glob
import math
import os

DATA = os.environ.get("LAKELEAF_TESTDATA", "/root/testdata/sf0.001")


def connection(data=DATA):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(spark, name, query, sql, data=DATA):
    df = query(spark, data)
    found = connection(data).sql(sql)
    assert sorted(df.columns) == sorted(found.columns), name
    want, got = rows_of(found.columns, found.fetchall()), rows_of(df.columns, df.collect())
    assert len(want) == len(got), (name, len(want), len(got))
    different = [(a, b) for a, b in zip(want, got, strict=True) if a != b]
    assert not different, (name, len(different), different[:3])
