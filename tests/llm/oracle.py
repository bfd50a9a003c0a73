"""Holds a registered query against its SQL on one folder of tables."""

import glob

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in sorted(glob.glob(f"{folder}/*.parquet")):
        name = f.rsplit("/", 1)[1].removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def rows_of(df, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def assert_same(spark, folder, query, sql):
    df = query(spark, folder)
    rel = connect(folder).sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = sorted((tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in columns) for r in rel.fetchall()), key=repr)
    assert rows_of(df, columns) == want
