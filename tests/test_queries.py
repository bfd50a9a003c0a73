import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.functions import names
from folioflow.plans import registry

FOLDER = "/root/testdata/sf0.01"


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(glob.glob(f"{FOLDER}/*.parquet")):
        c.sql(f"CREATE VIEW {f.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, FOLDER)
    rel = con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    place = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0


def test_sizes_round_halves_to_even(spark):
    sizes = [0, 1023, 1024, 1024 + 256, 1024 + 768, 118 * 1024 + 256, 1048575, 1048576 + 262144, (1 << 20) * 7 + 786432, (1 << 20) * 2 - 1, (1 << 43) + (1 << 18)]
    rows = spark.createDataFrame([(n,) for n in sizes] + [(None,)], "n long").select("n", names.human_size(F.col("n")).alias("said")).collect()
    want = lambda n: f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"
    assert [r.said for r in rows] == [*map(want, sizes), None]
