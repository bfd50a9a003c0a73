import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(ids, x, k=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            score = (x * x[i]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
            out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_tables(spark):
    for folder in ("sf0.01", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").orderBy("vec_id").collect()
        want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64))
        got = collected(neighbours.op10_prefix_forest(spark, f"/root/testdata/{folder}"))
        assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
        hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
        assert hits >= 0.95 * 20 * len(want)


def test_several_blocks_of_uneven_norms(spark):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((3000, 24)) * rng.uniform(0.2, 3, (3000, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA)
    got = collected(neighbours.search(df, F.col("vec_id") % 20 == 0, block_rows=700, query_rows=60, per_tree=60))
    want = brute(np.arange(3000), x.astype(np.float64))
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_ties_bad_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0], "") for i in range(40)] + [(100, None, ""), (120, [nan, 1.0], ""), (140, [0.0, 0.0], ""), (160, [inf, 1.0], ""), (180, [None, 1.0], ""), (None, [1.0, 1.0], ""), (200, [1.0, 1.0, 1.0], ""), (3, [1.0, 2.0], "")]
    got = collected(neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert got == {0: [(i, 5.0) for i in range(1, 21)], 20: [(i, 5.0) for i in range(20)]}
    assert neighbours.search(spark.createDataFrame(rows[:0], SCHEMA), F.lit(True)).count() == 0
