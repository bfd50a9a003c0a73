"""Operator 10: approximate nearest neighbours by a hash-prefix forest.

Each tree writes a vector as a long string of bits, the signs of its products
with random directions, and keeps the strings as a sorted array. A query
descends every tree to its longest matching prefix, then all trees ascend
together, a bit at a time, until the ranges of the shared prefixes hold
`per_tree` rows a tree; what they hold is compared exactly. For the largest
inner product, vectors get one more component that makes their norms equal,
queries a zero there, so that the angle orders as the product does.

Rows are dealt by a hash of the id to blocks of about `block_rows`, each with
its own forest, and queries to blocks of `query_rows`; every query block meets
every row block once, and the best of each are merged. Both block numbers come
from counts, so a task's share stays the same whatever the size of the table.

Every row is indexed. No part is taken by vectors that are null, of norm zero,
or hold nulls, NaNs or infinities. Vectors of different lengths never meet. An
id that repeats counts once, with its least vector; rows with a null id are
left out. Ties go to the smaller id. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RESULT = "query_id long, vec_id long, score double"


class Forest:
    """Sorted arrays of `trees` hash strings of `bits` bits over the rows of x, of norm `most` at most."""

    def __init__(self, x: np.ndarray, most: float, trees: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((x.shape[1] + 1, trees * bits)).astype(np.float32)
        self.trees, self.bits, self.rows = trees, bits, len(x)
        lift = np.sqrt(np.maximum(0.0, most**2 - (x**2).sum(axis=1)))
        strings = self.strings(np.column_stack([x, lift]))
        self.order = np.argsort(strings, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(strings, self.order.T, axis=0).T.copy()

    def strings(self, x: np.ndarray) -> np.ndarray:
        """One integer of `bits` bits a row and tree."""
        out = np.empty((len(x), self.trees), np.int64)
        weights = (1 << np.arange(self.bits)[::-1]).astype(np.int64)
        for a in range(0, len(x), 1024):
            signs = x[a : a + 1024].astype(np.float32) @ self.planes > 0
            out[a : a + 1024] = (signs.reshape(-1, self.trees, self.bits) * weights).sum(axis=2)
        return out

    def candidates(self, q: np.ndarray, per_tree: int) -> np.ndarray:
        """A row of flags over the indexed rows for each query."""
        strings = self.strings(np.column_stack([q, np.zeros(len(q))]))
        n = len(q)
        lo, hi = np.zeros((self.trees, n), np.int64), np.full((self.trees, n), self.rows)
        open_ = np.arange(n)
        for depth in range(self.bits, 0, -1):
            if not len(open_):
                break
            shift = self.bits - depth
            low = strings[open_] >> shift << shift
            for t in range(self.trees):
                lo[t, open_] = np.searchsorted(self.sorted[t], low[:, t])
                hi[t, open_] = np.searchsorted(self.sorted[t], low[:, t] + (1 << shift))
            held = (hi[:, open_] - lo[:, open_]).sum(axis=0)
            enough = held >= per_tree * self.trees
            still = open_[~enough]
            if depth == 1:  # the root holds all rows
                lo[:, still], hi[:, still] = 0, self.rows
            open_ = still
        flags = np.zeros((n, self.rows), bool)
        for i in range(n):
            row = flags[i]
            for t in range(self.trees):
                row[self.order[t, lo[t, i] : hi[t, i]]] = True
        return flags


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, flags: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k candidates of largest inner product, ties to the smaller id."""
    at = np.flatnonzero(flags & (ids != own))
    rough = x[at] @ q
    if len(at) > k:  # sums in another order differ in the last digits: leave room, then sum alike
        floor = np.partition(rough, len(at) - k)[len(at) - k]
        at = at[rough >= floor - 1e-9 * (1 + abs(floor))]
    score = (x[at] * q).sum(axis=1)
    top = np.lexsort((ids[at], -score))[:k]
    return ids[at][top], score[top]


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, queries: Column, k: int = 20, trees: int = 48, bits: int = 24, per_tree: int = 100, block_rows: int = 8192, query_rows: int = 16384, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors(vec_id, embedding); queries: which rows ask."""
    rows = (
        vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks"))
        .withColumn("dim", F.size("embedding"))
    )
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    # one row of three numbers
    n, asking, most = rows.agg(F.count("*"), F.count_if("asks"), F.max(norm)).first()
    row_blocks, query_blocks = -(-n // block_rows) or 1, -(-asking // query_rows) or 1
    deal = lambda blocks, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(blocks))
    indexed = rows.select("vec_id", "embedding", "dim", deal(row_blocks, "row").alias("rb"), F.explode(F.expr(f"sequence(0L, {query_blocks - 1}L)")).alias("qb"))
    asked = rows.filter("asks").select("vec_id", "embedding", "dim", F.explode(F.expr(f"sequence(0L, {row_blocks - 1}L)")).alias("rb"), deal(query_blocks, "query").alias("qb"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, ids = np.stack(left["embedding"].to_numpy()), left["vec_id"].to_numpy()
            forest = Forest(x, most, trees, bits, seed)
            asks, names = np.stack(right["embedding"].to_numpy()), right["vec_id"].to_numpy()
            for a in range(0, len(asks), 512):
                flags = forest.candidates(asks[a : a + 512], per_tree)
                for i in range(len(flags)):
                    found, score = best(x, ids, asks[a + i], names[a + i], flags[i], k)
                    out.append(pd.DataFrame({"query_id": names[a + i], "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["dim", "rb", "qb"]
    found = indexed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, RESULT)
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
