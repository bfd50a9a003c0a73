from collections import defaultdict

from pyspark.sql import functions as F

from folioflow.llm import mixing

from .oracle import assert_same

SCHEMA = "doc_id long, text string, lang string, source string, taken int"


def test_equals_sql(spark):
    assert_same(spark, "/root/testdata/sf0.01", mixing.op3_source_mix, mixing.op3_sql())


def leaves(spark, rows, mix):
    df = spark.createDataFrame(rows, "__domain string, __lang string, __source string, available long, docs long")
    return {(r["__domain"], r["__lang"], r["__source"]): r.budget for r in mixing.leaf_budgets(df, mix).collect()}


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "en", "s1", 10, 1), ("a", "en", "s2", 1000, 1), ("a", "de", "s3", 1000, 1), ("b", "en", "s4", 1000, 1)]
    got = leaves(spark, rows, mixing.Mix(target_tokens=400, max_epochs=1))
    # a and b get 200 each, en and de 100 each; what s1 lacks of its 50 goes to s2
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 90, ("a", "de", "s3"): 100, ("b", "en", "s4"): 200}
    got = leaves(spark, rows, mixing.Mix(domains={"b": 3}, target_tokens=1600, max_epochs=1))
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 290, ("a", "de", "s3"): 300, ("b", "en", "s4"): 1000}


def test_prefix_of_seeded_epochs_with_hot_leaf(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "hot" if i % 3 else f"s{i % 5}", 9) for i in range(900)]
    rows += [(None, "a b c", None, None, 0), (5000, None, "en", "hot", 0), (5001, "", "en", "hot", 0), (1, "w w", "en", "hot", 9), (1, "w w", "en", "hot", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.Mix(share_percent=130, sources={"hot": 2, "s0": 9}, max_epochs=3, range_rows=20)
    got = mixing.mix_sources(docs, mix, F.lit("d"), mixing.n_tokens(F.col("text"))).collect()
    many = mixing.mix_sources(docs.repartition(7), mixing.Mix(**{**mix.__dict__, "range_rows": 100000, "broadcast_leaves": 0}), F.lit("d"), mixing.n_tokens(F.col("text"))).collect()
    key = lambda r: (r.doc_id or -1, r.epoch, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, many))
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    assert total * 130 // 100 - 10 <= sum(r.taken for r in got) <= total * 130 // 100
    partial = defaultdict(int)
    for r in got:
        partial[r.lang, r.source] += r.taken < r.n_tokens
    assert max(partial.values()) <= 1
    assert {r.doc_id for r in got} <= {r[0] for r in rows} - {5000, 5001}


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA), mixing.Mix(), F.lit("d"), mixing.n_tokens(F.col("text"))).count() == 0
