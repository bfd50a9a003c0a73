import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.llm import common, phraseindex

from .oracle import assert_same

DOC = "doc_id long, text string, win string, pos int"
ITEM = "item_id long, text string, words int"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, size):
    out = []
    for d, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item, t, *_ in items:
            v = words(t)
            k = min(size, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for s in range(len(w) - k + 1):
                if k and tuple(w[s : s + k]) in grams:
                    hit |= set(range(s, s + k))
                    found.add(item)
        out.append((d, len(hit), tuple(sorted(map(str, found)))))
    return sorted(out, key=repr)


def test_equals_sql(spark):
    assert_same(spark, "/root/testdata/sf0.01", phraseindex.op6_decontaminate, phraseindex.OP6_SQL)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_equals_brute_force(spark, limit):
    rnd = random.Random(3)
    some = ["the", "Of", "é", "x1", "Éa", "and", "zz", "q"]
    say = lambda n: [rnd.choice(some) for _ in range(n)]
    items = [(i, " ".join(say(rnd.choice([1, 2, 4, 6, 9]))), 0) for i in range(5, 17)] + [(90, None, 0), (91, "!?", 0), (92, "the THE, the the the", 0), (92, "the THE, the the the", 0), (93, "never seen words here", 0)]
    docs = []
    for i in range(80):
        w = say(rnd.randrange(0, 25))
        if i % 3 == 0:
            w += (rnd.choice(items)[1] or "").split() + say(3)
        docs.append((i, rnd.choice([" ", "-", "\n", "..."]).join(w) + rnd.choice(["", " ", "."]), "", 0))
    docs += [(200, None, "", 0), (201, "", "", 0), (202, "---", "", 0), (203, "the " * 5000, "", 0), (7, docs[9][1], "", 0)]
    d, b = spark.createDataFrame(docs, DOC).repartition(5), spark.createDataFrame(items, ITEM)
    hits = {(r.k1, r.k2): r for r in phraseindex.contamination(common.keyed(d), b, 4, limit).collect()}
    got = []
    for r in common.keyed(d).collect():
        h = hits.get((r.k1, r.k2))
        got.append((r.k1, h.n_hit if h else 0, tuple(sorted(map(str, h.item_ids))) if h else ()))
    assert sorted(got, key=repr) == brute(docs, items, 4)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare common x y z scarce", "", 0), (2, "scarce then rare", "", 0), (3, "rare " + "pad " * 20 + "scarce", "", 0), (4, "rare alone", "", 0)], DOC)
    items = spark.createDataFrame([(1, "rare pad scarce", 0)], ITEM)
    index = phraseindex.Index(common.keyed(docs), items, 3)
    got = sorted((r.k1, r["first"], r["last"]) for r in index.proximity(5).collect())
    assert got == [(1, 0, 5), (2, 0, 2)] and index.matches().count() == 0


def test_stage_nulls_and_empty(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven")]
    docs = spark.createDataFrame([(1, "A: one two three four five six seven eight nine TEN!", "", 0), (2, "one two three", "", 0), (None, None, "", 0), (3, "x", "", 1), (3, "x", "", 1)], DOC)
    hits = phraseindex.contamination(common.keyed(docs), spark.createDataFrame(items, "item_id long, text string"))
    (r,) = hits.collect()
    assert (r.k1, r.n_hit, r.item_ids, [tuple(s) for s in r.spans]) == (1, 10, [1], [(1, 10)])
    assert phraseindex.contamination(common.keyed(docs.limit(0)), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert phraseindex.contamination(common.keyed(docs), spark.createDataFrame([], ITEM)).count() == 0
    assert phraseindex.stage.__doc__ and docs.withColumn("z", F.lit(1)).count() == 5


def test_without_broadcasts(spark):
    """The same hits whatever the bound on what is broadcast; sizes are counted in bytes."""
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "é short"), (None, None)], "item_id long, text string")
    rows = [(1, "x one two three four five six seven eight nine ten y"), (2, "an é short one"), (3, None), (4, "two one")]
    docs = common.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    hits = [sorted((r.k1, r.n_hit, sorted(r.item_ids)) for r in phraseindex.contamination(docs, items, broadcast_bytes=n).collect()) for n in (0, 1 << 20)]
    assert hits[0] == hits[1] == [(1, 10, [1]), (2, 2, [2])]
    assert phraseindex.measured(spark.createDataFrame([("é",), (None,)], "w string")) == 32 + 18 + 32 + 8
    assert phraseindex.measured(spark.createDataFrame([(["a", "bc"], 1)], "w array<string>, n long")) == 32 + 16 + 17 + 18 + 8
    assert phraseindex.measured(docs.limit(0)) == 0
