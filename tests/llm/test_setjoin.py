import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import common, setjoin
from folioflow.llm.components import components

SCHEMA = "doc_id long, text string, component string, n int"


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words, num, den):
    sets = [shingles(t, words) for _, t, *_ in rows]
    n = len(rows)
    top, links = list(range(n)), [0] * n

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0] if rows[i][0] is not None else -9, len(sets[i]), low.get(find(i), -9), links[i]) for i in range(n))


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
    prose = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    passage = prose(30)
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.4 or not texts:
            w = prose(rnd.choice([0, 1, 2, 3, 5, 8, 12, 40, 90, 300]))
        else:
            w = list(rnd.choice(texts))
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 9])):
                if w:
                    at = rnd.randrange(len(w))
                    w[at : at + rnd.randrange(2)] = prose(rnd.randrange(3))
        if rnd.random() < 0.3:
            w = w + passage
        texts.append(w)
    return [(i * 7 % (7 * n + 1), rnd.choice([" ", "\n", "\t "]).join(x.upper() if rnd.random() < 0.01 else x for x in w), "", 0) for i, w in enumerate(texts)]


@pytest.mark.parametrize("words,num,den,points", [(4, 85, 100, 8192), (5, 80, 100, 40), (1, 60, 100, 8192)])
def test_equals_brute_force(spark, words, num, den, points):
    rows = corpus(words, 260) + [(90001, None, "", 0), (90002, " \n ", "", 0), (90003, "", "", 0), (None, "some words of a null id", "", 0)]
    rows += [rows[3], rows[3]]
    got = setjoin.link(common.keyed(spark.createDataFrame(rows, SCHEMA).repartition(6)), words, num, den, points)
    none = lambda v: -9 if v is None or v == common.NULL_ID else v
    assert sorted((none(r.k1), r.n, none(r.component), r.links) for r in got.collect()) == brute(rows, words, num, den)


def test_a_large_group_of_near_copies_is_divided_by_pivots():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 60, 120).astype(np.uint64)) for _ in range(6)]
    sets = []
    for i in range(700):
        s = base[i % 6].copy()
        for _ in range(rng.integers(0, 14)):
            s[rng.integers(len(s))] = rng.integers(0, 1 << 60)
        sets.append(np.unique(s))
    got, tally = set(), {}
    for home, other in setjoin.region_links(sets, 85, 100, tally):
        pairs = list(zip(home.tolist(), other.tolist(), strict=True))
        assert not got & set(pairs)
        got |= set(pairs)
    want = set()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            k = len(np.intersect1d(x, y))
            if i != j and 100 * k >= 85 * (len(x) + len(y) - k):
                want.add((i, j))
    assert got == want
    assert tally["divisions"] > 0 and tally["by pivots"] > 0


@pytest.mark.parametrize("num", [80, 85, 95])
def test_linked_sets_share_a_landmark(num):
    rng = np.random.default_rng(num)
    parts = setjoin.Parts(num, 100)
    for n in [1, 2, 5, 20, 61, 62, 95, 96, 97, 130, 177, 301, 700, 5000]:
        for _ in range(20):  # as far apart as a link may be: others added, others in place, others left out
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            d = int(parts.differences(np.array(n)))
            swap = n - -(-2 * num * n // (100 + num))
            for y in (np.append(x, rng.integers(0, 1 << 63, d).astype(np.uint64)), np.append(x[swap:], rng.integers(0, 1 << 63, swap).astype(np.uint64))):
                y = np.unique(y)
                shared = len(np.intersect1d(x, y))
                if 100 * shared < num * (len(x) + len(y) - shared) or len(x) == len(y) == shared:
                    continue
                sig, which = parts.signatures([x, y])
                assert set(sig[which == 0].tolist()) & set(sig[which == 1].tolist()), (n, len(y))
    sig, _ = parts.signatures([np.unique(rng.integers(0, 1 << 63, 100_000).astype(np.uint64))])
    assert len(sig) <= 2 * 100  # whatever the size of a set


def test_pivots_run_on_the_regions_of_the_given_tables(spark):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    found = setjoin.link(common.keyed(docs), 4, 85, 100).select("k1", "root")
    groups = found.join(found.groupBy("root").count().filter("count > 2"), "root").select("root", F.col("k1").alias("doc_id"))
    texts = groups.join(docs, "doc_id").select("root", "text").collect()
    rounds, decided = 0, 0
    for root in sorted({r.root for r in texts}):
        flat = [t.encode() for t in sorted({r.text for r in texts if r.root == root})]
        sets = setjoin.shingle_sets(np.frombuffer(b"".join(flat), np.uint8), np.cumsum([0, *map(len, flat)]), 4)
        tally = {}
        got = sum(len(home) for home, _ in setjoin.region_links(sets, 85, 100, tally))
        both = [(len(np.intersect1d(x, y)), len(x) + len(y)) for i, x in enumerate(sets) for y in sets[:i]]
        assert got == 2 * sum(100 * k >= 85 * (n - k) for k, n in both)
        rounds += tally.get("pivot rounds", 0)
        decided += tally.get("by pivots", 0)
    assert rounds > 0 and decided > 0


def test_empty_and_stage(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert setjoin.link(common.keyed(empty)).count() == 0
    rows = [(5, "one two three four five six seven", "x", 1), (3, "one two three four five six seven", "y", 2), (4, "", "z", 3), (6, None, "z", 3), (3, "other", "w", 1)]
    got = setjoin.stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == ["doc_id", "text", "component", "n"]
    assert {r.doc_id for r in got.collect()} == {3, 4, 6}


def test_stage_keeps_one_row_of_each_component_whatever_its_ids(spark):
    say = lambda c: " ".join(f"{c}{i}" for i in range(60))
    near = lambda c: say(c) + " end"
    rows = [(None, say(c), "", 0) for c in "abc"]  # unrelated, all without an id
    rows += [(None, near("a"), "", 0), (None, say("d"), "", 0), (9, near("d"), "", 0)]  # an id goes before none
    rows += [(3, say("e"), "", 0), (3, say("f"), "", 0), (4, near("e"), "", 0), (5, near("f"), "", 0)]  # one id, two components
    rows += [(None, say("g"), "", 2), (None, say("g"), "", 1), (6, say("h"), "", 1), (6, say("h"), "", 1)]  # rows that repeat id and text
    rows += [(None, "", "", 0), (None, None, "", 0)]  # no words: no duplicates
    got = sorted((r.doc_id or -1, (r.text or "")[:1], r.n) for r in setjoin.stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert got == sorted([(-1, "a", 0), (-1, "b", 0), (-1, "c", 0), (9, "d", 0), (3, "e", 0), (3, "f", 0), (-1, "g", 1), (6, "h", 1), (-1, "", 0), (-1, "", 0)])


def test_groups_are_connected_as_by_all_pairs():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)) for n in (30, 200, 230, 900)]
    passage = base[1][:60]
    sets = []
    for i in range(160):
        s = base[i % 4].copy()
        s[rng.permutation(len(s))[: rng.integers(0, len(s) // 4)]] = rng.integers(0, 1 << 63)
        sets.append(np.unique(np.append(s, passage)))
    n, profiles = np.array([len(s) for s in sets]), [setjoin.profile(s) for s in sets]
    top = list(range(len(sets)))
    find = lambda i: i if top[i] == i else find(top[i])
    for i, j in setjoin.near_points(n, profiles, 85, 100):
        top[find(i)] = find(j)
    linked = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            k = len(np.intersect1d(x, y))
            if 100 * k >= 85 * (len(x) + len(y) - k):
                linked += 1
                assert find(i) == find(j)
    assert linked and len({find(i) for i in range(len(sets))}) > 1


def test_groups_over_the_limit_lose_no_link(spark):
    rows = corpus(9, 200)
    docs = common.keyed(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = setjoin.link(docs, 4, 85, 100, group_points=2).select("k1", "n", "component", "links").collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 85, 100)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    top = list(range(2000))
    find = lambda i: i if top[i] == i else find(top[i])
    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0
