import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import common, substrings

SCHEMA = "doc_id long, text string, k1 string, bucket int"


def brute(texts, length):
    counts = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["the", "of", "éa", "and", "x" * 30, "qu", "onth", "zz"]
    prose = lambda k: " ".join(rnd.choice(words) + str(rnd.randrange(90)) for _ in range(k))
    shared = [prose(rnd.randrange(3, 40)) for _ in range(6)]
    texts = []
    for i in range(n):
        t = prose(rnd.randrange(0, 60))
        for _ in range(rnd.randrange(3)):
            t = t + rnd.choice(shared) + prose(3)
        if i % 9 == 0 and texts:
            t = rnd.choice(texts)
        if i % 11 == 0 and texts:
            u = rnd.choice(texts) or "abc"
            j = rnd.randrange(len(u))
            t = u[:j] + "!" + u[j:]
        texts.append(t)
    texts += [None, "", "a" * 500, "ab" * 300, "a" * 37, "abc" * 100, texts[3], texts[3]]
    return texts


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 400])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, bucket_bytes):
    texts = corpus(seed)
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), length=40, q=13, bucket_bytes=bucket_bytes, near=25).collect()
    want = brute([(t or "").encode() for t in texts], 40)
    assert {r.doc_id: r.n_repeated for r in got} == {i: x[1] for i, x in enumerate(brute([(t or "").encode() for t in texts], 25))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [(None, "z" * 10 + "abcdefghij" * 5, "", 0), (7, "same text, said twice over", "", 0), (7, "same text, said twice over", "", 0), (7, "another text of that id", "", 0)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=12, q=4).collect()
    by = {(r.doc_id, r.n_bytes): r.n_removed for r in got}
    assert len(got) == 4 and by[7, 26] == 26 and by[7, 23] == 0 and by[None, 60] == 50
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA), length=12, q=4).count() == 0


def test_refine_classes():
    rnd = random.Random(3)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(5, 60))) for _ in range(40)]
    begin = np.cumsum([0, *map(len, texts[:-1])])
    bucket = substrings.refine(np.frombuffer(b"".join(texts), np.uint8), begin, 11, q=3)
    seen = {}
    for b, t in zip(begin, texts, strict=True):
        for i in range(len(t)):
            if i + 11 > len(t):
                assert bucket[b + i] == -1
            else:
                assert seen.setdefault(bucket[b + i], t[i : i + 11]) == t[i : i + 11]
    assert len(seen) == len({t[i : i + 11] for t in texts for i in range(len(t) - 10)})


def test_disk_of_earlier_steps_is_given_back(spark):
    shuffles = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.sha2((F.col("id") % 2000).cast("string"), 512).alias("text"))
    before = shuffles().size()
    out = common.released(docs.groupBy("text").agg(F.count("*").alias("n")))
    end = time.time() + 10
    while shuffles().size() > before and time.time() < end:
        time.sleep(0.1)
    assert shuffles().size() <= before
    assert sorted(r.n for r in out.collect()) == [1] * 1000 + [2] * 1000
