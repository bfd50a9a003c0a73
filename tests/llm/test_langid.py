import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import langid

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = langid.op2_language_id(spark, DIR).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_nulls_symbols_clashes_and_long_texts(spark):
    train = [(i, ("the and of with that this from " if i % 2 else "der die und nicht ein mit das ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(400)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    rows = [(1, None, "old"), (2, "", "old"), (3, "123 !!!", "old"), (None, "the and of that", None), (5, "die und das ein " * 100000, "old"), (5, "die und das ein " * 100000, "old")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    by = sorted((r.doc_id or 0, r.lang_pred, r.score > 0.5, r.rejected) for r in got.collect())
    assert by == [(0, "en", True, False), (1, "und", False, True), (2, "und", False, True), (3, "und", False, True), (5, "de", True, False), (5, "de", True, False)]
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in langid.identify(docs, None).select("lang_pred").collect()} == {"und"}


def test_a_text_does_not_depend_on_its_neighbours(spark):
    model = langid.train([("the and of with that", "en"), ("der die und nicht ein", "de")] * 20)
    import numpy as np

    texts = [b"the and", b"", b"x", b"der die und", b"of"]
    alone = np.vstack([model.logits(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts])
    together = model.logits(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.allclose(alone, together)
    text = np.frombuffer("the und of nicht é ein and ".encode() * 400, np.uint8)
    whole = model.logits(text, np.array([0, len(text)]))
    part, langid.LONG_PART = langid.LONG_PART, 101
    try:
        assert np.allclose(whole, model.logits(text, np.array([0, len(text)])))
        assert np.allclose(together, model.logits(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])))
    finally:
        langid.LONG_PART = part


def test_gibberish_and_languages_that_were_not_learned_are_rejected(spark):
    rnd = random.Random(5)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").filter("length(text) > 100")
    model = langid.fit(docs.filter("lang in ('de', 'fr')"))
    junk = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(200)) for _ in range(200)]
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string"), model)
    assert got.filter("rejected").count() == 200
    share = {r.lang: r.share for r in langid.identify(docs.select("doc_id", "text", "lang"), model).groupBy("lang").agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
    assert share["de"] <= 0.01 and share["fr"] <= 0.01 and share["en"] >= 0.9 and share["es"] >= 0.9


def test_texts_of_other_scripts_and_tongues_are_rejected(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.fit(docs)
    other = [
        "Это обычный русский текст о погоде и о людях, которые живут в городе",
        "これは日本語の普通の文章です。天気と人々について書いています",
        "Tämä on tavallinen suomalainen teksti säästä ja ihmisistä kaupungissa",
        "To jest zwykły polski tekst o pogodzie i ludziach, którzy mieszkają w mieście",
        "xkcd qwrtz plmk vbnm zxcv jklh",
    ]
    got = langid.identify(spark.createDataFrame(list(enumerate(other)), "doc_id long, text string"), model)
    assert got.filter("rejected").count() == len(other)
    assert 1 / len(model.langs) < model.reject_below < 1


def plain(model, text):
    """Language, score and share of met grams by loops over one text's words."""
    total, n, met = [0.0] * len(model.langs), 0, 0
    raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
    for word in re.finditer(rb"[^ ]+", raw):
        stretch = word.group() + b" "  # a word's end is part of its last grams
        for size, most in ((3, 2654435761), (4, 2246822519)):
            for i in range(-1, len(stretch) - size + 1):
                if i < 0 and (word.start() == 0 or raw[word.start() - 1] != 32):
                    continue
                gram = (b" " + stretch)[i + 1 : i + 1 + size]
                if len(gram) < size or b" " in gram[1 : size - 1]:
                    continue
                if i + size > len(word.group()) and word.end() == len(raw):
                    continue  # the text ends with the word
                x = int.from_bytes(gram, "little")
                x ^= x >> 15 if size == 4 else 0
                slot = (x * most & 0xFFFFFFFF) >> 12
                n, met = n + 1, met + int(model.met[slot])
                row = model.scores[slot >> 5]
                total = [t + float(v) for t, v in zip(total, row, strict=True)]
    z = [(t / max(n, 1) + float(b)) / model.temperature for t, b in zip(total, model.bias, strict=True)]
    p = [math.exp(v - max(z)) for v in z]
    return p.index(max(p)), max(p) / sum(p), met / max(n, 1)


def test_equals_a_plain_prediction(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.fit(docs)
    texts = [r.text for r in docs.filter("length(text) < 900").orderBy("doc_id").limit(60).collect()] + ["", "a", "ab", "abc", " abc", "abcd é", "x yz", "the  and"]
    flat = [t.lower().encode() for t in texts]
    got = model.judge(np.frombuffer(b"".join(flat), np.uint8), np.cumsum([0, *map(len, flat)]))
    for text, lang, score, known in zip(texts, *got, strict=True):
        want = plain(model, text)
        assert (lang, round(score, 5), round(known, 9)) == (want[0], round(want[1], 5), round(want[2], 9)), text


def test_stage_leaves_columns_of_the_results_names(spark):
    rows = [(i, "the and of with that" if i % 2 else "der die und nicht ein", "en" if i % 2 else "de", f"own{i}", i, i % 3 == 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, Score long, rejected boolean")
    got = langid.stage(spark, docs, "")
    assert got.schema == docs.schema
    assert sorted(map(tuple, got.collect())) == rows


def test_only_the_text_goes_to_python_and_once(spark, tmp_path, capsys):
    model = langid.train([("the cat sat on the mat", "en"), ("der hund lag auf dem sofa", "de")] * 10)
    spark.createDataFrame([(1, "the cat", "x"), (2, None, "y"), (3, "12", "z")], "doc_id long, text string, other string").write.parquet(str(tmp_path / "d"))
    got = langid.identify(spark.read.parquet(str(tmp_path / "d")), model).filter("not rejected or other <> 'x'")
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    assert {(r.doc_id, r.text, r.lang_pred, r.score) for r in got.filter("other <> 'x'").collect()} == {(2, None, "und", 0.0), (3, "12", "und", 0.0)}
