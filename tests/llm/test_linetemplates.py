import random

from folioflow.llm import linetemplates as lt

from .oracle import assert_same

SCHEMA = "doc_id long, text string, n_chars long, n_lines string, pos string"


def test_equals_sql(spark):
    assert_same(spark, "/root/testdata/sf0.01", lt.op7_line_templates, lt.OP7_SQL)


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, len(t or ""), "old", "p") for i, t in enumerate(texts)], SCHEMA)


def cleaned(spark, texts, **more):
    return {r.doc_id: (r.text, r.n_dropped) for r in lt.drop_recurring(docs(spark, texts), **more).collect()}


def test_variable_fields_are_generalised(spark):
    names = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = [f"text {n} begins here so and goes on\nPosted by user {n} on the site\nPage {i} of 9\n\nand {n} ends" for i, n in enumerate(names)]
    got = cleaned(spark, texts)
    assert got == {i: (f"text {n} begins here so and goes on\n\nand {n} ends", 2) for i, n in enumerate(names)}


def test_copies_of_whole_documents_stay(spark):
    body = "first line of it\nthe second line is the longest one of it\nthird line of it"
    near = [body.replace("longest", f"longest{c}") for c in "abcdefghij"]
    got = cleaned(spark, [body] * 30 + near)
    assert all(n == 0 for _, n in got.values())


def test_rare_lines_blank_lines_and_nulls_stay(spark):
    texts = [None, "", "\n\n", "a\n\nb", " \t", "same words"] + [f"own {c} line which is long\nfour times only here\nmore {c}" for c in "wxyz"]
    assert cleaned(spark, texts) == {i: (t or "", 0) for i, t in enumerate(texts)}


def test_all_of_a_text_may_go_and_long_words_are_quick(spark):
    texts = [f"opening number {c} of the letters\nall rights are reserved\nclosing {c}" for c in "abcdef"] + ["all rights are reserved", "x" * 300_000, "1" + "x" * 300_000]
    got = cleaned(spark, texts)
    assert got[6] == ("", 1) and got[0] == ("opening number a of the letters\nclosing a", 1)
    assert got[7] == (texts[7], 0) and got[8] == (texts[8], 0)


def test_repeated_rows_null_ids_stage_and_empty(spark):
    rows = [(None, "own\nkeep", 8, "", "")] * 2 + [(1, f"q{c} is longer than that\nthe footer line\nr{c}", 99, "", "") for c in "abcde"]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lt.stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r.text, r.n_chars) for r in got.collect()) == sorted([("own\nkeep", 8)] * 2 + [(f"q{c} is longer than that\nr{c}", 25) for c in "abcde"])
    assert lt.drop_recurring(df.limit(0)).count() == 0


def staged(spark, texts):
    return {r.doc_id: r.text for r in lt.stage(spark, docs(spark, texts), "").collect()}


def test_stage_drops_boilerplate_that_is_the_longest_line(spark):
    licence = " ".join(f"clause{c} of the long licence" for c in "abcdefghijkl")
    own = lambda c: f"what text {c} says itself\nand then {c} more of it"
    texts = [f"{own(c)}\n{licence}\nall rights are reserved" for c in "abcdef"]
    assert staged(spark, texts) == {i: own(c) for i, c in enumerate("abcdef")}


def test_a_licence_that_is_the_longest_line_of_short_texts_goes(spark):
    licence = " ".join(f"clause{c} of the long licence" for c in "abcdefghijkl")
    got = cleaned(spark, [f"short {c}\n{licence}" for c in "abcdefghijklmnopqrst"])
    assert sorted(got.values()) == [(f"short {c}", 1) for c in "abcdefghijklmnopqrst"]


def test_stage_drops_boilerplate_beside_a_large_group_of_copies(spark):
    story = lambda c: f"the one long story that is told by every copy with word{c} in it"
    words = [a + b + c for a in "abcdef" for b in "ghijkl" for c in "mnopqr"]
    own = [f"{c} independent text of its own and about {c}" for c in "uvwxyz"]
    texts = [f"{story(w)}\nthe footer line" for w in words] + [f"{o}\nthe footer line" for o in own]
    assert staged(spark, texts) == dict(enumerate([story(w) for w in words] + own))


def test_stage_keeps_the_lines_of_edited_copies(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    whole = [[[word() for _ in range(rnd.randrange(8, 16))] for _ in range(n)] for n in (2, 3, 4, 8, 20)]
    texts = []
    for body in whole:
        for i in range(250):
            copy = [list(line) for line in body]
            for _ in range(1 + i % 2):
                line = rnd.choice(copy)
                line[rnd.randrange(len(line))] = word()
            texts.append("\n".join(map(" ".join, copy)))
    assert staged(spark, texts) == dict(enumerate(texts))


def test_stage_keeps_unique_lines_of_one_opening(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = [f"text {w} has its own beginning\nthis is the {w}\n{i} {i * 7} {i + 100}\nthis is the end" for i, w in enumerate(words, 10)]
    texts += [f"mail {w} is about something\nSent to you {w} by us\n2024 12 31" for w in words]
    want = [t.replace("\nthis is the end", "") for t in texts[:8]] + [t.split("\n")[0] for t in texts[8:]]
    assert staged(spark, texts) == dict(enumerate(want))


def test_stage_leaves_columns_of_the_results_names(spark):
    rows = [(i, f"text {c} is longer than that\nthe footer line", f"lines{i}", i * 5) for i, c in enumerate("abcdef")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_lines string, n_dropped long")
    got = lt.stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(i, t.split("\n")[0], a, b) for i, t, a, b in rows]
