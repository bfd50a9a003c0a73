import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import langid, mixing

from .test_phraseindex import words as item_words
from .test_setjoin import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and that with this from have they will been were their which about would there could other after".split()
DE = "der die und das nicht mit sich auch auf für werden aus noch nach bei einer über einen sind wird".split()


def fixture():
    rnd = random.Random(8)
    rows = []
    footer = "Visit our site for all of it"
    benchmark = " ".join(rnd.choice(EN) + str(rnd.randrange(9)) for _ in range(14))
    for i in range(140):
        stock = EN if i % 3 else DE
        say = lambda n, stock=stock: " ".join(rnd.choice(stock) + rnd.choice(["", "", "en", "x"]) for _ in range(n))
        lines = [say(rnd.randrange(12, 30)) for _ in range(rnd.randrange(1, 6))]
        if i % 4 == 0:
            lines.append(footer)
        if i % 10 == 7:
            lines[0] += " " + benchmark
        text = "\n".join(lines)
        if i % 9 == 5:
            text = rows[i - 3][1]
        if i % 9 == 8:
            text = rows[i - 2][1] + " end"
        rows.append((i, text, "en" if i % 3 else "de", f"src{i % 4}", len(text)))
    rows += [(500, None, "en", "src1", 0), (501, "12 34 !!", None, None, 8), (502, "", "en", None, 0)]
    return rows, [(1, benchmark), (2, "never")]


def plain_lines(rows):
    """Recurring lines in plain Python."""

    def mask(line):
        numbers, one = " ".join(re.sub(r"\S*\d\S*", "<*>", line).split()), " ".join(line.split())
        return numbers if re.search("[a-zß-ü]", numbers) else one

    head = lambda line: tuple(line.split(" ")[:3])
    texts = {r[1] for r in rows}
    lines = {t: [x for x in map(mask, t.split("\n")) if x] for t in texts}
    leaves = defaultdict(set)
    for x in {x for xs in lines.values() for x in xs}:
        leaves[len(x.split(" ")), head(x)].add(x)
    rule = {}
    for (n, _), group in leaves.items():
        if len(group) >= 3 and n >= 4:
            pattern = []
            for place in zip(*(x.split(" ") for x in group), strict=True):
                top = max(set(place), key=place.count)
                pattern.append(top if 2 * place.count(top) > len(place) else None)
            if 4 * sum(p is not None for p in pattern) >= 3 * n and any(p and re.search("[a-zß-ü]", p) for p in pattern[3:]):
                for x in group:
                    if all(p in (None, w) for p, w in zip(pattern, x.split(" "), strict=True)):
                        rule[x] = " ".join(p or "<*>" for p in pattern)
    seen = defaultdict(set)
    for t in texts:
        for x in lines[t]:
            seen[rule.get(x, x)].add(t)
    often = {k for k, v in seen.items() if len(v) >= 5}
    about = {}  # of texts of their own, what their longest own line begins with, and other words of it
    for t in texts:
        own = [(len(x), -i, x.split(" ")) for i, x in enumerate(lines[t]) if rule.get(x, x) not in often]
        if own and 3 * len(own) >= len(lines[t]):
            w = max(own)[2]
            n = len(w)
            ends = {tuple(w[n - min(3, n // 2) :])} if n > 1 else set()
            about[t] = tuple(w[: n if n < 4 else min(3, (n + 1) // 2)]), ends | ({tuple(w[3:6]), tuple(w[-6:-3])} if n >= 6 else set())
    gone = set()
    for k in often:
        heads = defaultdict(list)
        for t in seen[k] & about.keys():
            heads[about[t][0]].append(about[t][1])
        edited = sum(min(len(v), 5) for v in heads.values() if len(v) > 1)
        known = {e for v in heads.values() if len(v) > 1 for ends in v for e in ends}
        alone = sum(len(v) == 1 and not v[0] & known for v in heads.values())
        if alone >= 5 and alone >= edited:
            gone.add(k)
    clean = lambda t: "\n".join(x for x in t.split("\n") if not mask(x) or rule.get(mask(x), mask(x)) not in gone)
    return [(d, clean(t), a, s, len(clean(t))) for d, t, a, s, _ in rows]


def plain_near(rows):
    sets = {r[0]: shingles(r[1], 5) for r in rows}
    ids, top = sorted(sets), {i: i for i in sets}
    find = lambda i: i if top[i] == i else find(top[i])
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
                top[max(find(a), find(b))] = min(find(a), find(b))
    return [r for r in rows if find(r[0]) == r[0]]


def plain_clean(rows, items):
    grams = set()
    for _, t in items:
        w = item_words(t)
        k = min(10, len(w))
        grams |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    sizes = {len(g) for g in grams}
    hit = lambda w: any(tuple(w[i : i + k]) in grams for k in sizes for i in range(len(w) - k + 1))
    return [r for r in rows if not hit(item_words(r[1]))]


def water(budget, nodes):
    """Shares by weight, none over its capacity: {name: (weight, capacity)}."""
    out, left = {}, dict(nodes)
    while left:
        total = sum(w for w, _ in left.values())
        full = [k for k, (w, c) in left.items() if c * total <= w * budget]
        if not full:
            return out | {k: w * budget // total for k, (w, _) in left.items()}
        k = min(full, key=lambda k: (left[k][1] / left[k][0], k))
        out[k] = left[k][1]
        budget -= left.pop(k)[1]
    return out


def plain_mix(rows, mix):
    leaves = defaultdict(list)
    for d, t, lang, source, _ in rows:
        if t.split():
            domain = f"domain{int(hashlib.md5(source.encode()).hexdigest()[:4], 16) % 4}" if source else mixing.NONE
            leaves[domain, lang or mixing.NONE, source or mixing.NONE].append((d, len(t.split())))
    have = {k: sum(n for _, n in v) for k, v in leaves.items()}
    cap = lambda *p: mix.max_epochs * sum(n for k, n in have.items() if k[: len(p)] == p)
    out = []
    domains = water(min(sum(have.values()) * mix.share_percent // 100, cap()), {d: (mix.domains.get(d, 1), cap(d)) for d, _, _ in have})
    for d, budget in domains.items():
        langs = water(budget, {x: (mix.langs.get(x, 1), cap(d, x)) for y, x, _ in have if y == d})
        for lang, share in langs.items():
            for source, own in water(share, {s: (mix.sources.get(s, 1), cap(d, lang, s)) for y, x, s in have if (y, x) == (d, lang)}).items():
                for epoch in range(1, mix.max_epochs + 1):
                    for doc, n in sorted(leaves[d, lang, source], key=lambda r: hashlib.md5(f"{mix.seed}:{epoch}:{r[0]}".encode()).hexdigest()):  # noqa: B023
                        take = min(n, own)
                        own -= take
                        if take:
                            out.append((doc, epoch, n, take))
    return sorted(out)


def test_each_stage_equals_plain_python(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.fit(docs)
    kept = [r for r in rows if r[1] and re.search("[a-z]", r[1])]

    def judged(text):
        raw = text.lower().encode()
        _, score, known = model.judge(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return score[0] >= model.reject_below and known[0] >= model.known_below

    kept = [r for r in kept if judged(r[1])]
    assert len(kept) >= len(rows) - 4
    want = [sorted(kept)]
    want.append(plain_lines(want[-1]))
    want.append(plain_near(want[-1]))
    want.append(plain_clean(want[-1], items))
    assert len(kept) > len(want[2]) > len(want[3]) and sum(a != b for a, b in zip(want[0], want[1], strict=True)) > 20
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want, strict=False):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect())) == expected, name
        docs = spark.createDataFrame(expected, SCHEMA)
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.epoch, r.n_tokens, r.taken) for r in result.collect()) == plain_mix(want[3], mixing.PRODUCTION)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
