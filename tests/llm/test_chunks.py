import random

import numpy as np

from folioflow.llm import chunks

SCHEMA = "doc_id long, text string, keeper string"


def plain_cuts(body, least, most, bits):
    """One byte at a time."""
    mask = (1 << bits) - 1 << 16 - bits
    out, start, h, window = [], 0, 0, []
    for i, b in enumerate(body):
        window = (window + [b])[-16:]
        h = sum(int(chunks.GEAR[x]) << (len(window) - 1 - j) for j, x in enumerate(window)) & 0xFFFFFFFF
        char_end = i + 1 == len(body) or body[i + 1] & 0xC0 != 0x80
        if char_end and i + 1 - start >= least and h & mask == 0 and i + 1 - start <= most:
            out.append(i + 1)
            start = i + 1
        elif i + 1 - start >= most + 1:
            p = start + most
            while p < len(body) and body[p] & 0xC0 == 0x80:
                p -= 1
            out.append(p)
            start = p
    if len(body) > start:
        out.append(len(body))
    return out


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghé") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def expected(texts, least, most, bits):
    seen, out = {}, {}
    for d, t in enumerate(texts):
        body, s = (t or "").encode(), 0
        kept = b""
        for e in plain_cuts(body, least, most, bits):
            if body[s:e] not in seen:
                seen[body[s:e]] = d
                kept += body[s:e]
            s = e
        out[d] = kept.decode()
    return out


def test_cuts_equal_the_plain_ones():
    rnd = random.Random(1)
    texts = [prose(rnd, rnd.randrange(0, 90)).encode() for _ in range(60)] + [b"", b"a" * 700, "é".encode() * 300]
    at = np.cumsum([0, *map(len, texts)])
    ends, rows = chunks.cuts(np.frombuffer(b"".join(texts), np.uint8), at, 20, 64, 4)
    for i, t in enumerate(texts):
        assert [int(e - at[i]) for e, r in zip(ends, rows, strict=True) if r == i] == plain_cuts(t, 20, 64, 4)


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    passage = prose(rnd, 60)
    texts = [prose(rnd, rnd.randrange(0, 120)) for _ in range(60)]
    texts += [prose(rnd, 9) + passage + prose(rnd, 7) for _ in range(8)] + [texts[4], texts[5], None, ""]
    got = {r.doc_id: r for r in chunks.dedup_chunks(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(4)).collect()}
    want = expected(texts, 32, 256, 5)
    assert {k: r.kept_text for k, r in got.items()} == want
    for i in range(61, 68):
        assert got[i].n_removed > 100
    assert all(got[i].n_shared > 0 for i in range(60, 68)) and got[68].n_removed == len(texts[4].encode())


def test_nulls_twins_and_empty(spark):
    rows = [(None, "x" * 90, ""), (3, "y" * 90 + "Z", ""), (3, "y" * 90 + "Z", ""), (4, None, None)]
    got = chunks.dedup_chunks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in got) == [(0, 0, "x" * 90), (3, 0, "y" * 90 + "Z"), (3, 91, ""), (4, 0, "")]
    assert chunks.dedup_chunks(spark.createDataFrame([], SCHEMA)).count() == 0
