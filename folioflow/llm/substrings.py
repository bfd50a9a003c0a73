"""Operator 1: removal of long repeated byte strings with a suffix array.

A byte goes when it lies in a string of `length` bytes that starts anywhere
else too, in the same text or another one. The suffix array is that of Bucket
Pointer Refinement, cut at depth `length` and dealt over the cluster:

1. Every start of a `length`-byte string gets the bucket of the least q-gram
   hash inside the string, which equal strings share wherever they stand.
   Neighbouring starts of one bucket form a segment, so one row stands for
   about a hundred suffixes. Counts by bucket, combined before the shuffle,
   drop the buckets with one segment; a bucket whose segments are all equal
   is settled: all its starts repeat.
2. Of the buckets left, each different segment travels once, with its bytes,
   and the buckets of a task are refined together (`refine`): suffixes start
   in q-gram buckets and are sorted by the bucket of a later offset, each new
   bucket array being the next round's pointers, until the depth is reached.
3. A bucket whose segments hold more than `bucket_bytes` (a passage shared by
   very many texts) isn't sent to one task: its segments are cut again by
   longer grams, up to `length` itself, where a bucket is one string and a
   count settles it.

What is removed is at least `length` bytes. Shorter passages that stand elsewhere
too, of `near` bytes at least (some forty words), are told but not removed: they
are sought first, and strings of `length` bytes then only inside of them.

Null texts count as empty. Rows may repeat: two rows with one id and text are
two documents, so each repeats the other. An empty table gives no rows.
Hashes have 64 bits; equal hashes count as equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bytesops import PIECE_BYTES, Rolling, merged, pieces, sliding, utf8

SEGMENT = "k1 long, k2 long, bucket long, whole long, start int, stop int, again boolean"
SEGMENT_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("bucket", pa.int64()), ("whole", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("again", pa.bool_())])


def segments(data: np.ndarray, first: np.ndarray, last: np.ndarray, q: int, length: int) -> tuple[np.ndarray, ...]:
    """(bucket, whole, start, stop, again, which range) of the starts in [first, last) ranges of the data.

    first and last bound the starts of strings; each range lies in one text.
    whole is a hash of the bytes from the segment's first start to the end of
    its last string. again: the segment's own strings may repeat inside it.
    """
    rolling = Rolling(data)
    w = length - q + 1
    grams = rolling.grams(q)
    least = sliding(grams, w)
    n = len(least)
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    inside = np.cumsum(inside[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = least[1:] != least[:-1]
    new[first[first < n]] = True
    start = np.flatnonzero(new & inside)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, bool), none
    which = np.searchsorted(first, start, side="right") - 1
    stop = np.minimum(np.append(start[1:], n), last[which])
    bucket = least[start]
    if w == 1:  # each start has a bucket to itself, or shares it with an equal neighbour
        again = stop - start > 1
    else:  # more than one place in the segment's reach holds its least gram
        most = sliding(np.concatenate([np.full(w - 1, least[0]), least, np.full(w - 1, least[-1])]), w, np.maximum)
        place = np.flatnonzero(grams == most[: len(grams)])
        values, rank = np.unique(grams[place], return_inverse=True)
        code = np.sort(rank.astype(np.int64) << 32 | place)
        own = np.searchsorted(values, bucket).astype(np.int64) << 32
        again = np.searchsorted(code, own | (stop - 1 + w - 1), side="right") - np.searchsorted(code, own | start) > 1
    return bucket, rolling.spans(start, stop - 1 + length), start, stop, again, which


def cut_texts(batches: Iterator[pa.RecordBatch], q: int, length: int) -> Iterator[pa.RecordBatch]:
    """Segments of whole texts, or of the `ranges` of starts where the column is there."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
        ranges = batch.column("ranges").to_pylist() if "ranges" in batch.schema.names else None
        for a, b in pieces(at):
            first, last, row = [], [], []
            for i in range(a, b):
                for x, y in [(0, at[i + 1] - at[i] - length + 1)] if ranges is None else [(r["start"], r["stop"]) for r in ranges[i]]:
                    # a very long text in parts: a part's last strings reach into the next one's bytes
                    for s in range(int(x), int(y), PIECE_BYTES):
                        first.append(at[i] + s)
                        last.append(at[i] + min(s + PIECE_BYTES, y))
                        row.append(i)
            if not first:
                continue
            first, last, row = np.array(first), np.array(last), np.array(row)
            order = np.argsort(first, kind="stable")
            first, last, row = first[order], last[order], row[order]
            for x, y in pieces(np.append(first, last[-1])):  # parts of one long text go one by one
                base, end = first[x], last[y - 1] + length - 1
                bucket, whole, start, stop, again, which = segments(data[base:end], first[x:y] - base, last[x:y] - base, q, length)
                if len(bucket):
                    of = row[x:y][which]
                    shift = base - at[of]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[of]), pa.array(k2[of]), pa.array(bucket.view(np.int64)), pa.array(whole.view(np.int64)), pa.array((start + shift).astype(np.int32)), pa.array((stop + shift).astype(np.int32)), pa.array(again)], schema=SEGMENT_ARROW
                    )


def refine(data: np.ndarray, begin: np.ndarray, length: int, q: int = 100) -> np.ndarray:
    """Bucket identifier at depth `length` of every position of the data that starts such a string, else -1.

    begin: where each string of bytes starts in the data; no suffix leaves its
    own. Buckets begin as those of the q-gram at each position. A round sorts
    the suffixes of buckets that hold more than one by (own bucket, bucket of
    the suffix `step` further on); identifiers of a round are the pointers of
    the next, so the depth doubles, and ends at exactly `length`.
    """
    n = len(data)
    end = np.append(begin[1:], n)
    room = np.repeat(end, end - begin) - np.arange(n)  # bytes up to the end of the own string
    bucket = np.full(n, -1, np.int64)
    q = min(q, length)
    grams = Rolling(data).grams(q)
    at = np.flatnonzero(room[: len(grams)] >= q)
    if not len(at):
        return bucket
    bucket[at] = np.unique(grams[at], return_inverse=True)[1]
    depth = q
    while depth < length:
        step = min(depth, length - depth)
        counts = np.bincount(bucket[at])
        active = at[(room[at] >= depth + step) & (counts[bucket[at]] > 1)]
        keep = at[(room[at] >= depth + step) & (counts[bucket[at]] == 1)]
        pair = bucket[active] * (len(counts) + 1) + bucket[active + step]
        ids = np.unique(pair, return_inverse=True)[1] if len(pair) else pair
        fresh = np.full(n, -1, np.int64)
        fresh[active] = ids
        fresh[keep] = (ids.max() + 1 if len(ids) else 0) + np.arange(len(keep))
        at = np.flatnonzero(fresh >= 0)
        bucket, depth = fresh, depth + step
    return bucket


def settle(batches: Iterator[pa.RecordBatch], length: int, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated starts in each segment; the rows of a bucket come one after the other."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        sizes = np.array([len(r[3]) for r in rows])
        begin = np.cumsum(sizes) - sizes
        bucket = refine(data, begin, length)
        at = np.flatnonzero(bucket >= 0)
        twice = np.zeros(len(data) + 1, bool)
        twice[at] = np.bincount(bucket[at])[bucket[at]] > 1
        out: list[tuple] = []
        for (key, whole, many, payload), b in zip(rows, begin, strict=True):
            n = len(payload) - length + 1
            mark = np.ones(n, bool) if many else twice[b : b + n]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
            out += [(key, whole, int(s), int(e)) for s, e in zip(edge[::2], edge[1::2], strict=True)]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["bucket", "whole", "x", "y"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "whole", "many", "payload")), strict=True):
            if size >= batch_bytes and row[0] != held[-1][0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield solve(held)


def slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments asked for."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        out: list[tuple] = []
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            out += [(r["bucket"], r["whole"], r["many"], data[at[i] + r["start"] : at[i] + r["stop"] - 1 + length].tobytes()) for r in wanted]
            if len(out) > 4000:
                yield _sliced(out)
                out = []
        if out:
            yield _sliced(out)


def _sliced(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "whole", "many", "payload"])


def inner(batches: Iterator[pa.RecordBatch], more: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, ranges): of ranges of starts, those whose strings may be `more` bytes longer."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        out = []
        for k1, k2, ranges in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ranges")), strict=True):
            start, stop = merged(np.array([r["start"] for r in ranges], np.int64), np.array([r["stop"] for r in ranges], np.int64))
            if left := [{"start": int(s), "stop": int(e) - more} for s, e in zip(start, stop, strict=True) if e - more > s]:
                out.append((k1, k2, left))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), kind), strict=True)], names=["k1", "k2", "ranges"])


def repeated_starts(docs: DataFrame, length: int = 400, q: int = 128, bucket_bytes: int = 1 << 20, within: DataFrame | None = None) -> DataFrame:
    """(k1, k2, start, stop): ranges of starts whose strings of `length` bytes stand elsewhere too. docs as common.keyed(); within: (k1, k2, ranges) outside of which no such start can be."""
    long_enough = docs.filter(F.octet_length("text") >= length)
    # the reach in which a least gram is sought shrinks to a quarter each time, and at last to the string itself
    levels = sorted({length - (length - min(q, length)) // part for part in (1, 4, 16)} | {length})
    found: list[DataFrame] = []
    source = long_enough if within is None else long_enough.join(within, ["k1", "k2"])
    for level in levels:
        rows = source.mapInArrow(lambda it, level=level: cut_texts(it, level, length), SEGMENT)
        buckets = (
            rows.groupBy("bucket")
            .agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start") + length).alias("size"), F.min("whole").alias("low"), F.max("whole").alias("high"), F.max("again").alias("loops"))
            .filter("n > 1 or loops")
            .select("bucket", F.when(F.lit(level == length) | (F.col("n") > 1) & (F.col("low") == F.col("high")), "same").when(F.col("size") > bucket_bytes, "large").otherwise("mixed").alias("state"))
        )
        marked = common.released(common.split_join(rows.drop("again"), buckets, ["bucket"]))
        found.append(marked.filter("state = 'same'").select("k1", "k2", "start", "stop"))
        mixed, large = marked.filter("state = 'mixed'"), marked.filter("state = 'large'")
        more = level < length and not large.isEmpty()
        if more:  # copies of a segment travel once: what counts is the size of the different ones
            size = F.max(F.col("stop") - F.col("start") + length)
            small = large.groupBy("bucket", "whole").agg(size.alias("size")).groupBy("bucket").agg(F.sum("size").alias("size")).filter(F.col("size") <= bucket_bytes).select("bucket")
            mixed = mixed.unionByName(large.join(small, "bucket", "left_semi"))
            large = large.join(small, "bucket", "left_anti")
        # a mixed bucket's segments: each different one once, with its bytes
        one = (
            mixed.groupBy("bucket", "whole")
            .agg(F.min(F.struct("k1", "k2", "start", "stop")).alias("at"), (F.count("*") > 1).alias("many"))
            .select("at.k1", "at.k2", F.struct("bucket", "whole", "many", "at.start", "at.stop").alias("w"))
            .groupBy("k1", "k2")
            .agg(F.collect_list("w").alias("wanted"))
        )
        bytes_of = docs.join(one, ["k1", "k2"]).select("text", "wanted").mapInArrow(lambda it: slices(it, length), "bucket long, whole long, many boolean, payload binary")
        runs = bytes_of.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: settle(it, length, 1 << 21), "bucket long, whole long, x int, y int")
        found.append(mixed.join(runs, ["bucket", "whole"]).select("k1", "k2", (F.col("start") + F.col("x")).alias("start"), (F.col("start") + F.col("y")).alias("stop")))
        if not more or large.isEmpty():
            break
        # the same document again and again gives the same ranges: one row of them, whatever the number of copies
        ranges = large.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("ranges"))
        source = long_enough.join(ranges, ["k1", "k2"])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, spans array<struct<start:long,stop:long>>"


def apply_spans(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        ids, near = batch.column("doc_id"), batch.column("near").to_pylist()
        removed, spans, digests, texts, runs, repeated = [], [], [], [], [], []
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            body = data[at[i] : at[i + 1]]
            if ranges:
                start, stop = merged(np.array([r["start"] for r in ranges], np.int64), np.array([r["stop"] for r in ranges], np.int64))
                edge = np.concatenate([[0], np.column_stack([start, stop]).ravel(), [len(body)]])
                kept = b"".join(body[edge[j] : edge[j + 1]].tobytes() for j in range(0, len(edge), 2))
                removed.append(int((stop - start).sum()))
                runs.append([{"start": int(s), "stop": int(e)} for s, e in zip(start, stop, strict=True)])
            else:
                kept = body.tobytes()
                removed.append(0)
                runs.append([])
            spans.append(len(runs[-1]))
            start, stop = merged(*(np.array([r[k] for r in near[i]], np.int64) for k in ("start", "stop"))) if near[i] else (np.zeros(0, np.int64),) * 2
            repeated.append(int((stop - start).sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept if keep_text else b"")
        cols = [ids, pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(repeated, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "spans"]
        if keep_text:
            cols.append(pa.array(texts, pa.binary()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def remove_repeats(docs: DataFrame, length: int = 400, q: int = 128, bucket_bytes: int = 1 << 20, keep_text: bool = True, near: int = 256) -> DataFrame:
    """Per row of docs(doc_id, text): sizes, the removed spans in bytes, a digest of what is left, n_repeated (bytes of passages of `near` bytes that stand elsewhere too) and, on demand, what is left itself (bytes)."""
    keys, near = common.keyed(docs), min(near, length)

    def ranges(starts: DataFrame, stop: Column, name: str) -> DataFrame:
        return starts.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", stop.alias("stop"))).alias(name))

    first = common.released(ranges(repeated_starts(keys, near, min(q, near // 2), bucket_bytes), F.col("stop"), "ranges"))
    within = first.mapInArrow(lambda it: inner(it, length - near), "k1 long, k2 long, ranges array<struct<start:int,stop:int>>")
    gone = ranges(repeated_starts(keys, length, q, bucket_bytes, within), F.col("stop") - 1 + length, "ranges")
    told = first.select("k1", "k2", F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), (r["stop"] - 1 + near).alias("stop"))).alias("near"))
    full = keys.join(told, ["k1", "k2"], "left").join(gone, ["k1", "k2"], "left").select(common.doc_id(), "text", "ranges", "near")
    return full.mapInArrow(lambda it: apply_spans(it, keep_text), RESULT + (", kept binary" if keep_text else ""))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), keep_text=False).drop("spans")
