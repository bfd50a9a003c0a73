"""Operator 5: substring dedup by content-defined chunks.

Texts are cut where a gear rolling hash of the last 16 bytes has its top bits
clear, so a cut depends on its neighbourhood alone and an insertion moves no
cut beyond it. Chunks are at least `least` bytes (but for a text's last one)
and at most `most`, and never split a UTF-8 character. The first chunk of a
digest, by (doc_id, text hash, position), stays; later ones go.

Counts by digest are combined before the shuffle, and the join back to the
chunks splits at hot digests, so no task holds all rows of one.

Null texts count as empty; empty texts have no chunk. Of rows that repeat id
and text, one counts as the first and the others as its copies, which lose all.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bytesops import merged, mix, pieces, utf8

#: One random 32-bit value a byte, drawn from the 64-bit finaliser.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last 16 bytes at each position, by doubling: 1, 2, 4, 8, 16 bytes."""
    h = GEAR[data]
    for reach in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[reach:] = h[:-reach] << np.uint32(reach)
        h = h + older
    return h


def cuts(data: np.ndarray, at: np.ndarray, least: int, most: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(end of each chunk, row) of the texts data[at[i]:at[i+1]]."""
    # the low 16 bits hold all 16 bytes' shares; of these, the top ones are best mixed
    clear = (gear(data) & np.uint32((1 << bits) - 1 << 16 - bits)) == 0
    whole = np.ones(len(data) + 1, bool)  # a cut after position i needs a character's start at i + 1
    whole[: len(data)] = (data & 0xC0) != 0x80
    places = np.flatnonzero(clear & whole[1:]) + 1
    ends: list[int] = []
    rows: list[int] = []
    lo = np.searchsorted(places, at[:-1], side="right")
    hi = np.searchsorted(places, at[1:], side="left")
    places = places.tolist()
    for i in range(len(at) - 1):
        start, stop = int(at[i]), int(at[i + 1])
        if start == stop:
            continue
        n = len(ends)
        for p in places[lo[i] : hi[i]]:
            while p - start > most:
                start += most
                while not whole[start]:
                    start -= 1
                ends.append(start)
            if p - start >= least:
                ends.append(p)
                start = p
        while stop - start > most:
            start += most
            while not whole[start]:
                start -= 1
            ends.append(start)
        ends.append(stop)
        rows += [i] * (len(ends) - n)
    return np.array(ends, np.int64), np.array(rows, np.int64)


CHUNK = "k1 long, k2 long, start int, stop int, d1 long, d2 long"


def chunk_texts(batches: Iterator[pa.RecordBatch], least: int, most: int, bits: int, digest_only: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
        for a, b in pieces(at):
            part, base = data[at[a] : at[b]], at[a]
            ends, rows = cuts(part, at[a : b + 1] - base, least, most, bits)
            if not len(ends):
                continue
            starts = np.append(0, ends[:-1])
            raw, digest = part.tobytes(), hashlib.blake2b
            sums = np.frombuffer(b"".join([digest(raw[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
            d1, d2 = pa.array(np.ascontiguousarray(sums[:, 0])), pa.array(np.ascontiguousarray(sums[:, 1]))
            if digest_only:
                yield pa.RecordBatch.from_arrays([d1], names=["d1"])
                continue
            of = rows + a
            shift = at[of] - base
            yield pa.RecordBatch.from_arrays([pa.array(k1[of]), pa.array(k2[of]), pa.array((starts - shift).astype(np.int32)), pa.array((ends - shift).astype(np.int32)), d1, d2], names=["k1", "k2", "start", "stop", "d1", "d2"])


RESULT = "doc_id long, n_bytes long, n_shared long, n_removed long, n_dup_chunks long, kept_text string"


def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        shared, removed, chunks, kept = [], [], [], []
        for i, (ranges, again) in enumerate(zip(batch.column("ranges").to_pylist(), batch.column("again").to_pylist(), strict=True)):
            body = data[at[i] : at[i + 1]]
            gone = [r for r in ranges or () if again or not r["first"]]
            shared.append(sum(r["stop"] - r["start"] for r in ranges or ()))
            removed.append(sum(r["stop"] - r["start"] for r in gone))
            chunks.append(len(gone))
            if gone:
                start, stop = merged(np.array([r["start"] for r in gone], np.int64), np.array([r["stop"] for r in gone], np.int64))
                edge = np.concatenate([[0], np.column_stack([start, stop]).ravel(), [len(body)]])
                kept.append(b"".join(body[edge[j] : edge[j + 1]].tobytes() for j in range(0, len(edge), 2)).decode())
            else:
                kept.append(body.tobytes().decode())
        longs = [pa.array(x, pa.int64()) for x in (shared, removed, chunks)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), *longs, pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_shared", "n_removed", "n_dup_chunks", "kept_text"])


def dedup_chunks(docs: DataFrame, least: int = 32, most: int = 256, bits: int = 5) -> DataFrame:
    """Per row of docs(doc_id, text): bytes, bytes in chunks that occur elsewhere too, bytes and chunks removed, and the text that is left."""
    keys = common.keyed(docs)

    def chunked(digest_only: bool) -> DataFrame:
        return keys.mapInArrow(lambda it: chunk_texts(it, least, most, bits, digest_only), "d1 long" if digest_only else CHUNK)

    # half a digest is enough to drop the chunks that occur once; the rest is held against the whole digest
    often = chunked(True).groupBy("d1").agg(F.count("*").alias("n")).filter("n > 1").select("d1")
    some = common.cut(common.split_join(chunked(False), often, ["d1"], "left_semi"))
    place = F.struct("k1", "k2", "start")
    first = some.groupBy("d1", "d2").agg(F.min(place).alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    ranges = (
        common.split_join(some, first, ["d1", "d2"])
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("start", "stop", (place == F.col("keeper")).alias("first"))).alias("ranges"))
    )
    full = keys.join(ranges, ["k1", "k2"], "left").withColumn("again", F.lit(False))
    twins = common.cut(keys.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if not twins.isEmpty():  # rows that are alike in all that counts: any of them may be the first
        place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
        alike = full.join(twins, ["k1", "k2"], "left_semi").withColumn("again", place > 1)
        full = full.join(twins, ["k1", "k2"], "left_anti").unionByName(alike)
    return full.select(common.doc_id(), "text", "ranges", "again").mapInArrow(rebuild, RESULT)


def op5_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_chunks(common.table(spark, sf_dir, "documents"))
