"""Operator 6: benchmark decontamination by a positional inverted index, in DataFrame functions only.

Items are cut into windows of `size` words (shorter items are one window). The
corpus' counts of the items' words name each window's rarest two; a window
with a word that the corpus lacks can't occur. The index stores the postings
(document, place) of these rarest words alone. A posting less the word's
offset in a window is where that window would begin: the lists of both words
are intersected on it, and what is left is held against the window's words in
the document. So phrase matches are exact, and common words are never joined.
`proximity` gives the windows whose rarest words come close, in any order.

What the items give - their words, windows and rarest words - is broadcast
while it has at most `broadcast_bytes` bytes, which are counted first, else
joined by shuffle. The corpus never is.

Words are runs of 0-9, A-Z, a-z and characters beyond ASCII, with A-Z made
lower case. A null text has none, and an item without words has no window. A
null item_id is left out of the list of items, but its windows count as hits.
Rows that repeat are documents of equal results; repeated items count once.
Empty tables give no rows, or no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: All that isn't part of a word, before A-Z is lowered.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z lowered, and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def split_words(text: Column) -> Column:
    """Words as they stand; a text that begins or ends in a gap has an empty one there."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), GAP, -1)


def count_words(words: Column) -> Column:
    ends = (words[0] == "").cast("int") + (F.element_at(words, -1) == "").cast("int")
    return F.greatest(F.lit(0), F.size(words) - ends).cast("long")


def windows(items: DataFrame, size: int) -> DataFrame:
    """(words, item_ids): the different windows of items(item_id, text)."""
    all_ = F.filter(F.transform(split_words(F.col("text")), lowered), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - size + 1))
    return (
        items.select("item_id", all_.alias("all"))
        .filter("size(all) > 0")
        .select("item_id", F.explode(F.transform(starts, lambda s: F.slice("all", s, size))).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item_id").alias("item_ids"))
        .select(F.xxhash64("words").alias("win"), "words", "item_ids")
    )


def measured(small: DataFrame) -> int:
    """Bytes of the rows, about, as a task holds them: of strings their own and 16, of numbers 8, of a row 32."""
    size = F.lit(32)
    for f in small.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            one = F.octet_length(c) + 16
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            one = F.aggregate(c, F.lit(16), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
        elif isinstance(f.dataType, T.ArrayType):
            one = F.size(c) * 8 + 16
        else:
            one = F.lit(8)
        size = size + F.coalesce(one, F.lit(8))
    return small.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def bounded(small: DataFrame, size: int, limit: int) -> DataFrame:
    return F.broadcast(small) if size <= limit else small


def tokens(docs: DataFrame) -> DataFrame:
    """(k1, k2, pos, word) of docs as common.keyed()."""
    return docs.select("k1", "k2", F.posexplode(split_words(F.col("text"))).alias("pos", "raw")).select("k1", "k2", "pos", lowered(F.col("raw")).alias("word"))


class Index:
    """Windows of the items with their rarest words, and the postings of these."""

    def __init__(self, docs: DataFrame, items: DataFrame, size: int = 10, broadcast_bytes: int = 32 << 20):
        self.docs, self.limit = docs, broadcast_bytes
        wins = common.cut(windows(items, size))
        vocabulary = common.cut(wins.select(F.explode("words").alias("word")).distinct())
        in_words = measured(vocabulary)  # their counts are no more
        self.in_windows = measured(wins)
        found = tokens(docs).join(bounded(vocabulary, in_words, broadcast_bytes), "word").groupBy("word").agg(F.count("*").alias("n"))
        counts = common.cut(found)
        # of each window, the places of its two rarest words; windows with a word that isn't in the corpus go
        places = wins.select("win", F.size("words").alias("k"), F.posexplode("words").alias("off", "word")).join(bounded(counts, in_words, broadcast_bytes), "word")
        ranked = places.groupBy("win", "k").agg(F.sort_array(F.collect_list(F.struct("n", "off", "word"))).alias("by")).filter("size(by) = k")
        self.anchors = common.cut(ranked.select("win", "k", F.posexplode(F.slice("by", 1, 2)).alias("rank", "a")).select("win", "k", "rank", F.col("a.off").alias("off"), F.col("a.word").alias("word")))
        self.in_anchors = measured(self.anchors)
        self.windows = wins.join(bounded(self.anchors.select("win").distinct(), self.in_anchors, broadcast_bytes), "win", "left_semi")
        rare = self.anchors.select("word").distinct()
        self.postings = tokens(docs).join(bounded(rare, self.in_anchors, broadcast_bytes), "word")

    def candidates(self) -> DataFrame:
        """(k1, k2, win, k, start): where the lists of a window's rarest words, less their offsets, agree."""
        at = self.postings.join(bounded(self.anchors, self.in_anchors, self.limit), "word").select("k1", "k2", "win", "k", (F.col("pos") - F.col("off")).alias("start"), "rank")
        lists = at.filter("start >= 0").groupBy("k1", "k2", "win", "k", "start").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("met"))
        return lists.filter("met = 3 or k = 1").drop("met")

    def matches(self) -> DataFrame:
        """(k1, k2, start, k, item_ids) of the windows that occur, word for word."""
        asked = self.candidates().groupBy("k1", "k2").agg(F.collect_set(F.struct("win", "k", "start")).alias("asked"))
        words = split_words(F.col("text"))
        said = F.transform("asked", lambda a: F.struct(a["win"].alias("win"), a["k"].alias("k"), a["start"].alias("start"), F.transform(F.slice(words, a["start"] + 1, a["k"]), lowered).alias("words")))
        # twins (rows of one id and text) ask alike, and one of them is enough
        read = self.docs.join(asked, ["k1", "k2"]).select("k1", "k2", F.explode(said).alias("s")).select("k1", "k2", "s.*")
        same = self.windows.select("win", "words", "item_ids")
        return read.join(bounded(same, self.in_windows, self.limit), ["win", "words"]).select("k1", "k2", "start", "k", "item_ids")

    def proximity(self, within: int) -> DataFrame:
        """(k1, k2, win, first, last): windows whose two rarest words stand at most `within` words apart, in any order; of more such places, the closest of each first one."""
        at = self.postings.join(bounded(self.anchors, self.in_anchors, self.limit), "word").select("k1", "k2", "win", "rank", "pos")
        # places are dealt to stretches of `within` words, so that only near ones meet
        one = at.filter("rank = 0").withColumn("cell", F.explode(F.expr(f"sequence(pos div {within} - 1, pos div {within} + 1)")))
        two = at.filter("rank = 1").select("k1", "k2", "win", F.col("pos").alias("other"), F.expr(f"pos div {within}").alias("cell"))
        near = one.join(two, ["k1", "k2", "win", "cell"]).filter((F.abs(F.col("pos") - F.col("other")) <= within) & (F.col("pos") != F.col("other")))
        best = near.groupBy("k1", "k2", "win", "pos").agg(F.min(F.struct(F.abs(F.col("other") - F.col("pos")).alias("gap"), "other")).alias("m"))
        return best.select("k1", "k2", "win", F.least("pos", "m.other").alias("first"), F.greatest("pos", "m.other").alias("last"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(k1, k2, n_hit, item_ids, spans) of the documents, as common.keyed(), in which a window occurs; spans: (first word, number of words)."""
    found = Index(docs, items, size, broadcast_bytes).matches()
    spans = F.collect_set(F.struct("start", "k"))
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["k"] - 1)))
    return (
        found.groupBy("k1", "k2")
        .agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))
        .select("k1", "k2", F.size(F.array_distinct(places)).cast("long").alias("n_hit"), "item_ids", "spans")
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.keyed(common.table(spark, sf_dir, "documents"))
    hits = contamination(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    ids = F.sort_array(F.transform(F.coalesce("item_ids", F.array().cast("array<bigint>")), lambda i: i.cast("string")))
    return docs.join(hits, ["k1", "k2"], "left").select(
        common.doc_id(),
        count_words(split_words(F.col("text"))).alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in which a window of a benchmark item occurs go."""
    hits = contamination(common.keyed(docs), common.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    keys = {"__k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)), "__k2": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    return docs.withColumns(keys).join(hits.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), ["__k1", "__k2"], "left_anti").select(docs.columns)


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
wins AS (SELECT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM dw),
hits AS (
  SELECT doc_id, item_id, s, k FROM
    (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM starts, sizes WHERE s + k - 1 <= len(w)) JOIN wins USING (k, g)
),
places AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
