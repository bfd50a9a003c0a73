"""Operator 2: language identification.

Averaged hashed subword embeddings under a linear softmax, trained by
stochastic gradient descent in numpy: the subwords are the 3- and 4-byte grams
of lower-cased words with their edges, hashed to `buckets` rows; a text's
vector is the mean of its grams' rows. As mean and softmax layer are both
linear, prediction adds one learned row of scores a gram, over the whole text.

The model is fitted on the driver on a bounded sample of labelled rows: at
most `per_lang` rows a language and `max_rows` in all, texts of at most
`max_bytes`, the first ones by a hash of the id. A fifth of the sample is held
back; it sets the temperature of the scores and two thresholds under which
texts are rejected, one of the score and one of the share of a text's grams
that fitting has met (a score is one over the number of languages at least,
whatever the text). What other languages look like is learned from models that
are fitted without one of the languages: a threshold lies halfway between the
median of the texts and snippets of the languages left out and what all but
`reject_share` of the held-back ones that are named rightly exceed, and never
over the latter; texts may have `unmet_times` as many unknown grams as these.
Held-back texts too few to show that share widen both, by half the logarithm of what lacks.

A text that is null or has no letter is `und` with score 0, and rejected.
Rows with a null id or lang are predicted, not learned from (a null id counts
as the text ''). Without labelled rows everything is `und`. Repeated rows get
equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bytesops import pieces, utf8

UNDETERMINED = "und"
SPACE = 32
LONG_PART = 4 << 20  # bytes
#: What isn't an ASCII letter or part of a longer character separates words.
WORDY = np.array([b if b >= 128 or 97 <= b <= 122 else SPACE for b in range(256)], np.uint32)


#: Slots that tell whether fitting has met a gram; the first bits of a slot are the bucket.
SLOTS = 1 << 20


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of the 3- and 4-gram from each byte on; SLOTS where a word's edge lies inside, or past the end."""
    n = len(data)
    b = np.full(n + 3, SPACE, np.uint32)
    b[:n] = WORDY[data]
    three = b[:n] | b[1 : n + 1] << np.uint32(8) | b[2 : n + 2] << np.uint32(16)
    four = three | b[3 : n + 3] << np.uint32(24)
    shift = np.uint32(32 - SLOTS.bit_length() + 1)
    one = (b[1 : n + 1] == SPACE)
    h3 = ((three * np.uint32(2654435761)) >> shift).astype(np.int32)
    h4 = (((four ^ (four >> np.uint32(15))) * np.uint32(2246822519)) >> shift).astype(np.int32)
    h3[one] = SLOTS
    h4[one | (b[2 : n + 2] == SPACE)] = SLOTS
    return h3, h4


@dataclass
class Model:
    """scores: a row of one score a language for each bucket, and a last row of zeros; met: 1 for each slot that fitting has met."""

    langs: list[str]
    scores: np.ndarray
    met: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    known_below: float = 0.0
    buckets: int = field(default=0)

    def means(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The mean row of scores of each of the texts data[at[i]:at[i+1]], and the share of its grams that fitting has met."""
        width = len(self.langs) + 1
        out = np.zeros((len(at) - 1, width))
        for a, b in pieces(at):
            total, n = np.zeros((b - a, width)), np.zeros(b - a, np.int64)
            # a very long text goes in parts, each with the three bytes that its last grams reach into
            for s in range(int(at[a]), max(int(at[b]), int(at[a]) + 1), LONG_PART) if b == a + 1 else [int(at[a])]:
                stop = min(s + LONG_PART, int(at[b])) if b == a + 1 else int(at[b])
                self._add(data[s : min(stop + 3, int(at[b]))], stop - s, np.array([0, stop - s]) if b == a + 1 else at[a : b + 1] - s, stop == at[b], total, n)
            out[a:b] = total / np.maximum(n, 1)[:, None]
        return out

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One row for each of the texts data[at[i]:at[i+1]]."""
        return self.means(data, at)[:, : len(self.langs)] + self.bias

    def _add(self, part: np.ndarray, size: int, local: np.ndarray, ends: bool, total: np.ndarray, n: np.ndarray) -> None:
        """Adds the scores and the number of the grams that begin in the texts part[local[i]:local[i+1]]."""
        h3, h4 = (h[:size] for h in grams(part))
        if ends:  # no gram may reach into the next text
            for k in (1, 2, 3):
                edge = local[1:] - k
                edge = edge[edge >= local[:-1]]
                if k < 3:
                    h3[edge] = SLOTS
                h4[edge] = SLOTS
        full = np.flatnonzero(np.diff(local) > 0)
        if not len(full):
            return
        starts = local[:-1][full]
        n[full] += np.add.reduceat((h3 < SLOTS).astype(np.int32) + (h4 < SLOTS), starts)
        total[full, -1] += np.add.reduceat(self.met[h3] + self.met[h4], starts, dtype=np.int64)
        shift = (SLOTS // self.buckets).bit_length() - 1
        b3, b4 = h3 >> shift, h4 >> shift
        for j in range(len(self.langs)):
            column = self.scores[:, j]
            total[full, j] += np.add.reduceat(column[b3] + column[b4], starts, dtype=np.float64)

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.judge(data, at)[:2]

    def judge(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and share of known grams of each text."""
        means = self.means(data, at)
        z = (means[:, : len(self.langs)] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1), means[:, len(self.langs)]


def _bags(texts: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets and their shares, and the slots, of each text."""
    out = []
    for t in texts:
        h = np.concatenate(grams(np.frombuffer(t.encode(), np.uint8)))
        slots, count = np.unique(h[h < SLOTS], return_counts=True)
        own, at = np.unique(slots // (SLOTS // buckets), return_inverse=True)
        out.append((own, np.bincount(at, count, len(own)) / max(1, count.sum()), slots))
    return out


def _snippets(text: str, rng: np.random.Generator) -> list[str]:
    """Two stretches of a few words each, so that short texts are learned and calibrated too."""
    words = text.split()
    out = []
    for n in (4, 15):
        if len(words) > n:
            i = int(rng.integers(0, len(words) - n))
            out.append(" ".join(words[i : i + n]))
    return out


def _fit(bags: list[tuple], langs: list[str], buckets: int, dim: int, epochs: int, rate: float, seed: int) -> Model:
    """Embeddings and softmax for bags (buckets, shares, slots, language) by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    weights, bias = np.zeros((dim, len(langs))), np.zeros(len(langs))
    total, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            idx, share, _, y = bags[k]
            now = rate * (1 - step / total)
            hidden = share @ vectors[idx]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weights @ p
            weights -= now * np.outer(hidden, p)
            bias -= 0.1 * now * p
            # rows are rare in a text, so their steps aren't scaled down by its length but by its root
            vectors[idx] -= now * len(idx) ** 0.5 * np.outer(share, back)
            step += 1
    scores, met = np.zeros((buckets + 1, len(langs)), np.float32), np.zeros(SLOTS + 1, np.uint8)
    scores[:buckets] = vectors @ weights
    for _, _, slots, _ in bags:
        met[slots] = 1
    return Model(langs, scores, met, bias, buckets=buckets)


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _temper(model: Model, texts: list[str], y: np.ndarray) -> None:
    """Sets the temperature under which the texts' languages y are likeliest."""
    z = model.logits(*_laid(texts))

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    model.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))


def train(rows: list[tuple[str, str]], buckets: int = 1 << 15, dim: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 7, reject_share: float = 0.001, unmet_times: float = 2.0, left_out: int = 4, left_out_epochs: int = 2) -> Model | None:
    """Fits (text, lang) rows, in the order given; None without rows. left_out: languages that a model is fitted without, at most, to calibrate rejection."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    fit, held = [], []
    for i, (text, lang) in enumerate(rows):
        low = text.lower()
        (held if i % 5 == 4 else fit).extend((t, langs.index(lang)) for t in [low, *_snippets(low, rng)])
    bags = [(*bag, y) for bag, (_, y) in zip(_bags([t for t, _ in fit], buckets), fit, strict=True) if len(bag[0])]
    model = _fit(bags, langs, buckets, dim, epochs, rate, seed)
    if not held:
        return model
    texts, y = [t for t, _ in held], np.array([y for _, y in held])
    _temper(model, texts, y)
    named, score, known = model.judge(*_laid(texts))
    if not (named == y).any():
        return model
    model.reject_below, model.known_below = (float(np.quantile(x[named == y], reject_share)) for x in (score, known))
    outside: list[tuple[np.ndarray, np.ndarray]] = []
    for k in sorted(rng.permutation(len(langs))[:left_out].tolist()) if len(langs) > 1 else []:
        others = [lang for i, lang in enumerate(langs) if i != k]
        other = _fit([(*bag, i - (i > k)) for *bag, i in bags if i != k], others, buckets, dim, left_out_epochs, rate, seed)
        inside = [(t, i - (i > k)) for t, i in held if i != k]
        if inside and (out := [t for t, i in held if i == k]):
            _temper(other, [t for t, _ in inside], np.array([i for _, i in inside]))
            outside.append(other.judge(*_laid(out))[1:])
    if outside:
        score, known = (np.concatenate(x) for x in zip(*outside, strict=True))
        model.reject_below = min(model.reject_below, (model.reject_below + float(np.median(score))) / 2)
        model.known_below = min(model.known_below, (model.known_below + float(np.median(known))) / 2)
    # too few texts to show the share have their least value too high
    few = max(1.0, float(-np.log((named == y).sum() * reject_share)) / 2)
    model.reject_below = max(0.0, 1 - few * (1 - model.reject_below))
    model.known_below = max(0.0, 1 - few * unmet_times * (1 - model.known_below))
    return model


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, per_lang: int = 300, max_rows: int = 2000, max_bytes: int = 1 << 16, **settings) -> Model | None:
    """The model of the labelled rows of docs(doc_id, text, lang) that aren't held out."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "k2"))
    rows = (
        docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= max_bytes))
        .select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")).alias("h"), F.xxhash64("text").alias("k2"))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= per_lang)
        .orderBy("rank", "lang")
        .limit(max_rows)
    )
    picked = rows.select(F.col("doc_id").alias("pick"), "k2", "rank", "lang")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("own")).join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("pick")) & (F.col("own") == F.col("k2")))
    # by rank first: neighbours in the order differ in language
    sample = sorted({(r["rank"], r["lang"], r["text"]) for r in texts.select("rank", "lang", "text").collect()})
    return train([(text, lang) for _, lang, text in sample], **settings)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and rejected; columns of these names give way.

    Only the lower-cased text goes to Python and only the three results come
    back, so a batch takes its text's size once there and once on its way.
    """
    kept = docs.drop(*(f.name for f in FIELDS))
    if model is None:
        return kept.select("*", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers: a fixed size

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m: Model = shared.value
        names = np.array([*m.langs, UNDETERMINED], object)
        for low in batches:
            named, score, known = m.judge(*utf8(low))
            letters = low.is_valid().to_numpy(zero_copy_only=False)
            named, score = np.where(letters, named, len(m.langs)), np.where(letters, score, 0.0)
            columns = [pa.array(names[named].tolist(), pa.string()), pa.array(score), pa.array((score < m.reject_below) | (known < m.known_below) | ~letters)]
            yield pa.StructArray.from_arrays(columns, names=[f.name for f in FIELDS])

    # a text without letters goes as null; as one that isn't deterministic, a filter on the outcome doesn't repeat the work
    judged = F.arrow_udf(run, T.StructType(FIELDS)).asNondeterministic()(F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")))
    return kept.withColumn("__judged", judged).select(*(F.col(f"`{c}`") for c in kept.columns), *(F.col(f"__judged.{f.name}").alias(f.name) for f in FIELDS))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go; columns stay as they are."""
    held, back = common.aside(docs, [f.name for f in FIELDS])
    return identify(held, fit(docs)).filter(~F.col("rejected")).select(back)
