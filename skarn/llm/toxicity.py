"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (2**20 places) of its lower-cased words, of their first four and five
letters (a crude stem, so inflected forms share a place), of word pairs and of pairs with one word between them; a
feature is present or not.  Training is on-line with a rate per coordinate and L1, so most places stay at zero and the
model is a short list of (place, weight), whose size has the fixed bound 2**20.  L1 grows with the root of the number
of training rows, as does what a place without a meaning gathers by chance.

Training reads a bounded sample: at most `max_labelled` labelled documents that the fold lets in, those with the
smallest hash of doc_id, a row for each id.  One task streams them in a hashed order, once for each epoch, and holds only its two state
vectors.  Scoring reads every whole text.

Nulls and ties: a null text counts as empty and gets the score of the bias; a null doc_id is never labelled and never
held out.  Several labels of one document count as their largest; null labels do not count.  Without labelled rows all
scores are 0.5.  Repeated rows stay rows and are learnt from once; of texts with one id, that with the smallest hash.  A
very long text is scored whole, in memory by its words.  An empty table gives an empty table.  Extra columns are not read;
`drop_toxic` keeps them, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

BITS = 20
#: Labelled documents that training reads, at most.
MAX_LABELLED = 8_000
EPOCHS = 3
#: Rates, and L1 for one training row.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.1, 1.0
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT, _HALF, _REST = np.uint64(64 - BITS), np.uint64(31), np.uint64(33)
#: Words whose hashes a worker keeps.
_KEPT_WORDS = 100_000


class _Hashes(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        return h


_hashes = _Hashes()


def places(text: str) -> Iterator[np.ndarray]:
    """The feature places of a text, repeats included: words, stems, pairs, pairs around a word."""
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    yield (h * _SALTS[0]) >> _SHIFT
    for n in (4, 5):
        stems = [w[:n] + "-" for w in words if len(w) > n]
        yield (np.fromiter(map(_hashes.__getitem__, stems), np.uint64, len(stems)) * _SALTS[0]) >> _SHIFT
    for gap in (1, 2):
        yield ((h[:-gap] * _SALTS[gap]) ^ ((h[gap:] << _HALF) | (h[gap:] >> _REST))) * _SALTS[0] >> _SHIFT


def features(text: str) -> np.ndarray:
    """Distinct places of a text."""
    return np.unique(np.concatenate(list(places(text)))).astype(np.int32)


class Ftrl:
    """State of FTRL-proximal; place 2**BITS is the bias, which L1 spares."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = _sigmoid(float(w.sum())) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w)
        return at, w[at]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def held_out(doc_id) -> object:
    """True where crc32 of the id as text leaves 1 by 3; such rows are never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of the sparse model; 2**20 + 1 numbers at most."""
    known = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    drawn = known.join(base.drawn(known, "doc_id", max_labelled), "doc_id")  # max_labelled bounds what is broadcast
    l1 = L1 * math.sqrt(drawn.count())
    # a row for each id, that with the smallest hash of its text: a repeated one would bring all its rows to the one task
    rows = docs.select("doc_id", base.text_of(docs).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py()) for t in b.column(2)], pa.list_(pa.int32()))], ["doc_id", "label", "at"])

    seen = base.mapped(rows.select("doc_id", "label", "text"), found, "doc_id long, label int, at array<int>")
    seen = seen.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    seen = seen.withColumn("turn", F.xxhash64("epoch", "doc_id")).repartition(1).sortWithinPartitions("epoch", "turn", "doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Ftrl(l1=l1)
        for b in batches:
            at = b.column(0)
            flat, ends = at.flatten().to_numpy(), np.cumsum(at.value_lengths().to_numpy())
            for label, s, e in zip(b.column(1).to_pylist(), np.concatenate(([0], ends[:-1])), ends):
                state.learn(flat[s:e], label)
        where, w = state.model()
        for i in range(0, len(where), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(where[i : i + (1 << 16)]), pa.array(w[i : i + (1 << 16)])], ["at", "w"])

    model = base.mapped(seen.select("at", "label"), learn, T.StructType([T.StructField("at", T.LongType()), T.StructField("w", T.DoubleType())])).collect()
    return np.array([r[0] for r in model], np.int64), np.array([r[1] for r in model])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """docs with two more columns at the end, the score (double) and the prediction (int) from whole texts.  They are
    named __score and __predicted, with more underscores where docs has columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    mine = docs.select("*", base.text_of(docs).alias(base.unused(docs, "__text")[0]))
    found = base.unused(docs, "__score", "__predicted")
    schema = T.StructType([*docs.schema, *(T.StructField(c, k) for c, k in zip(found, (T.DoubleType(), T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = w
        bias, known = dense[-1], dense != 0

        def one(text: str) -> float:
            hits = [p[known[p]] for p in places(text)]
            return _sigmoid(float(bias + dense[np.unique(np.concatenate(hits))].sum()))

        for b in batches:
            s = np.array([one(t.as_py()) for t in b.column(len(names))], float)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, *found])

    return base.mapped(mine, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    slim = docs.select("doc_id", base.text_of(docs).alias("text"))
    out = score(slim, train(docs, labels, max_labelled))
    score_, predicted = out.columns[-2:]
    return out.select("doc_id", held_out(out["doc_id"]).alias("held_out"), F.col(score_).alias("score"), F.col(predicted).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold; all columns of docs."""
    out = score(docs, train(docs, labels), threshold)
    return out.where(F.col(out.columns[-1]) == 0).select(docs.columns)
