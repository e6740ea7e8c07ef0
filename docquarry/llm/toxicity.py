"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, pairs of neighbours and pairs with one word between,
hashed into 2**bits places. Training follows the per-coordinate FTRL-proximal rule: a
coordinate's rate falls with its own squared gradients, and L1 leaves most weights at exactly
zero, so what is broadcast is a short list of (place, weight).

The classifier is fitted on at most max_rows labelled documents of each class, those with the
least hashes of their ids: a documented bound, so that training doesn't grow with the corpus.
Every document is scored, over its whole text.

Defined cases: a NULL text scores as an empty one (the bias alone); very long texts are scored
whole; rows with a NULL id are scored, and can't be labelled; labels that are NULL are left out; of
several labels for a document the largest counts, and of several texts with one id the least is
learnt from; a score that is equal to the threshold isn't toxic; without labels of both classes all
weights are zero, every score is 0.5 and nothing is rejected; repeated rows get the same score; an
empty table gives no rows; columns are picked by exact name, and drop_toxic carries all others, of
any name, along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Memo, cut, fields, mix64, release, rows_back, with_row

BITS = 20
THRESHOLD = 0.5
MAX_ROWS = 4000

_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "…“”‘’«»–—¡¿"


_hashes = Memo(lambda word: xxhash.xxh64_intdigest(word.strip(_PUNCTUATION).lower()))


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The sorted distinct places of a text's words, pairs and skip-pairs."""
    _hashes.ready()
    words = text.split() if text else []
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        turned = h * np.uint64(0x9E3779B97F4A7C15)
        pairs = mix64(h[:-1] ^ (turned[1:] + np.uint64(1)))
        skips = mix64(h[:-2] ^ (turned[2:] + np.uint64(2)))
    return np.concatenate([h, pairs, skips]) >> np.uint64(64 - bits)


class Ftrl:
    """FTRL-proximal over presence features, one document at a time; a bias that isn't penalised."""

    def __init__(self, bits: int = BITS, alpha: float = 0.15, beta: float = 1.0, l1: float = 2.0, l2: float = 0.1):
        self.z, self.n = np.zeros(2**bits), np.zeros(2**bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.zb = self.nb = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return -self.zb / ((self.beta + math.sqrt(self.nb)) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()) + b)))) - label
        root = np.sqrt(self.n[at])
        after = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (after - root) / self.alpha * w
        self.n[at] += g * g
        self.zb += g - (math.sqrt(self.nb + g * g) - math.sqrt(self.nb)) / self.alpha * b
        self.nb += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(np.abs(self.z) > self.l1)
        return at, self.weights(at), self.bias()


def fit(rows: list[tuple[str | None, int]], bits: int = BITS, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero places, their weights and the bias; all empty or zero without both classes."""
    if len({label for _, label in rows}) < 2:
        return np.empty(0, np.int64), np.empty(0), 0.0
    seen = [(np.unique(features(text, bits)).astype(np.int64), label) for text, label in rows]
    model = Ftrl(bits)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(seen)):
            model.learn(*seen[i])
    return model.sparse()


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label) of at most max_rows documents of each class, by the hash of the id."""
    marked = fields(labels, __dq_id=id_col, __dq_label=label_col).withColumn("__dq_label", F.col("__dq_label").cast("int")).where("__dq_id IS NOT NULL AND __dq_label IS NOT NULL").groupBy("__dq_id").agg(F.max("__dq_label").alias("__dq_label"))
    picked = None
    for label in (0, 1):
        some = marked.where(F.col("__dq_label") == label).orderBy(F.xxhash64("__dq_id"), "__dq_id").limit(max_rows)
        picked = some if picked is None else picked.unionByName(some)
    # At most 2 * max_rows rows, so this side may always be broadcast.
    texts = fields(docs, __dq_id=id_col, __dq_text=text_col).withColumn("__dq_text", F.col("__dq_text").cast("string"))
    # Of several texts with one id the least, so that there are never more rows than were picked.
    return texts.join(F.broadcast(picked), "__dq_id").groupBy("__dq_id", "__dq_label").agg(F.min("__dq_text").alias("__dq_text"))


def fit_sample(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on the bounded sample, in one task; only the sparse weights come to the driver."""
    rows = cut(training_rows(docs, labels, max_rows, id_col, text_col, label_col))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(i, t, y) for b in batches for i, t, y in zip(*(b.column(k).to_pylist() for k in range(3)))]
        at, w, bias = fit([(t, y) for _, t, y in sorted(got, key=lambda r: (r[0], r[1] or ""))], bits)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*w.tolist(), bias], pa.float64())], names=["at", "w"])
        del got
        release()

    found = rows.select("__dq_id", "__dq_text", "__dq_label").coalesce(1).mapInArrow(train, "at int, w double").toPandas()
    places = found[found["at"] >= 0]
    bias = found.loc[found["at"] < 0, "w"]
    return places["at"].to_numpy(np.int64), places["w"].to_numpy(), float(bias.iloc[0]) if len(bias) else 0.0


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxicity, toxic) of every document."""
    rated = _rated(fields(docs, __id=id_col, __text=text_col), model, bits)
    return rated.select(F.col("__id").alias(id_col), F.round("__score", 6).alias("toxicity"), (F.col("__score") > threshold).alias("toxic"))


def _rated(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int) -> DataFrame:
    """docs with the __score of __text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w, bias = shared.value
        dense = np.zeros(2**bits, np.float32)
        dense[at] = w
        for batch in texts:
            found = np.empty(len(batch))
            for i, scalar in enumerate(batch):
                places = features(scalar.as_py(), bits)
                # Few places have a weight; only those are made distinct.
                hit = places[dense[places] != 0]
                if len(hit):
                    hit = np.unique(hit)
                found[i] = bias + float(dense[hit].sum(dtype=np.float64))
            yield pa.array(1 / (1 + np.exp(-np.clip(found, -35, 35))), pa.float64())
        batch = dense = None
        release()

    return docs.withColumn("__score", F.arrow_udf(scores, "double")(F.col("__text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **names: str) -> DataFrame:
    return score(docs, fit_sample(docs, labels, **names), threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score isn't above the threshold, all columns kept."""
    rated = _rated(with_row(docs, __text="text"), fit_sample(docs, labels), BITS)
    return rows_back(rated.where(F.col("__score") <= threshold), docs.columns)
