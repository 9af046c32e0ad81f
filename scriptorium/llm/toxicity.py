"""Toxicity by FTRL-proximal logistic regression on hashed n-grams and skip-grams.

Features of a text are its distinct hashed word unigrams, bigrams and skip
bigrams (one word left out), lower-cased; each weighs 1. Training is
FTRL-proximal with a rate for each coordinate and L1, which leaves few nonzero
weights; only those are broadcast, at most ``2 ** BITS`` of them.

Defined results: a null or empty text scores the bias alone; without training
rows every score is 0.5, which predicts 1; labels repeated for an id count with
the highest; a null id has no label; repeated rows give equal rows; texts of any
length are scored whole; a score of exactly 0.5 predicts 1; null ids are scored
like others; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, fold, hash_share, small_batches

BITS = 20
#: Bound of the labelled sample, in expectation, chosen by a hash of the id ...
SAMPLE_ROWS = 12_000
#: ... of texts of at most so many bytes.
SAMPLE_BYTES = 65_536
EPOCHS = 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_STRIP = b".,;:!?\"'()[]{}|*#$%&-"


class Hasher:
    """Feature numbers of texts; words' hashes are remembered up to a bound."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, hashes = self.words, []
        if len(known) > 500_000:
            known.clear()
        for w in (text or "").lower().encode().split():
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.strip(_STRIP) or w)
            hashes.append(h)
        x = np.array(hashes, np.uint64)
        grams = [x * _A]
        for gap in (1, 2):
            grams.append(((x[:-gap] * _A) ^ ((x[gap:] + np.uint64(gap)) * _B)) * _A)
        return np.unique(np.concatenate(grams) >> self.shift).astype(np.int64)


class Ftrl:
    """FTRL-proximal logistic regression over binary features; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, features: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * weight
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


class Model:
    """Nonzero weights, sorted by feature."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float, bits: int = BITS):
        self.features, self.weights, self.bias, self.bits = features, weights, bias, bits
        self.hasher: Hasher | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"hasher": None}

    def score(self, texts: list[str | None]) -> np.ndarray:
        self.hasher = self.hasher or Hasher(self.bits)
        out = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            x = self.hasher(t)
            if len(self.features) and len(x):
                at = np.searchsorted(x, self.features)
                at[at == len(x)] = 0
                out[i] += self.weights[x[at] == self.features].sum()
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(rows: list[tuple[str, int]], bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Train on (text, label) rows, in the order given each time."""
    hasher, ftrl = Hasher(bits), Ftrl(1 << bits)
    held = [(hasher(t), y) for t, y in rows]
    positive = max(1, sum(y for _, y in held))
    up = min(3.0, max(1.0, (len(held) - positive) / positive))
    for _ in range(epochs):
        for x, y in held:
            ftrl.learn(x, y, up if y else 1.0)
    w = ftrl.weights(slice(None))
    at = np.flatnonzero(w[:-1])
    return Model(at, w[at], float(w[-1]), bits)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 0, folds: int = 5, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from labelled rows outside the held-out fold, about ``sample_rows`` at most, of at most ``sample_bytes`` each.

    Rows that repeat an id are learned from once each, but no more than
    ``2 * sample_rows`` rows are taken in all.
    """
    own = labels.filter(F.col(label_col).isin(0, 1) & (fold(id_col, folds) != held_out)).groupBy(F.col(id_col).alias("_k")).agg(F.max(label_col).cast("int").alias("_y"))
    n = own.count()
    chosen = own.filter(hash_share("_k", 23) < min(1.0, sample_rows / max(1, n)))  # so many ids: may be broadcast
    text = docs.filter(F.octet_length(text_col) <= sample_bytes)
    rows = text.join(F.broadcast(chosen), F.col(id_col) == F.col("_k")).select(F.xxhash64("_k", text_col).alias("h"), F.col(text_col).cast("string").alias("t"), "_y")
    rows = rows.orderBy("h", "t", "_y").limit(2 * sample_rows)  # each task keeps no more
    return fit([(r.t, r._y) for r in sorted(rows.collect(), key=lambda r: (r.h, r.t, r._y))])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    schema = extended(docs.select(id_col), "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shipped.value.score(b.column(1).to_pylist()))], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
