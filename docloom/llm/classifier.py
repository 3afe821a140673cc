"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Random indexing: each unit (a word's hash bucket, or a word's shape) has a
sparse random index vector; a unit's context vector is the sum of the index
vectors that stand around it in the training texts, damped and normalised. A
document's vector is the mean of its words' context vectors and of its words'
shape vectors. A network with one hidden layer scores it; a temperature fitted
on rows kept out of training calibrates the probability.

Training takes at most ``SAMPLE_DOCS`` labelled rows. Training and scoring read
whole texts. The vocabulary has ``BUCKETS`` hash buckets, so the model's size is
fixed.

Defined results: a text without words, or null, gets the score of the mean
vector 0; every row gets a row; without labels of both classes the score is
0.5; rows that repeat a labelled id train once, with the lower label.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import pieces, schema, text_of
from .quality_rules import labelled_sample

SAMPLE_DOCS = 3000
BUCKETS, SHAPES, DIM, NONZERO, HIDDEN, CONTEXT = 1 << 15, 1 << 11, 96, 6, 24, 2
TWIN = BUCKETS + SHAPES
THRESHOLD = 0.3
BATCH_BYTES = 1 << 20
KNOWN = 200_000
_RUNS = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^a-zA-Z0-9\x80-\xff])\1+"), rb"\1\1")]


def shape(word: bytes) -> bytes:
    for pattern, mark in _RUNS:
        word = pattern.sub(mark, word)
    return word[:24]


class Units(dict):
    """The bucket and shape of a word, as one number; words are remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        unit = zlib.crc32(word) % BUCKETS * SHAPES + zlib.crc32(shape(word)) % SHAPES
        if len(self) < KNOWN:
            self[word] = unit
        return unit

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        x = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        shapes = x % SHAPES + BUCKETS
        shapes[1:][x[1:] == x[:-1]] = TWIN  # a word like the one before has a shape of its own
        return x // SHAPES, shapes


def index_vectors(seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((TWIN + 1, DIM), np.float32)
    at = rng.integers(0, DIM, (len(out), NONZERO))
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), at.shape), 1)
    return out


def context_vectors(texts: list[bytes], units: Units) -> np.ndarray:
    """Damped, normalised sums of the index vectors around each unit."""
    index = index_vectors()
    out = index.copy()  # a unit that training doesn't meet keeps its own
    for text in texts:
        words, shapes = units.of(text)
        if not len(words):
            continue
        around = index[words] + index[shapes]
        total = np.zeros_like(around)
        for k in range(1, CONTEXT + 1):
            total[k:] += around[:-k]
            total[:-k] += around[k:]
        np.add.at(out, words, total)
        np.add.at(out, shapes, total)
    own = index * 4  # a unit's own index vector keeps units apart that stand in like places
    out = np.sign(out) * np.log1p(np.abs(out)) + own
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


@dataclass
class Model:
    words: np.ndarray  # for each unit, its part in the hidden layer
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float

    def logit(self, text: bytes, units: Units) -> float:
        words, shapes = units.of(text)
        # Pooling and the first layer are linear, so units carry the layer's values and are pooled in these.
        pooled = self.words[words].mean(0) + self.words[shapes].mean(0) if len(words) else 0.0
        return float(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)

    def score(self, text: bytes, units: Units) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.logit(text, units) / self.temperature, -40, 40))))


def _pool(vectors: np.ndarray, texts: list[bytes], units: Units) -> np.ndarray:
    out = np.zeros((len(texts), 2 * DIM))
    for i, text in enumerate(texts):
        words, shapes = units.of(text)
        if len(words):
            out[i] = np.concatenate([vectors[words].mean(0), vectors[shapes].mean(0)])
    return out


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 60, rate: float = 0.01, l2: float = 1e-4, seed: int = 11) -> Model:
    """Train on four fifths of the rows, fit the temperature on the rest."""
    y = np.asarray(labels, float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((TWIN + 1, HIDDEN), np.float32), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    units = Units()
    vectors = context_vectors(texts, units)
    x = _pool(vectors, texts, units)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    theta = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, t = [0.0] * 4, [0.0] * 4, 0
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), 128):
            b = used[at : at + 128]
            z = x[b] @ theta[0] + theta[1]
            h = np.maximum(z, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ theta[2] + theta[3], -40, 40))) - y[b]) / len(b)
            back = np.outer(d, theta[2]) * (z > 0)
            grads = [x[b].T @ back + l2 * theta[0], back.sum(0), h.T @ d + l2 * theta[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(grads):
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                theta[i] = theta[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    logits = np.maximum(x[held] @ theta[0] + theta[1], 0) @ theta[2] + theta[3]
    temperatures = np.geomspace(0.25, 10, 60)
    loss = [np.mean(np.logaddexp(0, logits / k) - y[held] * logits / k) if len(held) else abs(np.log(k)) for k in temperatures]
    layer = theta[0] / scale[:, None]
    parts = np.concatenate([vectors[:BUCKETS] @ layer[:DIM], vectors[BUCKETS:] @ layer[DIM:]]).astype(np.float32)
    return Model(parts, theta[1] - mean @ layer, theta[2], float(theta[3][0]), float(temperatures[int(np.argmin(loss))]))


def train(docs: DataFrame, labels: DataFrame, use, sample_docs: int = SAMPLE_DOCS) -> Model:
    sample = labelled_sample(docs, labels, sample_docs, use)
    return fit([t.encode() for t, _ in sample], np.array([q for _, q in sample]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of each document. The model, whose size is fixed, is sent once to each executor."""
    out = schema("doc_id long, score double, predicted int")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        units, m = Units(), sent.value
        for rows in pieces(batches, BATCH_BYTES, "doc_id", "text"):
            scores = [m.score(r[1].encode(), units) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], out.names)

    return text_of(docs).mapInArrow(run, out)


def trained_on(n: int = 5):
    """Rows that may teach: the crc32 of the id's text modulo n isn't 0."""
    from .common import crc_mod

    def use(doc_id: Column) -> Column:
        return crc_mod(doc_id, n) != 0

    return use
