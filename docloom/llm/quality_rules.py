"""Quality rules with line sequence labelling.

Base rules count words, symbols, repeated lines and repeated 8-word windows.
The lines with words then form a sequence that a linear-chain conditional
random field labels: Viterbi decoding marks each line as content or
boilerplate, and the share of words in content lines decides whether the
document stays.

The field is trained by maximum likelihood (forward-backward, Adam) on a
bounded sample of labelled rows: at most ``SAMPLE_DOCS`` whole documents, whose
lines all bear the document's own quality label. A document's lines form one
sequence of whatever length; sequences of like length are trained together, and
each step sees all of them. Without labels, ``prior_model`` is used.

Defined results: a null text has no words and fails the base rules; every row
gets a row, repeated ones too; an empty table gives none; only doc_id and text
are read. Long texts are taken whole; memory is proportional to one text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, schema, text_of

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT_SHARE = 8, 20, 30, 0.5
SAMPLE_DOCS, EPOCHS = 1500, 150
BATCH_BYTES = 1 << 20
_SPACES = b" \t\n\x0b\x0c\r"
_NOT_LEADING = _SPACES + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _ENDS, _SHOUTS = b"0123456789", b".,;:?", b"!"
FEATURES = 29


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that stand twice or more in the sequence, the first one included; exact, by doubling ranks."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        pair = x[:-step] * (int(x.max()) + 1) + x[step:]
        _, x, counts = np.unique(pair, return_inverse=True, return_counts=True)
        length += step
    twice = counts[x] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()  # bytes split at ASCII white space, which is what bounds a word here
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text.translate(None, _NOT_LEADING)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def features(lines: list[bytes], counts: np.ndarray) -> np.ndarray:
    """A row of 0/1 features for each line: levels of its ratios and lengths. ``counts``: its words."""
    split = [x.split() for x in lines]
    twins = np.array([sum(map(eq, w, islice(w, 1, None))) for w in split]) / np.maximum(counts - 1, 1)  # words like the one before
    distinct = np.array([len(set(w)) for w in split]) / np.maximum(counts, 1)
    n = np.array([len(x) for x in lines], float)

    def share(chars: bytes, of: np.ndarray) -> np.ndarray:
        return np.array([len(x) - len(x.translate(None, chars)) for x in lines]) / np.maximum(of, 1)

    seen: set[bytes] = set()
    again = np.array([x in seen or seen.add(x) is not None for x in lines], float)
    upper, symbols, shouts = share(_UPPER, n), share(_SYMBOLS, counts), share(_SHOUTS, counts)
    digits, ends, chars = share(_DIGITS, n), share(_ENDS, counts), n / np.maximum(counts, 1)
    levels = [
        np.ones(len(lines)), again,
        upper > 0.1, upper > 0.3, upper > 0.6,
        symbols > 0.02, symbols > 0.1, symbols > 0.3, symbols > 0.7,
        shouts > 0.05, shouts > 0.3, shouts > 0.7,
        digits > 0.05, digits > 0.25,
        ends < 0.01, ends > 0.05, ends > 0.3,
        counts < 3, counts < 6, counts > 15, counts > 60,
        chars > 8, chars > 14, n > 200, n > 1000,
        twins > 0.15, twins > 0.5, (distinct < 0.6) & (counts > 8), (distinct < 0.3) & (counts > 8),
    ]
    return np.stack(levels, 1).astype(float)


@dataclass
class Model:
    """Weights of a chain with labels 0 (content) and 1 (boilerplate)."""

    weights: np.ndarray  # FEATURES x 2
    moves: np.ndarray  # 2 x 2: from, to


def prior_model() -> Model:
    """Used without labelled rows: symbols, capitals, shouting and repeated lines speak for boilerplate."""
    w = np.zeros((FEATURES, 2))
    w[0, 0] = 1.5
    for i in (1, 3, 4, 6, 7, 8, 10, 11, 13, 25, 26, 28):
        w[i, 1] = 1.0
    return Model(w, np.array([[0.5, -0.5], [-0.5, 0.5]]))


def viterbi(unary: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best label sequence; ties go to label 0."""
    n = len(unary)
    back = []
    a, b = unary[0].tolist()
    (m00, m01), (m10, m11) = moves.tolist()
    for x, y in unary[1:].tolist():
        f0, f1 = b + m10 > a + m00, b + m11 > a + m01
        a, b = (b + m10 if f0 else a + m00) + x, (b + m11 if f1 else a + m01) + y
        back.append((f0, f1))
    out = np.zeros(n, np.int8)
    last = int(b > a)
    out[n - 1] = last
    for i in range(n - 2, -1, -1):
        last = int(back[i][last])
        out[i] = last
    return out


def _batches(sequences: list[np.ndarray], labels: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Padded features, labels and masks of sequences of like length: between two powers of 2."""
    out = []
    sizes = np.array([int(len(s) - 1).bit_length() for s in sequences])
    for k in np.unique(sizes):
        some = np.flatnonzero(sizes == k)
        longest = max(len(sequences[i]) for i in some)
        x, y, mask = np.zeros((len(some), longest, FEATURES)), np.zeros((len(some), longest), int), np.zeros((len(some), longest), bool)
        for at, i in enumerate(some):
            n = len(sequences[i])
            x[at, :n], y[at, :n], mask[at, :n] = sequences[i], labels[i], True
        out.append((x, y, mask))
    return out


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high = np.maximum(a, b)
    return high + np.log1p(np.exp(-np.abs(a - b)))


def _chain(u: np.ndarray, m: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log sums over all label sequences up to (alpha) and from (beta) each place. ``u``: scores by place, sequence and label."""
    alpha, beta = np.zeros(u.shape), np.zeros(u.shape)
    alpha[0] = u[0]
    for i in range(1, len(u)):
        step = _log_sum(alpha[i - 1, :, :1] + m[0], alpha[i - 1, :, 1:] + m[1]) + u[i]
        alpha[i] = np.where(mask[i, :, None], step, alpha[i - 1])
    for i in range(len(u) - 2, -1, -1):
        v = u[i + 1] + beta[i + 1]
        beta[i] = np.where(mask[i + 1, :, None], _log_sum(v[:, :1] + m[:, 0], v[:, 1:] + m[:, 1]), 0.0)
    return alpha, beta


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, l2: float = 1e-3, rate: float = 0.1) -> Model:
    """Maximum likelihood over whole sequences: forward-backward on padded arrays, steps by Adam."""
    if not sequences:
        return prior_model()
    batches, want, total = [], np.zeros(FEATURES * 2 + 4), 0
    for x, y, mask in _batches(sequences, labels):
        both = mask[:, 1:] & mask[:, :-1]
        want[:-4] += np.stack([(x * (mask & (y == k))[..., None]).sum((0, 1)) for k in (0, 1)], 1).ravel()
        want[-4:] += [(both & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for i in (0, 1) for j in (0, 1)]
        total += mask.sum()
        batches.append((x, np.ascontiguousarray(mask.T), both))
    theta, first, second = np.zeros(FEATURES * 2 + 4), 0.0, 0.0
    for t in range(1, epochs + 1):
        w, m = theta[:-4].reshape(FEATURES, 2), theta[-4:].reshape(2, 2)
        got = np.zeros(len(theta))
        for x, mask, both in batches:
            u = np.ascontiguousarray((x @ w).transpose(1, 0, 2))
            alpha, beta = _chain(u, m, mask)
            z = _log_sum(alpha[-1, :, 0], alpha[-1, :, 1])
            p = np.exp(alpha + beta - z[:, None]) * mask[..., None]
            q = np.exp(alpha[:-1, :, :, None] + m + (u[1:] + beta[1:])[:, :, None, :] - z[:, None, None]) * both.T[..., None, None]
            got[:-4] += (x.reshape(-1, FEATURES).T @ p.transpose(1, 0, 2).reshape(-1, 2)).ravel()
            got[-4:] += q.sum((0, 1)).ravel()
        g = (want - got) / total - l2 * theta
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta = theta + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:-4].reshape(FEATURES, 2).copy(), theta[-4:].reshape(2, 2).copy())


def _lines(text: bytes) -> tuple[list[bytes], np.ndarray]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return lines, np.array([len(x.split()) for x in lines], float)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, use=None) -> list[tuple[str, int]]:
    """At most ``most`` labelled rows, chosen by a hash of the id: whole texts with their quality. Ids repeated among documents give twice as many at most."""
    rows = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = rows if use is None else rows.filter(use(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)
    # The limit bounds this broadcast: ``most`` rows of two numbers.
    found = text_of(docs).join(F.broadcast(rows), "doc_id").select("doc_id", "text", "quality")
    found = found.orderBy("doc_id", "text").limit(2 * most).toPandas()
    return list(zip(found["text"].tolist(), found["quality"].tolist(), strict=True))


def train(docs: DataFrame, labels: DataFrame | None, sample_docs: int = SAMPLE_DOCS) -> Model:
    if labels is None:
        return prior_model()
    sequences, marks = [], []
    for text, quality in labelled_sample(docs, labels, sample_docs):
        lines, counts = _lines(text.encode())
        if lines:
            sequences.append(features(lines, counts))
            marks.append(np.full(len(sequences[-1]), 0 if quality else 1))
    if len({int(m[0]) for m in marks}) < 2:
        return prior_model()
    return fit(sequences, marks)


def content_share(text: bytes, model: Model) -> tuple[float, list[int]]:
    """The share of words in content lines, and the labels of the lines that have words."""
    lines, counts = _lines(text)
    if not lines:
        return 0.0, []
    marks = viterbi(features(lines, counts) @ model.weights, model.moves)
    return float(counts[marks == 0].sum() / counts.sum()), marks.tolist()


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, line_labels array<tinyint>"


def apply_rules(docs: DataFrame, model: Model, least: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The counts, verdicts, content share and labels (0 content, 1 boilerplate, of lines with words) of each document."""
    out = schema(OUT)

    def run(batches):
        for rows in pieces(batches, BATCH_BYTES, "doc_id", "text"):
            cols = [[] for _ in out.names]
            for doc_id, text in rows:
                text = text.encode()
                n, *counts = base_counts(text)
                share, marks = content_share(text, model)
                failed = n < MIN_WORDS or 100 * counts[3] > MAX_REPEAT_PERCENT * n
                for c, v in zip(cols, (doc_id, n, *counts, failed, not failed and share >= least, share, marks), strict=True):
                    c.append(v)
            types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64(), pa.list_(pa.int8())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], out.names)

    return text_of(docs).mapInArrow(run, out)
