"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over them, and their rectified
responses are max-pooled over half-overlapping chunks that cover the whole
document.  Each chunk gets a score; the largest, the mean and the smallest
chunk score are combined into one probability.

The network is fitted on the driver on a bounded, documented sample of
labelled rows (``rows_per_class``, texts of at most ``max_chars``); scoring
reads every text whole, a slice of a document at a time.

Defined cases: a null or empty text is scored as one chunk of padding; equal
texts have equal scores; without labels of both classes every score is the
labels' share (0.5 without labels).  Every row gets a score, also rows that
repeat an id or have none (a null id counts as the empty text for the fold, and
is never learned from); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_mod, map_batches, slices
from .labelled import labelled_sample

PAD, DIM, WIDTH, STRIDE, FILTERS, HIDDEN, CHUNK = 256, 8, 8, 2, 24, 16, 512
SLICE = 1 << 16
SCORES = "doc_id long, score double"


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def as_bytes(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(data, np.uint8).astype(np.int16)


def chunked(data: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) bytes: every half chunk starts one, the last ends with the document, short documents are padded."""
    if len(data) <= CHUNK:
        return np.pad(data, (0, CHUNK - len(data)), constant_values=PAD)[None]
    starts = np.append(np.arange(0, len(data) - CHUNK, CHUNK // 2), len(data) - CHUNK)
    return data[starts[:, None] + np.arange(CHUNK)]


@dataclass
class ByteNetwork:
    """Parameters; ``combine`` weighs (max, mean, min, 1) of the chunk scores."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    combine: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5, 0.0, 0.0]))

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> ByteNetwork:
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        embed = normal(257, DIM, scale=0.5)
        embed[PAD] = 0
        return cls(embed, normal(WIDTH * DIM, FILTERS, scale=(2 / (WIDTH * DIM)) ** 0.5), np.zeros(FILTERS, np.float32), normal(FILTERS, HIDDEN, scale=0.4), np.zeros(HIDDEN, np.float32), normal(HIDDEN + 1, scale=0.2))

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, positions, WIDTH * DIM)"""
        e = self.embed[chunks].reshape(len(chunks), -1)
        view = np.lib.stride_tricks.sliding_window_view(e, WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]
        return np.ascontiguousarray(view)

    def head(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.hidden + self.hidden_bias, 0) @ self.out[:-1] + self.out[-1]

    def chunk_scores(self, data: np.ndarray) -> np.ndarray:
        """Chunk scores of a document.  Responses are computed once per position, pooled by half chunks, then by pairs of halves.

        Windows that begin in a half and end beyond it belong to a chunk only as its first half.  Responses
        are never below 0, so zeros fill up the last half.
        """
        if len(data) <= CHUNK:
            return self.head(self.responses(chunked(data)[0]).max(axis=0)[None])
        half, per_half = CHUNK // 2, CHUNK // 2 // STRIDE
        inside = per_half - (WIDTH // STRIDE - 1)
        firsts, seconds = [], []
        for at in range(0, len(data), SLICE):
            part = data[at : at + SLICE + WIDTH - STRIDE]
            responses = self.responses(np.pad(part, (0, max(0, WIDTH - len(part))), constant_values=PAD))
            halves = np.pad(responses, ((0, -len(responses) % per_half), (0, 0))).reshape(-1, per_half, FILTERS)
            seconds.append(halves[:, :inside].max(axis=1))
            firsts.append(np.maximum(seconds[-1], halves[:, inside:].max(axis=1)))
        n = len(range(0, len(data) - CHUNK, half))
        pooled = np.maximum(np.concatenate(firsts)[:n], np.concatenate(seconds)[1 : n + 1])
        return self.head(np.append(pooled, self.responses(data[-CHUNK:]).max(axis=0)[None], axis=0))

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Rectified filter responses at every STRIDE-th byte: one matrix product per offset, on a table of the embedded bytes."""
        e = self.embed[data[: len(data) // STRIDE * STRIDE]].reshape(-1, STRIDE * DIM)
        n, step = len(e) - WIDTH // STRIDE + 1, STRIDE * DIM
        total = e[:n] @ self.filters[:step]
        for j in range(1, WIDTH // STRIDE):
            total += e[j : j + n] @ self.filters[j * step : (j + 1) * step]
        return np.maximum(total + self.bias, 0)

    def features(self, data: np.ndarray) -> np.ndarray:
        s = self.chunk_scores(data)
        return np.array([s.max(), s.mean(), s.min(), 1.0])

    def score(self, data: np.ndarray) -> float:
        return float(sigmoid(self.features(data) @ self.combine))


def fit_chunks(net: ByteNetwork, chunks: np.ndarray, labels: np.ndarray, rng: np.random.Generator, epochs: int, batch: int = 64, rate: float = 4e-3) -> None:
    """Adam on the logistic loss of single chunks, which bear their document's label."""
    names = ("embed", "filters", "bias", "hidden", "hidden_bias", "out")
    first, second, step = {n: 0 for n in names}, {n: 0 for n in names}, 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(chunks)), max(1, len(chunks) // batch)):
            x, y = chunks[at], labels[at]
            cols = net.windows(x)
            conv = cols @ net.filters + net.bias
            best = conv.argmax(axis=1)
            top = np.take_along_axis(conv, best[:, None], axis=1)[:, 0]
            pooled = np.maximum(top, 0)
            pre = pooled @ net.hidden + net.hidden_bias
            act = np.maximum(pre, 0)
            error = ((sigmoid(act @ net.out[:-1] + net.out[-1]) - y) / len(x)).astype(np.float32)
            d_pre = error[:, None] * net.out[None, :-1] * (pre > 0)
            d_top = d_pre @ net.hidden.T * (top > 0)
            picked = cols[np.arange(len(x))[:, None], best]
            d_cols = d_top[:, :, None] * net.filters.T[None]
            d_embed = np.zeros_like(net.embed)
            where = x[np.arange(len(x))[:, None, None], (best * STRIDE)[:, :, None] + np.arange(WIDTH)]
            np.add.at(d_embed, where.ravel(), d_cols.reshape(-1, DIM))
            d_embed[PAD] = 0
            grads = {"embed": d_embed, "filters": np.einsum("bf,bfk->kf", d_top, picked), "bias": d_top.sum(0), "hidden": pooled.T @ d_pre, "hidden_bias": d_pre.sum(0), "out": np.append(act.T @ error, error.sum())}
            step += 1
            for n in names:
                g = grads[n] + 1e-4 * getattr(net, n)
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                move = rate * 0.5**epoch * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - move).astype(np.float32))


def fit_combine(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; rows are weighed so that label 1 has the given share."""
    ones = y.mean()
    weight = np.where(y == 1, share / ones, (1 - share) / (1 - ones))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + ridge * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def fit(texts: list[str], labels: list[int], share: float, chunks_per_text: int = 4, epochs: int = 3, seed: int = 7) -> ByteNetwork | float:
    """A fitted network, or the constant score where one class is missing."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return share
    rng = np.random.default_rng(seed)
    net = ByteNetwork.fresh(rng)
    data = [as_bytes(t) for t in texts]
    parts, owner = [], []
    for d, label in zip(data, y, strict=True):
        c = chunked(d)
        c = c[rng.permutation(len(c))[:chunks_per_text]]
        parts.append(c)
        owner += [label] * len(c)
    fit_chunks(net, np.concatenate(parts), np.array(owner), rng, epochs)
    net.combine = fit_combine(np.array([net.features(d) for d in data]), y, min(max(share, 0.01), 0.99))
    return net


def score_texts(documents: DataFrame, model: ByteNetwork | float) -> DataFrame:
    """doc_id, score of every document."""

    def scored(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1):
                scores = [model if isinstance(model, float) else model.score(as_bytes(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_batches(documents.select("doc_id", "text"), scored, SCORES)


def classify_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out: int = 0, rows_per_class: int = 1500, max_chars: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    texts, marks, share = labelled_sample(documents, labels, "quality", folds, held_out, rows_per_class, max_chars)
    scores = score_texts(documents, fit(texts, marks, share))
    return scores.select("doc_id", (bucket_mod("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
