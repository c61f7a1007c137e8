"""Quality classifier: a byte-level convolutional network in numpy.

A document is the bytes of its whole text, cut into overlapping chunks. Bytes are embedded,
learned filters slide over each chunk, and each filter keeps its largest response in the
chunk. The mean and the maximum of these over all chunks of the document go through a small
dense layer into one probability. Training is on a bounded, documented sample of labelled
rows; scoring covers every byte of every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpath.llm.common import document_columns, labelled_sample

CHUNK, OVERLAP = 256, 32
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 8, 2, 16, 12
PAD = 256
SAMPLE_ROWS = {0: 1500, 1: 2500}
EPOCHS, DOCS_PER_STEP, RATE = 6, 32, 0.01
CHUNKS_AT_ONCE = 512


def chunks_of(data: bytes) -> np.ndarray:
    """Overlapping chunks that cover all bytes, the last one padded; an empty text is one chunk of padding."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    flat = np.full((n - 1) * step + CHUNK, PAD, dtype=np.int32)
    flat[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


@dataclass
class ByteNetwork:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, seed: int = 7) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        embed = rng.standard_normal((PAD + 1, EMBED)).astype(np.float32) * 0.5
        embed[PAD] = 0
        zeros = lambda n: np.zeros(n, dtype=np.float32)
        return cls(embed, draw(WIDTH * EMBED, FILTERS), zeros(FILTERS), draw(2 * FILTERS, HIDDEN), zeros(HIDDEN), draw(HIDDEN), zeros(1))

    def patches(self, chunks: np.ndarray) -> np.ndarray:
        """Embedded windows: (chunks, places, WIDTH * EMBED)."""
        flat = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        view = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBED, axis=1)
        return view[:, :: STRIDE * EMBED]

    def pool(self, chunks: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each chunk, not below 0."""
        pooled = []
        for i in range(0, len(chunks), CHUNKS_AT_ONCE):
            windows = self.patches(chunks[i : i + CHUNKS_AT_ONCE])
            responses = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ self.filters
            pooled.append(responses.reshape(len(windows), -1, FILTERS).max(axis=1))
        return np.maximum(np.concatenate(pooled) + self.bias, 0)

    def head(self, pooled: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        mean = np.add.reduceat(pooled, starts) / counts[:, None]
        features = np.concatenate([mean, np.maximum.reduceat(pooled, starts)], axis=1)
        hidden = np.tanh(features @ self.dense + self.dense_bias)
        return features, hidden, hidden @ self.out + self.out_bias[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each text."""
        pieces = [chunks_of(text.encode()) for text in texts]
        counts = np.array([len(piece) for piece in pieces])
        pooled = []
        held: list[np.ndarray] = []
        size = 0
        for piece in pieces:
            held.append(piece)
            size += len(piece)
            if size >= CHUNKS_AT_ONCE:
                pooled.append(self.pool(np.concatenate(held)))
                held, size = [], 0
        if held:
            pooled.append(self.pool(np.concatenate(held)))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        logits = self.head(np.concatenate(pooled), starts, counts)[2]
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))

    def gradients(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Gradients of the weighted log loss; only the places of the maxima pass any back."""
        pieces = [chunks_of(text) for text in texts]
        counts = np.array([len(piece) for piece in pieces])
        chunks = np.concatenate(pieces)
        owner = np.repeat(np.arange(len(texts)), counts)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        places, raw = [], []
        for i in range(0, len(chunks), CHUNKS_AT_ONCE):
            windows = self.patches(chunks[i : i + CHUNKS_AT_ONCE])
            responses = (np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(windows), -1, FILTERS)
            places.append(responses.argmax(axis=1))
            raw.append(responses.max(axis=1))
        place = np.concatenate(places)
        pooled = np.maximum(np.concatenate(raw) + self.bias, 0)
        features, hidden, logits = self.head(pooled, starts, counts)
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        total = weights.sum()
        loss = -float((weights * np.where(labels == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum() / total)
        d_logit = (weights * (p - labels) / total).astype(np.float32)
        d_out, d_out_bias = hidden.T @ d_logit, np.array([d_logit.sum()], dtype=np.float32)
        d_hidden = np.outer(d_logit, self.out) * (1 - hidden**2)
        d_dense, d_dense_bias = features.T @ d_hidden, d_hidden.sum(axis=0)
        d_features = d_hidden @ self.dense.T
        best = pooled == features[owner, FILTERS:]
        d_pooled = d_features[owner, :FILTERS] / counts[owner, None] + d_features[owner, FILTERS:] * best
        d_pooled *= pooled > 0
        at = place * STRIDE
        d_filters, d_embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        rows = np.arange(len(chunks))[:, None]
        for k in range(WIDTH):
            symbols = chunks[rows, at + k]
            block = slice(k * EMBED, (k + 1) * EMBED)
            d_filters[block] = np.einsum("cfe,cf->ef", self.embed[symbols], d_pooled)
            np.add.at(d_embed, symbols, d_pooled[:, :, None] * self.filters[block].T[None])
        d_embed[PAD] = 0
        return [d_embed, d_filters, d_pooled.sum(axis=0), d_dense, d_dense_bias, d_out, d_out_bias], loss

    def values(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]


def train(rows: list[tuple[bytes, int]], weights: dict[int, float], epochs: int = EPOCHS, seed: int = 7) -> ByteNetwork:
    """Adam over shuffled steps with a falling rate; ``weights`` by label restore the class shares."""
    network, rng = ByteNetwork.start(seed), np.random.default_rng(seed)
    first = [np.zeros_like(v) for v in network.values()]
    second = [np.zeros_like(v) for v in network.values()]
    step, steps = 0, epochs * -(-len(rows) // DOCS_PER_STEP)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), DOCS_PER_STEP):
            part = [rows[j] for j in order[i : i + DOCS_PER_STEP]]
            labels = np.array([label for _, label in part], dtype=np.float32)
            grads, _ = network.gradients([text for text, _ in part], labels, np.array([weights[int(y)] for y in labels], dtype=np.float32))
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for value, grad, m, v in zip(network.values(), grads, first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network


def fit_quality(docs: DataFrame, labels: DataFrame, keep: Column, sample_rows: dict[int, int] | None = None) -> ByteNetwork:
    """Train on at most ``sample_rows`` labelled rows of each class among those that ``keep`` allows.

    Without labels of both classes the network stays untrained but for the class share: it
    then scores every text alike.
    """
    sample = labelled_sample(docs, labels, "quality", keep, sample_rows or SAMPLE_ROWS)
    rows = sorted((r.doc_id, bytes(r.data), r.label) for r in sample.select("doc_id", F.col("text").cast("binary").alias("data"), "label").collect())
    pairs = [(data, label) for _, data, label in rows]
    have = {c: sum(1 for _, y in pairs if y == c) for c in (0, 1)}
    counted = labels.where(keep & F.col("quality").isNotNull()).groupBy(F.col("quality").cast("int").alias("c")).count()
    shares = {r.c: r["count"] for r in counted.collect()}
    if not have[0] or not have[1]:
        network = ByteNetwork.start()
        network.out[:] = 0
        network.out_bias[0] = np.log((shares.get(1, 0) + 0.5) / (shares.get(0, 0) + 0.5))
        return network
    return train(pairs, {c: shares[c] / have[c] for c in (0, 1)})


def score_documents(docs: DataFrame, network: ByteNetwork) -> DataFrame:
    """``doc_id``, ``score`` of every row, one pass without a shuffle.

    A null text counts as empty and an empty text gets the score of one padded chunk; repeated
    rows and null ids are kept; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = network.scores(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return document_columns(docs).mapInArrow(work, "doc_id long, score double")
