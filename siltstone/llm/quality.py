"""Quality of a text, by a byte-level convolutional network in numpy.

A text is cut into chunks of eight bytes, a new one every four bytes, to its
very end. Each chunk's bytes are embedded, learned filters are applied, each
filter's response is max-pooled over all chunks, and a logistic unit combines
the pooled responses into one probability. Filters, embeddings and the unit
are learned together by Adam from a bounded sample of labelled documents.

Edge cases: null and empty texts are one chunk of zero bytes and get a score;
texts of any length are read whole, a few megabytes at a time; repeated rows
and extra columns pass through; without labels of both kinds every score is
the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.batches import append_columns, flat_text

STEP, DIMS, FILTERS = 4, 6, 24
#: Blocks whose responses are held at once.
ROWS = 1 << 15


class ByteNet:
    """Weights; ``chunks`` and ``pooled`` are shared by training and scoring."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, DIMS)).astype(np.float32)
        self.filters = rng.normal(0, 0.25, (2 * STEP * DIMS, FILTERS)).astype(np.float32)
        self.unit = np.zeros(FILTERS, np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.shift = np.zeros(1, np.float32)
        self.constant: float | None = None

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.unit, self.bias, self.shift]

    def responses(self, padded: np.ndarray) -> np.ndarray:
        """Filter responses of the chunk that begins at each block but the last."""
        # little-endian: the first byte is the low one, which varies fastest
        pairs = np.concatenate([np.tile(self.embed, (256, 1)), np.repeat(self.embed, 256, 0)], 1)
        blocks = pairs[padded.view("<u2")].reshape(-1, STEP * DIMS)
        both = np.concatenate([self.filters[: STEP * DIMS], self.filters[STEP * DIMS :]], 1)
        part = blocks @ both
        return part[:-1, :FILTERS] + part[1:, FILTERS:]

    def pooled(self, padded: np.ndarray, first: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """[texts, FILTERS] responses after pooling and rectifying; a long text is pooled piece by piece."""
        top = np.full((len(first), FILTERS), -np.inf, np.float32)
        last = first + blocks - 1  # the empty block, where no chunk begins
        for a in range(0, len(padded) // STEP - 1, ROWS):
            b = min(a + ROWS, len(padded) // STEP - 1)
            response = self.responses(padded[a * STEP : (b + 1) * STEP])
            i, j = np.searchsorted(last, a, side="right"), np.searchsorted(first, b)
            if i == j:
                continue
            edges = np.stack([np.maximum(first[i:j], a), np.minimum(last[i:j], b)], 1).ravel() - a
            edges = edges[:-1] if edges[-1] == b - a else edges
            top[i:j] = np.maximum(top[i:j], np.maximum.reduceat(response, edges, axis=0)[::2])
        return np.maximum(top + self.bias, 0)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offs) - 1, self.constant)
        feature = self.pooled(*chunks(data, offs))
        # single-precision products differ in their last bits with a text's place in its batch
        return np.round(1 / (1 + np.exp(-(feature @ self.unit + self.shift[0]).astype(np.float64))), 6)


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes padded so that each text begins a block and ends in an empty one, first block, number of blocks)."""
    size = np.diff(offs)
    blocks = np.maximum(-(-size // STEP), 1) + 1
    first = np.cumsum(blocks) - blocks
    padded = np.zeros(int(blocks.sum()) * STEP, np.uint8)
    padded[np.repeat(first * STEP - offs[:-1], size) + np.arange(len(data))] = data
    return padded, first, blocks


def gradient(net: ByteNet, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(weighted cross-entropy of a batch, its derivative by each of the net's weights)."""
    padded, first, blocks = chunks(*joined(texts))
    response = net.responses(padded)  # a batch whole, as its argmax is needed
    best = np.stack([f + response[f : f + b - 1].argmax(0) for f, b in zip(first, blocks)])
    top = np.take_along_axis(response, best, 0) + net.bias
    feature = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-(feature @ net.unit + net.shift[0])))
    loss = -(weight * np.log(np.where(labels == 1, p, 1 - p) + 1e-12)).mean()
    wrong = (p - labels) * weight / len(labels)
    back = wrong[:, None] * net.unit * (top > 0)
    byte = padded.reshape(-1, STEP)[best[..., None] + np.arange(2)].reshape(*best.shape, 2 * STEP)
    seen = net.embed[byte].reshape(*best.shape, 2 * STEP * DIMS)
    g_embed = np.zeros_like(net.embed)
    np.add.at(g_embed, byte.ravel(), (back[..., None] * net.filters.T[None]).reshape(-1, DIMS))
    return float(loss), [g_embed, np.einsum("nf,nfk->kf", back, seen), feature.T @ wrong, back.sum(0), wrong.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 16, batch: int = 32, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Fit by Adam on cross-entropy with the two labels weighed alike."""
    net = ByteNet(seed)
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        net.constant = float(labels.mean()) if len(labels) else 0.5
        return net
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            _, slopes = gradient(net, [texts[i] for i in pick], labels[pick], weight[pick])
            step += 1
            pace = rate * (0.3 ** (epoch / epochs))
            for w, (m, v), g in zip(net.weights(), moments, slopes):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 900, modulus: int = 5, held_out: int = 0, most_chars: int = 1 << 16, **how) -> ByteNet:
    """Learn from a bounded sample: at most ``per_label`` documents of each label, the first by hash of doc_id.

    One text counts for each doc_id, with ``most_chars`` characters. Rows whose
    crc32(doc_id as text) mod ``modulus`` is ``held_out`` are never used. Ids
    are chosen from the small label table first, so one pass over the
    documents fetches just the texts chosen.
    """
    told = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    told = told.where(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out).distinct()
    ends = [told.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    chosen = [(r.doc_id, r.quality) for part in ends for r in part.collect()]
    ids = docs.sparkSession.createDataFrame(chosen, T.StructType([labels.schema["doc_id"], T.StructField("quality", T.IntegerType())]))
    text = F.min(F.coalesce(F.substring("text", 1, most_chars), F.lit(""))).alias("text")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(text).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality))
    return train([r.text.encode() for r in rows], np.array([r.quality for r in rows]), **how)


def quality_scores(docs: DataFrame, net: ByteNet, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (double, higher: better) and predicted (1 if score >= threshold)."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        def run(part: pa.RecordBatch):
            score = net.scores(*flat_text(part.column(text_col)))
            return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]

        return run

    return append_columns(docs, text_col, fields, make, limit=2 << 20)
