"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are words, runs of other signs, and the letter case of each word. A token's vector is the sum of
the sparse ternary index vectors of its neighbours in the training sample (random indexing); tokens share
2**14 hash slots, so the model has a fixed size. A document's vector is the mean over all its tokens. The
network is trained in numpy on a bounded sample of labelled rows and its logits are divided by a
temperature fitted on rows that the training left out.

Defined cases: null and empty texts have the zero vector and get a score like any other; a document whose
labels contradict each other, or with a null label, teaches nothing; without two classes to learn from,
the score is the share of label 1 among the labels (one half without labels); every input row gives one
output row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmatch.llm.common import BYTE_CODES, arrow_rows, fold_of, pieces, prefix_sums, runs_of, span_hash, stored, utf8

SLOTS = 1 << 14
WIDTH = 32
NONZERO = 4
REACH = 4
#: Bound of the training sample: labelled documents, smallest id hashes first.
SAMPLE = 20_000
HIDDEN = 32
THRESHOLD = 0.3
SEED = 11

_BYTES = np.arange(256)
SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
UPPER = (_BYTES >= 65) & (_BYTES <= 90)
WORD = UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES >= 128)
FOLD = np.where(UPPER, _BYTES + 32, _BYTES)


def token_slots(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all tokens, and how many each text has. Each token is followed by one for its shape."""
    word = WORD[raw]
    sign = ~word & ~SPACE[raw]
    breaks = offsets[1:-1]
    starts, ends = runs_of(word, breaks)
    other_starts, other_ends = runs_of(sign, breaks)
    upper = np.concatenate([[0], np.cumsum(UPPER[raw])])
    size = ends - starts
    capitals = upper[ends] - upper[starts]
    title = UPPER[raw[starts]] if len(starts) else np.zeros(0, bool)
    shape = np.where(capitals == 0, 0, np.where((capitals == size) & (size > 1), 1, np.where(title & (capitals == 1), 2, 3)))
    shape = shape * 4 + np.minimum(size, 15) // 4
    at = np.concatenate([starts, other_starts])
    order = np.argsort(at, kind="stable")
    sums = prefix_sums(BYTE_CODES[FOLD[raw]])
    reserved = np.uint64(32)
    hashed = span_hash(sums, np.concatenate([starts, other_starts]), np.concatenate([ends, other_ends]))
    slot = (hashed % np.uint64(SLOTS - 32) + reserved).astype(np.int64)
    shapes = np.concatenate([shape, 16 + np.minimum(other_ends - other_starts, 15)])
    both = np.empty(2 * len(at), np.int64)
    both[0::2], both[1::2] = slot[order], shapes[order]
    counts = 2 * np.diff(np.searchsorted(at[order], offsets))
    return both, counts


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero entries of every slot's index vector."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.integers(0, WIDTH, (SLOTS, NONZERO)), rng.choice([-1.0, 1.0], (SLOTS, NONZERO))


def context_sums(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum, for every slot, of the index vectors of its neighbours in the same text."""
    slots, counts = token_slots(raw, offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    where, sign = _index_vectors()
    total = np.zeros(SLOTS * WIDTH)
    for step in range(1, REACH + 1):
        if len(slots) <= step:
            break
        same = text[step:] == text[:-step]
        left, right = slots[:-step][same], slots[step:][same]
        for a, b in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(a * WIDTH + where[b, k], weights=sign[b, k], minlength=SLOTS * WIDTH)
    return total.reshape(SLOTS, WIDTH)


def pooled(raw: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean token vector of each text."""
    out = np.zeros((len(offsets) - 1, vectors.shape[1]))
    for a, b in pieces(offsets, 1 << 20):
        part = offsets[a : b + 1] - offsets[a]
        slots, counts = token_slots(raw[offsets[a] : offsets[b]], part)
        filled = np.flatnonzero(counts)
        if len(filled):
            begin = (np.cumsum(counts) - counts)[filled]
            if b - a == 1:  # one long text: no large gather
                weight = np.bincount(slots, minlength=len(vectors))
                out[a] = weight @ vectors.astype(float) / len(slots)
            else:
                out[a + filled] = np.add.reduceat(vectors[slots], begin, axis=0) / counts[filled, None]
    return out


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit vectors of all slots from a sample of texts. One table of fixed size is added up and collected."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SLOTS, WIDTH))
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets):
                total += context_sums(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        filled = np.flatnonzero(total.any(axis=1))
        yield arrow_rows(slot=filled, **{f"v{i}": total[filled, i] for i in range(WIDTH)})

    names = [f"v{i}" for i in range(WIDTH)]
    rows = texts.select("text").mapInArrow(sums, "slot long, " + ", ".join(f"{n} double" for n in names))
    added = rows.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    vectors = np.zeros((SLOTS, WIDTH))
    vectors[added["slot"].to_numpy(np.int64)] = added[names].to_numpy()
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(length, 1e-9)).astype(np.float32)


@dataclass
class Network:
    """Two layers and a temperature; `prior` alone where there was nothing to learn."""

    prior: float
    layers: tuple[np.ndarray, ...] = ()
    center: np.ndarray | None = None
    spread: np.ndarray | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.center) / self.spread @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, batch: int = 256) -> Network:
    """Adam on the cross entropy; every fifth row is left out to fit the temperature."""
    prior = float(y.mean()) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        return Network(prior)
    rng = np.random.Generator(np.random.PCG64(SEED))
    order = rng.permutation(len(y))
    held, used = order[::5], order[np.arange(len(order)) % 5 != 0]
    net = Network(prior, center=x[used].mean(axis=0), spread=np.maximum(x[used].std(axis=0), 1e-6))
    scaled = (x - net.center) / net.spread
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    for epoch in range(epochs):
        slow = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        shuffled = rng.permutation(used)
        for at in range(0, len(shuffled), batch):
            rows = shuffled[at : at + batch]
            hidden = np.tanh(scaled[rows] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-(hidden @ w[2] + w[3]))) - y[rows]) / len(rows)
            back = np.outer(error, w[2]) * (1 - hidden**2)
            slopes = [scaled[rows].T @ back + 1e-5 * w[0], back.sum(axis=0), hidden.T @ error + 1e-5 * w[2], error.sum(keepdims=True)]
            step += 1
            for p, g, m, v in zip(w, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.layers = tuple(w)
    raw = net.logits(x[held])
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: _loss(raw / t, y[held]))) if len(held) else 1.0
    return net


@dataclass
class Classifier:
    vectors: np.ndarray
    net: Network

    def scores(self, column: pa.Array) -> np.ndarray:
        raw, offsets = utf8(column)
        return self.net.score(pooled(raw, offsets, self.vectors))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """From at most `sample` labelled documents outside the held-out fold; only texts and labels are read."""
    usable = labels.filter(F.col("quality").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    agreed = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality"), F.max("quality").alias("_most")
    ).filter(F.col("quality") == F.col("_most")).drop("_most")
    drawn = agreed.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    taught = stored(once.select("text", "quality"))
    vectors = word_vectors(taught)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            x = pooled(raw, offsets, vectors)
            yield arrow_rows(quality=batch.column("quality").cast(pa.float64()), **{f"x{i}": x[:, i] for i in range(WIDTH)})

    names = [f"x{i}" for i in range(WIDTH)]
    rows = taught.mapInArrow(features, "quality double, " + ", ".join(f"{n} double" for n in names)).toPandas()
    rows = rows.sort_values(["quality", *names])  # an order of its own: the same model on any cluster
    return Classifier(vectors, train(rows[names].to_numpy(float), rows["quality"].to_numpy(float)))


def score(documents: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score) of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield arrow_rows(doc_id=batch.column("doc_id"), score=model.scores(batch.column("text")))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, score double")


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(documents, fit(documents, labels))
    return found.select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, model: Classifier | None = None) -> DataFrame:
    """The documents that the classifier does not reject, all columns kept."""
    model = model or fit(documents, labels)
    text_at = documents.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.scores(batch.column(text_at).cast(pa.string())) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return documents.mapInArrow(kept, documents.schema)
