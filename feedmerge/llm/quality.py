"""Quality classifier: random-indexing word vectors and a two-layer network.

Tokens are runs of letters, of digits and of other signs, hashed to 2**14
slots.  Each slot has a sparse index vector of +1 and -1; the context vector of
a slot is the sum of the index vectors of the tokens at most two places away,
over all documents.  Tasks add up whole tables (fixed size) and Spark adds the
tables in two rounds, so no task gathers all of them.  A document is the mean
and the spread of its tokens' unit context vectors.  A two-layer network (numpy)
is fitted on at most ``max_rows`` labelled rows (lowest hash of doc_id first);
a fifth of them sets the temperature of its probabilities.

Defined cases: null, empty and blank texts have the zero vector (and so one
fixed score); rows with a null doc_id are scored but never train; a null label
is ignored, of several labels of one doc_id the largest holds; repeated rows are
scored alike; with one class only every score is the smoothed base rate; other
columns pass through and those named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmerge.llm.runtime import materialize
from feedmerge.llm.textarrays import CHUNK, as_bytes, hash_spans, mix
from feedmerge.llm.toxicity import training_rows

SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
DIMS = 32
NONZERO = 4
REACH = 2
PARTS = 64              # slices of the table
FAN = 256               # tables that meet in the first round: their number / FAN
MAX_ROWS = 8_000
HIDDEN = 16

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[0x30:0x3A] = 1
for _range in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _CLASS[_range[0]:_range[1]] = 2


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each slot's index vector."""
    h = mix(np.arange(SLOTS * NONZERO, dtype=np.uint64) + np.uint64(12345)).reshape(SLOTS, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


def token_slots(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and slot of each token of a text."""
    kind = np.zeros(len(data) + 2, np.uint8)
    kind[1:-1] = _CLASS[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    start, end = edge[:-1], edge[1:]
    word = kind[start + 1] > 0
    start, end = start[word], end[word]
    return start, (hash_spans(data, start, end) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _text_runs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, slots, bounds) for runs of texts of about CHUNK bytes; a
    longer text is one run."""
    i = 0
    while i < len(texts):
        size, j = len(texts[i]) + 1, i + 1
        while j < len(texts) and size + len(texts[j]) < CHUNK:
            size += len(texts[j]) + 1
            j += 1
        start, slot = token_slots(b" ".join(texts[i:j]))
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        yield i, slot, np.searchsorted(start, np.r_[0, ends])
        i = j


def _context_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = _index_vectors()
    table = np.zeros(SLOTS * DIMS, np.int64)
    for batch in batches:
        for _, slot, bounds in _text_runs(as_bytes(batch.column(0))):
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for far in range(1, REACH + 1):
                inside = doc[far:] == doc[:-far]
                left, right = slot[:-far][inside], slot[far:][inside]
                for at, other in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        table += np.bincount(at * DIMS + place[other, k], weights=sign[other, k],
                                             minlength=len(table)).astype(np.int64)
    pieces = table.reshape(PARTS, -1)
    spread = TaskContext.get().partitionId() % FAN
    codec = pa.Codec("zstd")
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(PARTS)), pa.array(np.full(PARTS, spread)),
         pa.array([codec.compress(p.tobytes(), asbytes=True) for p in pieces], pa.binary())],
        names=["part", "spread", "sums"])


def _add(table: pa.Table) -> pa.Table:
    codec, size = pa.Codec("zstd"), SLOTS * DIMS // PARTS
    total = np.zeros(size, np.int64)
    for x in table["sums"]:
        total += np.frombuffer(codec.decompress(x.as_py(), size * 8, asbytes=True), np.int64)
    return pa.table({"part": table["part"][:1], "spread": table["spread"][:1],
                     "sums": pa.array([codec.compress(total.tobytes(), asbytes=True)], pa.binary())})


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors, SLOTS by DIMS: 2 MB, the bound of what is sent."""
    schema = "part long, spread long, sums binary"
    tables = docs.select("text").mapInArrow(_context_tables, schema)
    sums = (tables.groupBy("part", "spread").applyInArrow(_add, schema)
            .groupBy("part").applyInArrow(_add, schema).collect())
    codec, size = pa.Codec("zstd"), SLOTS * DIMS // PARTS
    out = np.zeros((PARTS, size))
    for r in sums:
        out[r["part"]] = np.frombuffer(codec.decompress(r["sums"], size * 8, asbytes=True), np.int64)
    out = out.reshape(SLOTS, DIMS)
    out -= out.sum(axis=0) * (np.abs(out).sum(axis=1, keepdims=True) / max(np.abs(out).sum(), 1))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def document_vectors(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's token vectors."""
    out = np.zeros((len(texts), 2 * DIMS))
    for first, slot, bounds in _text_runs(texts):
        size = np.diff(bounds)
        full = np.flatnonzero(size)
        if not len(full):
            continue
        # a long text in slices, so that memory does not grow with it
        if len(size) == 1 and len(slot) > 400_000:
            sums = np.zeros((1, DIMS))
            squares = np.zeros((1, DIMS))
            for k in range(0, len(slot), 200_000):
                v = vectors[slot[k:k + 200_000]]
                sums += v.sum(axis=0, dtype=float)
                squares += (v * v).sum(axis=0, dtype=float)
        else:
            v = vectors[slot]
            start = bounds[:-1][full]
            sums = np.add.reduceat(v, start, axis=0, dtype=float)
            squares = np.add.reduceat(v * v, start, axis=0, dtype=float)
        n = size[full][:, None]
        mean = sums / n
        out[first + full, :DIMS] = mean
        out[first + full, DIMS:] = np.sqrt(np.maximum(squares / n - mean**2, 0))
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((features - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        logit = self.logits(document_vectors(texts, self.vectors)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit_network(x: np.ndarray, y: np.ndarray, steps: int = 600, seed: int = 5) -> tuple:
    """A tanh layer and a logistic output, by Adam on the whole sample."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m1, m2 = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    for step in range(1, steps + 1):
        hidden = np.tanh(x @ p[0] + p[1])
        error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3][0], -30, 30))) - y) / len(y)
        back = error[:, None] * p[2] * (1 - hidden**2)
        grads = [x.T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * p[2], np.array([error.sum()])]
        for w, g, a, b in zip(p, grads, m1, m2):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def fit_temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
    loss = [np.logaddexp(0, np.where(y > 0, -logit, logit) / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _row_vectors(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = document_vectors(as_bytes(batch.column(0)), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["y", "features"])
    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> QualityModel:
    """Vectors of all documents; network of labelled rows outside fold 1 of 3."""
    vectors = context_vectors(docs)
    sample = materialize(training_rows(docs, labels, "quality", 3, 1, max_rows), "quality-rows")
    rows = sample.mapInArrow(_row_vectors(vectors), "y int, features binary").collect()
    rows.sort(key=lambda r: (r["features"], r["y"]))
    x = np.array([np.frombuffer(r["features"]) for r in rows]).reshape(-1, 2 * DIMS)
    y = np.array([r["y"] for r in rows], float)
    base = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        empty = (np.zeros((2 * DIMS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(base / (1 - base))))
        return QualityModel(vectors, np.zeros(2 * DIMS), np.ones(2 * DIMS), empty, 1.0)
    order = np.random.default_rng(1).permutation(len(y))
    x, y = x[order], y[order]
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    apart = np.arange(len(y)) % 5 == 0
    fit = ~apart if 0 < y[~apart].sum() < (~apart).sum() else np.ones(len(y), bool)
    model = QualityModel(vectors, centre, scale, fit_network((x[fit] - centre) / scale, y[fit]), 1.0)
    if apart.any():
        model.temperature = fit_temperature(model.logits(x[apart]), y[apart])
    return model


def score_column(model: QualityModel, text: Column) -> Column:
    """Calibrated probability that a text is good."""
    @F.arrow_udf("double")
    def good(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(model.probabilities(as_bytes(part)))
    return good(text)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5)."""
    return (docs.withColumn("score", score_column(model, F.col("text")))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
