"""Toxicity: character n-gram linear classifier scaled by naive Bayes ratios.

Features are the presence of character n-grams (3 to 6 bytes, inside lower-cased
words with their boundaries) hashed to 2**20 slots.  Each feature is scaled by
the log-count ratio of its slot between toxic and clean training texts, and a
logistic regression is fitted on the scaled features.  The fit uses at most
``max_rows`` labelled rows (lowest hash of doc_id first) and keeps the
``n_features`` slots with the largest class deviation, so the model has a fixed
size; scoring covers every whole text.

Defined cases: null or empty text scores as a text without features; rows with
a null doc_id are scored but never train; a null label is ignored; of several
labels of one doc_id the largest holds; repeated rows are scored alike; with no
usable training rows (or one class only) every score is the smoothed base rate.
Other columns of ``docs`` pass through; a column named like an added one is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmerge.llm.pretokens import shrink
from feedmerge.llm.runtime import fold, materialize
from feedmerge.llm.textarrays import as_bytes, mix

SLOT_BITS = 20
LENGTHS = (3, 4, 5, 6)
MAX_ROWS = 8_000
N_FEATURES = 5_000
CACHE_WORDS = 150_000


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character n-grams of each word, and the word they are from."""
    buf = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    slots, owners = [], []
    for n in LENGTHS:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(1099511628211) + buf[k:k + m]
        inside = owner[:m] == owner[n - 1:]
        slots.append((mix(h[inside] + np.uint64(n)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
        owners.append(owner[:m][inside])
    if not slots:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(slots), np.concatenate(owners)


def _text_slots(text: bytes) -> np.ndarray:
    words = list(set(text.lower().split()))
    return np.unique(word_grams(words)[0]) if words else np.zeros(0, np.int32)


@dataclass
class ToxicityModel:
    """``slots`` sorted; ``weights`` already multiplied by the ratios."""
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def score_texts(self, texts: list[bytes], cache: dict) -> np.ndarray:
        """Logit of each text.  ``cache``: word -> its kept features (or None)."""
        out = np.full(len(texts), self.bias)
        at, size = 0, 0
        group: list[set[bytes]] = []
        for k, text in enumerate(texts):
            group.append(set(text.lower().split()))
            size += len(text)
            if size >= 1 << 20 or k == len(texts) - 1:
                used = set().union(*group)
                shrink(cache, CACHE_WORDS, used)
                self._learn(used, cache)
                for i, words in enumerate(group):
                    kept = [f for w in words if (f := cache[w]) is not None]
                    if kept:
                        out[at + i] += self.weights[np.unique(np.concatenate(kept))].sum()
                at, size, group = k + 1, 0, []
        return out

    def _learn(self, words: set[bytes], cache: dict) -> None:
        new = [w for w in words if w not in cache]
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            slots, owner = word_grams(part)
            at = np.searchsorted(self.slots, slots)
            at[at == len(self.slots)] = 0
            hit = self.slots[at] == slots if len(self.slots) else np.zeros(len(slots), bool)
            cache.update(dict.fromkeys(part))
            owner, at = owner[hit], at[hit]
            order = np.argsort(owner, kind="stable")
            owner, at = owner[order], at[order]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
            for a, b in zip(first, np.r_[first[1:], len(owner)] if len(owner) else []):
                cache[part[owner[a]]] = at[a:b]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, max_rows: int) -> DataFrame:
    """(text, y) of at most ``max_rows`` labelled rows outside the held-out fold."""
    picked = (labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
              .where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & (fold("_id", mod) != held))
              .groupBy("_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    # at most max_rows small rows: the bound of this broadcast
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    return texts.join(F.broadcast(picked), "_id").select("text", "y")


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << SLOT_BITS), np.int32)
    for batch in batches:
        for text, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
            counts[y, _text_slots(text)] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[1, seen].astype(np.int64)),
                                      pa.array(counts[0, seen].astype(np.int64))], names=["slot", "p", "q"])


def _row_features(slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.flatnonzero(np.isin(slots, _text_slots(t), assume_unique=True)).astype(np.int32).tobytes()
                    for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(kept, pa.binary())], names=["y", "features"])
    return run


def fit_logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, scale: np.ndarray,
                 steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights (scaled) and bias of a logistic regression on sparse 0/1 rows."""
    w, b = np.full(len(scale), 0.05), -2.0
    m1, m2 = np.zeros(len(scale)), np.zeros(len(scale))
    for step in range(1, steps + 1):
        logit = np.bincount(rows, weights=(w * scale)[cols], minlength=len(y)) + b
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
        grad = np.bincount(cols, weights=error[rows], minlength=len(scale)) * scale / len(y) + 1e-4 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w -= 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * error.mean()
    return w * scale, float(b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, n_features: int = N_FEATURES) -> ToxicityModel:
    """Fit on the labelled rows of ``docs`` whose crc32 fold (mod 5) is not 0."""
    sample = materialize(training_rows(docs, labels, "toxic", 5, 0, max_rows), "toxic-rows")
    # at most 2**SLOT_BITS rows reach the driver
    table = (sample.mapInArrow(_slot_counts, "slot int, p long, q long").groupBy("slot")
             .agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toPandas())
    slot, p, q = (table[c].to_numpy() for c in ("slot", "p", "q"))
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    base = (pos + 1) / (pos + neg + 2)
    if not pos or not neg:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0), float(np.log(base / (1 - base))))
    ratio = np.log((p + 1) / (pos + 2)) - np.log((q + 1) / (neg + 2))
    seen = p + q
    rate = pos / (pos + neg)
    deviation = np.abs(p - seen * rate) / np.sqrt(seen * rate * (1 - rate))
    deviation[seen < 4] = 0
    best = np.lexsort((slot, -deviation))[:n_features]
    best = best[np.argsort(slot[best])]
    slots, scale = slot[best].astype(np.int32), ratio[best]
    # at most max_rows * n_features flags, one integer each where set
    rows = sample.mapInArrow(_row_features(slots), "y int, features binary").collect()
    cols = [np.frombuffer(r["features"], np.int32) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["y"], rows[i]["features"]))
    own = np.repeat(np.arange(len(rows)), [len(cols[i]) for i in order])
    y = np.array([rows[i]["y"] for i in order], float)
    weights, bias = fit_logistic(own, np.concatenate([cols[i] for i in order]), y, scale)
    return ToxicityModel(slots, weights, bias)


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Probability that a text is toxic."""
    @F.arrow_udf("double")
    def toxic(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for part in parts:
            logit = model.score_texts(as_bytes(part), cache)
            yield pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
    return toxic(text)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5)."""
    return (docs.withColumn("score", score_column(model, F.col("text")))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns."""
    return (docs.withColumn("_toxic", score_column(model, F.col("text")))
            .where(F.col("_toxic") < 0.5).drop("_toxic"))
