"""Interpolated modified Kneser-Ney bigram model in memory-mapped hash arrays.

Counting runs in Spark: map tasks add up the bigrams of a block before the
shuffle, then each shard merges its blocks.  A shard holds all bigrams of its
contexts, except for very common contexts (over 1 / HOT_SHARE of the words of a
bounded sample; at most HOT_SHARE of them), whose bigrams are spread over all
shards, so no shard grows with one word.  The sample only steers the routing;
the counts cover all training rows.

The model is stored below spark.checkpoint.dir as raw sorted arrays: for each
shard the bigram hashes with their counts, the contexts with their totals and
types, and for each word shard the word hashes with their counts and numbers
of contexts.  Workers map these files (a shared folder that is not a local path
is read through pyarrow instead) and look up sorted, distinct queries, so pages
are touched in order.

The order is two: bigrams with 64-bit word hashes already take about one input
in shuffle; trigrams would need more than the space allowed for the job.

Defined cases: A-Z are lower-cased; null, empty and blank texts are one end
token; a null id never trains and is not held out; repeated rows train and are
scored each; without training rows every probability is 1 (log 0); other columns
pass through and those named like the added ones are replaced.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmerge.llm.jaccard_join import pack, unpack
from feedmerge.llm.runtime import materialize, scratch_path, shuffle_partitions
from feedmerge.llm.textarrays import as_bytes, hashed, mix

_U = np.uint64
BEGIN = _U(0x1B873593CC9E2D51)
END = _U(0x9E3779B185EBCA87)
HOT_SHARE = 1000
SAMPLE_ROWS = 20_000
BLOCK_TOKENS = 2_000_000
SCORE_TOKENS = 1_000_000


def sequences(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and tokens of consecutive documents, and each one's tokens:
    the words and one end, after a begin that is never predicted."""
    n = len(bounds) - 1
    size = np.diff(bounds) + 1
    ends = np.cumsum(size) - 1
    token = np.empty(len(h) + n, np.uint64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = h
    token[ends] = END
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[np.r_[0, ends[:-1] + 1]] = BEGIN
    return context, token, size


def bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _U(0xD6E8FEB86659FD93) + w)


def shard_of(v: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    route = np.where(np.isin(v, hot), mix(v ^ mix(w)), mix(v + _U(1))) if len(hot) else mix(v + _U(1))
    return ((route >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def word_shard(w: np.ndarray, shards: int) -> np.ndarray:
    return ((w >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination starts in columns sorted together."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# ---- files -----------------------------------------------------------------

def _write(path: str, values: np.ndarray) -> None:
    """The array's bytes; a second attempt of the task writes the same file."""
    fs, at = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    fs.create_dir(os.path.dirname(at), recursive=True)
    context = TaskContext.get()
    part = f"{at}.{context.taskAttemptId() if context else 0}"
    with fs.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    fs.move(part, at)


def _map(path: str, kind: str) -> np.ndarray:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        if not os.path.exists(url.path) or not os.path.getsize(url.path):
            return np.zeros(0, kind)
        return np.memmap(url.path, kind, "r")
    fs, at = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return np.zeros(0, kind)
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read(), kind)


# ---- counting --------------------------------------------------------------

BLOCKS = "shard int, contexts binary, runs binary, words binary, counts binary"


def _count_blocks(hot: np.ndarray, shards: int):
    def rows(v: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        shard = shard_of(v, w, hot, shards)
        order = np.lexsort((w, v, shard))
        v, w, shard = v[order], w[order], shard[order]
        at = _runs(shard, v, w)
        count = np.diff(np.r_[at, len(v)])
        v, w, shard = v[at], w[at], shard[at]
        first = np.searchsorted(shard, np.arange(shards + 1))
        out: list[tuple] = []
        for s in np.flatnonzero(np.diff(first)).tolist():
            a, b = first[s], first[s + 1]
            start = _runs(v[a:b])
            out.append((s, pack(v[a:b][start]), np.diff(np.r_[start, b - a]).astype(np.uint32).tobytes(),
                        w[a:b].tobytes(), count[a:b].astype(np.uint32).tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                          names=["shard", "contexts", "runs", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, h, bounds in hashed(as_bytes(batch.column(0)), lower=True):
                v, w, _ = sequences(h, bounds)
                held.append((v, w))
                size += len(v)
                if size >= BLOCK_TOKENS:
                    yield rows(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield rows(*map(np.concatenate, zip(*held)))
    return run


#: kind w: words of a word shard; kind v: part of a common context; kind n: totals
PARTS = "kind string, key long, a binary, b binary, c binary, x1 long, x2 long, x3 long, x4 long"
_PART_NAMES = ["kind", "key", "a", "b", "c", "x1", "x2", "x3", "x4"]
_PART_KINDS = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 4)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PART_KINDS)], names=_PART_NAMES)


def _classes(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def word_shards(shards: int) -> int:
    """Word shards: few enough that shards times word shards stay few rows."""
    return 2 * max(1, math.isqrt(shards))


def _merge_shard(folder: str, hot: np.ndarray, shards: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        v = np.concatenate([np.repeat(unpack(c), np.frombuffer(r, np.uint32)) for c, r in
                            zip(table["contexts"].to_pylist(), table["runs"].to_pylist())])
        w = np.concatenate([np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()])
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64)
        order = np.lexsort((w, v))
        v, w, c = v[order], w[order], c[order]
        at = _runs(v, w)
        v, w, c = v[at], w[at], np.add.reduceat(c, at)
        rows: list[tuple] = [("n", 0, None, None, None, *_classes(c))]

        at = _runs(v)
        stats = np.column_stack([np.add.reduceat(c, at), *(np.add.reduceat((test).astype(np.int64), at)
                                                          for test in (c == 1, c == 2, c > 2))])
        common = np.isin(v[at], hot)
        for key, line in zip(v[at][common].view(np.int64).tolist(), stats[common].tolist()):
            rows.append(("v", key, None, None, None, *line))
        _write(f"{folder}/context-{shard}.keys", v[at][~common])
        _write(f"{folder}/context-{shard}.stats", stats[~common].astype(np.int64))

        key = bigram_key(v, w)
        order = np.argsort(key)
        _write(f"{folder}/bigram-{shard}.keys", key[order])
        _write(f"{folder}/bigram-{shard}.counts", np.minimum(c[order], 0xFFFFFFFF).astype(np.uint32))

        order = np.argsort(w, kind="stable")
        w, c = w[order], c[order]
        at = _runs(w)
        word, contexts, times = w[at], np.diff(np.r_[at, len(w)]), np.add.reduceat(c, at)
        parts = word_shards(shards)
        first = np.searchsorted(word_shard(word, parts), np.arange(parts + 1))
        for s in np.flatnonzero(np.diff(first)).tolist():
            a, b = first[s], first[s + 1]
            rows.append(("w", s, pack(word[a:b]), contexts[a:b].astype(np.uint32).tobytes(),
                         times[a:b].astype(np.uint64).tobytes(), 0, 0, 0, 0))
        return _table(rows)
    return run


def _merge_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table["key"][0].as_py()
        w = np.concatenate([unpack(x) for x in table["a"].to_pylist()])
        contexts = np.concatenate([np.frombuffer(x, np.uint32) for x in table["b"].to_pylist()]).astype(np.int64)
        times = np.concatenate([np.frombuffer(x, np.uint64) for x in table["c"].to_pylist()]).astype(np.int64)
        order = np.argsort(w, kind="stable")
        w, contexts, times = w[order], contexts[order], times[order]
        at = _runs(w)
        w, contexts, times = w[at], np.add.reduceat(contexts, at), np.add.reduceat(times, at)
        _write(f"{folder}/word-{shard}.keys", w)
        _write(f"{folder}/word-{shard}.contexts", contexts.astype(np.int64))
        _write(f"{folder}/word-{shard}.counts", times.astype(np.int64))
        return _table([("n", 0, None, None, None, *_classes(contexts)),
                       ("t", 0, None, None, None, len(w), int(contexts.sum()), int(times.sum()),
                        int((contexts > 2).sum()))])
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, kept between 0 and the count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 and n2 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5
    return np.array([0.0, min(max(d1, 0.05), 1), min(max(d2, 0.05), 2), min(max(d3, 0.05), 3)])


class Model:
    """Where the arrays are, and the model's few numbers."""

    def __init__(self, folder: str, shards: int, hot: np.ndarray, hot_stats: np.ndarray,
                 pair: np.ndarray, single: np.ndarray, words: int, types: int, tokens: int, often: int,
                 n_single: list[int]):
        self.folder, self.shards = folder, shards
        self.hot, self.hot_stats = hot, hot_stats
        self.pair, self.single = pair, single
        self.words, self.types, self.tokens = words, types, tokens
        mass = single[1] * n_single[0] + single[2] * n_single[1] + single[3] * often
        self.uniform = (mass / types if types else 1.0) / (words + 1)

    def _find(self, name: str, shard: np.ndarray, key: np.ndarray, kinds: dict[str, tuple[str, int]],
              maps: dict) -> dict[str, np.ndarray]:
        """Values of sorted (shard, key) queries; zeros where there are none."""
        out = {k: np.zeros((len(key), width) if width > 1 else len(key), np.int64) for k, (_, width) in kinds.items()}
        for s in np.unique(shard).tolist():
            a, b = np.searchsorted(shard, [s, s + 1])
            if (name, s) not in maps:
                base = f"{self.folder}/{name}-{s}"
                maps[name, s] = (_map(f"{base}.keys", "u8"),
                                 {k: _map(f"{base}.{k}", kind) for k, (kind, _) in kinds.items()})
            keys, values = maps[name, s]
            if not len(keys):
                continue
            at = np.searchsorted(keys, key[a:b])
            at[at == len(keys)] = 0
            hit = keys[at] == key[a:b]
            for k, (_, width) in kinds.items():
                found = values[k].reshape(-1, width)[at[hit]] if width > 1 else values[k][at[hit]]
                out[k][a:b][hit] = found
        return out

    def score(self, v: np.ndarray, w: np.ndarray, maps: dict) -> tuple[np.ndarray, np.ndarray]:
        """Count of each token and log10 of its probability after its context."""
        word, index = np.unique(w, return_inverse=True)
        got = self._find("word", word_shard(word, word_shards(self.shards)), word, {"contexts": ("i8", 1), "counts": ("i8", 1)}, maps)
        count = got["counts"][index]
        types = got["contexts"]
        low = np.maximum(types - self.single[np.minimum(types, 3)], 0) / max(self.types, 1) + self.uniform
        low = low[index]

        context, where = np.unique(v, return_inverse=True)
        stats = np.zeros((len(context), 4), np.int64)
        shard = shard_of(context, context, np.zeros(0, np.uint64), self.shards)
        order = np.lexsort((context, shard))
        stats[order] = self._find("context", shard[order], context[order], {"stats": ("i8", 4)}, maps)["stats"]
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            is_hot = self.hot[at] == context
            stats[is_hot] = self.hot_stats[at[is_hot]]
        total = stats[:, 0]
        gamma = np.where(total > 0, stats[:, 1:] @ self.pair[1:] / np.maximum(total, 1), 1.0)

        key = bigram_key(v, w)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        bv, bw, bk = v[first], w[first], key[first]
        shard = shard_of(bv, bw, self.hot, self.shards)
        order = np.lexsort((bk, shard))
        pairs = np.empty(len(bk), np.int64)
        pairs[order] = self._find("bigram", shard[order], bk[order], {"counts": ("u4", 1)}, maps)["counts"]
        pairs = pairs[back]
        high = np.maximum(pairs - self.pair[np.minimum(pairs, 3)], 0) / np.maximum(total, 1)[where]
        return count, np.log10(high + gamma[where] * low)


def train(docs: DataFrame) -> Model:
    """Count the texts of ``docs`` and store the model's arrays."""
    spark = docs.sparkSession
    shards = 4 * shuffle_partitions(spark)
    folder = scratch_path(spark, "kneser-ney")
    texts = docs.select("text")
    rows = texts.count()
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    common = texts.sample(False, share, 11).mapInArrow(_sample_counts, "key long, n long")
    common = common.groupBy("key").agg(F.sum("n").alias("n"))
    total = common.agg(F.sum("n")).first()[0] or 0
    # at most HOT_SHARE rows: each has over 1 / HOT_SHARE of the sample
    hot = np.array(sorted(r["key"] & 0xFFFFFFFFFFFFFFFF for r in
                          common.where(F.col("n") * HOT_SHARE > total).collect()), np.uint64)
    blocks = texts.mapInArrow(_count_blocks(hot, shards), BLOCKS)
    parts = materialize(blocks.groupBy("shard").applyInArrow(_merge_shard(folder, hot, shards), PARTS), "bigram-parts")
    sums = [F.sum(f"x{k}").alias(f"x{k}") for k in (1, 2, 3, 4)]
    pair = parts.where("kind = 'n'").agg(*sums).first()
    lines = parts.where("kind = 'v'").groupBy("key").agg(*sums).collect()
    words = materialize(parts.where("kind = 'w'").groupBy("key").applyInArrow(_merge_words(folder), PARTS), "word-parts")
    numbers = {r["kind"]: [r[f"x{k}"] or 0 for k in (1, 2, 3, 4)] for r in words.groupBy("kind").agg(*sums).collect()}
    n_words, types, tokens, often = numbers.get("t", [0, 0, 0, 0])
    n_single = numbers.get("n", [0, 0, 0, 0])
    stats = {r["key"] & 0xFFFFFFFFFFFFFFFF: [r["x1"], r["x2"], r["x3"], r["x4"]] for r in lines}
    hot_stats = np.array([stats.get(int(k), [0, 0, 0, 0]) for k in hot], np.int64).reshape(-1, 4)
    return Model(folder, shards, hot, hot_stats, discounts(*[pair[f"x{k}"] or 0 for k in (1, 2, 3, 4)]),
                 discounts(*n_single), n_words, types, tokens, often, n_single)


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, h, bounds in hashed(as_bytes(batch.column(0)), lower=True):
            key, n = np.unique(sequences(h, bounds)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))],
                                             names=["key", "n"])


SCORES = "struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double>"


def score_column(text: Column, model: Model) -> Column:
    """Tokens, known tokens, add-one unigram score and the model's log10."""
    @F.arrow_udf(SCORES)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        maps: dict = {}
        for part in parts:
            n = len(part)
            out = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)]
            held: list[tuple] = []
            size = 0

            def flush() -> None:
                v, w, sizes = (np.concatenate(x) for x in zip(*[h[1:] for h in held]))
                rows = np.concatenate([np.arange(h[0], h[0] + len(h[3])) for h in held])
                count, logs = model.score(v, w, maps)
                start = np.r_[0, np.cumsum(sizes)[:-1]]
                base = np.log10((count + 1) / (model.tokens + model.words + 1))
                out[0][rows] = sizes
                out[1][rows] = np.add.reduceat((count > 0).astype(np.int64), start)
                out[2][rows] = np.add.reduceat(base, start)
                out[3][rows] = np.add.reduceat(logs, start)

            for first, h, bounds in hashed(as_bytes(part), lower=True):
                held.append((first, *sequences(h, bounds)))
                size += len(held[-1][1])
                if size >= SCORE_TOKENS:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            yield pa.StructArray.from_arrays([pa.array(c) for c in out], ["n_tokens", "n_known", "base_score", "score"])
    return run(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score, score and
    perplexity (10 ** (-score / n_tokens))."""
    names = ("n_tokens", "n_known", "base_score", "score")
    out = docs.withColumn("_scores", score_column(F.col("text"), model))
    return (out.withColumns({c: F.col("_scores")[c] for c in names}).drop("_scores")
            .withColumn("train_tokens", F.lit(model.tokens).cast("long"))
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
