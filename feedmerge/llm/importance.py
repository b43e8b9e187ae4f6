"""Importance resampling towards a target corpus, with exact ranks.

1. Hashed features: runs of consecutive words fall into ``buckets`` by crc32.
   The source and the target are each counted into one dense array (a task adds
   up its own before the shuffle), and every bucket gets an integer gain, the
   floored log ratio of its smoothed frequencies.
2. Array-scored weights: a task lays its texts out as one byte array, finds the
   words, hashes all of them position by position, and adds up the gains of each
   document.  A draw that depends on the seed and the id alone turns the weight
   into a score (Gumbel top-k: drawing without replacement by exp(weight)).
3. Parallel sorting by regular sampling ranks the scores.  Each task writes
   sorted runs; every ``step``-th row of each run is the regular sample, and evenly
   spaced rows of the sorted sample are the splitters.  They cut each run into
   slices; the rows of one segment are exchanged and merged by one task, and the
   prefix counts of the segments make its places exact ranks.  Only segments
   that begin within the draw are exchanged.  A segment over twice
   ``SEGMENT_ROWS`` is cut again with a finer sample of its own, so no task holds
   more, whatever the order of the scores is.

The driver holds one gain a bucket, ``SAMPLES`` sample rows a segment, at most
``SAMPLE_ROWS`` (and one a run) at a time, and one splitter a segment.  Runs are written below
spark.checkpoint.dir; places in them break the last ties, so ranks do not change
when executors are lost.

Defined cases: null, empty and blank texts have no features and weight 0; a null
id draws like the empty id and comes last among equal scores; repeated rows are
rows of their own, each with a rank; an empty target or source leaves its
smoothed counts of one; without rows there is nothing to rank; extra columns pass
through ``draw`` and are replaced if named like the added ones.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmerge.llm.jaccard_join import _with_row_key
from feedmerge.llm.runtime import materialize, shuffle_partitions
from feedmerge.llm.textarrays import as_bytes

CHUNK = 1 << 20
LONG_WORD = 48          # longer words are hashed one by one
RUN_ROWS = 500_000
SEGMENT_ROWS = 500_000
SAMPLES = 64            # sample rows a segment
SAMPLE_ROWS = 500_000   # at most
MAX_SEGMENTS = 8_192

_WORD = np.zeros(256, bool)
_WORD[ord("0"):ord("9") + 1] = True
_WORD[ord("a"):ord("z") + 1] = True
_WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


@dataclass(frozen=True)
class Settings:
    max_run: int = 1        # features are runs of 1 to max_run words
    buckets: int = 10_000
    seed: int = 2024
    min_words: int = 20     # documents with fewer words are not drawn
    percent: int = 10       # of the others


def crc32_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each ``buf[start:end]``, all spans one byte at a time."""
    size = end - start
    out = np.zeros(len(start), np.uint32)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = zlib.crc32(buf[start[k]:end[k]].tobytes())
    short = np.flatnonzero(size <= LONG_WORD)
    order = short[np.argsort(LONG_WORD - size[short].astype(np.uint16), kind="stable")]
    left = np.searchsorted(-size[order], -np.arange(LONG_WORD), "left")  # spans with more than j bytes
    at, crc = start[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(LONG_WORD):
        k = left[j]
        if not k:
            break
        c = crc[:k]
        crc[:k] = _CRC[(c ^ buf[at[:k] + j]) & 0xFF] ^ (c >> 8)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = _WORD[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long lower-case text cut between words."""
    at = 0
    while at < len(text):
        to = min(at + CHUNK, len(text))
        while to < len(text) and _WORD[text[to]]:
            to += 1
        yield text[at:to]
        at = to


def _buckets_of(data: bytes, bounds: np.ndarray, settings: Settings, carried: int = 0):
    """Buckets of all runs in lower-case ``data`` and the document of each run;
    the words of each document; document k owns the bytes bounds[k]:bounds[k + 1].
    Runs that end within the first ``carried`` words are left out."""
    buf = np.frombuffer(data, np.uint8)
    start, end = _spans(buf)
    if settings.max_run > 1:  # lay the words out with single spaces between them
        size = end - start
        owner = np.searchsorted(bounds, start, "right") - 1
        end = np.cumsum(size + 1) - 1
        flat = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
        flat[np.arange(len(flat)) != np.repeat(end, size + 1)] = buf[_WORD[buf]]
        start, buf = end - size, flat
    else:
        owner = np.searchsorted(bounds, start, "right") - 1
    buckets, docs = [], []
    for run in range(1, settings.max_run + 1):
        n = max(0, len(start) - run + 1)
        keep = owner[:n] == owner[run - 1:run - 1 + n]
        keep &= np.arange(n) + run - 1 >= carried
        buckets.append(crc32_spans(buf, start[:n][keep], end[run - 1:run - 1 + n][keep]) % np.uint32(settings.buckets))
        docs.append(owner[:n][keep])
    words = np.bincount(owner[carried:], minlength=len(bounds) - 1)
    last = [buf[a:b].tobytes() for a, b in zip(start[-settings.max_run + 1:], end[-settings.max_run + 1:])] \
        if settings.max_run > 1 else []
    return np.concatenate(buckets).astype(np.int64), np.concatenate(docs), words, last


def features(texts: list[bytes], settings: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, buckets, document of each bucket counted from the
    first text, words) for runs of texts; a long text comes in several parts."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > CHUNK:
            carry: list[bytes] = []
            for piece in _pieces(texts[i].lower()):
                data = b" ".join([*carry, piece])
                bucket, doc, words, last = _buckets_of(data, np.array([0, len(data)]), settings, len(carry))
                yield i, 1, bucket, doc, words
                carry = last
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and len(texts[j]) <= CHUNK and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j]) + 1
            j += 1
        data = b" ".join(texts[i:j]).lower()
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        bucket, doc, words, _ = _buckets_of(data, bounds, settings)
        yield i, j - i, bucket, doc, words
        i = j


# ---- gains -----------------------------------------------------------------

def bucket_counts(texts: DataFrame, settings: Settings) -> np.ndarray:
    """Features of each bucket over all rows of (text): one dense array."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for _, _, bucket, _, _ in features(as_bytes(batch.column(0)), settings):
                total += np.bincount(bucket, minlength=settings.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(settings.buckets, np.int64)
    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in rows.collect():  # one row a bucket
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets."""
    b = len(source)
    total_s, total_t = float(int(source.sum()) + b), float(int(target.sum()) + b)
    return np.array([math.floor(1000 * math.log(float(t + 1) * total_s / (float(s + 1) * total_t)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def draw_noise(doc_id: int | None, seed: int) -> int:
    """floor of 1000 Gumbel variates, from the seed and the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


# ---- sorted runs -----------------------------------------------------------

#: ``place`` is the row's place in its sorted run, null if it cannot be drawn
RUNS = "run long, place long, row long, doc_id long, n_features long, weight long, score long"
_RUN_NAMES = ["run", "place", "row", "doc_id", "n_features", "weight", "score"]


def _id_order(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sort keys of ids: values, and whether they are null (last)."""
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)


def _score_runs(gains: np.ndarray, settings: Settings):
    def sorted_run(run: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        row, ids = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
        n_words, n_features, weight, score = (np.concatenate([h[k] for h in held]) for k in range(2, 6))
        value, none = _id_order(ids)
        can = n_words >= settings.min_words
        order = np.lexsort((value, none, -score, ~can))
        place = np.arange(len(order))
        table = pa.Table.from_arrays([
            pa.array(np.full(len(order), run)), pa.array(place, mask=~can[order]), row.take(pa.array(order)),
            ids.take(pa.array(order)), pa.array(n_features[order]), pa.array(weight[order]), pa.array(score[order])],
            names=_RUN_NAMES)
        yield from table.to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for first, k, bucket, doc, words in features(as_bytes(batch.column(2)), settings):
                part = slice(first, first + k)
                n_words[part] += words
                n_features[part] += np.bincount(doc, minlength=k)
                weight[part] += np.bincount(doc, gains[bucket], minlength=k).astype(np.int64)
            ids = batch.column(1).cast(pa.int64())
            noise = np.fromiter((draw_noise(i, settings.seed) for i in ids.to_pylist()), np.int64, n)
            held.append((batch.column(0), ids, n_words, n_features, weight, weight + noise))
            size += n
            if size >= RUN_ROWS:
                yield from sorted_run(name, held)
                name, held, size = name + 1, [], 0
        if size:
            yield from sorted_run(name, held)
    return run


# ---- splitters and segments -------------------------------------------------

_KEY = ["score", "doc_id", "run", "place"]


def _key_columns(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """Columns of the sort key of rows, most significant first."""
    column = {c: table.column(c) for c in _KEY}
    column = {c: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for c, v in column.items()}
    value, none = _id_order(column["doc_id"])
    return [-column["score"].to_numpy(zero_copy_only=False), none.astype(np.int64), value,
            column["run"].to_numpy(zero_copy_only=False), column["place"].to_numpy(zero_copy_only=False)]


def _sorted_keys(columns: list[np.ndarray]) -> np.ndarray:
    """The keys as sorted rows."""
    return np.stack(columns, axis=1)[np.lexsort(columns[::-1])]


def _segments(splitters: np.ndarray):
    """Adds ``segment``: the number of splitters at or before the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(splitters)
        for batch in batches:
            both = [np.concatenate([splitters[:, c], own]) for c, own in enumerate(_key_columns(batch))]
            mark = np.r_[np.zeros(k, np.int64), np.ones(batch.num_rows, np.int64)]  # splitters first among equals
            order = np.lexsort([mark, *both[::-1]])
            segment = np.empty(k + batch.num_rows, np.int64)
            segment[order] = np.cumsum(order < k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment[k:])], names=[*_RUN_NAMES, "segment"])
    return run


def _sample(rows: DataFrame, step: int) -> np.ndarray:
    """Sorted keys of every step-th row of each run."""
    picked = rows.where(F.col("place") % step == 0).select(*_KEY).toArrow()
    return _sorted_keys(_key_columns(picked))


def _evenly(keys: np.ndarray, parts: int) -> np.ndarray:
    """The keys that cut sorted keys into about ``parts`` equal parts."""
    at = np.unique(np.arange(1, parts) * len(keys) // parts)
    return keys[at[(at > 0) & (at < len(keys))]]


def _cut(runs: DataFrame, total: int, take: int, segment_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows of the runs with their segment, and for each segment the number of
    rows before it; segments within the draw are of a bounded size."""
    spark = runs.sparkSession
    parts = min(MAX_SEGMENTS, max(-(-total // segment_rows), shuffle_partitions(spark)))
    step = max(1, -(-total // min(SAMPLE_ROWS, SAMPLES * parts)))
    keys = _sample(runs, step)
    splitters = _evenly(keys, parts)
    while True:
        rows = runs.mapInArrow(_segments(splitters), f"{RUNS}, segment long")
        counts = sorted((s, n) for s, n in rows.groupBy("segment").count().collect())
        before, sofar, large = {}, 0, []
        for segment, n in counts:
            before[segment] = sofar
            if n > 2 * segment_rows and sofar < take:
                large.append((segment, n))
            sofar += n
        if not large or step == 1:
            return rows, before
        again = sum(n for _, n in large)
        step = min(max(1, step // 8), max(1, -(-again // SAMPLE_ROWS)))
        keys = _sample(rows.where(F.col("segment").isin([s for s, _ in large])), step)
        size = dict(large)
        # the keys of each large segment lie between its two splitters
        lows = [splitters[s - 1] if s else None for s, _ in large]
        new = [splitters]
        starts = [0 if low is None else _first_at(keys, low) for low in lows] + [len(keys)]
        for k, (s, _) in enumerate(large):
            new.append(_evenly(keys[starts[k]:starts[k + 1]], -(-size[s] // segment_rows)))
        splitters = np.concatenate(new)
        splitters = np.unique(splitters[np.lexsort(splitters.T[::-1])], axis=0)


def _first_at(keys: np.ndarray, low: np.ndarray) -> int:
    """Place of the first of sorted keys that is not below ``low``."""
    a, b = 0, len(keys)
    while a < b:
        mid = (a + b) // 2
        if tuple(keys[mid]) < tuple(low):
            a = mid + 1
        else:
            b = mid
    return a


RANKED = "row long, doc_id long, n_features long, weight long, score long, rank long"
_RANKED_NAMES = ["row", "doc_id", "n_features", "weight", "score", "rank"]


def _merge(before: dict[int, int], take: int):
    def merge(table: pa.Table) -> pa.Table:
        """One segment: its sorted slices merged, ranks from its prefix count."""
        order = np.lexsort(_key_columns(table)[::-1])
        rank = before[table["segment"][0].as_py()] + 1 + np.arange(len(order))
        rows = table.take(pa.array(order))
        return pa.table([*(rows[c] for c in _RANKED_NAMES[:-1]), pa.array(rank, mask=rank > take)],
                        names=_RANKED_NAMES)
    return merge


def ranked(docs: DataFrame, target: DataFrame, settings: Settings = Settings(),
           segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(row, doc_id, n_features, weight, score, rank) for every row of ``docs``
    (row, doc_id, text); rank is null for rows that are not drawn."""
    gains = bucket_gains(bucket_counts(docs, settings), bucket_counts(target, settings))
    runs = materialize(docs.select("row", "doc_id", "text").mapInArrow(_score_runs(gains, settings), RUNS),
                       "importance-runs")
    drawable = runs.where("place is not null")
    total = drawable.count()
    take = settings.percent * total // 100
    names = _RANKED_NAMES[:-1]
    undrawn = F.lit(None).cast("long").alias("rank")
    if not take:
        return runs.select(*names, undrawn)
    rows, before = _cut(drawable, total, take, segment_rows)
    within = [s for s, n in before.items() if n < take]
    last = max(within)
    merged = rows.where(F.col("segment") <= last).groupBy("segment").applyInArrow(_merge(before, take), RANKED)
    rest = rows.where(F.col("segment") > last).select(*names, undrawn)
    return merged.unionByName(rest).unionByName(runs.where("place is null").select(*names, undrawn))


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of (doc_id, text)."""
    return ranked(docs.select(F.lit(None).cast("long").alias("row"), "doc_id", "text"), target, settings).drop("row")


def draw(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The drawn rows of ``docs`` with n_features, weight, score and rank."""
    added = ["n_features", "weight", "score", "rank"]
    keyed = _with_row_key(docs.drop(*added))
    drawn = (ranked(keyed.select(F.col("_row").alias("row"), "doc_id", "text"), target, settings)
             .where("rank is not null").select(F.col("row").alias("_row"), *added))
    return keyed.join(drawn, "_row").drop("_row")


def _oracle(settings: Settings) -> str:
    """DuckDB SQL of ``resample`` over documents and benchmark."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = (r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (upper, lower))
    table = f"[{', '.join(map(str, _CRC.tolist()))}]"
    b = settings.buckets
    return f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
d AS (SELECT r, unnest(w) AS f FROM docs),
t AS (SELECT unnest({words}) AS f FROM benchmark),
vocab AS (SELECT DISTINCT f FROM (SELECT f FROM d UNION ALL SELECT f FROM t)),
crc AS (
  SELECT f, hex(encode(f)) AS x, 0 AS i, 4294967295::BIGINT AS c FROM vocab
  UNION ALL
  SELECT f, x, i + 2, xor(({table}::BIGINT[])[1 + (xor(c, ('0x' || substr(x, i + 1, 2))::BIGINT) & 255)], c >> 8)
  FROM crc WHERE i < length(x)),
bucket AS MATERIALIZED (SELECT f, xor(c, 4294967295) % {b} AS k FROM crc WHERE i = length(x)),
s AS (SELECT k, count(*) AS n FROM d JOIN bucket USING (f) GROUP BY k),
u AS (SELECT k, count(*) AS n FROM t JOIN bucket USING (f) GROUP BY k),
gain AS (
  SELECT k, CAST(floor(1000 * ln((coalesce(u.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {b})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM u) + {b})::DOUBLE))) AS BIGINT) AS g
  FROM s FULL JOIN u USING (k)),
weight AS (SELECT r, sum(g) AS weight FROM d JOIN bucket USING (f) JOIN gain USING (k) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('{settings.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weight USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () AS total
  FROM scored WHERE n_features >= {settings.min_words})
SELECT doc_id, n_features, weight, score,
  CASE WHEN n <= {settings.percent} * total // 100 THEN n END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""


ORACLE = _oracle(Settings())
