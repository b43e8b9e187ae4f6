"""Substring dedup: windows of 35 words that also start anywhere else.

A window's minimiser is the least hash among its 32 runs of four words.
Consecutive windows with one minimiser travel as one packed string (a super
k-mer) to the minimiser's bucket, so equal windows meet and a word travels about
three times, not 35 times.  A bucket numbers its words exactly, sorts the
windows by a hash, compares the words of neighbours in that order, and so counts
every window exactly.  A minimiser may be frequent and its bucket large: there the
windows are hashed in steps and compared in parts by hash, so that a word costs
little more than its number and its window's hash.

A block sends each distinct string once.  A string that a block holds twice is
known to repeat: it goes without its places, which the block keeps for itself.
So a passage in a third of all documents costs one string a block, and no bucket
gathers its places.  The covered word ranges go back to the block, whose
document table turns them into ranges by document.

Defined cases: words are runs without white space, unchanged; null, empty and
short texts keep all words; repeated rows are separate documents (so each
repeats the other); a null id is an id like any other; other columns pass
through and those named like the added ones are replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmerge.llm.runtime import materialize, shuffle_partitions
from feedmerge.llm.textarrays import as_bytes, hashed_spans, mix, ngram_hashes

WINDOW = 35
RUN = 4                        # words of a minimiser
SPAN = WINDOW - RUN + 1        # runs of a window: a power of two
BLOCK_WORDS = 1_000_000
BLOCK_DOCS = 60_000
STEP_WORDS = 500_000           # of a bucket: words hashed, and windows compared, at once
_U = np.uint64


def minimisers(h: np.ndarray) -> np.ndarray:
    """Least run hash of each window of a sequence of word hashes."""
    least, width = ngram_hashes(h, RUN), 1
    while width < SPAN:
        if len(least) <= width:
            return np.zeros(0, np.uint64)
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return least


def super_kmers(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, minimiser) of each super k-mer."""
    least = minimisers(h)
    size = np.diff(bounds)
    count = np.maximum(size - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(size)), count)
    window = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][doc]
    if not len(window):
        return doc, window, window, np.zeros(0, np.uint64)
    least = least[window]
    new = np.flatnonzero(np.r_[True, (window[1:] != window[:-1] + 1) | (least[1:] != least[:-1])])
    return doc[new], window[new], np.diff(np.r_[new, len(window)]), least[new]


FORWARD = "key long, block long, a binary, b binary, c binary, d binary, ids array<long>, prints array<long>"
_NAMES = ["key", "block", "a", "b", "c", "d", "ids", "prints"]
_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(),
          pa.list_(pa.int64()), pa.list_(pa.int64()))


class _Block:
    """Super k-mers of some documents, equal strings together."""

    def __init__(self, number: int):
        self.number, self.words = number, 0
        self.ids: list = []
        self.prints: list = []
        self.index: dict[bytes, int] = {}
        self.places: list[list[tuple[int, int, int]]] = []   # (document, first word, windows)
        self.minimiser: list[int] = []

    def add(self, ids: list, prints: list, run: tuple) -> None:
        _, data, start, end, h, bounds = run
        base = len(self.ids)
        self.ids += ids
        self.prints += prints
        self.words += len(h)
        doc, window, count, least = super_kmers(h, bounds)
        if not len(doc):
            return
        first, last = start[window], end[window + count + WINDOW - 2]
        for d, a, b, w, n, m in zip((doc + base).tolist(), first.tolist(), last.tolist(),
                                    (window - bounds[doc]).tolist(), count.tolist(), least.tolist()):
            text = data[a:b]
            k = self.index.setdefault(text, len(self.places))
            if k == len(self.places):
                self.places.append([])
                self.minimiser.append(m)
            self.places[k].append((d, w, n))

    def rows(self, buckets: int) -> pa.RecordBatch:
        texts = list(self.index)
        bucket = ((np.array(self.minimiser, np.uint64) >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(buckets + 1))
        # places of strings that this block holds twice or more
        own = np.array([(d, w, w + n + WINDOW - 1) for p in self.places if len(p) > 1 for d, w, n in p],
                       np.uint32).reshape(-1, 3)
        out = [(-1 - self.number, self.number, own.tobytes(), None, None, None, self.ids, self.prints)]
        codec = pa.Codec("zstd")
        for k in np.flatnonzero(np.diff(first)).tolist():
            chosen = order[first[k]:first[k + 1]].tolist()
            joined = b"".join(texts[i] for i in chosen)
            sizes = np.array([len(texts[i]) for i in chosen], np.uint32)
            # document and first word of a single place; all ones if there are more
            places = np.array([self.places[i][0][:2] if len(self.places[i]) == 1 else (0xFFFFFFFF, 0)
                               for i in chosen], np.uint32)
            out.append((k, self.number, codec.compress(joined, asbytes=True), sizes.tobytes(),
                        places[:, 0].tobytes(), places[:, 1].tobytes(), None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], names=_NAMES)


def _forward(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids, prints = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in hashed_spans(as_bytes(batch.column(2))):
                first, n = part[0], len(part[5]) - 1
                if len(block.ids) + n > BLOCK_DOCS:
                    yield block.rows(buckets)
                    block = _Block(block.number + 1)
                block.add(ids[first:first + n], prints[first:first + n], part)
                if block.words >= BLOCK_WORDS:
                    yield block.rows(buckets)
                    block = _Block(block.number + 1)
        if block.ids:
            yield block.rows(buckets)
    return run


def _window_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW numbers from each place on."""
    one = mix(ids.astype(np.uint64) + _U(1))
    join = lambda a, b: mix(a * _U(0xD6E8FEB86659FD93) + b)
    two = join(one[:-1], one[1:])
    three = join(two[:-1], one[2:])
    wide, width = two, 2
    while width < SPAN:
        wide = join(wide[:-width], wide[width:])
        width *= 2
    return join(wide[:len(ids) - WINDOW + 1], three[width:width + len(ids) - WINDOW + 1])


def _all_hashes(ids: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of all windows of strings (of ``length`` words, one after another)."""
    end = np.cumsum(length)
    out, at = np.empty(int((length - WINDOW + 1).sum()), np.uint64), 0
    first = 0
    while first < len(length):
        base = int(end[first] - length[first])
        last = max(first + 1, int(np.searchsorted(end, base + STEP_WORDS, "right")))
        h = _window_hashes(ids[base:int(end[last - 1])])
        inside = np.ones(len(h), bool)  # windows over the end of a string are none
        for k in range(1, WINDOW):
            inside[end[first:last - 1] - base - k] = False
        h = h[inside]
        out[at:at + len(h)] = h
        first, at = last, at + len(h)
    return out


def _groups(ids: np.ndarray, place: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number for each window (by place and hash), equal exactly for equal windows."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    view = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    wrong = []
    at = np.flatnonzero(same)
    for k in range(0, len(at), 20_000):
        part = at[k:k + 20_000]
        equal = (view[place[order[part]]] == view[place[order[part + 1]]]).all(axis=1)
        wrong.append(part[~equal])
    group = np.empty(len(place), np.int64)
    group[order] = np.cumsum(np.r_[True, ~same]) - 1
    for g in np.unique(group[order[np.concatenate(wrong)]]).tolist() if wrong else []:
        # one hash for different windows: number them by their words
        members = np.flatnonzero(group == g)
        seen: dict[bytes, int] = {}
        for i in members.tolist():
            group[i] = seen.setdefault(view[place[i]].tobytes(), g if not seen else int(group.max()) + 1)
    return group


REPLY = "block long, ranges binary, ids array<long>, prints array<long>"
_REPLY_NAMES = ["block", "ranges", "ids", "prints"]
_REPLY_KINDS = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))


def _count(table: pa.Table) -> pa.Table:
    """One bucket: covered word ranges of each block's documents."""
    if table["key"][0].as_py() < 0:
        columns = (table["block"], table["a"], table["ids"], table["prints"])
        return pa.table([c.cast(t) for c, t in zip(columns, _REPLY_KINDS)], names=_REPLY_NAMES)
    codec = pa.Codec("zstd")
    blocks = table["block"].to_pylist()
    number: dict[bytes, int] = {}
    ids, lengths, rows = array("i"), [], []
    for k, (packed, sizes) in enumerate(zip(table["a"].to_pylist(), table["b"].to_pylist())):
        sizes = np.frombuffer(sizes, np.uint32)
        joined = codec.decompress(packed, int(sizes.sum()), asbytes=True)
        ends = np.cumsum(sizes).tolist()
        for a, b in zip([0, *ends[:-1]], ends):
            words = joined[a:b].split()
            lengths.append(len(words))
            ids.extend([number.setdefault(w, len(number)) for w in words])
        rows.append(np.full(len(sizes), k))
    number.clear()
    ids, length, row = np.frombuffer(ids, np.int32), np.array(lengths, np.int64), np.concatenate(rows)
    doc = np.concatenate([np.frombuffer(x, np.uint32) for x in table["c"].to_pylist()])
    word = np.concatenate([np.frombuffer(x, np.uint32) for x in table["d"].to_pylist()]).astype(np.int64)
    begin = np.cumsum(length) - length
    windows = length - WINDOW + 1
    before = np.cumsum(windows) - windows
    single = doc != 0xFFFFFFFF

    def located(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        string = np.searchsorted(before, window, "right") - 1
        return string, window - before[string] + begin[string]

    hashes = _all_hashes(ids, length)
    again = np.zeros(len(hashes), bool)
    bits = (len(hashes) // STEP_WORDS).bit_length()
    for part in range(1 << bits):  # equal windows have one hash, so they are in one part
        window = np.flatnonzero(hashes >> _U(64 - bits) == part) if bits else np.arange(len(hashes))
        if len(window):
            string, place = located(window)
            group = _groups(ids, place, hashes[window])
            weight = np.where(single, 1, 2)[string]
            again[window[(np.bincount(group, weights=weight)[group] > 1) & single[string]]] = True
    string, place = located(np.flatnonzero(again))
    if not len(place):
        return pa.table([pa.array([], t) for t in _REPLY_KINDS], names=_REPLY_NAMES)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | (string[1:] != string[:-1])])
    last = np.r_[new[1:], len(place)] - 1
    string, start, stop = string[new], place[new], place[last] + WINDOW
    shift = word[string] - begin[string]
    ranges = np.column_stack([doc[string].astype(np.uint32), (start + shift).astype(np.uint32),
                              (stop + shift).astype(np.uint32)])
    out = []
    row = row[string]
    first = np.searchsorted(row, np.arange(len(blocks) + 1))
    for k in np.flatnonzero(np.diff(first)).tolist():
        out.append((blocks[k], ranges[first[k]:first[k + 1]].tobytes(), None, None))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), _REPLY_KINDS)], names=_REPLY_NAMES)


RANGES = "doc_id long, _print long, starts array<int>, stops array<int>"


def _assemble(table: pa.Table) -> pa.Table:
    """One block: merged word ranges of each of its documents."""
    k = int(np.flatnonzero(table["ids"].is_valid().to_numpy())[0])
    ids, prints = table["ids"][k].as_py(), table["prints"][k].as_py()
    ranges = np.concatenate([np.frombuffer(x, np.uint32).reshape(-1, 3) for x in table["ranges"].to_pylist()])
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))].astype(np.int64)
    out: list[tuple] = []
    doc = ranges[:, 0]
    first = np.searchsorted(doc, np.arange(len(ids) + 1))
    for d in np.flatnonzero(np.diff(first)).tolist():
        own = ranges[first[d]:first[d + 1]]
        reach = np.maximum.accumulate(own[:, 2])
        new = np.flatnonzero(np.r_[True, own[1:, 1] > reach[:-1]])
        out.append((ids[d], prints[d], own[new, 1].tolist(), reach[np.r_[new[1:], len(own)] - 1].tolist()))
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    names = ["doc_id", "_print", "starts", "stops"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else
                    [pa.array([], t) for t in kinds], names=names)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, _print, starts, stops): covered words of documents that have any."""
    buckets = 16 * shuffle_partitions(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_print"), "text")
    sent = keyed.mapInArrow(_forward(buckets), FORWARD)
    counted = sent.groupBy("key").applyInArrow(_count, REPLY)
    ranges = counted.groupBy("block").applyInArrow(_assemble, RANGES)
    return materialize(ranges, "repeated-ranges").dropDuplicates(["doc_id", "_print"])


KEPT = "struct<n_words:bigint,n_removed:bigint,kept:string>"


def kept_column(text: Column, starts: Column, stops: Column) -> Column:
    @F.arrow_udf(KEPT)
    def keep(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, last in parts:
            rows = []
            for value, a, b in zip(as_bytes(texts), first.to_pylist(), last.to_pylist()):
                words = value.split()
                total = len(words)
                for x, y in zip(reversed(a or []), reversed(b or [])):
                    del words[x:y]
                rows.append((total, total - len(words), b" ".join(words).decode()))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in
                                              zip(columns, (pa.int64(), pa.int64(), pa.string()))],
                                             ["n_words", "n_removed", "kept"])
    return keep(text, starts, stops)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_removed and kept (the kept words, one space between)."""
    ranges = repeated_ranges(docs.select("doc_id", "text")).withColumnsRenamed({"doc_id": "_id", "_print": "_p"})
    keyed = docs.withColumn("_print", F.xxhash64("text"))
    both = keyed.join(ranges, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_p")), "left")
    out = both.withColumn("_kept", kept_column(F.col("text"), F.col("starts"), F.col("stops")))
    names = ("n_words", "n_removed", "kept")
    keep = [c for c in docs.columns if c not in names]
    return out.select(*keep, *(F.col("_kept")[c].alias(c) for c in names))
