"""Token ids in wavelet-matrix shards: one compressed file each, searchable.

1. ``encode_documents``: ids of each text by a public word-level BPE.  Texts are
   cut at ASCII white space, which no token of that vocabulary spans; a worker
   keeps the ids of the words it met in a bounded cache (by 64-bit hash).
2. ``write_shards``: documents are range-partitioned and sorted by id; each task
   appends the end id to every document and closes a shard after
   ``SHARD_TOKENS`` ids (a document is never split, so a longer one makes a
   longer shard).  A manifest has a row a file; the ids before each file come
   from prefix sums over the manifest (per thousand partitions, then over those).
3. A shard is a wavelet matrix: plane l holds bit l (highest first) of all ids in
   the order that planes before it leave, zeros before ones.  Each plane is cut
   into blocks, deflated where that is shorter, with a directory of block places
   and of the ones before each block.  Rank reads one block, select one block
   found in the directory, so access, counting and occurrence lookup read a few
   blocks of a file; ``values`` undoes the planes in bulk.
4. ``read_documents``, ``count_token``, ``find_token`` read the files back.

File layout (little-endian): magic, then the header (bits, documents, ids,
block bits, section places), documents (ids, null marks, lengths; deflated),
directories, blocks.  Files are written below spark.checkpoint.dir (or a given
folder) under a name of their partition and place, by rename, so a second attempt
of a task leaves the same file.

Defined cases: null, empty and blank texts hold the end id only; a null id comes
first in the order; repeated ids keep a fixed order of their rows; strings of
special tokens in texts are one token, as the library does by default; without
documents there are no files; extra columns are not stored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmerge.llm.ragged import RaggedCache
from feedmerge.llm.runtime import materialize, scratch_path, shuffle_partitions
from feedmerge.llm.textarrays import as_bytes, hashed_spans
from feedmerge.llm.token_counts import load_tokenizer

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 1 << 23
BLOCK_BITS = 1 << 15
CACHE_WORDS = 3_000_000
CACHE_PARTS = 200_000
READ_TOKENS = 1 << 20
MAGIC = b"WVLTMTX1"
#: white space that is not one of the ASCII characters texts are cut at
_ODD_SPACE = (rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f"
              rb"|\xe3\x80\x80")


# ---- encoding --------------------------------------------------------------

class WordCache:
    """Ids of words, in bulk by hash; and of their pre-tokens, in two generations
    (when the young one is full it becomes the old one).  Many words (with a
    comma, in capitals) share pre-tokens, so the merges run once for a pre-token."""

    def __init__(self, vocabulary: str):
        self.tokenizer = load_tokenizer(vocabulary)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alone = re.compile(b"|".join([_ODD_SPACE, *special]))
        self.words = RaggedCache(CACHE_WORDS, self.kind)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a pre-token."""
        ids = self.old.get(part)
        if ids is None:
            ids = self._bytes([t.id for t in self.tokenizer.model.tokenize(part)])
        self.young[part] = ids
        return ids

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Normalise and split many words at once; none holds a special token or
        a space of any kind."""
        text = self.tokenizer.normalizer.normalize_str(" ".join(w.decode() for w in words))
        size = np.fromiter(map(len, text.split(" ")), np.int64)
        if len(size) != len(words):
            raise ValueError("the vocabulary's normaliser adds or drops spaces")
        parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        start = np.fromiter((at for _, (at, _) in parts), np.int64, len(parts))
        first = np.searchsorted(start, np.r_[0, np.cumsum(size + 1)])
        get = self.young.get
        ids = [get(part) or self._part(part) for part, _ in parts]
        return [ids[a] if b == a + 1 else b"".join(ids[a:b])
                for a, b in zip(first[:-1].tolist(), first[1:].tolist())]

    def _encode_new(self, new: list[bytes]) -> list[bytes]:
        if len(self.young) > CACHE_PARTS:
            self.young, self.old = {}, self.young
        out = [b""] * len(new)
        plain = range(len(new))
        if self.alone.search(b" ".join(new)):
            plain = []
            for k, word in enumerate(new):
                if self.alone.search(word):
                    out[k] = self._bytes(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
                else:
                    plain.append(k)
        for at in range(0, len(plain), 1000):
            part = plain[at:at + 1000]
            for k, ids in zip(part, self._encode_words([new[k] for k in part])):
                out[k] = ids
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as bytes of ``kind``."""
        out = [b""] * len(texts)
        width = np.dtype(self.kind).itemsize
        for first, data, start, end, h, bounds in hashed_spans(texts):
            self.words.shrink()
            keys, at, own = np.unique(h, return_index=True, return_inverse=True)
            slots = self.words.find(keys)
            unknown = np.flatnonzero(slots < 0)
            if len(unknown):
                new = self._encode_new([data[a:b] for a, b in zip(start[at[unknown]].tolist(), end[at[unknown]].tolist())])
                sizes = np.fromiter(map(len, new), np.int64, len(new)) // width
                slots[unknown] = self.words.add(keys[unknown], (np.frombuffer(b"".join(new), self.kind), sizes))
            ids, sizes = self.words.rows(0, slots[own])
            places = np.r_[0, np.cumsum(sizes)][bounds] * width
            flat = ids.tobytes()
            for k in range(len(bounds) - 1):
                out[first + k] = flat[places[k]:places[k + 1]]
        return out


_caches: dict[str, WordCache] = {}


def _cache(vocabulary: str) -> WordCache:
    """The word cache of this worker process."""
    if vocabulary not in _caches:
        _caches[vocabulary] = WordCache(vocabulary)
    return _caches[vocabulary]


def encode_column(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Ids of a text without special tokens added: binary, little-endian, two
    bytes each (four for a vocabulary over 65,536 ids)."""
    @F.arrow_udf("binary")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = _cache(vocabulary)
        for part in parts:
            yield pa.array(cache.encode(as_bytes(part)), pa.binary())
    return encode(text)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), encode_column(F.col("text"), vocabulary).alias("ids"))


# ---- files -----------------------------------------------------------------

def _store(path: str) -> tuple[pafs.FileSystem, str]:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem(), url.path
    return pafs.FileSystem.from_uri(path)


def _put(path: str, data: bytes) -> None:
    """Write under an own name, then rename: a second attempt does no harm."""
    fs, at = _store(path)
    context = TaskContext.get()
    part = f"{at}.{context.taskAttemptId() if context else 0}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, at)


# ---- wavelet matrix ---------------------------------------------------------

def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, bits: int) -> bytes:
    """The bytes of a shard file for the ids of consecutive documents."""
    n, step = len(ids), BLOCK_BITS // 8
    n_blocks = -(-n // BLOCK_BITS)
    zeros, ones, places, blocks, at = [], [], [], [], 0
    left = ids
    for level in range(bits):
        bit = (left >> (bits - 1 - level) & 1).astype(bool)
        plane = np.packbits(bit, bitorder="little").tobytes()
        low = left[~bit]
        left = np.concatenate([low, left[bit]])
        zeros.append(len(low))
        packed = np.frombuffer(plane, np.uint8)
        ones.append(np.r_[0, np.cumsum(np.add.reduceat(np.bitwise_count(packed).astype(np.int64),
                                                       np.arange(0, len(packed), step)))] if n else np.zeros(1))
        place = [at]
        for k in range(n_blocks):
            raw = plane[k * step:(k + 1) * step]
            short = zlib.compress(raw, 1)
            short = short if len(short) < len(raw) else raw
            blocks.append(short)
            at += len(short)
            place.append(at)
        places.append(place)
    null = np.array([i is None for i in doc_ids], bool)
    documents = [np.array([0 if i is None else i for i in doc_ids], "<i8"), null, np.asarray(lengths, "<i8")]
    sections = [zlib.compress(x.tobytes(), 1) for x in documents]
    sections += [np.array(zeros, "<i8").tobytes(), np.concatenate(ones).astype("<i8").tobytes(),
                 np.array(places, "<i8").tobytes()]
    header = json.dumps({"bits": bits, "ids": n, "documents": len(doc_ids), "block_bits": BLOCK_BITS,
                         "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections, *blocks])


class WaveletMatrix:
    """A shard file opened for reading; blocks are read as they are needed."""

    def __init__(self, path: str):
        fs, at = _store(path)
        self.file = fs.open_input_file(at)
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is not a shard file")
        size = struct.unpack("<I", self.file.read_at(4, 8))[0]
        header = json.loads(self.file.read_at(size, 12))
        self.bits, self.n, self.block_bits = header["bits"], header["ids"], header["block_bits"]
        self.n_blocks = -(-self.n // self.block_bits)
        sections, start = [], 12 + size
        for length in header["sections"]:
            sections.append(self.file.read_at(length, start))
            start += length
        self.body = start
        ids, null, lengths = (np.frombuffer(zlib.decompress(s), t) for s, t in zip(sections, ("<i8", bool, "<i8")))
        self.doc_ids = pa.array(ids, mask=null)
        self.bounds = np.r_[0, np.cumsum(lengths)]
        self.zeros = np.frombuffer(sections[3], "<i8")
        self.ones = np.frombuffer(sections[4], "<i8").reshape(self.bits, self.n_blocks + 1)
        self.places = np.frombuffer(sections[5], "<i8").reshape(self.bits, self.n_blocks + 1)
        self.last: tuple[tuple[int, int], np.ndarray] | None = None

    def __enter__(self) -> WaveletMatrix:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _raw(self, level: int, k: int, data: bytes | None = None, base: int = 0) -> bytes:
        a, b = self.places[level, k], self.places[level, k + 1]
        raw = data[a - base:b - base] if data is not None else self.file.read_at(int(b - a), int(self.body + a))
        size = (min(self.block_bits, self.n - k * self.block_bits) + 7) // 8
        return raw if len(raw) == size else zlib.decompress(raw)

    def block(self, level: int, k: int) -> np.ndarray:
        """The bits of one block (0 and 1)."""
        if self.last is None or self.last[0] != (level, k):
            count = min(self.block_bits, self.n - k * self.block_bits)
            self.last = ((level, k), np.unpackbits(np.frombuffer(self._raw(level, k), np.uint8), count=count,
                                                   bitorder="little"))
        return self.last[1]

    def plane(self, level: int) -> np.ndarray:
        """All bits of a plane, as booleans."""
        a, b = int(self.places[level, 0]), int(self.places[level, -1])
        data = self.file.read_at(b - a, self.body + a)
        raw = b"".join(self._raw(level, k, data, a) for k in range(self.n_blocks))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)

    def _rank1(self, level: int, i: int) -> int:
        k, rest = divmod(i, self.block_bits)
        return int(self.ones[level, k]) + (int(self.block(level, k)[:rest].sum(dtype=np.int64)) if rest else 0)

    def access(self, i: int) -> int:
        """The id at a place."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = int(self.block(level, i // self.block_bits)[i % self.block_bits])
            ones = self._rank1(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, a: int, b: int) -> tuple[int, int]:
        """Where the value's occurrences within [a, b) lie below the last plane."""
        if not 0 <= value < 1 << self.bits:
            return 0, 0
        for level in range(self.bits):
            if a == b:
                return 0, 0
            x, y = self._rank1(level, a), self._rank1(level, b)
            if value >> (self.bits - 1 - level) & 1:
                a, b = int(self.zeros[level]) + x, int(self.zeros[level]) + y
            else:
                a, b = a - x, b - y
        return a, b

    def rank(self, value: int, i: int) -> int:
        """Occurrences of an id before a place."""
        a, b = self._range(value, 0, i)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th zeros or ones of a plane (k ascending, from 0)."""
        before = self.ones[level]
        if not bit:
            before = np.minimum(np.arange(self.n_blocks + 1) * self.block_bits, self.n) - before
        block = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        first = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(k)]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            at = int(block[a])
            out[a:b] = at * self.block_bits + np.flatnonzero(self.block(level, at) == bit)[k[a:b] - before[at]]
        return out

    def occurrences(self, value: int) -> np.ndarray:
        """All places of an id, ascending."""
        a, b = self._range(value, 0, self.n)
        at = np.arange(a, b)
        for level in range(self.bits - 1, -1, -1):
            if not len(at):
                break
            bit = value >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - (int(self.zeros[level]) if bit else 0))
        return at

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = np.array([a + k])
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - (int(self.zeros[level]) if bit else 0))
        return int(at[0])

    def values(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            bit, zeros = self.plane(level), int(self.zeros[level])
            up = np.empty(self.n, kind)
            up[~bit] = ids[:zeros]
            up[bit] = ids[zeros:]
            up |= bit.astype(kind) << kind(self.bits - 1 - level)
            ids = up
        return ids


# ---- shards in Spark ---------------------------------------------------------

MANIFEST = "part long, shard long, path string, documents long, tokens long"
_MANIFEST_NAMES = ["part", "shard", "path", "documents", "tokens"]


def _write(folder: str, end_id: int, kind: str, bits: int, limit: int):
    width = np.dtype(kind).itemsize
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{shard:06d}.wm"
            lengths = np.fromiter((len(h) // width for h in held), np.int64, len(held))
            _put(path, build(np.frombuffer(b"".join(held), kind), doc_ids, lengths, bits))
            row = [part, shard, path, len(doc_ids), size]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=_MANIFEST_NAMES)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = len(ids) // width + 1
                if size and size + more > limit:
                    yield close()
                    shard, doc_ids, held, size = shard + 1, [], [], 0
                doc_ids.append(doc_id)
                held.append(ids + end)
                size += more
        if doc_ids:
            yield close()
    return run


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: the ids in all files before each one."""
    group = F.floor(F.col("part") / 1000)
    inner = Window.partitionBy("_group").orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    grouped = manifest.withColumn("_group", group)
    # one row for a thousand partitions
    groups = (grouped.groupBy("_group").agg(F.sum("tokens").alias("_all"))
              .select("_group", F.coalesce(F.sum("_all").over(Window.orderBy("_group").rowsBetween(
                  Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")))
    return (grouped.withColumn("_inner", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
            .join(groups, "_group").withColumn("start", F.col("_before") + F.col("_inner"))
            .drop("_group", "_inner", "_before"))


def write_shards(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, end_id: int = END_ID,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode (doc_id, text) into shard files in the order of doc_id; the
    manifest: part, shard, path, documents, tokens, start."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "wavelet")
    cache = _cache(vocabulary)
    bits = max(1, (max(cache.tokenizer.get_vocab_size() - 1, end_id)).bit_length())
    kind = cache.kind
    coded = materialize(encode_documents(docs, vocabulary).withColumn("_row", F.monotonically_increasing_id()), "coded")
    width = np.dtype(kind).itemsize
    total = coded.agg(F.sum(F.octet_length("ids") / width + 1)).first()[0] or 0
    # whole shards a partition; a small corpus still goes to several tasks
    parts = max(1, -(-int(total) // shard_tokens), min(shuffle_partitions(spark), int(total) * 8 // shard_tokens))
    fs, at = _store(folder)
    fs.create_dir(at, recursive=True)
    order = [F.asc_nulls_first("doc_id"), "_row"]
    rows = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return with_starts(materialize(rows.mapInArrow(_write(folder, end_id, kind, bits, shard_tokens), MANIFEST),
                                   "manifest"))


def _each_file(manifest: DataFrame, visit, schema: str) -> DataFrame:
    """One row a file, spread over the tasks; ``visit(matrix, start)`` yields
    record batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with WaveletMatrix(path) as matrix:
                    yield from visit(matrix, start)

    spread = manifest.select("path", "start").repartition(
        4 * shuffle_partitions(manifest.sparkSession), F.xxhash64("path"))
    return spread.mapInArrow(run, schema)


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, token_ids) of every stored document: the ids before it
    in all files, and its ids (binary, little-endian unsigned 32-bit)."""
    def visit(matrix: WaveletMatrix, start: int) -> Iterator[pa.RecordBatch]:
        ids = matrix.values()
        first = 0
        while first < len(matrix.doc_ids):
            last = max(first + 1, int(np.searchsorted(matrix.bounds, matrix.bounds[first] + READ_TOKENS, "right")) - 1)
            at = matrix.bounds[first:last + 1]
            data = pa.py_buffer(ids[at[0]:at[-1]].astype("<u4").tobytes())
            offsets = pa.py_buffer(((at - at[0]) * 4).astype(np.int64).tobytes())
            tokens = pa.Array.from_buffers(pa.large_binary(), last - first, [None, offsets, data]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([matrix.doc_ids[first:last], pa.array(start + at[:-1]), tokens],
                                             names=["doc_id", "start", "token_ids"])
            first = last
    return _each_file(manifest, visit, "doc_id long, start long, token_ids binary")


def count_token(manifest: DataFrame, token: int) -> DataFrame:
    """(start, n): how often an id is in each file, by rank alone."""
    def visit(matrix: WaveletMatrix, start: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([matrix.count(token)])], names=["start", "n"])
    return _each_file(manifest, visit, "start long, n long")


def find_token(manifest: DataFrame, token: int) -> DataFrame:
    """(doc_id, place): every occurrence of an id, places counted within the
    document, by select alone."""
    def visit(matrix: WaveletMatrix, start: int) -> Iterator[pa.RecordBatch]:
        at = matrix.occurrences(token)
        for k in range(0, len(at), 1 << 16):
            part = at[k:k + (1 << 16)]
            doc = np.searchsorted(matrix.bounds, part, "right") - 1
            yield pa.RecordBatch.from_arrays([matrix.doc_ids.take(pa.array(doc)), pa.array(part - matrix.bounds[doc])],
                                             names=["doc_id", "place"])
    return _each_file(manifest, visit, "doc_id long, place long")
