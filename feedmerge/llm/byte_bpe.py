"""Byte-level BPE encoding and decoding in two tiers.

Tier one: a minimal perfect hash over the vocabulary (hash and displace)
resolves whole pre-tokens that are tokens themselves.  Tier two: any other
pre-token is merged by rank with a heap over linked bytes, O(n log n) for a
pre-token of n bytes.  Texts are cut at safe boundaries first; the ids of
pieces and of pre-tokens are kept in bounded caches of the worker.  Decoding
gathers the bytes of all ids of a text from the concatenated vocabulary.

Defined cases: null and empty texts encode to no ids; no special tokens exist,
so their strings are ordinary text; every byte is in the vocabulary, so
decoding gives back the UTF-8 bytes of the text.  Repeated rows and null ids
are encoded alike; other columns pass through, those named like the added ones
are replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmerge.llm.pretokens import SPACE, Recent, byte_groups, pieces
from feedmerge.llm.textarrays import hash_spans

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_PIECES = 60_000      # pieces a generation of a worker's cache
CACHE_PRETOKENS = 150_000  # the same for pre-tokens


def pretoken_pattern():
    import public_tokenizers
    return regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}")
                         .replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def load_ranks(name: str) -> dict[bytes, int]:
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def hash_items(items: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(x) for x in items])
    return hash_spans(b"".join(items), np.r_[0, ends[:-1]].astype(np.int64), ends)


class PerfectHash:
    """Minimal perfect hash: each key owns one slot of ``len(keys)``.

    Keys fall into buckets; each bucket of two or more gets the first
    displacement that puts its keys on free slots, and a bucket of one gets a
    free slot directly (stored as a negative number).
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size)  # one key a bucket on average: few tries
        h = hash_items(keys)
        if len(np.unique(h)) != len(h):
            raise ValueError("two keys have one hash")
        self.shift = np.zeros(self.buckets, np.int64)
        self.key_at = np.zeros(self.size, np.int64)
        bucket, a, b = self._split(h)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = bytearray(self.size)
        sizes = np.diff(first)
        for k in np.argsort(-sizes, kind="stable").tolist():
            own = order[first[k]:first[k + 1]].tolist()
            if len(own) < 2:
                break
            pairs, d = [(int(a[i]), int(b[i])) for i in own], 0
            while True:
                slots = {(x + d * y) % self.size for x, y in pairs}
                if len(slots) == len(own) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[k] = d
            for i, (x, y) in zip(own, pairs):
                slot = (x + d * y) % self.size
                taken[slot] = 1
                self.key_at[slot] = i
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(np.frombuffer(taken, np.uint8) == 0)[:len(single)]
        self.shift[single] = -free - 1
        self.key_at[free] = order[first[single]]

    def _split(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return ((h % np.uint64(self.buckets)).astype(np.int64),
                (h >> np.uint64(40)).astype(np.int64),
                ((h >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.int64) | 1)

    def find(self, items: list[bytes]) -> np.ndarray:
        """The index of the key that could equal each item (to be compared)."""
        bucket, a, b = self._split(hash_items(items))
        d = self.shift[bucket]
        slot = np.where(d >= 0, (a + d * b) % self.size, -d - 1)
        return self.key_at[slot]


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.keys = list(ranks)
        self.ids = list(ranks.values())
        self.pieces = Recent(CACHE_PIECES)
        self.pretokens = Recent(CACHE_PRETOKENS)
        self.table = PerfectHash(self.keys)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: least rank first, leftmost of equals."""
        n, get = len(piece), self.ranks.get
        # rank, place and end in one integer: small ones compare fastest
        bits = 8 if n < 256 else 32
        mask, wide = (1 << bits) - 1, 2 * bits
        end = list(range(1, n + 1))      # of the part that starts here; 0: none does
        start = list(range(-1, n))       # of the part that ends here
        heap = []
        for i in range(n - 1):
            r = get(piece[i:i + 2])
            if r is not None:
                heap.append(r << wide | i << bits | i + 2)
        heapify(heap)
        while heap:
            x = heappop(heap)
            to = x & mask
            i = x >> bits & mask
            mid = end[i]
            if not mid or mid >= to or end[mid] != to:
                continue  # one of its parts has grown or gone
            end[i], end[mid], start[to] = to, 0, i
            if to < n:
                far = end[to]
                r = get(piece[i:far])
                if r is not None:
                    heappush(heap, r << wide | i << bits | far)
            if i:
                back = start[i]
                r = get(piece[back:to])
                if r is not None:
                    heappush(heap, r << wide | back << bits | to)
        ids, at = [], 0
        while at < n:
            to = end[at]
            ids.append(self.ranks[piece[at:to]])
            at = to
        return ids

    def encode_pieces(self, new: list[str], pattern) -> None:
        """Put the ids (little-endian unsigned 32-bit) of each piece in the cache."""
        split = [pattern.findall(p) for p in new]
        known = self.pretokens
        lacking = known.lacking(set().union(*split))
        raw = [t.encode() for t in lacking]
        for text, item, k in zip(lacking, raw, self.table.find(raw).tolist() if raw else []):
            ids = [self.ids[k]] if self.keys[k] == item else self.merge(item)
            known[text] = array("I", ids).tobytes()
        for piece, tokens in zip(new, split):
            self.pieces[piece] = known[tokens[0]] if len(tokens) == 1 else b"".join(map(known.__getitem__, tokens))

    def encode(self, texts: list[str], pattern) -> list[bytes]:
        out = []
        for first, stop in byte_groups(texts):
            cut = [pieces(t) for t in texts[first:stop]]
            new = self.pieces.lacking(set().union(*cut))
            for i in range(0, len(new), 20_000):
                self.encode_pieces(new[i:i + 20_000], pattern)
            out += [b"".join(map(self.pieces.__getitem__, c)) for c in cut]
        return out


class Decoder:
    """The vocabulary as one byte array and the bounds of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        items = [b""] * size
        for token, k in ranks.items():
            items[k] = token
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.length = np.array([len(x) for x in items], np.int64)
        self.first = np.r_[0, np.cumsum(self.length)[:-1]]

    def decode(self, ids: bytes, step: int = 1 << 20) -> bytes:
        out = []
        for a in range(0, len(ids) // 4, step):
            k = np.frombuffer(ids, "<u4", min(step, len(ids) // 4 - a), 4 * a)
            length = self.length[k]
            ends = np.cumsum(length)
            out.append(self.data[np.repeat(self.first[k] - ends + length, length) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


_codecs: dict[str, BytePairCodec] = {}
_decoders: dict[str, Decoder] = {}


def codec(name: str) -> BytePairCodec:
    """The codec of a public vocabulary, built once per process."""
    if name not in _codecs:
        _codecs[name] = BytePairCodec(load_ranks(name))
    return _codecs[name]


def decoder(name: str) -> Decoder:
    """Its decoder: workers that only decode hold nothing else."""
    if name not in _decoders:
        _decoders[name] = Decoder(load_ranks(name))
    return _decoders[name]


def encode_column(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Ids of a text: binary, little-endian unsigned 32-bit integers."""
    @F.arrow_udf("binary")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, pattern = codec(vocabulary), pretoken_pattern()
        for part in parts:
            yield pa.array(own.encode([t or "" for t in part.to_pylist()], pattern), pa.binary())
    return encode(text)


def decode_column(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """Bytes that ids (as ``encode_column`` gives them) stand for."""
    @F.arrow_udf("binary")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = decoder(vocabulary)
        for part in parts:
            yield pa.array([own.decode(x or b"") for x in part.to_pylist()], pa.binary())
    return decode(ids)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with token_ids (binary) and n_tokens (long)."""
    return (docs.withColumn("token_ids", encode_column(F.col("text"), vocabulary))
            .withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long")))


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with decoded (binary), from token_ids alone."""
    return encoded.withColumn("decoded", decode_column(F.col("token_ids"), vocabulary))


def code_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with token_ids, n_tokens and decoded: both ways in one worker, so
    an executor runs one Python worker a task instead of two."""
    @F.arrow_udf("struct<token_ids: binary, decoded: binary>")
    def code(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, back, pattern = codec(vocabulary), decoder(vocabulary), pretoken_pattern()
        for part in parts:
            ids = own.encode([t or "" for t in part.to_pylist()], pattern)
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(back.decode, ids), pa.binary())],
                                             names=["token_ids", "decoded"])
    added = ("token_ids", "n_tokens", "decoded", "_coded")
    out = docs.select(*[c for c in docs.columns if c not in added], code(F.col("text")).alias("_coded"))
    return out.select(*[c for c in out.columns if c != "_coded"], F.col("_coded.token_ids").alias("token_ids"),
                      (F.octet_length("_coded.token_ids") / 4).cast("long").alias("n_tokens"),
                      F.col("_coded.decoded").alias("decoded"))
