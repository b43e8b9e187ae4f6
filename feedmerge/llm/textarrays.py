"""Vectorised word hashing shared by the text operators.

A word is a run of bytes outside 0x20 and 0x09-0x0D (``bytes.split`` with no
argument).  Each word gets a 64-bit hash that depends on its bytes only, so
hashes agree between tasks, executors and runs.  Work goes in pieces of at
most ``CHUNK`` bytes, so memory does not grow with the batch or the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
#: Words longer than this are hashed by blake2b, so that one endless word
#: needs no power table of its own length.
LONG_WORD = 1 << 16

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables() -> list[np.ndarray]:
    if not _powers:
        size = CHUNK + 2 * LONG_WORD
        inverse = pow(_BASE, -1, 1 << 64)
        _powers.append(np.cumprod(np.full(size, _BASE, np.uint64)))
        _powers.append(np.cumprod(np.full(size, inverse, np.uint64)))
    return _powers


def _long_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _hash_buffer(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one piece."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _WS[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    return start, end, hash_spans(data, start, end)


def hash_spans(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]``; depends on the bytes of the span only."""
    buf = np.frombuffer(data, np.uint8)
    power, inverse = _tables()
    if len(buf) > len(power):  # spans are in order: hash them in runs
        cut = int(np.searchsorted(start, len(buf) // 2))
        if 0 < cut < len(start):
            at = int(start[cut])
            return np.concatenate([hash_spans(data[:at], start[:cut], end[:cut]),
                                   hash_spans(data[at:], start[cut:] - at, end[cut:] - at)])
        return np.array([_long_hash(data[a:b]) if b - a > LONG_WORD else int(hash_spans(
            data[a:b], np.array([0]), np.array([b - a]))[0]) for a, b in zip(start, end)], np.uint64)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[:len(buf)], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start])
    for k in np.flatnonzero(end - start > LONG_WORD):
        h[k] = _long_hash(data[start[k]:end[k]])
    return h


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text of more than ``CHUNK`` bytes, cut at white space."""
    at = 0
    while at < len(text):
        to = min(at + CHUNK, len(text))
        if to < len(text):
            cut = max(text.rfind(c, at, to) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
            if cut < at:
                cut = min((p for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
                           if (p := text.find(c, to)) >= 0), default=len(text) - 1)
            to = cut + 1
        yield text[at:to]
        at = to


def hashed_spans(texts: list[bytes], lower: bool = False) -> Iterator[tuple]:
    """(first text, data, word starts, word ends, word hashes, word bounds) for
    runs of consecutive texts; starts and ends are places in ``data``.

    ``bounds`` has one entry more than the run has texts: text ``first + k``
    owns the words ``bounds[k]`` to ``bounds[k + 1]``.
    """
    i = 0
    while i < len(texts):
        size, j = len(texts[i]) + 1, i + 1
        while j < len(texts) and size + len(texts[j]) < CHUNK:
            size += len(texts[j]) + 1
            j += 1
        if size > CHUNK:
            data = texts[i].lower() if lower else texts[i]
            starts, ends, hashes, at = [], [], [], 0
            for piece in _pieces(data):
                start, end, h = _hash_buffer(piece)
                starts.append(start + at)
                ends.append(end + at)
                hashes.append(h)
                at += len(piece)
            h = np.concatenate(hashes)
            yield i, data, np.concatenate(starts), np.concatenate(ends), h, np.array([0, len(h)])
        else:
            data = b" ".join(texts[i:j])
            data = data.lower() if lower else data
            start, end, h = _hash_buffer(data)
            lengths = np.fromiter((len(t) + 1 for t in texts[i:j]), np.int64, j - i)
            yield i, data, start, end, h, np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
        i = j


def hashed(texts: list[bytes], lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, word bounds), see ``hashed_spans``."""
    for first, _, _, _, h, bounds in hashed_spans(texts, lower):
        yield first, h, bounds


_COEF = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 64, 64, dtype=np.uint64) | _U(1)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (fewer: empty)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += h[k:k + m] * _COEF[k]
    return mix(total + _U(n))


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null becomes empty."""
    import pyarrow as pa
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
