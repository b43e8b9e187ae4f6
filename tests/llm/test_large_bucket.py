"""op4: a bucket that one frequent minimiser fills."""

import tracemalloc

import numpy as np
import pyarrow as pa

from feedmerge.llm import substring_dedup as sd

NAMES = [("key", pa.int64()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()),
         ("d", pa.binary()), ("ids", pa.list_(pa.int64())), ("prints", pa.list_(pa.int64()))]


def bucket(blocks, strings, rng):
    """Random strings of 40 to 70 words; every ninth repeats a run of an earlier one."""
    rows, kept = [], []
    for block in range(blocks):
        texts = []
        for k in range(strings):
            words = rng.integers(0, 5000, rng.integers(40, 70)).tolist()
            if kept and k % 9 == 0:
                words[2:39] = kept[int(rng.integers(len(kept)))][1:38]
            kept.append(words)
            texts.append(" ".join(map(str, words)).encode())
        sizes = np.array([len(t) for t in texts], np.uint32)
        rows.append((0, block, pa.Codec("zstd").compress(b"".join(texts), asbytes=True), sizes.tobytes(),
                     np.arange(strings, dtype=np.uint32).tobytes(), np.zeros(strings, np.uint32).tobytes(), None, None))
    return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows), NAMES)], names=[n for n, _ in NAMES]), kept


def brute(kept, strings):
    """Covered words of each (block, document)."""
    seen = {}
    for s, words in enumerate(kept):
        for at in range(len(words) - sd.WINDOW + 1):
            seen.setdefault(tuple(words[at:at + sd.WINDOW]), []).append((s, at))
    out = {}
    for places in seen.values():
        if len(places) > 1:
            for s, at in places:
                out.setdefault(divmod(s, strings), set()).update(range(at, at + sd.WINDOW))
    return out


def covered(table):
    out = {}
    for block, ranges in zip(table["block"].to_pylist(), table["ranges"].to_pylist()):
        for doc, a, b in np.frombuffer(ranges, np.uint32).reshape(-1, 3).tolist():
            out.setdefault((block, doc), set()).update(range(a, b))
    return out


def test_parts_by_hash_count_every_window(monkeypatch):
    table, kept = bucket(3, 200, np.random.default_rng(4))
    expected = brute(kept, 200)
    assert len(expected) > 20
    for step in (1, 70, 1000, 10 ** 9):  # raising: the step was not there before
        monkeypatch.setattr(sd, "STEP_WORDS", step)
        assert covered(sd._count(table)) == expected


def test_memory_of_a_large_bucket():
    table, kept = bucket(10, 6000, np.random.default_rng(6))
    words = sum(map(len, kept))
    del kept
    tracemalloc.start()
    sd._count(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(f"{words} words, {peak / words:.1f} bytes a word")
    assert peak < 30 * words
