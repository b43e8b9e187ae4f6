"""Wavelet-matrix shards against plain lists of ids."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from llm.edge import SMALL, edge_rows
from feedmerge.llm import wavelet
from feedmerge.llm.queries import QUERIES
from feedmerge.llm.runtime import read
from feedmerge.llm.token_counts import load_tokenizer

TOKENIZER = load_tokenizer(wavelet.VOCABULARY)
CACHE = wavelet.WordCache(wavelet.VOCABULARY)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def plain(rows):
    """(doc_id, n_tokens, crc32) in the order of ids, nulls first."""
    out = []
    for doc_id, text in rows:
        ids = np.array([*ids_of(text), wavelet.END_ID], "<u4")
        out.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    return out


@pytest.mark.parametrize("where", ["small", "edge"])
def test_query(spark, edge_dir, where):
    at = SMALL if where == "small" else edge_dir
    rows = [tuple(r) for r in read(spark, at, "documents").select("doc_id", "text").collect()]
    if where == "edge":
        assert sorted(rows, key=repr) == sorted(edge_rows(), key=repr)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"])
                 for r in QUERIES["op12_wavelet"](spark, at).collect())
    assert sorted((r[1:] for r in got), key=repr) == sorted(plain(rows), key=repr)
    sofar = 0
    for start, _, n, _ in got:  # starts are running totals in the order of ids
        assert start == sofar
        sofar += n
    ids = [r[1] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_shards_and_lookups(spark, tmp_path, monkeypatch):
    """Many shards of few ids: order, counts and occurrences over all files."""
    docs = read(spark, SMALL, "documents").select("doc_id", "text")
    manifest = wavelet.write_shards(docs, f"file://{tmp_path}/shards", shard_tokens=5_000).persist()
    rows = {i: [*ids_of(t), wavelet.END_ID] for i, t in docs.collect()}
    assert manifest.count() > 5
    assert {r["path"].startswith(f"file://{tmp_path}") for r in manifest.collect()} == {True}
    got = {r["doc_id"]: np.frombuffer(r["token_ids"], "<u4").tolist()
           for r in wavelet.read_documents(manifest).collect()}
    assert got == rows
    for token in (wavelet.END_ID, rows[0][0], 49_407, 48_000, 70_000):
        want = sorted((i, k) for i, ids in rows.items() for k, x in enumerate(ids) if x == token)
        assert sorted(tuple(r) for r in wavelet.find_token(manifest, token).collect()) == want
        assert sum(r["n"] for r in wavelet.count_token(manifest, token).collect()) == len(want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1023), max_size=300), st.integers(0, 1100), st.sampled_from([64, 1 << 15]))
def test_matrix(tmp_path_factory, ids, token, block):
    before, wavelet.BLOCK_BITS = wavelet.BLOCK_BITS, block
    try:
        path = str(tmp_path_factory.mktemp("wm") / "one.wm")
        half = len(ids) // 2
        with open(path, "wb") as f:
            f.write(wavelet.build(np.array(ids, np.uint16), [7, None], np.array([half, len(ids) - half]), 10))
        with wavelet.WaveletMatrix(path) as m:
            assert m.values().tolist() == ids
            assert m.doc_ids.to_pylist() == [7, None] and m.bounds.tolist() == [0, half, len(ids)]
            assert [m.access(i) for i in range(0, len(ids), 7)] == ids[::7]
            for value in {token, *ids[:5]}:
                at = [k for k, x in enumerate(ids) if x == value]
                assert m.occurrences(value).tolist() == at and m.count(value) == len(at)
                assert m.rank(value, half) == sum(k < half for k in at)
                assert [m.select(value, k) for k in range(len(at))] == at
                with pytest.raises(IndexError):
                    m.select(value, len(at))
    finally:
        wavelet.BLOCK_BITS = before


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB ΣςéÉ́ͅ  ‍'’.,1²\t\n\r\x0b\x1c\x85İ<|endoftext>sSẞ")))
def test_texts_cut_at_white_space(text):
    cache = CACHE
    cache.words._reset()
    cache.young.clear()
    for t in (text, f"a <|endoftext|>{text}", text):
        assert np.frombuffer(cache.encode([t.encode()])[0], "<u2").tolist() == ids_of(t)


def test_small_caches(monkeypatch):
    monkeypatch.setattr(wavelet, "CACHE_WORDS", 6)
    monkeypatch.setattr(wavelet, "CACHE_PARTS", 3)
    cache = wavelet.WordCache(wavelet.VOCABULARY)
    for k in range(20):
        texts = [f"word{k} word{k % 3} shared", "", "and more words here"]
        got = [np.frombuffer(x, cache.kind).tolist() for x in cache.encode([t.encode() for t in texts])]
        assert got == [ids_of(t) for t in texts]
        assert len(cache.words) <= 6 + 7 and len(cache.young) <= 3 + 9


def test_empty_table(spark, no_docs):
    manifest = wavelet.write_shards(no_docs)
    assert manifest.collect() == [] and wavelet.read_documents(manifest).collect() == []


def test_starts_over_many_partitions(spark):
    rows = [(p, s, f"f{p}-{s}", 1, 10 * p + s) for p in range(0, 2500, 7) for s in range(2)]
    manifest = spark.createDataFrame(rows, wavelet.MANIFEST)
    got = {(r["part"], r["shard"]): r["start"] for r in wavelet.with_starts(manifest).collect()}
    sofar = 0
    for p, s, _, _, n in rows:
        assert got[p, s] == sofar
        sofar += n
