"""Alignment against both libraries on whole texts and a plain merge of ends."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

import public_tokenizers
from llm.edge import SMALL, edge_rows, prose
from feedmerge.llm import alignment
from feedmerge.llm.queries import QUERIES
from feedmerge.llm.ragged import RaggedCache
from feedmerge.llm.runtime import read
from feedmerge.llm.token_counts import load_tokenizer

A = load_tokenizer(alignment.VOCABULARY_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.VOCABULARY_B))
A_PIECES = {k: t for t, k in A.get_vocab(with_added_tokens=True).items()}
ALPHABET = alignment._byte_alphabet()


def a_bytes(k):
    return bytes(ALPHABET[c] for c in A_PIECES[k])


def b_bytes(k):
    p = B.id_to_piece(k)
    return bytes([int(p[3:5], 16)]) if B.is_byte(k) else p.replace("▁", " ").encode()


def tokens(text):
    """Groups [(A ids, B ids)] and links [(A id, B id)] of one text."""
    if not text:
        return [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    spans = []
    for ids, of in ((a, a_bytes), (b, b_bytes)):
        parts = [of(i) for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return [], []
        ends = np.cumsum([len(p) for p in parts]).tolist()
        spans.append(list(zip([0, *ends], ends, ids)))
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups, at = [], [0, 0]
    for cut in cuts:
        group = []
        for side in (0, 1):
            own = []
            while at[side] < len(spans[side]) and spans[side][at[side]][1] <= cut:
                own.append(spans[side][at[side]][2])
                at[side] += 1
            group.append(own)
        groups.append(tuple(group))
    links, low = [], 0
    for x, y, i in spans[0]:
        while spans[1][low][1] <= x:
            low += 1
        k = low
        while k < len(spans[1]) and spans[1][k][0] < y:
            links.append((i, spans[1][k][2]))
            k += 1
    return groups, links


def plain(rows):
    docs = [tokens(t) for _, t in rows]
    count = Counter(x for _, ls in docs for x in ls)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), (groups, ls) in zip(rows, docs):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(ls),
                    sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("where", ["small", "edge"])
def test_query(spark, edge_dir, where):
    at = SMALL if where == "small" else edge_dir
    rows = [tuple(r) for r in read(spark, at, "documents").select("doc_id", "text").collect()]
    assert where == "small" or order(rows) == order(edge_rows())
    assert order(QUERIES["op13_alignment"](spark, at).collect()) == order(plain(rows))


ODD = ["a  b\n\n c\td \v e\f\n", "x\r\ny \r z", "▁ a▁b", " lead and trail  ", "\n", " ", "\t\tx", "é́ ﬁ ǆ 日本語 テスト 👍🏽 ok",
       "nb\xa0sp a　b  c", "<|endoftext|> <s> </s> <unk> <0x41>", "a\x00b \x1c c", "it's I'll 12 345 !!! ---",
       "= {\n    return x;\n}\n\n\n", "word " * 50, "﻿ bom", "ſ ß İ", None, "", "a", "\n a", " \n a"]


def test_odd_texts_in_small_blocks(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(ODD * 2)] + [(None, prose(300, 4)), (7, "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert order(alignment.align_documents(docs, block_bytes=200).collect()) == order(plain(rows))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab  \n\t.,'1é日▁\r\xa0sS<|>"), max_size=40))
def test_pieces_give_the_tokens_of_the_text(text):
    pair = alignment._pair(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    block = alignment._Block(0)
    alignment._add_group(block, pair, [1, 2], [text.encode(), b"other text"])
    want = plain([(1, text)])[0]
    assert tuple(c[0] for c in block.columns[:5]) == want[:5] and block.columns[5][0] == want[7]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_divide_and_conquer(a, b):
    a, b = sorted(a | {61}), sorted(b | {61})
    groups = alignment.align(a, b)
    cuts = sorted(set(a) & set(b))
    assert [a[g[1] - 1] for g in groups] == cuts == [b[g[3] - 1] for g in groups]
    assert [g[0] for g in groups] == [0, *(g[1] for g in groups[:-1])]
    assert [g[2] for g in groups] == [0, *(g[3] for g in groups[:-1])]
    starts = [[0, *x[:-1]] for x in (a, b)]
    want = [(i, j) for i in range(len(a)) for j in range(len(b))
            if max(starts[0][i], starts[1][j]) < min(a[i], b[j])]
    assert sorted(x for g in groups for x in alignment.links(a, b, g)) == want


def test_whole_vocabulary_is_read():
    pair = alignment._pair(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    assert pair.a_bytes == [a_bytes(k) if k != 50_256 else b"<|endoftext|>" for k in range(50_257)]


def test_empty_table(spark, no_docs):
    assert alignment.align_documents(no_docs).collect() == []


def test_ragged_cache_keeps_what_was_used_last():
    cache, rng, known = RaggedCache(50, "<i8"), np.random.default_rng(1), {}
    for _ in range(60):
        cache.shrink()
        keys = np.unique(rng.zipf(1.3, 20).astype(np.uint64))
        slots = cache.find(keys)
        new = np.flatnonzero(slots < 0)
        for k in keys[new].tolist():
            known[k] = np.arange(k % 7) + k
        flat = np.concatenate([known[k] for k in keys[new].tolist()] + [np.zeros(0, np.int64)])
        slots[new] = cache.add(keys[new], (flat, keys[new].astype(np.int64) % 7))
        got, sizes = cache.rows(0, slots)
        assert got.tolist() == [x for k in keys.tolist() for x in known[k]]
        assert sizes.tolist() == [k % 7 for k in keys.tolist()] and len(cache) <= 70


def test_ends_of_a_piece_take_no_array(monkeypatch):
    """Pieces are many and have a few tokens each: an array for each cost a fifth of the CPU time."""
    parts = [b" a", b"", "é".encode(), b"word"]
    monkeypatch.setattr(alignment.np, "cumsum", None)
    assert alignment._ends(parts) == [2, 2, 4, 8] and alignment._ends([]) == []


def test_large_rows_are_written_in_row_groups_of_a_few(spark):
    """100 rows and more in one row group would be held at once, however long they are."""
    import glob
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq
    from feedmerge.llm.runtime import materialize

    def rows(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([os.urandom(2 << 20)])], names=["data"])
    written = materialize(spark.range(0, 48, 1, 1).mapInArrow(rows, "data binary"), "large-rows", large_rows=True)
    files = [f for p in written.inputFiles() for f in glob.glob(p.removeprefix("file:").replace("//", "/"))]
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in files for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 48 and max(g.total_byte_size for g in groups) <= 40 << 20


def test_the_last_stage_lets_go_of_the_caches():
    """Workers are kept: what they learnt of pieces would lie beside the last stage's rows."""
    alignment._pair(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    list(alignment._finish(iter([])))
    assert not alignment._pairs
