"""Importance resampling against a plain version of it."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm.edge import SMALL, edge_rows, prose
from feedmerge.llm import importance
from feedmerge.llm.importance import Settings
from feedmerge.llm.queries import QUERIES
from feedmerge.llm.runtime import read

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows, items, s=Settings()):
    """(doc_id, n_features, weight, score, rank) for (doc_id, text) rows."""
    def runs(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = WORD.findall(low)
        made = [" ".join(words[i:i + k]) for k in range(1, s.max_run + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(m.encode()) % s.buckets for m in made]

    source, target = Counter(), Counter()
    docs = [runs(t) for _, t in rows]
    for _, b in docs:
        source.update(b)
    for t in items:
        target.update(runs(t)[1])
    S, T = sum(source.values()), sum(target.values())
    out = []
    for k, ((doc_id, _), (n, b)) in enumerate(zip(rows, docs)):
        weight = sum(math.floor(1000 * math.log((target[x] + 1) * (S + s.buckets) / ((source[x] + 1) * (T + s.buckets))))
                     for x in b)
        h = int(hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(b), weight, score, None, n])
    order = sorted((r for r in out if r[5] >= s.min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(order[:s.percent * len(order) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def texts(spark, at, table):
    return [tuple(r) for r in read(spark, at, table).select(read(spark, at, table).columns[0], "text").collect()]


@pytest.mark.parametrize("where", ["small", "edge"])
def test_query(spark, edge_dir, where):
    at = SMALL if where == "small" else edge_dir
    rows = texts(spark, at, "documents") if where == "small" else edge_rows()
    got = order(QUERIES["op11_importance"](spark, at).collect())
    assert got == order(plain(rows, [t for _, t in texts(spark, at, "benchmark")]))


@pytest.mark.parametrize("settings", [Settings(max_run=3, buckets=97, min_words=1, percent=50),
                                      Settings(max_run=2, min_words=4, percent=100)])
def test_other_settings(spark, edge_docs, settings):
    items = [prose(50, 9), None, "one two"]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    got = importance.resample(edge_docs, target, settings).collect()
    assert order(got) == order(plain(edge_rows(), items, settings))


def test_large_segments_are_cut_again(spark, monkeypatch):
    """Ranks stay exact with runs, samples and segments of a few rows."""
    monkeypatch.setattr(importance, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(importance, "RUN_ROWS", 40)
    rows = [(i // 2 if i < 900 else None, prose(30, i % 7)) for i in range(1000)]  # many ties, a third of one text
    docs = spark.createDataFrame([(None, *r) for r in rows], "row long, doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(prose(50, 9),)], "text string")
    settings = Settings(percent=60)
    got = importance.ranked(docs, target, settings, segment_rows=20).drop("row").collect()
    assert order(r[:4] for r in got) == order(r[:4] for r in plain(rows, [prose(50, 9)], settings))
    drawn = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["rank"])
    assert [r[0] for r in drawn] == list(range(1, 601))
    assert [r[1:] for r in drawn] == sorted(r[1:] for r in drawn)
    sizes = importance._cut(*_runs_of(spark, docs, target, settings), 600, 20)[0].groupBy("segment").count().collect()
    assert max(n for s, n in sizes if s <= 5) <= 60


def _runs_of(spark, docs, target, settings):
    gains = importance.bucket_gains(*(importance.bucket_counts(x, settings) for x in (docs, target)))
    runs = docs.select("row", "doc_id", "text").mapInArrow(importance._score_runs(gains, settings), importance.RUNS)
    return runs.persist(), runs.count()


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 50)
    text = prose(200, 3).encode()
    for settings in (Settings(), Settings(max_run=3)):
        parts = [p for p in importance.features([b"a b", text, b""], settings)]
        got = np.sort(np.concatenate([p[2] for p in parts if p[0] == 1 and p[1] == 1]))
        want = plain([(0, text.decode())], [], settings)[0][1]
        assert len(got) == want


def test_draw_keeps_the_columns(spark, edge_docs):
    target = spark.createDataFrame([(prose(50, 9),)], "text string")
    settings = Settings(percent=50)
    got = importance.draw(edge_docs, target, settings)
    assert got.columns == [*(c for c in edge_docs.columns if c != "score"), "n_features", "weight", "score", "rank"]
    want = [r for r in plain(edge_rows(), [prose(50, 9)], settings) if r[4]]
    assert order((r["doc_id"], r["rank"]) for r in got.collect()) == order((r[0], r[4]) for r in want)


def test_empty_tables(spark, no_docs):
    target = spark.createDataFrame([], "text string")
    assert importance.resample(no_docs, target).collect() == []
    one = spark.createDataFrame([(1, prose(30, 1))], "doc_id long, text string")
    assert order(importance.resample(one, target, Settings(percent=100)).collect()) == order(
        plain([(1, prose(30, 1))], [], Settings(percent=100)))
