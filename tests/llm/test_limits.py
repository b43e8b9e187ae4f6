"""What a worker is given at once, and the cache that it keeps."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from feedmerge.llm.ragged import RaggedCache
from feedmerge.llm.runtime import ARROW_BYTES, read


def test_large_rows_reach_python_in_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    read(spark, "/root/testdata/sf0.001", "documents")
    row = 4_000_000
    blocks = spark.range(0, 15, 1, 1).select(F.repeat(F.lit("x"), row).alias("block"))
    found = blocks.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 15
    assert max(r["size"] for r in found) <= int(ARROW_BYTES) + 2 * row


def test_cache_finds_rows_added_in_any_order():
    rng = np.random.default_rng(5)
    cache, known = RaggedCache(100_000, "<i8"), {}
    for _ in range(30):
        keys = np.setdiff1d(rng.integers(0, 1 << 63, 50).astype(np.uint64), np.array(list(known), np.uint64))
        rng.shuffle(keys)
        sizes = rng.integers(0, 4, len(keys))
        flat = rng.integers(0, 1000, sizes.sum())
        cache.add(keys, (flat, sizes))
        for key, part in zip(keys.tolist(), np.split(flat, np.cumsum(sizes)[:-1])):
            known[key] = part.tolist()
    keys = np.array(sorted(known), np.uint64)
    flat, sizes = cache.rows(0, cache.find(keys))
    assert [p.tolist() for p in np.split(flat, np.cumsum(sizes)[:-1])] == [known[k] for k in keys.tolist()]
    assert (cache.find(np.array([1, 2], np.uint64)) == -1).all()


def test_links_are_not_broadcast(spark, monkeypatch):
    """Links are many rows in small files, salted components many rows of a small
    table: Spark's estimates would pass them through the driver."""
    from feedmerge.llm import embedding_dedup as ed
    from feedmerge.llm import jaccard_join as jj
    plans, write = {}, ed.materialize
    plan_of = (lambda df: df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(ed, "materialize", lambda df, name: plans.update({name: plan_of(df)}) or write(df, name))
    rows = [(k, [1.0, 0.01 * (k % 5), 0.5 * (k // 5)], 0) for k in range(40)]
    out = ed.deduplicate(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert "SortMergeJoin [a#" in plans["vector-links"]
    known = plans["class-components"]
    assert "BroadcastHashJoin [print#" not in known and known.count("SortMergeJoin [print#") >= 2
    docs = [(k, " ".join(f"w{x + k // 4}" for x in range(40))) for k in range(20)]
    pairs = jj.cluster(spark.createDataFrame(docs, "id long, text string"))
    for df in (out, pairs):
        assert "BroadcastHashJoin [part#" not in plan_of(df) and "SortMergeJoin [part#" in plan_of(df)
