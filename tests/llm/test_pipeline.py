"""The pipeline against its stages by brute force."""

import numpy as np
import tiktoken

import corpus_pipeline
import public_tokenizers
from llm.brute import contained, jaccard_components
from llm.edge import SMALL
from feedmerge.llm import byte_bpe, pii, toxicity
from feedmerge.llm.runtime import read


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=repr)


def stage(name, spark, docs, at):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, at)


def test_pipeline(spark, edge_dir):
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                              mergeable_ranks=byte_bpe.load_ranks(byte_bpe.VOCABULARY), special_tokens={})
    for at in (SMALL, edge_dir):
        docs = read(spark, at, "documents")
        model = toxicity.train(docs, read(spark, at, "labels"))
        left = [r for r in rows(docs) if model.score_texts([(r[1] or "").encode()], {})[0] < 0]

        clusters = jaccard_components(left)
        keep, seen = [], set()
        for r, (_, n, part) in sorted(zip(left, clusters), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
            if n == 0 or part is None or part not in seen:
                keep.append(r)
            if n:
                seen.add(part)
        items = [tuple(r) for r in read(spark, at, "benchmark").select("item_id", "text").collect()]
        bad = {k for k in range(len(keep)) if contained([keep[k]], items)}
        keep = [r for k, r in enumerate(keep) if k not in bad]

        got = corpus_pipeline.run(spark, at)
        out = got.collect()
        assert sorted((r["doc_id"] for r in out), key=repr) == sorted((r[0] for r in keep), key=repr)
        weights = pii.train(spark.createDataFrame(keep, "doc_id long, text string"))
        masked = sorted(((i, pii.replace_spans(t, pii.find_spans(t or "", weights)[1])) for i, t in keep), key=repr)
        assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == masked
        assert all(r["round_trip"] for r in out)
        for r in out:
            assert np.frombuffer(r["token_ids"], "<u4").tolist() == codec.encode_ordinary(r["text"] or "")
        assert set(docs.columns) <= set(got.columns)


def test_stages_keep_the_columns(spark, edge_dir):
    docs = read(spark, edge_dir, "documents")
    for name, run in corpus_pipeline.STAGES[:-1]:
        assert run(spark, docs, edge_dir).columns == docs.columns
