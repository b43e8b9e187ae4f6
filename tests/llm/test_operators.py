"""Every corpus operator against brute force, on edge rows and small tables."""

import struct

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from llm.brute import (KINDS, base_spans, contained, fold, jaccard_components, kneser_ney, remove_windows, sha, span_text,
                   vector_links)
from llm.edge import SMALL, edge_rows
from feedmerge.llm import (byte_bpe, decontamination, embedding_dedup, jaccard_join, kneser_ney as lm, pii, quality,
                           substring_dedup, token_counts, toxicity)
from feedmerge.llm.pretokens import Recent
from feedmerge.llm.queries import QUERIES
from feedmerge.llm.runtime import components


def order(rows):
    return sorted(rows, key=repr)


def small(spark, table="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("where", ["small", "edge"])
class TestQueries:
    @pytest.fixture()
    def at(self, where, edge_dir):
        return SMALL if where == "small" else edge_dir

    @pytest.fixture()
    def rows(self, spark, where):
        return small(spark) if where == "small" else edge_rows()

    def test_pii(self, spark, at, rows):
        got = [tuple(r) for r in QUERIES["op1_pii"](spark, at).collect()]
        want = []
        for doc_id, text in rows:
            base = base_spans(text)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            want.append((doc_id, *counts, sha(span_text(base))))
        assert order(r[:6] for r in got) == order(want)
        texts = {(i, sha(span_text(base_spans(t)))): t for i, t in rows}
        for r in got:
            base = span_text(base_spans(texts[r[0], r[5]]))
            assert set(filter(None, base.split(","))) <= set(r[6].split(","))

    def test_kneser_ney(self, spark, at, rows):
        got = [tuple(r) for r in QUERIES["op2_kneser_ney"](spark, at)
               .select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
        for a, b in zip(order(got), order(kneser_ney(rows)), strict=True):
            assert a[:4] == b[:4]
            assert a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-6)

    def test_byte_bpe(self, spark, at, rows):
        codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                  mergeable_ranks=byte_bpe.load_ranks(byte_bpe.VOCABULARY), special_tokens={})
        want = []
        for doc_id, text in rows:
            ids = codec.encode_ordinary(text or "")
            want.append((doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text or "")))
        assert order(tuple(r) for r in QUERIES["op3_byte_bpe"](spark, at).collect()) == order(want)

    def test_substring_dedup(self, spark, at, rows):
        want = [(i, n, gone, sha(kept)) for (i, _), (n, gone, kept) in
                zip(rows, remove_windows([t for _, t in rows]))]
        assert order(tuple(r) for r in QUERIES["op4_substring_dedup"](spark, at).collect()) == order(want)

    @pytest.mark.parametrize("name,mod,held", [("op5_quality", 3, 1), ("op6_toxicity", 5, 0)])
    def test_classifiers(self, spark, at, rows, name, mod, held):
        got = [tuple(r) for r in QUERIES[name](spark, at).collect()]
        assert order((i, h) for i, h, _, _ in got) == order((i, fold(i, mod) == held) for i, _ in rows)
        assert all(0 <= s <= 1 and p == int(s >= 0.5) for _, _, s, p in got)

    def test_token_counts(self, spark, at, rows):
        tokenizer = token_counts.load_tokenizer(token_counts.VOCABULARY)
        want = []
        for doc_id, text in rows:
            n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
            want.append((doc_id, len((text or "").encode()), n, n > 512))
        assert order(tuple(r) for r in QUERIES["op7_token_counts"](spark, at).collect()) == order(want)

    def test_jaccard_join(self, spark, at, rows):
        got = [tuple(r) for r in QUERIES["op9_jaccard_join"](spark, at).collect()]
        assert order(got) == order(jaccard_components(rows))

    def test_decontamination(self, spark, at, rows):
        items = [tuple(r) for r in spark.read.parquet(f"{at}/benchmark.parquet").select("item_id", "text").collect()]
        got = {tuple(r) for r in QUERIES["op10_decontamination"](spark, at)
               .select("doc_id", "item_id", "n_item", "n_shared").collect()}
        assert got == contained(rows, items)


def vectors(rng, n):
    base = rng.normal(size=(n, 64))
    rows = []
    for i in range(n):
        rows.append((len(rows), base[i].tolist(), i % 2))
        for k in range(i % 4):
            near = base[i] + rng.normal(size=64) * 0.25 * (k + 1) / 2
            rows.append((len(rows), near.tolist(), i % 2))
    copy = rows[0][1]
    return rows + [(900, copy, 0), (901, copy, 0), (901, copy, 0), (902, copy, None), (903, None, 0), (904, [0.0] * 64, 0),
                   (905, [float("nan")] * 64, 0), (906, [None] * 64, 0), (907, [], 0), (908, [1.0, 2.0], 0),
                   (None, copy, 0), (909, [float("inf")] * 64, 1)]


def test_embedding_dedup_recall(spark):
    rows = vectors(np.random.default_rng(0), 120)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in embedding_dedup.deduplicate(df).collect()]
    want = vector_links(rows)
    assert len(got) == len(want)
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)
    by_id = {r[0]: r for r in want if r[0] not in (901, None)}
    assert all(r[1] <= by_id[r[0]][1] for r in got if r[0] in by_id)
    alone = {r for r in got if r[0] in (902, 903, 904, 905, 906, 907, 908, 909)}
    assert alone == {(i, 0, i, True) for i in range(902, 910)}


def links_of(rows):
    """Linked pairs by brute force: (label, length) apart, cosines in double precision."""
    found = set()
    for key in {(label, len(v)) for _, v, label in rows}:
        ids = np.array([i for i, v, label in rows if (label, len(v)) == key])
        x = np.array([v for _, v, label in rows if (label, len(v)) == key], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found |= {(int(ids[a]), int(ids[b])) for a, b in np.argwhere(np.triu(x @ x.T >= 0.93, 1))}
    return found


def near_pairs(rng, n, size, share, first=0):
    """n pairs at cosine 0.945; ``share`` of each squared norm lies in one direction."""
    common = rng.normal(size=size)
    common /= np.linalg.norm(common)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)
    own = rng.normal(size=(n, size))
    own = unit(own - (own @ common)[:, None] * common)
    x = np.sqrt(share) * common + np.sqrt(1 - share) * own
    across = rng.normal(size=(n, size))
    across = unit(across - np.einsum("ij,ij->i", across, x)[:, None] * x)
    y = 0.945 * x + np.sqrt(1 - 0.945 ** 2) * across
    return [(first + k, v.tolist(), 0) for k, v in enumerate(np.vstack([x, y]))]


def test_embedding_links_of_any_length_and_direction(spark):
    rng, rows = np.random.default_rng(12), []
    kinds = [(64, 0.0, 300), (48, 0.8, 300), (96, 0.9, 300), (8, 0.0, 60), (1, 0.0, 3)]
    for size, share, n in kinds:
        rows += near_pairs(rng, n, size, share, len(rows)) if size > 1 else [
            (len(rows) + k, [x], 0) for k, x in enumerate((1.0, 2.0, -1.0))]
    rows += [(9000, [1.0, 2.0], 0), (9001, [1.0, 2.001], 0), (9002, [1e200, 2e200], 0), (9003, [-2.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    classes = embedding_dedup.vector_classes(df)
    name = {r["print"]: r["vec_id"] for r in classes.select("print", "vec_id").collect()}
    found = [tuple(sorted((name[r["a"]], name[r["b"]])))
             for r in embedding_dedup.class_links(classes.select("print", "label", "embedding")).collect()]
    want = links_of([(i, (np.array(v) / max(map(abs, v))).tolist(), label) for i, v, label in rows])
    assert len(found) == len(set(found)) and set(found) <= want
    length = {i: len(v) for i, v, _ in rows}
    for size in {len(v) for _, v, _ in rows}:
        here = {pair for pair in want if length[pair[0]] == size}
        assert len(here & set(found)) >= 0.95 * len(here), (size, len(here))
    assert {p for p in found if p[0] >= 9000} == {(9000, 9001), (9000, 9002), (9001, 9002)}


def test_embedding_dedup_ignores_columns_of_any_name(spark):
    rows = near_pairs(np.random.default_rng(4), 5, 16, 0.0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    more = df
    for name in ("print", "size", "n", "slice", "plan", "code", "part", "salt", "kept", "component_id"):
        more = more.withColumn(name, F.lit("x"))
    plain, clashing = (sorted(map(tuple, embedding_dedup.deduplicate(d).collect())) for d in (df, more))
    assert plain == clashing and len(plain) == 10 and sum(r[1] for r in plain) == 10


def test_substrings_widen_with_the_codes():
    easy, hard = np.full(100, 6), np.full(100, 24)
    _, few, _ = embedding_dedup.index_plan(easy, 1_000)
    _, many, tables = embedding_dedup.index_plan(easy, 10 ** 7)
    assert few == 10 and many > 16 and tables <= embedding_dedup.TABLES
    assert embedding_dedup.index_plan(hard, 10 ** 7)[1] < 10
    assert all(int(m).bit_count() == many for m in embedding_dedup.table_masks(many, tables))


def test_embedding_dedup_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.deduplicate(df).count() == 0


def test_empty_tables(spark, no_docs, no_labels):
    items = no_docs.select(F.col("doc_id").alias("item_id"), "text")
    assert pii.find_in_documents(no_docs, pii.train(no_docs)).count() == 0
    assert lm.score(no_docs, lm.train(no_docs)).count() == 0
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(no_docs)).count() == 0
    assert byte_bpe.code_documents(no_docs).count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert quality.score(no_docs, quality.train(no_docs, no_labels)).count() == 0
    assert toxicity.score(no_docs, toxicity.train(no_docs, no_labels)).count() == 0
    assert token_counts.with_counts(no_docs).count() == 0
    assert jaccard_join.keep_one(no_docs).count() == 0
    assert decontamination.search(no_docs, items).count() == 0


def test_clashing_columns(edge_docs, no_labels):
    n = edge_docs.count()
    scored = toxicity.score(edge_docs, toxicity.train(edge_docs, no_labels))
    assert scored.columns.count("score") == 1 and scored.count() == n
    kept = substring_dedup.remove_repeats(edge_docs)
    assert kept.columns.count("kept") == 1 and kept.where("kept = 'old'").count() == 0 and kept.count() == n
    assert pii.redact_documents(edge_docs, pii.train(edge_docs)).columns == edge_docs.columns
    coded = byte_bpe.encode_documents(edge_docs.withColumn("token_ids", F.lit(1)))
    assert coded.columns.count("token_ids") == 1 and coded.count() == n


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 101), (101, 100), (500, 300), (300, 400)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(100, 100), (101, 100), (300, 300), (400, 300), (500, 300)}


def test_prefix_join_finds_every_link_in_a_dense_family(spark):
    """Near copies that link only in part: no link may be lost."""
    rng = np.random.default_rng(2)
    rows = []
    for family in range(6):
        text = [f"w{family}_{k}" for k in range(120)]
        for _ in range(25):
            own = list(text)
            for k in rng.integers(0, len(own), int(rng.integers(0, 6))):
                own[k] = f"x{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(own[:int(rng.integers(90, 121))])))
    got = jaccard_join.cluster(spark.createDataFrame(rows, "id long, text string").repartition(5))
    assert order(tuple(r) for r in got.collect()) == order(jaccard_components(rows))


def test_skip_chain_labels_a_repeat_without_its_pattern():
    weights = {"shape": np.zeros((pii.N_SHAPES, 5)), "chain": np.zeros((5, 5)), "skip": np.zeros((5, 5))}
    weights["shape"][:, 0] = 2.0
    weights["skip"][range(1, 5), range(1, 5)] = 6.0
    text = "call +1 (212) 555-0100 now, or 555-0100 ... again 12125550100; room 12"
    base, every = pii.find_spans("ring +12125550100 or later 12125550100.", weights)
    assert base == [("phone", 5, 17)] and every == [("phone", 5, 17), ("phone", 27, 38)]
    base, every = pii.find_spans("only 12125550100 here", weights)
    assert base == every == []
    assert [k for k, _, _ in pii.find_spans(text, weights)[0]] == ["phone"]


def test_every_repeat_of_an_entity_gets_its_label():
    weights = {"shape": np.zeros((pii.N_SHAPES, 5)), "chain": np.zeros((5, 5)), "skip": np.zeros((5, 5))}
    weights["shape"][:, 0] = 2.0
    weights["skip"][range(1, 5), range(1, 5)] = 6.0
    phone, mail = ("+12125550100", "12125550100", " or "), ("a.smith9@example.com", "a.smith9@example-com", " ")
    for kind, (known, repeat, between) in (("phone", phone), ("email", mail)):
        for tokens in ([known, *[repeat] * 59], [*[repeat] * 30, known, *[repeat] * 30]):
            text = between.join(["ring", *tokens, "now"])
            base, every = pii.find_spans(text, weights)
            assert len(base) == 1 and len(every) == len(tokens)
            assert pii.replace_spans(text, every) == between.join(["ring", *[f"<{kind}>"] * len(tokens), "now"])


def test_the_field_runs_without_a_base_span():
    weights = {"shape": np.zeros((pii.N_SHAPES, 5)), "chain": np.zeros((5, 5)), "skip": np.zeros((5, 5))}
    weights["shape"][:, 0] = 2.0
    weights["shape"][pii.shape_of("12125550100"), 4] = 6.0
    base, every = pii.find_spans("x" * 200_000 + " only 12125550100 here", weights)   # no square time either
    assert base == [] and every == [("phone", 200_006, 200_017)]
    assert pii.shape_of("4111111111111111") != pii.shape_of("4111111111111112")       # the second is no card
    assert pii.shape_of("4111111111111112") == pii.shape_of("9870157079875996")


def test_messages_pass_to_the_end_of_a_long_chain():
    """On a line the messages give the exact marginals (forwards, then backwards)."""
    rng = np.random.default_rng(5)
    weights = {"shape": rng.normal(0, 0.3, (pii.N_SHAPES, 5)), "chain": np.eye(5) * 4.0, "skip": np.zeros((5, 5))}
    text = "+12125550100 " + " ".join(str(k) for k in range(10, 70))
    graph = pii.Graph(text, pii.base_spans("+12125550100"))
    unary = np.exp(weights["shape"][graph.shapes])
    unary[0] = [0, 0, 0, 0, 1]
    link, n = np.exp(weights["chain"]), len(unary)
    ahead, behind = unary.copy(), np.ones_like(unary)
    for k in range(1, n):
        ahead[k] *= ahead[k - 1] @ link
        ahead[k] /= ahead[k].sum()
    for k in range(n - 2, -1, -1):
        behind[k] = link @ (unary[k + 1] * behind[k + 1])
        behind[k] /= behind[k].sum()
    exact = ahead * behind
    assert n == 61 and np.allclose(pii._marginals(graph, weights), exact / exact.sum(axis=1, keepdims=True), atol=1e-4)


def test_base_patterns_equal_the_plain_ones():
    rng = np.random.default_rng(9)
    alphabet = list("0123456789.+-@ ()abZ%_ 411")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, int(rng.integers(1, 60))))
        assert span_text(pii.base_spans(text)) == span_text(base_spans(text)), text


def test_merge_of_a_long_pretoken():
    own = byte_bpe.codec(byte_bpe.VOCABULARY)
    ids = own.merge(b"ab" * 100_000)
    packed = np.array(ids, "<u4").tobytes()
    assert byte_bpe.decoder(byte_bpe.VOCABULARY).decode(packed, step=1000) == b"ab" * 100_000


def test_recent_entries_come_back_from_the_old_generation():
    cache = Recent(2)
    for keys in ({"a", "b", "c"}, {"a", "d"}, {"a", "e", "f"}, {"a"}):
        for key in cache.lacking(keys):
            cache[key] = key.upper()
        assert all(cache[key] == key.upper() for key in keys)
    assert cache.lacking({"a"}) == [] and cache.lacking({"b"}) == ["b"]


def test_both_ways_in_one_worker_equal_each_way(edge_docs):
    """Nulls, empty and long texts, repeats; columns named like the added ones."""
    both = byte_bpe.code_documents(edge_docs.withColumn("token_ids", F.lit(1)).withColumn("n_tokens", F.lit("x")))
    each = byte_bpe.decode_documents(byte_bpe.encode_documents(edge_docs))
    names = ["doc_id", "token_ids", "n_tokens", "decoded"]
    rows = [sorted(map(repr, df.select(*names).collect())) for df in (both, each)]
    assert rows[0] == rows[1]


def test_perfect_hash_is_minimal():
    own = byte_bpe.codec(byte_bpe.VOCABULARY)
    assert sorted(own.table.find(own.keys).tolist()) == list(range(len(own.keys)))


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    for name, label, least in (("op5_quality", "quality", 0.9), ("op6_toxicity", "toxic", 0.9)):
        both = QUERIES[name](spark, at).join(labels, "doc_id").where("held_out")
        assert both.where(F.col("predicted") == F.col(label)).count() >= least * both.count()


def test_base_spans_of_very_long_digit_runs(spark):
    texts = ["0" * 10_000 + "1.2.3.4", "1." + "0" * 5_000 + "255.3.4", "9" * 10_000 + ".1.2.3", "1.2.3." + "0" * 6_000,
             "1.2.3." + "0" * 6_000 + "256", "+" + "1" * 20_000, "4111111111111111" + "0" * 5_000]
    for text in texts:
        assert pii.base_spans(text) == base_spans(text)
    assert pii.base_spans(texts[0]) == [("ip", 0, 10_007)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_ip"] for r in pii.find_in_documents(docs, pii.train(docs)).collect()}
    assert got == {k: len([s for s in base_spans(t) if s[0] == "ip"]) for k, t in enumerate(texts)}
