"""Token counts: batch encoding in Arrow functions that return lengths only.

Each Arrow batch is taken in groups of about equal size in characters.  Texts
are cut at safe boundaries (see ``pretokens``), the distinct pieces of a group
that the task has not met are encoded by the tokenizers library in batches
balanced by bytes, and only their token counts are kept (in a bounded cache).

Defined cases: null and empty texts have 0 bytes and 0 tokens; strings of
special tokens inside texts are one token, as the library does by default;
repeated rows and null ids are counted alike; other columns pass through and
columns named like the added ones are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmerge.llm.pretokens import byte_groups, pieces, shrink

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CACHE_PIECES = 400_000
BATCH_BYTES = 1 << 16


def load_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(name))


def _balanced(items: list[str]) -> Iterator[list[str]]:
    """Batches of about BATCH_BYTES characters."""
    batch, size = [], 0
    for item in items:
        batch.append(item)
        size += len(item)
        if size >= BATCH_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _count_pieces(tokenizer, new: list[str], cache: dict[str, int]) -> None:
    """Pieces that start with a space are encoded as one text: a token never
    spans two of them, so each token belongs to the piece it starts in."""
    spaced = [p for p in new if p[0] in " \n\t" and not p[-1].isspace()]
    for batch in _balanced(spaced):
        ends = np.cumsum([len(p) for p in batch])
        starts = np.fromiter((a for a, _ in tokenizer.encode("".join(batch), add_special_tokens=False).offsets),
                             np.int64)
        counts = np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(batch))
        cache.update(zip(batch, counts.tolist()))
    for batch in _balanced([p for p in new if p not in cache]):
        encoded = tokenizer.encode_batch_fast(batch, add_special_tokens=False)
        cache.update((p, len(e)) for p, e in zip(batch, encoded))


def count_texts(tokenizer, texts: list[str], cache: dict[str, int]) -> list[int]:
    out = []
    for first, end in byte_groups(texts):
        cut = [pieces(t) for t in texts[first:end]]
        used = set().union(*cut)
        shrink(cache, CACHE_PIECES, used)
        _count_pieces(tokenizer, sorted(used.difference(cache)), cache)
        out += [sum(map(cache.__getitem__, c)) for c in cut]
    return out


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text (long)."""
    @F.arrow_udf("long")
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer, cache = load_tokenizer(vocabulary), {}
        for part in parts:
            yield pa.array(count_texts(tokenizer, [t or "" for t in part.to_pylist()], cache), pa.int64())
    return count(text)


def with_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    return (docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
            .withColumn("n_tokens", token_count(F.col("text"), vocabulary))
            .withColumn("over_limit", F.col("n_tokens") > limit))
