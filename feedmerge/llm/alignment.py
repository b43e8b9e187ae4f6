"""Cross-tokenizer alignment: groups, links and corpus-wide link counts.

Tokenizer A (byte-level BPE) gets a space and the text, tokenizer B
(sentencepiece, which adds that space itself) the text, so the tokens of both
cover the same bytes.

1. Divide: both vocabularies must end a token before white space that follows a
   character of another kind, so a document is first cut there.  The pieces
   repeat; each distinct one is encoded by both tokenizers and aligned once a
   worker, in a bounded cache.
2. Conquer (``align``): a common end near the middle of an interval is looked
   for, from the middle outwards, by bisect in the ends of the other tokenizer;
   both halves follow in the same way.  An interval without an inner common end
   is a leaf group.  A document whose pieces do not give back its bytes, or that
   holds characters at which the cut is not safe, is encoded whole and goes
   through the same routine in one interval.
3. Within a group no inner ends coincide, so walking the ends of both in order
   gives one link (overlapping pair of tokens) a step.
4. Counting: a block of documents keeps its distinct pieces, the distinct id pairs
   of their links with counts, and for each place in the text the number of its
   piece.  Pair counts are added up by Spark; each block gets back the counts of
   its own pairs only (a join on the pair), sums them up per piece, then per
   document.  No pair table is broadcast or held whole anywhere.

Defined cases: null and empty texts, and texts whose tokens do not spell a space
and the text, have no tokens, zeros and ''; null ids and repeated rows are rows
like any other; special tokens' strings are plain text; no rows give no rows;
other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmerge.llm.ragged import RaggedCache
from feedmerge.llm.runtime import materialize, release_memory
from feedmerge.llm.textarrays import as_bytes, hash_spans
from feedmerge.llm.token_counts import load_tokenizer

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
CACHE_PIECES = 600_000
GROUP_BYTES = 1 << 20
BLOCK_BYTES = 12 << 20
NEW_PIECES = 2_000
SPACE = "▁"  # how B's pieces write a space

#: white space other than the ASCII characters texts are cut at
_ODD = re.compile(rb"[\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f"
                  rb"|\xe3\x80\x80|\xe2\x96\x81")
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x09, 0x0A, 0x0B, 0x0C]] = True


# ---- divide and conquer ------------------------------------------------------

def _common_end(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int] | None:
    """(i, j) with a[i] == b[j] within the interval but not its end, i as near
    to the middle as there is one."""
    mid = (a0 + a1 - 1) // 2
    for step in range(a1 - a0):
        for i in ((mid + step,) if not step else (mid + step, mid - step)):
            if a0 <= i < a1 - 1:
                j = bisect_left(b, a[i], b0, b1)
                if j < b1 - 1 and b[j] == a[i]:
                    return i, j
    return None


def align(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups (a0, a1, b0, b1) of tokens with ends ``a`` and ``b`` (ascending,
    the last ones equal): cut wherever an end of both falls."""
    out, todo = [], [(0, len(a), 0, len(b))] if a else []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        cut = _common_end(a, b, a0, a1, b0, b1) if a1 - a0 > 1 and b1 - b0 > 1 else None
        if cut is None:
            out.append((a0, a1, b0, b1))
        else:
            i, j = cut
            todo.append((i + 1, a1, j + 1, b1))
            todo.append((a0, i + 1, b0, j + 1))
    return out


def links(a: list[int], b: list[int], group: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """The overlapping pairs (i, j) of tokens of one group."""
    i, a1, j, b1 = group
    out = [(i, j)]
    while (i, j) != (a1 - 1, b1 - 1):
        if a[i] < b[j]:
            i += 1
        else:
            j += 1
        out.append((i, j))
    return out


# ---- both tokenizers ---------------------------------------------------------

def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes as."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Two tokenizers and what a worker has learnt of pieces of text.

    Cache columns: pairs of linked ids (A's in the high 32 bits), numbers of A
    tokens, B tokens and groups; -1 groups mark a piece that must be seen whole.
    """

    def __init__(self, vocabulary_a: str, vocabulary_b: str):
        import public_tokenizers
        import sentencepiece
        self.a = load_tokenizer(vocabulary_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary_b))
        alphabet = _byte_alphabet()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, k in entries.items():
            self.a_bytes[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode()
                        for k, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(SPACE)
        # the cut is safe if no token of B has white space after something else
        self.safe = not any(re.search(rf"[^{SPACE}\t\n\v\f][{SPACE}\t\n\v\f]|{SPACE}[\t\n\v\f]", p) for p in pieces)
        self.cache = RaggedCache(CACHE_PIECES, "<i8", "<i4")
        self.texts: list[bytes] = []  # of each slot: its groups as text

    def shrink(self) -> None:
        kept = self.cache.shrink()
        if kept is not None:
            self.texts = [self.texts[k] for k in kept.tolist()]

    def _aligned(self, text: bytes, a: list[int], b: list[int]) -> tuple[bytes, list[int], int] | None:
        """(groups as text, linked pairs, groups), or null if a side does not
        spell ``text``."""
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_parts) != text or b"".join(b_parts) != text:
            return None
        if len(a) == 1 or len(b) == 1:
            groups = [(0, len(a), 0, len(b))]
            pairs = [i << 32 | j for i in a for j in b]
        else:
            a_ends, b_ends = _ends(a_parts), _ends(b_parts)
            groups = align(a_ends, b_ends)
            pairs = [a[i] << 32 | b[j] for g in groups for i, j in links(a_ends, b_ends, g)]
        shown = ";".join([f"{','.join(map(str, a[a0:a1]))}|{','.join(map(str, b[b0:b1]))}" for a0, a1, b0, b1 in groups])
        return shown.encode(), pairs, len(groups)

    def learn(self, keys: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Add pieces (each starts with white space) to the cache; their slots."""
        slots = []
        for at in range(0, len(pieces), NEW_PIECES):
            part = pieces[at:at + NEW_PIECES]
            text = [p.decode() for p in part]
            a = [e.ids for e in self.a.encode_batch_fast(text, add_special_tokens=False)]
            # B puts a space before each text: it stands for the piece's own
            # space, or is taken off
            b = self.b.encode([t[1:] if t[0] == " " else t for t in text], num_threads=1)
            flat, sizes, numbers = [], [], []
            for piece, x, y in zip(part, a, b):
                found = None
                if piece[0] != 0x20:
                    if y[:1] == [self.space]:
                        found = self._aligned(piece, x, y[1:])
                        y = y[1:]
                elif len(piece) == 1:  # B gives nothing for an empty text
                    y = [self.space]
                    found = self._aligned(piece, x, y)
                else:
                    found = self._aligned(piece, x, y)
                shown, pairs, groups = found or (b"", [], -1)
                self.texts.append(shown)
                flat += pairs
                sizes.append(len(pairs))
                numbers += (len(x), len(y), groups)
            n = len(part)
            slots.append(self.cache.add(keys[at:at + n], (np.array(flat, "<i8"), np.array(sizes, np.int64)),
                                        (np.array(numbers, "<i4"), np.full(n, 3))))
        return np.concatenate(slots)

    def whole(self, text: bytes) -> tuple[bytes, list[int], int, int, int] | None:
        """(groups as text, pairs, A tokens, B tokens, groups) of a space and a
        text seen as one interval; null if a side does not spell it."""
        a = self.a.encode(text.decode(), add_special_tokens=False).ids
        b = self.b.encode(text[1:].decode())
        found = self._aligned(text, a, b)
        return found and (found[0], found[1], len(a), len(b), found[2])


def _ends(parts: list[bytes]) -> list[int]:
    return list(accumulate(map(len, parts)))  # a few tokens a piece: an array costs more


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(vocabulary_a: str, vocabulary_b: str) -> Pair:
    """The tokenizers of this worker process."""
    key = (vocabulary_a, vocabulary_b)
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


# ---- blocks ------------------------------------------------------------------

#: one row a block: columns of its documents; ``at`` are bounds of ``places``,
#: the numbers of the distinct pieces in the order of the text (four byte planes);
#: ``link_sizes`` and ``links``: for each distinct piece numbers into ``pairs``
BLOCKS = ("block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "shas array<string>, at array<long>, places binary, link_sizes binary, links binary, "
          "pairs array<long>, counts array<long>")
_BLOCK_KINDS = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(),
                pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their low bytes first, then the next and so on:
    small numbers leave planes of zeros that any codec shortens."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


class _Block:
    """Documents and their pieces until the block is written."""

    def __init__(self, block: int):
        self.block, self.size = block, 0
        self.columns: list[list] = [[] for _ in range(6)]   # ids, n_a, n_b, n_groups, n_links, shas
        self.slots: list[np.ndarray] = []                   # per group: slot of each piece
        self.bounds: list[np.ndarray] = []                  # per group: pieces of each document
        self.own: list[tuple[int, list[int]]] = []          # documents seen whole: (document, pairs)

    def row(self, pair: Pair) -> pa.RecordBatch:
        slots = np.concatenate([*self.slots, np.zeros(0, np.int64)])
        used, place, often = np.unique(slots, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # frequent pieces get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        flat, sizes = pair.cache.rows(0, used[order])
        places, weight = rank[place], often[order]
        counts = np.concatenate([*self.bounds, np.zeros(0, np.int64)])
        if self.own:  # each such document is one piece of its own
            extra = np.zeros(len(counts), np.int64)
            extra[[k for k, _ in self.own]] = len(used) + np.arange(len(self.own))
            at = np.cumsum(counts)[[k for k, _ in self.own]]
            places = np.insert(places, at, extra[[k for k, _ in self.own]])
            counts[[k for k, _ in self.own]] += 1
            flat = np.concatenate([flat, *(np.array(p, np.int64) for _, p in self.own)])
            sizes = np.r_[sizes, [len(p) for _, p in self.own]]
            weight = np.r_[weight, np.ones(len(self.own), np.int64)]
        pairs, number = np.unique(flat, return_inverse=True)
        total = np.bincount(number, np.repeat(weight, sizes), len(pairs)).astype(np.int64)
        row = [self.block, *self.columns, np.r_[0, np.cumsum(counts)], _planes(places),
               sizes.astype("<u4").tobytes(), _planes(number), pairs, total]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_KINDS)], names=_BLOCK_NAMES)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about GROUP_BYTES."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text) + 1
        if size >= GROUP_BYTES:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _add_group(block: _Block, pair: Pair, ids: list, texts: list[bytes]) -> None:
    """Encode and align the documents (non-empty texts in pieces) into the block."""
    odd = [bool(t) and (not pair.safe or _ODD.search(t) is not None) for t in texts]
    spaced = [b" " + t if t and not o else b"" for t, o in zip(texts, odd)]
    data = b"".join(spaced)
    bounds = np.cumsum([0] + [len(t) for t in spaced])
    buf = np.frombuffer(data, np.uint8)
    space = _CUT[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    cut[bounds] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    keys, at, own = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
    slots = pair.cache.find(keys)
    new = np.flatnonzero(slots < 0)
    if len(new):
        pieces = [data[x:y] for x, y in zip(start[at[new]].tolist(), end[at[new]].tolist())]
        slots[new] = pair.learn(keys[new], pieces)
    slot = slots[own]
    numbers = pair.cache.rows(1, slots)[0].reshape(-1, 3).astype(np.int64)
    link = pair.cache.rows(0, slots)[1]
    first = np.searchsorted(start, bounds)
    per_piece = np.c_[numbers, link][own]
    total = np.r_[np.zeros((1, 4), np.int64), np.cumsum(per_piece, axis=0)]
    total = total[first[1:]] - total[first[:-1]]
    # a piece that does not spell itself: the document is seen whole
    broken = np.r_[0, np.cumsum(per_piece[:, 2] < 0)]
    broken = broken[first[1:]] > broken[first[:-1]]
    shown = [pair.texts[k] for k in slots.tolist()]
    place = own.tolist()
    keep = np.ones(len(slot), bool)
    for k, text in enumerate(texts):
        sha, row = "", total[k].tolist()
        if odd[k] or broken[k]:
            keep[first[k]:first[k + 1]] = False
            found = pair.whole(b" " + text)
            row = [0, 0, 0, 0]
            if found:
                row = [found[2], found[3], found[4], len(found[1])]
                sha = hashlib.sha256(found[0]).hexdigest()
                block.own.append((len(block.columns[0]), found[1]))
        elif text:
            sha = hashlib.sha256(b";".join([shown[x] for x in place[first[k]:first[k + 1]]])).hexdigest()
        for column, value in zip(block.columns, [ids[k], *row, sha]):
            column.append(value)
    block.slots.append(slot[keep])
    kept = np.r_[0, np.cumsum(keep)][first]
    block.bounds.append(np.diff(kept))
    block.size += sum(map(len, texts))


def _blocks(vocabulary_a: str, vocabulary_b: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(vocabulary_a, vocabulary_b)
        name = TaskContext.get().partitionId() << 32
        pair.shrink()
        block = _Block(name)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for first, last in _groups(texts):
                _add_group(block, pair, ids[first:last], texts[first:last])
                if block.size >= block_bytes:
                    yield block.row(pair)
                    pair.shrink()  # slots only change between blocks
                    release_memory()
                    name += 1
                    block = _Block(name)
        if block.columns[0]:
            yield block.row(pair)
    return run


ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")
_ALIGNED_NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the corpus-wide counts of their pairs: rows of documents."""
    _pairs.clear()  # every piece is aligned by now: the caches only take memory
    release_memory()
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(c)[k] for c, n in enumerate(batch.schema.names)}
            number = _unplanes(row["links"].as_py())
            sizes = np.frombuffer(row["link_sizes"].as_py(), "<u4").astype(np.int64)
            places = _unplanes(row["places"].as_py())
            at = row["at"].values.to_numpy()
            count = row["totals"].values.to_numpy(zero_copy_only=False)
            best = row["bests"].values.to_numpy(zero_copy_only=False).astype(np.int64)

            def per_document(value: np.ndarray) -> pa.Array:
                per_link = np.r_[0, np.cumsum(value[number])]
                ends = np.cumsum(sizes)
                per_piece = per_link[ends] - per_link[ends - sizes]
                per_place = np.r_[0, np.cumsum(per_piece[places])]
                return pa.array(per_place[at[1:]] - per_place[at[:-1]])

            columns = [row[n].values for n in ("ids", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*columns, per_document(best), per_document(count), row["shas"].values],
                                             names=_ALIGNED_NAMES)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, total, best): links that hold an id pair corpus-wide, and whether
    no pair with the same B id is held by more."""
    pairs = (blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
             .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total")))
    pairs = materialize(pairs, "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = pairs.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    return (pairs.withColumn("b", b).join(most, "b")
            .select("pair", "total", (F.col("total") == F.col("most")).alias("best")))


def align_documents(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256
    of every row of (doc_id, text)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = materialize(given.mapInArrow(_blocks(vocabulary_a, vocabulary_b, block_bytes), BLOCKS), "aligned-blocks",
                         large_rows=True)
    own = blocks.select("block", F.posexplode("pairs").alias("k", "pair"))
    # a block's pairs are bounded by its bytes
    answers = (own.join(pair_counts(blocks), "pair").groupBy("block")
               .agg(F.array_sort(F.collect_list(F.struct("k", "total", "best"))).alias("_all"))
               .select("block", F.col("_all.total").alias("totals"), F.col("_all.best").alias("bests")))
    none = F.array().cast("array<long>"), F.array().cast("array<boolean>")
    both = (blocks.drop("pairs", "counts").join(answers, "block", "left")
            .withColumn("totals", F.coalesce("totals", none[0])).withColumn("bests", F.coalesce("bests", none[1])))
    return both.mapInArrow(_finish, ALIGNED)
