"""N-gram Jaccard join: a grouped prefix join on 5-word shingle sets.

1. Each block of documents sends its distinct shingles (56-bit hashes, sorted
   and packed by difference) to token buckets.  There copies of one set (same
   fingerprint) count once, and shingles of two or more sets are sent back with
   their document frequency; shingles of one set can join nothing.
2. Per set, shingles are ordered by (frequency, hash); the first
   ``n - ceil(0.75 n) + 1`` are its prefix.  Two sets with Jaccard similarity of
   0.75 or more share a prefix shingle.  Sets with identical prefix and size
   form one group.
3. Pairs of groups (of their members in one component, from the second round on)
   that share a prefix shingle, whose sizes allow the threshold
   and whose sketches do not rule it out (sets of n and m shingles link only if
   they differ in at most (n + m) / 7 of them; differing sketch bits and shingles
   of one set only are a lower bound of that) are expanded into member pairs and
   verified by exact intersection.  First each set is verified against one anchor
   of its posting lists: the set of another component whose shingles are the most
   frequent, that is the middle of a family of near copies.  Then pairs that meet
   in the rarest shared shingles of both, then all.  Sets that are connected by
   then need no more pairs among themselves, so a large family costs a number of
   pairs in proportion to its members, and no link between components is lost.
4. Components of the verified links.

Hash collisions: a shingle is 56 bits, so a pair of sets of 1000 shingles gets
a false common shingle with a chance of about 1e-11; a set fingerprint is 64 bits.

Defined cases: null, empty and blank texts have no shingles and link with
nothing (component: the own id); fewer than five words make one shingle;
repeated rows are separate documents in one component; a null id takes the
least id of its component, or null if that has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedmerge.llm.runtime import components, materialize, shuffle_partitions
from feedmerge.llm.textarrays import as_bytes, hashed, mix, ngram_hashes

WORDS = 5
PERCENT = 75
BLOCK_TOKENS = 2_000_000
BLOCK_DOCS = 60_000
SKETCH = 512      # bits
FIRST = 2         # open shingles of the second round
SALTS = 16        # tasks that the rows of one component are dealt to
_U = np.uint64


def shingle_set(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 56-bit shingles of a document's word hashes."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(ngram_hashes(h, min(words, len(h))) >> _U(8))


def fingerprint(tokens: np.ndarray) -> np.uint64:
    total = int(mix(tokens).sum(dtype=np.uint64)) + len(tokens) * 0x9E3779B97F4A7C15
    return mix(np.array([total & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


def pack(tokens: np.ndarray) -> bytes:
    """Sorted integers: width, first, differences in the fewest whole bytes."""
    gap = np.diff(tokens)
    width = max(1, (int(gap.max()).bit_length() + 7) // 8) if len(gap) else 1
    return bytes([width]) + tokens[:1].tobytes() + gap.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    wide = np.zeros((len(raw) + 1, 8), np.uint8)
    wide[0] = np.frombuffer(data, np.uint8, 8, 1)
    wide[1:, :data[0]] = raw
    return np.cumsum(wide.reshape(-1).view(np.uint64), dtype=np.uint64)


FORWARD = "key long, block long, tokens binary, docs binary, prints binary, ids array<long>"
_FORWARD_NAMES = ["key", "block", "tokens", "docs", "prints", "ids"]


def _forward(n_buckets: int):
    def block_rows(block: int, ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        prints = np.array([fingerprint(s) for s in sets], np.uint64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens, own = tokens[order], np.repeat(np.arange(len(sets)), sizes)[order]
        bucket = ((tokens >> _U(24)) * _U(n_buckets)) >> _U(32)
        bounds = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
        columns: list[list] = [[-1 - block], [block], [sizes.astype(np.int32).tobytes()], [None],
                               [prints.tobytes()], [ids]]
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[k], bounds[k + 1]
            here, index = np.unique(own[a:b], return_inverse=True)
            row = (k, block, pack(tokens[a:b]), here.astype(np.uint16).tobytes() + index.astype(np.uint16).tobytes(),
                   prints[here].tobytes(), None)
            for column, value in zip(columns, row):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=_FORWARD_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids: list = []
        sets: list[np.ndarray] = []
        size = 0
        for batch in batches:
            given, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for first, h, bounds in hashed(texts, lower=True):
                for k in range(len(bounds) - 1):
                    ids.append(given[first + k])
                    sets.append(shingle_set(h[bounds[k]:bounds[k + 1]]))
                    size += len(sets[-1])
                    if size >= BLOCK_TOKENS or len(sets) >= BLOCK_DOCS:
                        yield block_rows(block, ids, sets)
                        block, ids, sets, size = block + 1, [], [], 0
        if sets:
            yield block_rows(block, ids, sets)
    return run


REPLY = "block long, tokens binary, docs binary, counts binary, prints binary, ids array<long>"
_REPLY_NAMES = ["block", "tokens", "docs", "counts", "prints", "ids"]
_REPLY_KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))


def _reply(table: pa.Table) -> pa.Table:
    """One token bucket: frequencies over distinct sets, sent back to blocks."""
    if table["key"][0].as_py() < 0:
        columns = [table["block"], table["tokens"], table["docs"], table["docs"], table["prints"], table["ids"]]
        return pa.table([c.cast(t) for c, t in zip(columns, _REPLY_KINDS)], names=_REPLY_NAMES)
    block = table["block"].to_numpy()
    tokens, where, doc, prints = [], [], [], []
    for k, (t, d, p) in enumerate(zip(table["tokens"].to_pylist(), table["docs"].to_pylist(),
                                      table["prints"].to_pylist())):
        tokens.append(unpack(t))
        p = np.frombuffer(p, np.uint64)
        d = np.frombuffer(d, np.uint16)
        index = d[len(p):]
        doc.append(d[:len(p)][index])
        prints.append(p[index])
        where.append(np.full(len(index), k, np.int32))
    token, where = np.concatenate(tokens), np.concatenate(where)
    doc, prints = np.concatenate(doc), np.concatenate(prints)
    order = np.argsort(token, kind="stable")
    token = token[order]
    same = token[1:] == token[:-1]
    often = np.r_[False, same] | np.r_[same, False]
    order, token = order[often], token[often]
    prints, where, doc = prints[order], where[order], doc[order]
    # a set's least (block, document) speaks for all its copies
    order = np.lexsort((doc, block[where], prints, token))
    token, prints, where, doc = token[order], prints[order], where[order], doc[order]
    live = np.r_[True, (token[1:] != token[:-1]) | (prints[1:] != prints[:-1])][:len(token)]
    token, where, doc = token[live], where[live], doc[live]
    _, index, count = np.unique(token, return_inverse=True, return_counts=True)
    df = count[index]
    shared = df > 1
    token, where, doc, df = token[shared], where[shared], doc[shared], df[shared]
    order = np.lexsort((token, where))
    token, where, doc, df = token[order], where[order], doc[order], df[order]
    rows: list[tuple] = []
    first = np.searchsorted(where, np.arange(len(block) + 1))
    for k in np.flatnonzero(np.diff(first)).tolist():
        a, b = first[k], first[k + 1]
        rows.append((int(block[k]), pack(token[a:b]), doc[a:b].tobytes(),
                     np.minimum(df[a:b], 0xFFFFFFFF).astype(np.uint32).tobytes(), None, None))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _REPLY_KINDS)] if rows else
                    [pa.array([], t) for t in _REPLY_KINDS], names=_REPLY_NAMES)


SETS = "id long, n_shingles long, print long, central double, sketch array<long>, prefix array<long>, tokens array<long>"


def parity_sketch(doc: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """Per document SKETCH bits: the parity of its tokens that fall on each bit.
    Sketches of two sets differ in at most as many bits as the sets differ in
    tokens, whatever the hashes do."""
    out = np.zeros((n, SKETCH // 64), np.int64)
    for a in range(0, n, 4096):
        b = min(a + 4096, n)
        x, y = np.searchsorted(doc, [a, b])
        bit = (doc[x:y].astype(np.int64) - a) * SKETCH + (token[x:y] & (SKETCH - 1))
        odd = (np.bincount(bit, minlength=(b - a) * SKETCH) & 1).astype(np.uint8).reshape(b - a, SKETCH)
        out[a:b] = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
    return out


def _assemble(table: pa.Table) -> pa.Table:
    """One block: per document its shared shingles by (frequency, hash)."""
    own = table["ids"].is_valid().to_numpy()
    k = int(np.flatnonzero(own)[0])
    ids = table["ids"][k].as_py()
    size = np.frombuffer(table["tokens"][k].as_py(), np.int32).astype(np.int64)
    prints = np.frombuffer(table["prints"][k].as_py(), np.int64)
    rest = table.filter(pa.array(~own))
    token = np.concatenate([np.zeros(0, np.uint64), *map(unpack, rest["tokens"].to_pylist())]).astype(np.int64)
    doc = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x, np.uint16) for x in rest["docs"].to_pylist())])
    df = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in rest["counts"].to_pylist())])
    order = np.lexsort((token, df, doc))
    token, doc = token[order], doc[order]
    first = np.searchsorted(doc, np.arange(len(ids) + 1))
    shared = np.diff(first)
    # shingles of one set only come first in the order, and match nothing
    prefix = np.clip(size - -(-PERCENT * size // 100) + 1 - (size - shared), 0, shared)
    keep = prefix > 0
    offsets = np.r_[0, np.cumsum(np.where(keep, shared, 0))]
    kept = token[np.repeat(keep, shared)]
    tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(kept))
    sketch = pa.FixedSizeListArray.from_arrays(pa.array(parity_sketch(doc, token, len(ids)).reshape(-1)), SKETCH // 64)
    sketch = sketch.cast(pa.list_(pa.int64()))
    # how much a set is made of shingles that many others hold
    central = np.bincount(doc, weights=np.log2(df[order]), minlength=len(ids)) / np.maximum(size, 1)
    ahead = np.arange(len(kept)) - np.repeat(offsets[:-1], np.diff(offsets)) < np.repeat(prefix, np.diff(offsets))
    heads = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(prefix)].astype(np.int32)), pa.array(kept[ahead]))
    return pa.table([pa.array(ids, pa.int64()), pa.array(size), pa.array(prints, mask=size == 0), pa.array(central),
                     sketch, heads, tokens],
                    names=["id", "n_shingles", "print", "central", "sketch", "prefix", "tokens"])


def shingle_sets(docs: DataFrame, name: str = "shingle-sets") -> DataFrame:
    """(id, n_shingles, print, central, sketch, prefix, tokens) for (id, text): a
    written table.

    ``print`` identifies equal sets (null for none); ``prefix`` and ``tokens``
    are filled for one document of each set that may join another set;
    ``central`` is the mean log frequency of its shingles, ``sketch`` the parity
    sketch of its shared ones."""
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    sent = docs.select("id", "text").mapInArrow(_forward(buckets), FORWARD)
    replied = sent.groupBy("key").applyInArrow(_reply, REPLY)
    return materialize(replied.groupBy("block").applyInArrow(_assemble, SETS), name)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of prints that meet the threshold exactly."""
    left = sets.select(F.col("print").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("print").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    return (both.select("a", "b", common.alias("c"), "na", "nb")
            .where(F.lit(100) * F.col("c") >= F.lit(PERCENT) * (F.col("na") + F.col("nb") - F.col("c")))
            .select("a", "b"))


def _fits(a: str, b: str):
    """Sizes that allow the threshold."""
    least, most = F.least(a, b), F.greatest(a, b)
    return F.lit(100) * least >= F.lit(PERCENT) * most


def _parts(member: DataFrame, parts: DataFrame) -> DataFrame:
    """(print, g, part) of every set."""
    return (member.join(parts, member["print"] == parts["node"], "left")
            .select("print", "g", F.coalesce("component", "print").alias("part")))


def _anchor_pairs(posting: DataFrame, part_of: DataFrame) -> DataFrame:
    """(a, b): each group with the anchor that it shares the most prefix
    shingles with.  Anchors are, by shingle and size class, the most central
    group and the most central one of another component."""
    place = ["token", "class"]
    tagged = posting.join(part_of.groupBy("g").agg(F.min("part").alias("part")), "g")
    best = F.max(F.struct("central", "g")).alias("best")
    by_part = tagged.groupBy(*place, "part").agg(best)
    first = (by_part.groupBy(*place).agg(F.max(F.struct("best", "part")).alias("one"), F.count("*").alias("parts"))
             .where("parts > 1"))
    second = (by_part.join(first, place).where("part <> one.part").groupBy(*place)
              .agg(F.max("best").alias("two"), F.first("one").alias("one")))
    anchor = F.when(F.col("part") == F.col("one.part"), F.col("two.g")).otherwise(F.col("one.best.g"))
    near = (tagged.join(second, place).select("g", anchor.alias("h"))
            .groupBy("g", "h").agg(F.count("*").alias("common"))
            .groupBy("g").agg(F.max(F.struct("common", "h")).alias("best")))
    return near.select(F.least("g", "best.h").alias("a"), F.greatest("g", "best.h").alias("b")).distinct()


def _apart(left: str, right: str):
    """A lower bound of how many shingles any member of one unit and any of the
    other differ in: bits that all members of one set and none of the other."""
    bits = [F.bit_count(F.col(f"{x}a{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}o{k}"))))
            for x, y in ((left, right), (right, left)) for k in range(SKETCH // 64)]
    return sum(bits, F.col(f"{left}single") + F.col(f"{right}single"))


def _open_pairs(posting: DataFrame, live: DataFrame, part_of: DataFrame, first: int | None) -> DataFrame:
    """(a, b): sets of different components whose groups share a prefix shingle
    (one of the ``first`` rarest open ones of each, if given).

    The members of a group that are of one component are a unit.  Units are
    paired by the bits that all their members have or lack, then the members of
    the remaining pairs by their own sketches."""
    spread = part_of.groupBy("g").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    tagged = posting.select("token", "at", "g", "n").join(spread, "g")
    # open: a shingle that is in more than one component
    open_tokens = (tagged.groupBy("token").agg(F.min("low").alias("x"), F.max("high").alias("y"))
                   .where("x <> y").select("token"))
    tagged = tagged.join(open_tokens, "token", "left_semi")
    if first is not None:
        # a group has at most as many rows as its prefix is long
        rank = F.row_number().over(Window.partitionBy("g").orderBy("at"))
        tagged = tagged.withColumn("_rank", rank).where(F.col("_rank") <= first)
    tagged = materialize(tagged.select("token", "g", "n"), "open-postings")
    words = range(SKETCH // 64)
    member = materialize(part_of.join(tagged.select("g").distinct(), "g", "left_semi").join(
        live.select("print", "n", "single", *[f"s{k}" for k in words]), "print"), "open-members")
    unit = member.groupBy("g", "part").agg(
        F.min("single").alias("single"), *[F.bit_and(f"s{k}").alias(f"a{k}") for k in words],
        *[F.bit_or(f"s{k}").alias(f"o{k}") for k in words])
    placed = materialize(tagged.join(unit, "g"), "open-units")
    one = placed.select("token", *[F.col(c).alias(f"x{c}") for c in placed.columns if c != "token"])
    two = placed.select("token", *[F.col(c).alias(f"y{c}") for c in placed.columns if c != "token"])

    def may():
        return _fits("xn", "yn") & (7 * _apart("x", "y") <= F.col("xn") + F.col("yn"))
    pairs = one.join(two, (one["token"] == two["token"]) & (F.col("xpart") < F.col("ypart")) & may())
    pairs = pairs.select("xg", "xpart", "yg", "ypart").distinct()
    own = [F.col("g"), F.col("part"), F.col("print"), F.col("n"), F.col("single"),
           *[F.col(f"s{k}").alias(f"{c}{k}") for k in words for c in "ao"]]
    own = member.select(*own)
    left = own.select(*[F.col(c).alias(f"x{c}") for c in own.columns])
    right = own.select(*[F.col(c).alias(f"y{c}") for c in own.columns])
    met = pairs.join(left, ["xg", "xpart"])
    met = met.join(right, (met["yg"] == right["yg"]) & (met["ypart"] == right["ypart"]) & may())
    return met.select(F.least("xprint", "yprint").alias("a"), F.greatest("xprint", "yprint").alias("b"))


def links(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, components) between prints: links (a, b) connect exactly the
    sets that the full set of links connects; components (node, component)."""
    words = [F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH // 64)]
    live = materialize(sets.where(F.size("prefix") > 0).select(
        "print", F.col("n_shingles").alias("n"), "central",
        (F.col("n_shingles") - F.size("tokens")).alias("single"), *words, "prefix", "tokens"), "prefix-sets")
    # sets of one prefix and size are one group, named by its least member
    groups = live.groupBy("n", "prefix").agg(F.min("print").alias("g"), F.max("central").alias("central"))
    groups = materialize(groups, "groups")
    member = materialize(live.select("print", "n", "prefix").join(groups.select("n", "prefix", "g"), ["n", "prefix"])
                         .select("print", "g"), "prefix-groups")
    step = float(np.log(100 / PERCENT))
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(step))
    posting = materialize(groups.select(F.posexplode("prefix").alias("at", "token"), "g", "n", "central",
                                        size_class.alias("class")), "postings")

    inside = member.where("print <> g").select(F.col("print").alias("a"), F.col("g").alias("b"))
    found = materialize(_verified(inside, live), "group-links")
    parts = components(found)
    steps = (lambda part_of: _anchor_pairs(posting, part_of),
             lambda part_of: _open_pairs(posting, live, part_of, FIRST),
             lambda part_of: _open_pairs(posting, live, part_of, None))
    for pairs in steps:
        new = materialize(_verified(pairs(_parts(member, parts)), live), "new-links")
        found = found.unionByName(new)
        if new.limit(1).count():
            parts = components(found)
    return found, parts


def cluster(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, component_id) for each row of (id, text)."""
    sets = shingle_sets(docs)
    _, parts = links(sets)
    part = (sets.select("id", "n_shingles", "print").join(parts, F.col("print") == F.col("node"), "left")
            .select("id", "n_shingles", F.coalesce("component", "print").alias("part")))
    part = materialize(part, "set-components")
    # a row alone in its component has the least id itself
    least = (part.where("part is not null").groupBy("part").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
             .where("rows > 1").drop("rows"))
    # a component may hold a third of the rows: its rows go to SALTS tasks
    part = part.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # Spark takes the size before the explode for that after it, and would pass
    # SALTS times what it may broadcast through the driver: joined by a sort
    return part.join(least.hint("merge"), ["part", "salt"], "left").select(
        "id", "n_shingles", F.coalesce("least", "id").alias("component_id"))


def _with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, which names a row by its file and place there: the
    same in every plan, also after executors are lost."""
    try:
        return docs.withColumn("_row", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:  # not a table on disk
        return _with_row_key(materialize(docs, "rows"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component: the least doc_id
    (null last), of repeated ids any one row."""
    numbered = _with_row_key(docs)
    parts = cluster(numbered.select(F.col("_row").alias("id"), "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    kept = (numbered.select("_row", "doc_id").join(parts.select(F.col("id").alias("_row"), "component_id"), "_row")
            .groupBy("component_id").agg(first).select(F.col("first._row").alias("_row")))
    return numbered.join(kept, "_row", "left_semi").select(*docs.columns)
