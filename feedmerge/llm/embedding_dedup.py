"""Embedding near-dedup: iterative quantisation and multi-index Hamming tables.

1. Equal vectors of one label are one class.  For each vector length a rotation
   is learned on at most ``SAMPLE`` classes (lowest hash first): principal
   components, then iterative quantisation, so that the signs are balanced
   64-bit codes (a shorter vector takes its bits from several rotations).  All
   classes are encoded and indexed.
2. Hash tables hold substrings of the codes.  Every code stands under its
   substring and the neighbours at distance one, so two codes with a substring
   at distance two or less share an entry.  Codes are taken after the mean is
   removed, the threshold is on raw cosines: how far apart the codes of a pair
   at the threshold lie depends on the data, so it is measured, on simulated
   pairs at exactly that cosine.  The radius, the width of the substrings (wider
   for more codes) and the number of tables follow, such that at most ``MISS``
   of those pairs share no entry.  Vectors that all point one way get narrow
   substrings: then most pairs are candidates, as most may be links.  Each pair
   is reported by its first such table at one defined entry.  Entries with more
   than ``BUCKET`` codes are cut into block pairs, so no task holds one whole.
3. Pairs within the radius are reranked: cosine of the original vectors in
   double precision, links at 0.93 or more.  Components of the links follow.

The tables are approximate; tests measure the recall against brute force.  No
link below the threshold is made.

Defined cases: vectors that are null, empty, zero, hold null or non-finite
components or have a null label link with nothing; vectors of different lengths
do not link; copies link with each other; repeated rows count as copies; a null
vec_id counts as a vector, its component is the least id of the others (null if
there is none) and it is not kept.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmerge.llm.runtime import components, materialize, shuffle_partitions

BITS = 64
SAMPLE = 20_000
SLICE = 4_000          # vectors encoded at once
ROUNDS = 30
MISS = 0.005           # share of pairs at the threshold that may share no entry
PROBES = 2_000         # simulated pairs, of each kind
TABLES, WIDEST = 8, 28
BUCKET = 2_000
SALTS = 16             # tasks that the rows of one component are dealt to
THRESHOLD = 0.93
_U = np.uint64


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): signs of ``(x - mean) @ projection`` are the code."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    centred = x - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / max(len(x), 1) + 1e-9 * np.eye(x.shape[1]))
    basis = vectors[:, ::-1][:, :bits]
    v = centred @ basis
    rng, parts = np.random.default_rng(3), []
    while sum(p.shape[1] for p in parts) < bits:
        rotation, _ = np.linalg.qr(rng.normal(size=(basis.shape[1],) * 2))
        # one start settles like another: further bits come from random rotations
        for _ in range(0 if parts else rounds):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        parts.append(basis @ rotation)
    return mean, np.hstack(parts)[:, :bits]


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = (x - mean) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _at_threshold(x: np.ndarray, towards: np.ndarray) -> np.ndarray:
    """Unit vectors whose cosine with the rows of ``x`` is THRESHOLD."""
    across = towards - np.einsum("ij,ij->i", towards, x)[:, None] * x
    norm = np.linalg.norm(across, axis=1, keepdims=True)
    return np.where(norm > 1e-9, THRESHOLD * x + np.sqrt(1 - THRESHOLD ** 2) * across / np.maximum(norm, 1e-9), x)


def threshold_distances(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Hamming distances of simulated pairs at the threshold: noise in any
    direction, and towards another vector."""
    rng = np.random.default_rng(7)
    at = rng.integers(0, len(x), PROBES)
    found = []
    for towards in (rng.normal(size=(PROBES, x.shape[1])), x[rng.integers(0, len(x), PROBES)] - x[at]):
        pair = _at_threshold(x[at], towards)
        found.append(np.bitwise_count(encode(x[at], mean, projection) ^ encode(pair, mean, projection)))
    return np.concatenate(found).astype(int)


def index_plan(distances: np.ndarray, codes: int) -> tuple[int, int, int]:
    """(radius, width, tables): the widest substrings, up to one code an entry,
    that keep the pairs with these distances but for MISS of them."""
    radius = min(BITS, int(np.quantile(distances, 1 - MISS)) + 2)
    for width in range(min(WIDEST, max(8, int(codes).bit_length())), 2, -1):
        meets = np.array([sum(comb(d, k) * comb(BITS - d, width - k) for k in range(3)) / comb(BITS, width)
                          for d in range(BITS + 1)])[distances]
        for tables in range(1, TABLES + 1):
            if ((1 - meets) ** tables).mean() <= MISS:
                return radius, width, tables
    return radius, 2, 1


def table_masks(width: int, tables: int) -> np.ndarray:
    """Bits of each table's substring: disjoint ones first, then from another order."""
    rng, masks = np.random.default_rng(13), []
    while len(masks) < tables:
        order = rng.permutation(BITS)
        masks += [sum(1 << int(b) for b in order[k:k + width]) for k in range(0, BITS - width + 1, width)]
    return np.array(masks[:tables], np.uint64)


def _scaled(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, starts) of non-empty lists, each scaled by a power of two, so that
    no square overflows."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum(size) - size
    _, exponent = np.frexp(np.maximum.reduceat(np.abs(flat), starts))
    return np.ldexp(flat, -np.repeat(exponent, size)), starts


def _unit(column, size: int) -> np.ndarray:
    x = _scaled(column)[0].reshape(-1, size)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, print) with print null for vectors that link with nothing, and
    label and embedding of the class."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & some, F.lit(False))
    # -0.0 and 0.0 are one number
    plain = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + 0.0)
    out = vectors.select("vec_id", "label", plain.alias("embedding"), usable.alias("usable"))
    return out.select("vec_id", "label", "embedding",
                      F.when(F.col("usable"), F.xxhash64("label", "embedding")).alias("print"))


MODEL = "size int, plan int, mean array<double>, projection array<double>"


def _fit(table: pa.Table) -> pa.Table:
    """Rotation and index plan of the vectors of one length."""
    table = table.sort_by("print").slice(0, SAMPLE)
    size, codes = table["size"][0].as_py(), table["n"][0].as_py()
    x = _unit(table["embedding"].combine_chunks(), size)
    mean, projection = learn_rotation(x)
    radius, width, tables = index_plan(threshold_distances(x, mean, projection), codes)
    return pa.table({"size": pa.array([size], pa.int32()),
                     "plan": pa.array([(radius * 100 + width) * 100 + tables], pa.int32()),
                     "mean": pa.array([mean], pa.list_(pa.float64())),
                     "projection": pa.array([projection.reshape(-1)], pa.list_(pa.float64()))})


def _unpack(plan: int) -> tuple[int, np.ndarray]:
    """(radius, masks) of the packed plan."""
    return plan // 10_000, table_masks(plan // 100 % 100, plan % 100)


ENTRIES = "label string, size int, plan int, table int, entry long, print long, code long"


def _entries(vectors: pa.Table, model: pa.Table) -> pa.Table:
    """Each class of a slice under its substrings and their neighbours."""
    out = []
    if vectors.num_rows:
        size, plan = model["size"][0].as_py(), model["plan"][0].as_py()
        mean = model["mean"].combine_chunks().flatten().to_numpy()
        projection = model["projection"].combine_chunks().flatten().to_numpy().reshape(size, BITS)
        code = encode(_unit(vectors["embedding"].combine_chunks(), size), mean, projection)
        for t, mask in enumerate(_unpack(plan)[1]):
            flips = _U(1) << np.arange(BITS, dtype=np.uint64)
            flips = np.r_[_U(0), flips[flips & mask > 0]]
            entry = ((code & mask)[:, None] ^ flips).reshape(-1)
            row = np.repeat(np.arange(len(code)), len(flips))
            at = pa.array(row)
            out.append(pa.table({
                "label": vectors["label"].take(at), "size": pa.array(np.full(len(row), size, np.int32)),
                "plan": pa.array(np.full(len(row), plan, np.int32)), "table": pa.array(np.full(len(row), t, np.int32)),
                "entry": pa.array(entry.view(np.int64)), "print": vectors["print"].take(at),
                "code": pa.array(code.view(np.int64)[row])}))
    return pa.concat_tables(out) if out else pa.table(
        {"label": pa.array([], pa.string()), **{c: pa.array([], pa.int32()) for c in ("size", "plan", "table")},
         **{c: pa.array([], pa.int64()) for c in ("entry", "print", "code")}})


def _meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The one entry at which substrings at distance two or less report."""
    d = x ^ y
    low = d & -d
    return np.where(np.bitwise_count(d.view(np.uint64)) == 2, np.minimum(x ^ low, y ^ low), np.minimum(x, y))


PAIRS = "a long, b long"


def _pairs(table: pa.Table) -> pa.Table:
    """Pairs within the radius that report at their entry, over many entries."""
    plans = table["plan"].to_numpy()
    found = [_plan_pairs(table.filter(pa.array(plans == plan)), *_unpack(int(plan))) for plan in np.unique(plans)]
    a, b = (np.concatenate(c) for c in zip(*found))
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _plan_pairs(table: pa.Table, radius: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the codes of one entry (or of two of its blocks) are compared,
    about a million at a time."""
    label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    size, t, entry, i, j = (table[c].to_numpy().astype(np.int64) for c in ("size", "table", "entry", "i", "j"))
    order = np.lexsort((j, i, entry, t, size, label))
    key = np.column_stack([label, size, t, entry, i, j])[order]
    new = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
    run = np.flatnonzero(new)
    stop = np.r_[run[1:], len(order)][np.cumsum(new) - 1]
    partners = stop - np.arange(len(order)) - 1
    code, name = table["code"].to_numpy().view(np.uint64)[order], table["print"].to_numpy()[order]
    block, t, entry, cross = table["block"].to_numpy()[order], t[order], entry[order], (i != j)[order]
    done = np.r_[0, np.cumsum(partners)]
    left, right, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(done, done[at] + 1_000_000, "right")) - 1)
        p = np.repeat(np.arange(at, to), partners[at:to])
        q = np.arange(len(p)) - (done[p] - done[at]) + p + 1
        near = (np.bitwise_count(code[p] ^ code[q]) <= radius) & (~cross[p] | (block[p] != block[q]))
        p, q = p[near], q[near]
        first = np.ones(len(p), bool)
        for s, mask in enumerate(masks):
            u, v = ((code[k] & mask).view(np.int64) for k in (p, q))
            apart = np.bitwise_count((u ^ v).view(np.uint64)) > 2
            first &= np.where(s < t[p], apart, (s > t[p]) | (_meeting(u, v) == entry[p]))
        left.append(name[p[first]])
        right.append(name[q[first]])
        at = to
    return np.concatenate(left), np.concatenate(right)


def _rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            # the two vectors of a pair have one length: their values lie alike
            (x, starts), (y, _) = _scaled(batch.column(2)), _scaled(batch.column(3))
            dot, xx, yy = (np.add.reduceat(v, starts) for v in (x * y, x * x, y * y))
            close = pa.array(dot / (np.sqrt(xx) * np.sqrt(yy)) >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(close), batch.column(1).filter(close)],
                                             names=["a", "b"])


def class_links(classes: DataFrame) -> DataFrame:
    """(a, b) for (print, label, embedding): linked classes, each pair once."""
    vectors = classes.select("print", F.col("label").cast("string").alias("label"), "embedding",
                             F.size("embedding").alias("size"))
    sized = vectors.join(vectors.groupBy("size").agg(F.count("*").alias("n")), "size")
    # about SAMPLE classes of each length, by hash: the rest does not reach the group
    chosen = F.pmod(F.xxhash64("print", F.lit(5)), F.ceil(F.col("n") / F.lit(SAMPLE)).cast("long")) == 0
    first = vectors.groupBy("size").agg(F.min("print").alias("print")).select("size", "print", F.lit(True).alias("least"))
    sample = sized.join(first, ["size", "print"], "left").where(chosen | F.col("least"))
    models = materialize(sample.select("print", "size", "n", "embedding").groupBy("size").applyInArrow(_fit, MODEL),
                         "rotations")
    slices = F.ceil(F.col("n") / F.lit(SLICE)).cast("long")
    sliced = sized.select("print", "label", "embedding", "size", F.pmod(F.xxhash64("print"), slices).alias("slice"))
    every = models.join(sized.select("size", "n").distinct(), "size").withColumn(
        "slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    entries = materialize(sliced.groupBy("size", "slice").cogroup(every.groupBy("size", "slice"))
                          .applyInArrow(_entries, ENTRIES), "hamming-entries")
    place = ["label", "size", "table", "entry"]
    crowd = entries.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1")
    held = entries.join(crowd, place)
    blocks = F.ceil(F.col("n") / F.lit(BUCKET)).cast("int")
    held = held.select(*place, "plan", "print", "code", blocks.alias("blocks"),
                       F.pmod(F.xxhash64("print"), blocks).cast("int").alias("block"))
    # a row goes to every block pair that its block is part of
    meet = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select(*place, "plan", "print", "code", "block", F.least("block", "other").alias("i"),
                       F.greatest("block", "other").alias("j"))
    # many entries a group: as many groups as keep each at a small share of all rows
    groups = 8 * shuffle_partitions(classes.sparkSession)
    meet = meet.withColumn("group", F.pmod(F.xxhash64(*place, "i", "j"), F.lit(groups)))
    pairs = materialize(meet.groupBy("group").applyInArrow(_pairs, PAIRS), "hamming-pairs")
    left = vectors.select(F.col("print").alias("a"), F.col("embedding").alias("x"))
    right = vectors.select(F.col("print").alias("b"), F.col("embedding").alias("y"))
    both = pairs.hint("merge").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return materialize(both.mapInArrow(_rerank, PAIRS), "vector-links")


def deduplicate(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each vector."""
    rows = materialize(vector_classes(vectors), "vectors")
    classes = materialize(rows.where("print is not null").groupBy("print")
                          .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"),
                               F.count("*").alias("copies"), F.min("vec_id").alias("least")), "vector-classes")
    # a family's links are many rows in a small file: by its size Spark would
    # broadcast them, through the driver, so all joins with links are by a sort
    links = class_links(classes.select("print", "label", "embedding"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).hint("merge")
    counts = classes.select("print", "copies")
    others = (both.join(counts.withColumnRenamed("print", "b"), "b").groupBy(F.col("a").alias("print"))
              .agg(F.sum("copies").alias("others")))
    parts = components(links).withColumnRenamed("node", "print")
    known = (classes.join(others.hint("merge"), "print", "left").join(parts.hint("merge"), "print", "left")
             .select("print", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "least",
                     F.coalesce("component", "print").alias("part")))
    known = materialize(known, "class-components")
    # a class alone in its component has that least id itself
    low = (known.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
           .where("classes > 1").drop("classes"))
    # a component may hold a third of the rows: its rows go to SALTS tasks
    known = known.withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(SALTS)))
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # Spark takes the size before the explode for that after it, and would pass
    # SALTS times what it may broadcast through the driver: joined by a sort
    known = known.join(low.hint("merge"), ["part", "salt"], "left").select(
        "print", "n_links", F.coalesce("component_id", "least").alias("component_id"))
    alone = F.col("print").isNull()
    out = rows.select("vec_id", "print").join(known, "print", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
