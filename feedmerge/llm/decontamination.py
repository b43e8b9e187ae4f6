"""Benchmark decontamination: size-partitioned MinHash containment search.

DataFrame functions only.  An item is contained in a document when at least
75 % of the item's distinct 5-word shingles are among the document's.

Items are partitioned by size (powers of two of their shingle count).  All
items of a partition keep a bottom-k MinHash sketch (their k least shingle
hashes) with ``k = u // 4 + 1`` for the partition's upper size ``u``.  A
document that contains 75 % of an item lacks at most ``q - ceil(0.75 q)`` of
its q shingles, so it holds at least ``k - (q - ceil(0.75 q)) >= 1`` values of
the sketch: probing documents' shingle hashes against the sketches loses
nothing, however long the document.  Documents with fewer shingles than an
item needs are pruned by size.  Candidate pairs are then verified on the
shingles themselves.

Defined cases: words are split at white space after A-Z are lower-cased; fewer
than five words make one shingle; null, empty and blank texts match nothing; a
null id is an id like any other; repeated rows (of documents or items) give a
pair once; empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmerge.llm.runtime import materialize

WORDS = 5
PERCENT = 75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, "[\\x20\\x09-\\x0D]+"), "")


def _starts(column: str) -> Column:
    """Start (from 1) of each shingle: one for fewer than five words."""
    n = F.size(column)
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (WORDS - 1), F.lit(1)))).otherwise(
        F.array().cast("array<int>"))


def hashed_shingles(column: str) -> Column:
    return F.array_distinct(F.transform(_starts(column), lambda i: F.xxhash64(F.slice(column, i, WORDS))))


def exact_shingles(column: str) -> Column:
    return F.array_distinct(F.transform(_starts(column), lambda i: F.array_join(F.slice(column, i, WORDS), " ")))


def _need(q: Column) -> Column:
    """Least number of shingles that make 75 % of q."""
    return F.ceil(q * PERCENT / F.lit(100)).cast("int")


def item_table(items: DataFrame) -> DataFrame:
    """(item_id, q, need, shingles, sketch) for (item_id, text), written once."""
    cut = items.select("item_id", words(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    sets = cut.select("item_id", hashed_shingles("_words").alias("hashes"), exact_shingles("_words").alias("shingles"))
    sets = sets.withColumn("q", F.size("shingles"))
    # partition [2**c, 2**(c+1)): its upper size sets the length of the sketch
    upper = F.pow(F.lit(2), F.floor(F.log2(F.col("q").cast("double"))) + 1) - 1
    sets = sets.withColumn("k", F.floor(upper / 4).cast("int") + 1)
    sets = sets.select("item_id", "q", _need(F.col("q")).alias("need"), "shingles",
                       F.slice(F.sort_array("hashes"), 1, F.col("k")).alias("sketch"))
    return materialize(sets, "items").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """A document is its id and text: a null id or a repeated id is no problem."""
    return docs.withColumn("_print", F.xxhash64("text"))


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, _print, item_id) of pairs with enough sketch values in common."""
    cut = _keyed(docs.select("doc_id", "text")).select("doc_id", "_print", words(F.col("text")).alias("_words"))
    sets = cut.select("doc_id", "_print", hashed_shingles("_words").alias("_hashes"))
    # explode() would add a filter on the array, which moves below the projections
    # and cuts the text anew for every shingle; the join drops the outer nulls
    probes = sets.select("doc_id", "_print", F.size("_hashes").alias("n"), F.explode_outer("_hashes").alias("token"))
    # sketch values in common that 75 % containment cannot go below
    least = F.size("sketch") - (F.col("q") - F.col("need"))
    sketches = materialize(items.select("item_id", "need", F.greatest(least, F.lit(1)).alias("least"),
                                        F.explode("sketch").alias("token")), "sketches")
    hits = probes.join(sketches, "token").where(F.col("n") >= F.col("need"))
    return (hits.groupBy("doc_id", "_print", "item_id", "least").agg(F.count("*").alias("common"))
            .where(F.col("common") >= F.col("least")).select("doc_id", "_print", "item_id"))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, _print, item_id, n_item, n_shared) of the contained items."""
    known = item_table(items.select("item_id", "text"))
    pairs = materialize(candidates(docs, known), "candidates")
    keyed = _keyed(docs.select("doc_id", "text"))
    which = pairs.select("doc_id", "_print").distinct()
    same = keyed["doc_id"].eqNullSafe(which["doc_id"]) & (keyed["_print"] == which["_print"])
    chosen = keyed.join(which, same, "left_semi").select("doc_id", "_print", words(F.col("text")).alias("_words"))
    sets = chosen.select("doc_id", "_print", exact_shingles("_words").alias("_own"))
    sets = sets.alias("s").join(pairs.alias("p"), F.col("s.doc_id").eqNullSafe(F.col("p.doc_id"))
                                & (F.col("s._print") == F.col("p._print")))
    sets = sets.select("s.doc_id", "s._print", "_own", "item_id")
    facing = known.select(F.col("item_id").alias("_item"), "q", "need", "shingles")
    both = sets.join(facing, F.col("item_id").eqNullSafe(F.col("_item")))
    both = both.select("doc_id", "_print", "item_id", F.col("q").alias("n_item"), "need",
                       F.size(F.array_intersect("shingles", "_own")).alias("n_shared"))
    return both.where(F.col("n_shared") >= F.col("need")).drop("need").distinct()


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment), one row for each pair
    of a document (id and text) and an item it contains."""
    return contained(docs, items).select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"),
                                         F.col("n_shared").cast("long").alias("n_shared"),
                                         (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns."""
    bad = materialize(contained(docs, items).select(F.col("doc_id").alias("_id"), F.col("_print").alias("_p"))
                      .distinct(), "contaminated")
    keyed = _keyed(docs)
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_p")),
                      "left_anti").select(*docs.columns)


ORACLE = r"""
WITH dw AS (
  SELECT DISTINCT doc_id, text, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
iw AS (
  SELECT DISTINCT item_id, text, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, text, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s
  FROM dw WHERE len(w) > 0),
it AS (
  SELECT DISTINCT item_id, text, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s
  FROM iw WHERE len(w) > 0),
sizes AS (SELECT item_id, text, count(*) AS n_item FROM it GROUP BY 1, 2),
shared AS (
  SELECT d.doc_id, d.text AS dt, i.item_id, i.text AS it, count(*) AS n_shared
  FROM ds d JOIN it i ON d.s = i.s GROUP BY 1, 2, 3, 4)
SELECT DISTINCT doc_id, h.item_id, CAST(n_item AS BIGINT) AS n_item, CAST(n_shared AS BIGINT) AS n_shared,
       n_shared / n_item AS containment
FROM shared h JOIN sizes z ON h.item_id = z.item_id AND h.it = z.text
WHERE n_shared * 100 >= 75 * n_item
"""
