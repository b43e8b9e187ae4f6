"""Session helpers of the corpus operators: shared scratch, folds, components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmerge.session import scratch_path


#: Rows of whole texts that go to Python at once (Spark's default of 10,000 may
#: be a large part of an executor's memory).
ARROW_ROWS = "1000"
#: And their bytes: a row may be a long text or a whole block of documents.
ARROW_BYTES = str(16 << 20)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: For rows of megabytes: Parquet's writer looks at the size of what it holds after
#: 100 rows only, and a reader takes in as many rows of a row group as there are.
LARGE_ROWS = {"parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1",
              "parquet.page.size.row.check.max": "8"}


def materialize(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """``df`` written once below spark.checkpoint.dir and read back; ``large_rows``:
    in row groups of a few rows, so that a task never holds more of them."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give what this worker no longer uses back to the system: workers stay, and
    the next stage runs beside what they keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod`` (null for null)."""
    return F.crc32(F.col(column).cast("string")) % F.lit(mod)


def held_out(column: str, mod: int, held: int) -> Column:
    """Whether the row is held out; a null id is not."""
    return F.coalesce(fold(column, mod) == held, F.lit(False))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node
    that links reach.  Null-free; loops and repeated edges do no harm.

    Alternating large-star and small-star steps; each round is one written
    table, so lineage stays short and a lost executor costs one round.  A node
    with many links is reduced by a partial minimum, never gathered.  Links are
    joined by a sort: their files are small beside their rows, and Spark would
    broadcast by the files' size.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, name)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = materialize(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.hint("merge"), "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        links = materialize(small, name)
        state = tuple(links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == before or state[0] == 0:
            break
        before = state
    # every link now points at its component's least node
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
