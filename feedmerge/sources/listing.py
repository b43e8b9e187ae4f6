"""Object listings: latest inbound file per vendor prefix (S6/M7) and the
input manifest (K6).

A listing is a table (key, etag, size, last_modified) -- from a file
system via the ``binaryFile`` source (content not read), or from an object
store inventory.  Vendors name a key *prefix* (a string, not a folder); the
objects of a prefix are a range of the sorted keys, see ``latest_by_prefix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedmerge.session import materialize

LISTING_COLUMNS = ("key", "etag", "size", "last_modified")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing of a folder tree (metadata only; file contents are not read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select("path", "modificationTime", "length"))
    return files.select(F.col("path").alias("key"), F.lit(None).cast("string").alias("etag"),
                        F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def _prefix_chains(prefixes: DataFrame) -> DataFrame:
    """(prefix, chain): the given prefixes that begin each prefix, itself
    included, by length.  A prefix is taken apart into its own beginnings, so
    the work grows with the vendors' prefixes, not with the objects."""
    begins = prefixes.select("prefix", F.explode(F.sequence(F.lit(0), F.char_length("prefix"))).alias("n")).select(
        "prefix", F.expr("substring(prefix, 1, n)").alias("begin"))
    known = prefixes.select(F.col("prefix").alias("begin"))
    # substring('x', 1, 0) is '': the empty prefix begins every one
    return (begins.join(known, "begin").groupBy("prefix")
            .agg(F.array_sort(F.collect_set("begin")).alias("chain")))


def latest_by_prefix(listing: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, object): the latest object whose key starts with each distinct
    prefix; on a tie the smallest key.

    The keys that start with a prefix are a range of the sorted keys, and two such
    ranges are nested or apart.  So keys and prefixes are range-partitioned and
    sorted together; the last prefix at or before a key, or one that begins it,
    is the longest match, and the shorter matches begin that one.  Objects are
    reduced to one a longest match (partial aggregates), then along the chains."""
    spark = listing.sparkSession
    prefixes = prefixes.select("prefix").distinct()
    chains = materialize(_prefix_chains(prefixes), "prefix-chains")
    obj = F.struct(*[F.col(c) for c in LISTING_COLUMNS])
    both = (listing.where(F.col("key").isNotNull()).select(F.col("key").alias("at"), F.lit(1).alias("kind"), obj.alias("o"))
            .unionByName(chains.select(F.col("prefix").alias("at"), F.lit(0).alias("kind"),
                                       F.lit(None).cast(listing.select(obj.alias("o")).schema["o"].dataType).alias("o"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(both.repartitionByRange(parts, "at", "kind").withColumn("part", F.spark_partition_id()),
                         "ranged-keys")
    here = F.when(F.col("kind") == 0, F.col("at"))
    # the last prefix of the parts before each one: a row a part
    ends = ranged.groupBy("part").agg(F.max(here).alias("last"))
    before = ends.select("part", F.max("last").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    so_far = F.max(here).over(Window.partitionBy("part").orderBy("at", "kind")
                              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (ranged.withColumn("near", so_far).where("kind = 1").join(before, "part")
              .select("at", "o", F.coalesce("near", "carried").alias("prefix")))
    matches = F.filter("chain", lambda p: F.col("at").startswith(p))
    longest = (placed.join(chains, "prefix").withColumn("_m", matches).where(F.size("_m") > 0)
               .select("o", F.try_element_at("_m", F.lit(-1)).alias("prefix")))
    rank = F.struct((-F.unix_micros(F.col("o.last_modified").cast("timestamp"))).alias("t"), F.col("o.key"))
    latest = longest.groupBy("prefix").agg(F.min_by("o", rank).alias("o"))
    return (latest.join(chains, "prefix").select("o", F.explode("chain").alias("prefix"))
            .groupBy("prefix").agg(F.min_by("o", rank).alias("object")))


def latest_inbound(listing: DataFrame, vendors: DataFrame, prefix_col: str = "s3_prefix") -> DataFrame:
    """Latest object per (tenant, vendor): greatest last_modified; on a tie
    the first in listing order (smallest key).  Vendors join last, by their
    prefix, so a prefix that many share is searched once."""
    wanted = vendors.select("tenant_id", "vendor_id", F.coalesce(F.col(prefix_col), F.lit("")).alias("prefix"))
    found = latest_by_prefix(listing, wanted)
    # a vendor listed twice is one vendor
    return (wanted.join(found, "prefix").groupBy("tenant_id", "vendor_id")
            .agg(F.min_by("object", F.struct((-F.unix_micros(F.col("object.last_modified").cast("timestamp"))).alias("t"),
                                             F.col("object.key"))).alias("_o"))
            .select("tenant_id", "vendor_id", *[F.col(f"_o.{c}").alias(c) for c in LISTING_COLUMNS]))


def input_manifest(listing: DataFrame, vendors: DataFrame, prefix_col: str = "s3_prefix") -> DataFrame:
    """One manifest entry per configured vendor: found (with the selected
    object) or missing (``no_objects_found``)."""
    latest = latest_inbound(listing, vendors, prefix_col)
    prefix = F.coalesce(F.col(prefix_col), F.lit(""))
    m = vendors.join(latest, ["tenant_id", "vendor_id"], "left")
    found = F.col("key").isNotNull()
    return m.select(
        "tenant_id", "vendor_id",
        F.when(found, F.lit("found")).otherwise(F.lit("missing")).alias("status"),
        prefix.alias("s3_prefix"), F.col("required"), prefix.alias("expected_prefix"),
        F.col("key").alias("s3_key"), "etag", "size", "last_modified",
        F.when(found, F.lit("latest_by_last_modified")).alias("selection"),
        F.when(~found, F.lit("no_objects_found")).alias("reason"),
    )
