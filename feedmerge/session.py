"""Session helpers: runtime SQL settings and the shared scratch location."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every feedmerge plan relies on.  They are runtime SQL confs, so
# they can be applied to a session someone else built (the driver's, a
# notebook's) without restarting it.
RUNTIME_CONF = {
    # Naive timestamps are UTC (the reference stores naive UTC datetimes).
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Header maps may name a column twice; the later one wins, as in a
    # Python dict built from the header row.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # HotSpot does not JIT-compile methods above 8000 bytes of bytecode; a
    # fused stage bigger than that would run interpreted.  Past this size
    # Spark keeps the operators' own (split, compilable) generated code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

LISTING_PARALLELISM = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS = 4  # tasks a core that list folders
SCAN_TASKS = 16    # tasks a core that read many small files
SCAN_BYTES = "spark.sql.files.maxPartitionBytes"
# A task that sorts the rows of its split (the first step of the merge) holds about
# ten times their bytes in the file: splits of 128 MB spill, these do not.
SCAN_SPLIT = 32 << 20


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    # Spark lists many folders with a task each (10,000 at most), which costs
    # more than the listing: feeds have a folder a vendor.
    tasks = str(LISTING_TASKS * spark.sparkContext.defaultParallelism)
    if spark.conf.get(LISTING_PARALLELISM, None) != tasks:
        spark.conf.set(LISTING_PARALLELISM, tasks)
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(SCAN_BYTES))
    if split > SCAN_SPLIT:
        spark.conf.set(SCAN_BYTES, str(SCAN_SPLIT))
    checkpoint_dir(spark)
    return spark


def build_session(master: str = "local[*]", app_name: str = "feedmerge",
                  shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Session for tests, benches and local runs (clusters pass their own)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", extra.pop("driver_memory", "8g"))
    )
    for key, value in {**RUNTIME_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a path every executor can
    reach); without it a job there is refused, because a local folder would
    be a different one on every executor.  Only a ``local[...]`` session (a
    test, a laptop) gets a fresh local folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        current = tempfile.mkdtemp(prefix="feedmerge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/feedmerge/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "stage"):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back.

    Used where a result is read more than once (valid rows and rejects of
    one parse) or where lineage should be cut.  The files live in the
    cluster's shared folder, so a lost executor does not lose them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(df):
    """A scan of very many small files in fewer tasks.

    Spark counts each file as some megabytes, so a task reads a few of them and
    costs more to start, and to commit what it writes, than they take to read.
    A scan that has fewer splits stays as it is."""
    return df.coalesce(SCAN_TASKS * df.sparkSession.sparkContext.defaultParallelism)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is (no error if absent)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (none if it is absent)."""
    if not path_exists(spark, path):
        return []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)]
