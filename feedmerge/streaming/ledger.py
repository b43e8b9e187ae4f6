"""The run ledger as a stream.

Status events arrive at least once.  A redelivered event (same run and sequence
number within the watermark) is dropped; the fold of each run is a streaming
aggregate in update mode, so a micro-batch yields the whole record of the runs it
changes, and these records replace the old ones in a table bucketed by run.
Replaying a micro-batch writes the same records again.

The state holds a key for each event and a record for each run: it lies in
RocksDB, on the executors' disks within a bound of memory, not in their heaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from feedmerge.operators.ledger import fold_runs
from feedmerge.streaming.buckets import upsert

BUCKETS = 64
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # all stores of an executor together
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "1024",
    # counting keys reads each key before it is put
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A query started within it keeps its state in RocksDB (one that was begun
    otherwise goes on as its checkpoint says)."""
    given = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in given.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ledger_stream(events: DataFrame, *, delivered: str = "delivered_at", delay: str = "1 hour") -> DataFrame:
    """Records of changed runs.  ``delivered``: when the event was sent first (a
    redelivery within ``delay`` of it is known as such)."""
    once = events.withWatermark(delivered, delay).dropDuplicatesWithinWatermark(["run_id", "seq"])
    return fold_runs(once)


def run_ledger_stream(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Bring the ledger table up to date with everything that has arrived."""
    spark = stream.sparkSession

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        upsert(spark, path, batch, ["run_id"], buckets)

    with _state_on_disk(spark):
        q = (stream.writeStream.outputMode("update").foreachBatch(on_batch)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
