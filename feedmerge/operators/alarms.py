"""Alarm evaluation over metric streams (R6), batch form.

An alarm reduces datapoints to one statistic per period (tumbling window),
flags periods that breach a threshold, and fires when the last N periods
in a row all breach.  A period without datapoints is "not breaching"
(missing data) and so breaks the run.

Scale: the windowed aggregation is a partial/final hash aggregate; the run
check then looks at one row per (dimension, period), a table bounded by the
time span divided by the period rather than by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_SLICE = 1000  # periods ordered by one task

STATS = {
    "Maximum": F.max,
    "Minimum": F.min,
    "Sum": F.sum,
    "Average": F.avg,
    "SampleCount": F.count,
}
COMPARISONS = {
    "GreaterThanOrEqualToThreshold": lambda v, t: v >= t,
    "GreaterThanThreshold": lambda v, t: v > t,
    "LessThanThreshold": lambda v, t: v < t,
    "LessThanOrEqualToThreshold": lambda v, t: v <= t,
}


def period_stats(metrics: DataFrame, *, value: str, statistic: str, period: str,
                 dims: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """One row per (dims, period): window_start, window_end, stat."""
    agg = metrics.groupBy(*dims, F.window(F.col(ts).cast("timestamp"), period).alias("w")).agg(
        STATS[statistic](F.col(value)).cast("double").alias("stat"))
    return agg.select(*dims, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "stat")


def breaches(stats: DataFrame, *, threshold: float, comparison: str) -> DataFrame:
    return stats.where(COMPARISONS[comparison](F.col("stat"), F.lit(threshold)))


def consecutive(breaching: DataFrame, *, periods: int, period_seconds: int,
                dims: Sequence[str] = ()) -> DataFrame:
    """Periods ending a run of ``periods`` consecutive breaching periods."""
    if periods <= 1:
        return breaching
    # Slices of time, so that an alarm without dimensions is no single task.
    # The last periods of a slice also go to the next one, as history only.
    length = period_seconds * max(RUN_SLICE, periods)
    second = F.unix_seconds("window_start")
    own = F.floor(second / length)
    until = F.floor((second + period_seconds * (periods - 1)) / length)
    sliced = breaching.withColumn("_slice", F.explode(F.sequence(own, until))).withColumn(
        "_history", F.col("_slice") != own)
    w = Window.partitionBy(*dims, "_slice").orderBy("window_start")
    first = F.lag("window_start", periods - 1).over(w)
    span = F.make_dt_interval(secs=F.lit(period_seconds * (periods - 1)))
    return sliced.withColumn("_first", first).where(
        (F.col("_first") == F.col("window_start") - span) & ~F.col("_history")).drop("_first", "_slice", "_history")


def evaluate(metrics: DataFrame, *, value: str, statistic: str, period_seconds: int, periods: int,
             threshold: float, comparison: str = "GreaterThanOrEqualToThreshold",
             dims: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    stats = period_stats(metrics, value=value, statistic=statistic, period=f"{period_seconds} seconds",
                         dims=dims, ts=ts)
    return consecutive(breaches(stats, threshold=threshold, comparison=comparison),
                       periods=periods, period_seconds=period_seconds, dims=dims)


def heartbeat_gaps(beats: DataFrame, *, min_gap_seconds: int = 300, key: str = "worker_id",
                   ts: str = "ts", bucket: str = "1 hour", as_of: Column | None = None) -> DataFrame:
    """Silences of ``min_gap_seconds`` or more between consecutive heartbeats
    of a worker (5 minutes by default) and, with ``as_of`` (a timestamp), from
    a worker's last heartbeat up to then: missing data is a breach.

    Beats are ordered within a worker and hour; silences across hours come
    from each hour's first and last beat.  So no ordered window holds more
    than one hour of a worker, or one row per hour of it."""
    t = F.col(ts).cast("timestamp")
    timed = beats.select(key, t.alias("_t"), F.window(t, bucket)["start"].alias("_b")).where("_t is not null")
    before = F.lag("_t").over(Window.partitionBy(key, "_b").orderBy("_t"))
    inside = timed.select(key, before.alias("gap_start"), F.col("_t").alias("gap_end"))
    per_bucket = timed.groupBy(key, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    prev = F.lag("_last").over(Window.partitionBy(key).orderBy("_b"))
    gaps = inside.unionByName(per_bucket.select(key, prev.alias("gap_start"), F.col("_first").alias("gap_end")))
    if as_of is not None:
        gaps = gaps.unionByName(per_bucket.groupBy(key).agg(F.max("_last").alias("gap_start"))
                                .select(key, "gap_start", as_of.cast("timestamp").alias("gap_end")))
    seconds = (F.unix_micros("gap_end") - F.unix_micros("gap_start")) / 1e6
    return gaps.where(F.col("gap_start").isNotNull()).select(
        key, "gap_start", "gap_end", seconds.alias("gap_seconds")).where(
        F.col("gap_seconds") >= min_gap_seconds)


def alarm_name(prefix: str, name: str, tenant: Column | None = None) -> Column:
    """``<prefix>-<tenant>-<name>`` or ``<prefix>-<name>``."""
    if tenant is None:
        return F.lit(f"{prefix}-{name}")
    return F.when(tenant.isNull(), F.lit(f"{prefix}-{name}")).otherwise(
        F.concat(F.lit(f"{prefix}-"), tenant, F.lit(f"-{name}")))
