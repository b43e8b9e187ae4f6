"""Alarm evaluation as a streaming query.

Datapoints -> watermark -> tumbling period statistic -> breach filter ->
sliding window of N periods (step one period) over ``window_time`` ->
fire when all N periods breached.  Two chained stateful aggregations in
append mode; a period is emitted once the watermark passes its end, so
the latest periods (still open) appear in later triggers.  When a stream
has ended, ``run_to_end`` closes them with a mark: one row without values
whose time lies behind that of any datapoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedmerge.operators.alarms import COMPARISONS, STATS

END = "9999-01-01 00:00:00"  # the time of the end mark; its own period never closes


def alarm_stream(points: DataFrame, *, value: str, statistic: str, period_seconds: int, periods: int,
                 threshold: float, comparison: str = "GreaterThanOrEqualToThreshold",
                 dims: Sequence[str] = (), ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    period = f"{period_seconds} seconds"
    s = points.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    per = s.groupBy(*dims, F.window(ts, period).alias("w")).agg(
        STATS[statistic](F.col(value)).cast("double").alias("stat"))
    br = per.where(COMPARISONS[comparison](F.col("stat"), F.lit(threshold)))
    run = br.groupBy(*dims, F.window(F.window_time("w"), f"{period_seconds * periods} seconds", period)
                     .alias("run")).agg(F.count(F.lit(1)).alias("n"), F.max("w.start").alias("window_start"),
                                        F.max("w.end").alias("window_end"))
    return run.where(F.col("n") == periods).select(*dims, "window_start", "window_end")


def heartbeat_sessions(beats: DataFrame, *, min_gap_seconds: int = 300, key: str = "worker_id", ts: str = "ts",
                       delay: str = "1 hour") -> DataFrame:
    """Stretches of heartbeats of a worker without a silence of
    ``min_gap_seconds`` or more: first_beat, last_beat, beats.

    A native session window per worker; it closes, and its row appears, when the
    watermark passes the last beat by the gap: that is the alarm "silent since
    last_beat".  State: the open session of each worker."""
    # beats exactly the gap apart are in two sessions
    gap = F.make_dt_interval(secs=F.lit(min_gap_seconds).cast("decimal(18,6)") - F.lit("0.000001").cast("decimal(18,6)"))
    timed = beats.select(key, F.col(ts).cast("timestamp").alias(ts)).where(F.col(ts).isNotNull())
    session = F.session_window(ts, f"{min_gap_seconds * 1_000_000 - 1} microseconds").alias("w")
    return (timed.withWatermark(ts, delay).groupBy(key, session).agg(F.count(F.lit(1)).alias("beats"))
            .select(key, F.col("w.start").alias("first_beat"), (F.col("w.end") - gap).alias("last_beat"), "beats"))


def silences(sessions: DataFrame, *, min_gap_seconds: int = 300, key: str = "worker_id",
             as_of: Column | None = None) -> DataFrame:
    """Gaps between the closed sessions of a worker and, with ``as_of``, after
    its last one.  The ordered window holds at most one row per gap of a worker."""
    following = F.lead("first_beat").over(Window.partitionBy(key).orderBy("first_beat"))
    end = following if as_of is None else F.coalesce(following, as_of.cast("timestamp"))
    gaps = sessions.select(key, F.col("last_beat").alias("gap_start"), end.alias("gap_end"))
    seconds = (F.unix_micros("gap_end") - F.unix_micros("gap_start")) / 1e6
    return gaps.withColumn("gap_seconds", seconds).where(F.col("gap_seconds") >= min_gap_seconds)


def run_to_completion(stream: DataFrame, sink_path: str, checkpoint: str) -> None:
    """Process everything available now (then stop) into a parquet sink."""
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", sink_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def with_end_mark(points: DataFrame, marks: str) -> DataFrame:
    """``points`` and the rows that ``run_to_end`` puts into the folder ``marks``."""
    spark = points.sparkSession
    spark.createDataFrame([], points.schema).write.mode("overwrite").parquet(marks)
    return points.unionByName(spark.readStream.schema(points.schema).parquet(marks))


def run_to_end(stream: DataFrame, sink_path: str, checkpoint: str, marks: str, *, ts: str = "ts") -> None:
    """As ``run_to_completion``, for a stream that has ended: when all is
    processed, the end mark moves the watermark past every open period."""
    spark = stream.sparkSession
    run_to_completion(stream, sink_path, checkpoint)
    schema = spark.read.parquet(marks).schema
    spark.range(1).select(*[F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in schema]
                          ).write.mode("append").parquet(marks)
    run_to_completion(stream, sink_path, checkpoint)
