"""Config versions, run-ledger fold, active runs and alarm evaluation."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from feedmerge.operators import alarms as al
from feedmerge.operators import ledger as lg


def test_latest_config_per_tenant(spark):
    puts = spark.createDataFrame([("tenant-a", 1, "x", 1), ("tenant-a", 2, "y", 2), ("tenant-b", 3, "z", 3),
                                  ("tenant-b", 2, "w", 4), ("tenant-b", 3, "z2", 5)],
                                 "tenant_id string, config_version bigint, config string, seq bigint")
    got = {r.tenant_id: (r.config_version, r.config, r.next_version)
           for r in lg.latest_config(lg.config_versions(puts)).collect()}
    assert got == {"tenant-a": (2, "y", 3), "tenant-b": (3, "z2", 4)}


EVENT_DDL = ("run_id bigint, seq bigint, status string, stage string, started_at timestamp, "
             "finished_at timestamp, completed_at timestamp, failed_stage string, error_code string, "
             "error_message string, errors_artifact_key string, error_report_key string, "
             "artifacts map<string,string>")


def _ev(run, seq, status, stage=None, started=None, finished=None, code=None):
    return (run, seq, status, stage, started, finished, None, stage if code else None, code, code, None, None, None)


def test_fold_runs(spark):
    t = datetime(2020, 1, 1)
    ev = spark.createDataFrame([
        _ev(1, 0, "QUEUED", "QUEUE"),
        _ev(1, 1, "RUNNING", "NORMALIZE", started=t),
        _ev(1, 2, "RUNNING", "FETCH_INPUTS", started=t + timedelta(hours=1)),  # stage cannot go back
        _ev(1, 3, "FAILED", "MERGE_PRICE", finished=t, code="validation_errors"),
        _ev(1, 4, "FAILED", None),                                               # second write without code
        _ev(2, 1, "FAILED", "NORMALIZE", code="DECODE_ERROR"),
        _ev(2, 2, "SUCCEEDED", "COMPLETE", finished=t),                          # clears error fields
    ], EVENT_DDL)
    got = {r.run_id: r for r in lg.run_view(lg.fold_runs(ev)).collect()}
    assert (got[1].status, got[1].stage, got[1].started_at, got[1].error_code) == \
        ("FAILED", "MERGE_PRICE", t, "validation_errors")
    assert (got[2].status, got[2].stage, got[2].error_code, got[2].artifacts) == ("SUCCEEDED", "COMPLETE", None, {})


def test_active_runs(spark):
    ledger = spark.createDataFrame([(1, "a", "RUNNING"), (2, "a", "SUCCEEDED"), (3, "b", "RUNNING"),
                                    (4, "b", "RUNNING")], "run_id bigint, tenant_id string, status string")
    req = spark.createDataFrame([(1, "a"), (5, "a"), (3, "b"), (6, "c")], "run_id bigint, tenant_id string")
    got = {r.run_id: (r.blocked, r.active_run_id) for r in lg.active_runs(req, ledger).collect()}
    assert got == {1: (False, None), 5: (True, 1), 3: (True, 4), 6: (False, None)}


def test_consecutive_breaches_need_adjacent_periods(spark):
    t0 = datetime(2024, 1, 1)
    pts = [(t0 + timedelta(minutes=5 * i), 1.0) for i in (0, 1, 2, 4, 5)]  # gap at period 3
    pts += [(t0 + timedelta(minutes=5 * i), 0.0) for i in (6,)]
    df = spark.createDataFrame(pts, "ts timestamp, v double")
    fired = al.evaluate(df, value="v", statistic="Maximum", period_seconds=300, periods=3, threshold=1)
    assert [r.window_start for r in fired.collect()] == [t0 + timedelta(minutes=10)]


def test_stream_alarm_closes_the_last_periods(spark, tmp_path):
    """Every hour breaches up to the last row of the stream."""
    from feedmerge.plans.catalog import REGISTRY
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=20 * k), k % 3, "error", 1.0) for k in range(200)]
    rows += [(200 + k, start + timedelta(minutes=20 * k), 1, "purchase", 1.0) for k in range(200)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    sf = str(tmp_path)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{sf}/events")
    next((tmp_path / "events").glob("*.parquet")).rename(tmp_path / "events.parquet")
    got = sorted(tuple(r) for r in REGISTRY["alarm_stream"](spark, sf).collect())
    want = sorted((r.tenant_id, r.window_start, r.window_end) for r in REGISTRY["alarm_consecutive"](spark, sf).collect())
    assert len(want) > 0 and got == want


def test_stream_alarm_equals_batch_exactly(spark):
    from feedmerge.plans.catalog import REGISTRY
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in REGISTRY["alarm_stream"](spark, sf).collect())
    assert got == sorted((r.tenant_id, r.window_start, r.window_end)
                         for r in REGISTRY["alarm_consecutive"](spark, sf).collect())


def test_heartbeat_gaps(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0), (1, t0 + timedelta(minutes=10)), (1, t0 + timedelta(hours=30)),
                                (2, t0)], "worker_id bigint, ts timestamp")
    got = [(r.worker_id, r.gap_seconds) for r in al.heartbeat_gaps(df, min_gap_seconds=86400).collect()]
    assert got == [(1, (30 * 3600 - 600.0))]


def test_heartbeat_gaps_inside_an_hour_and_at_the_end(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0), (1, t0 + timedelta(minutes=49)), (2, t0)], "worker_id bigint, ts timestamp")
    end = F.lit("2024-01-01 00:52:00")
    got = sorted((r.worker_id, r.gap_seconds) for r in al.heartbeat_gaps(df, as_of=end).collect())
    assert got == [(1, 49 * 60.0), (2, 52 * 60.0)]


def test_run_of_periods_across_time_slices(spark):
    """A run that crosses a slice's border fires as any other."""
    hour = timedelta(hours=1)
    border = datetime.fromtimestamp(al.RUN_SLICE * 3600 * 400, tz=timezone.utc).replace(tzinfo=None)
    points = [(border + k * hour, 1.0) for k in range(-3, 3)]
    df = spark.createDataFrame(points, "ts timestamp, v double")
    fired = al.evaluate(df, value="v", statistic="Maximum", period_seconds=3600, periods=3, threshold=1)
    assert sorted(r.window_start for r in fired.collect()) == [border + k * hour for k in range(-1, 3)]


def test_upserts_leave_no_copies_behind(spark, tmp_path):
    import os

    from feedmerge.session import checkpoint_dir
    from feedmerge.streaming.buckets import upsert
    at = checkpoint_dir(spark).removeprefix("file://") + "/feedmerge"
    rows = spark.createDataFrame([(k, k * 10) for k in range(20)], "k bigint, v bigint")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    for _ in range(2):
        upsert(spark, str(tmp_path / "t"), rows, ["k"], 4)
    upsert(spark, str(tmp_path / "t"), rows.where("k < 5").withColumn("v", rows.k), ["k"], 4)
    assert not {n for n in set(os.listdir(at)) - before if n.startswith(("upsert", "buckets"))}
    got = {r.k: r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {k: k if k < 5 else k * 10 for k in range(20)}
