"""Incremental ingest: each slot's newest file replaces that slot only."""

import json
import os
import time

from pyspark.sql import functions as F

from feedmerge.sources.feeds import scan_feeds
from feedmerge.streaming.ingest import ingest_stream


def _feed(root, vendor, name, lines):
    d = os.path.join(root, "tenant_id=t", f"vendor_id={vendor}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as f:
        f.write("sku,qty\n" + "".join(f"{s},{q}\n" for s, q in lines))


def _process(spark, paths):
    files, rows = scan_feeds(spark, paths)
    ident = F.regexp_extract("source_file", r"vendor_id=([^/]+)/", 1)
    return rows.select(F.lit("t").alias("tenant_id"), ident.alias("vendor_id"),
                       F.col("values")[0].alias("sku"), F.col("values")[1].alias("qty"))


def test_incremental_ingest_replaces_only_its_slot(spark, tmp_path):
    root, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    _feed(root, "a", "f1.csv", [("A1", 1), ("A2", 2)])
    _feed(root, "b", "f1.csv", [("B1", 5)])
    ingest_stream(spark, root, out, ckpt, _process, ("tenant_id", "vendor_id"))

    def table():
        return sorted((r.vendor_id, r.sku, r.qty) for r in spark.read.parquet(out).collect())
    assert table() == [("a", "A1", "1"), ("a", "A2", "2"), ("b", "B1", "5")]
    # nothing new: a second run changes nothing
    ingest_stream(spark, root, out, ckpt, _process, ("tenant_id", "vendor_id"))
    assert table() == [("a", "A1", "1"), ("a", "A2", "2"), ("b", "B1", "5")]
    # vendor a delivers a newer file: only a's rows are replaced
    time.sleep(1.1)
    _feed(root, "a", "f2.csv", [("A9", 9)])
    ingest_stream(spark, root, out, ckpt, _process, ("tenant_id", "vendor_id"))
    assert table() == [("a", "A9", "9"), ("b", "B1", "5")]


def test_late_older_file_and_empty_newest_file(spark, tmp_path):
    root, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")

    def deliver(name, lines, mtime):
        _feed(root, "a", name, lines)
        os.utime(os.path.join(root, "tenant_id=t", "vendor_id=a", name), (mtime, mtime))
        ingest_stream(spark, root, out, ckpt, _process, ("tenant_id", "vendor_id"))
        return sorted((r.sku, r.qty) for r in spark.read.schema("sku string, qty string, tenant_id string, "
                                                                "vendor_id string").parquet(out).collect())
    assert deliver("new.csv", [("NEW", 1)], 2_000_000_000) == [("NEW", "1")]
    # it arrives later, but is older (and from 2001: no age limit applies)
    assert deliver("old.csv", [("OLD", 2)], 1_000_000_000) == [("NEW", "1")]
    assert deliver("empty.csv", [], 2_000_000_100) == []


def test_scratch_needs_a_shared_folder_on_a_cluster():
    import pytest

    from feedmerge.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def _merge_state(spark, tmp_path, deliveries, fail_at=None):
    """Deliver (vendor, file, [(sku, qty, cost)]) in order through the merged feed."""
    from feedmerge.streaming.merge import MergedFeed
    root, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    rules = spark.sql("""select 't' tenant_id, cast(0.5 as decimal(10,6)) base_margin_pct, cast(0 as decimal(18,6)) min_price,
        cast(1 as decimal(18,6)) shipping_handling_flat, false map_enforce, 'none' map_floor_behavior,
        cast(0 as decimal(18,6)) rounding_increment, true include_shipping_handling, 7L fallback_lead_time_days""")
    merged = MergedFeed(spark, str(tmp_path / "merged"), rules, ("tenant_id", "vendor_id"), ("row_number",), buckets=8)
    calls = []
    update = merged.update

    def failing(epoch, replaced, rows):
        calls.append(epoch)
        if fail_at is not None and len(calls) == fail_at:
            raise RuntimeError("lost")
        update(epoch, replaced, rows)
    merged.update = failing

    def process(spark_, paths):
        _, rows = scan_feeds(spark_, paths)
        v = F.col("values")
        return rows.select(
            F.lit("t").alias("tenant_id"), F.regexp_extract("source_file", r"vendor_id=([^/]+)/", 1).alias("vendor_id"),
            F.col("row_number"), v[0].alias("sku"), v[1].cast("bigint").alias("quantity_available"),
            F.lit(None).cast("bigint").alias("lead_time_days"), v[2].cast("decimal(18,6)").alias("cost"),
            F.lit(None).cast("decimal(18,6)").alias("map_price"), F.lit(0).cast("decimal(18,6)").alias("price"))

    for k, (vendor, name, lines) in enumerate(deliveries):
        d = os.path.join(root, "tenant_id=t", f"vendor_id={vendor}")
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, name), "w") as f:
            f.write("sku,qty,cost\n" + "".join(f"{s},{q},{c}\n" for s, q, c in lines))
        os.utime(os.path.join(d, name), (1_700_000_000 + k, 1_700_000_000 + k))
        for _ in range(2):
            try:
                ingest_stream(spark, root, out, ckpt, process, ("tenant_id", "vendor_id"), merged=merged)
                break
            except Exception as error:  # the batch fails once and is run again
                assert fail_at is not None and "lost" in str(error)
    got = sorted((r.sku, r.vendor_id, int(r.quantity_available), float(r.price), r.lead_time_days)
                 for r in merged.read().collect())
    return merged, got


def _best(state):
    """The winners of {vendor: [(sku, qty, cost)]}, by a plain sort."""
    offers = sorted(((s, -(q > 0), c + 1, v, n, q) for v, rows in state.items() for n, (s, q, c) in enumerate(rows)))
    out = {}
    for s, _, c, v, _, q in offers:
        out.setdefault(s, (s, v, q, c * 1.5, 7))
    return sorted(out.values())


DELIVERIES = [
    ("a", "1.csv", [("S1", 5, 10), ("S2", 5, 10), ("S2", 5, 8), ("S3", 0, 1)]),
    ("b", "1.csv", [("S1", 5, 9), ("S3", 2, 50), ("S4", 1, 1)]),
    ("b", "2.csv", [("S1", 5, 11), ("S5", 1, 1)]),      # loses S1, drops S3 and S4
    ("a", "2.csv", []),                                   # an empty file: all of a's offers go
    ("a", "3.csv", [("S5", 3, 1), ("S6", 1, 2)]),        # a tie on S5: vendor order
]


def test_merged_feed_follows_every_delivery(spark, tmp_path):
    assert _merge_state(spark, tmp_path, DELIVERIES)[1] == _best({v: rows for v, _, rows in DELIVERIES})
    at = str(tmp_path / "out-slots")  # one row a slot, the last two epochs
    epochs = sorted(int(n) for n in os.listdir(at))
    assert len(epochs) == 2 and spark.read.parquet(os.path.join(at, str(epochs[-1]))).count() == 2


def test_merged_feed_after_a_failed_epoch(spark, tmp_path):
    """The epoch fails after the normalised rows are replaced; run again, it still
    knows the SKUs that only the old rows held."""
    state = {v: rows for v, _, rows in DELIVERIES[:3]}
    assert _merge_state(spark, tmp_path, DELIVERIES[:3], fail_at=3)[1] == _best(state)


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    merged, _ = _merge_state(spark, tmp_path, [("a", "1.csv", [(f"S{k}", 1, k) for k in range(40)])])
    files = set(spark.read.parquet(f"{merged.path}/merged").inputFiles())
    _, got = _merge_state(spark, tmp_path, [("b", "1.csv", [("S7", 1, 1)])])
    now = set(spark.read.parquet(f"{merged.path}/merged").inputFiles())
    folders = {f.rsplit("/", 1)[0] for f in files}
    assert len(folders) > 2 and len({f.rsplit("/", 1)[0] for f in now - files}) == 1
    assert len({f.rsplit("/", 1)[0] for f in now & files}) == len(folders) - 1
    assert ("S7", "b", 1, 3.0, 7) in got and len(got) == 40


def _stream_of(spark, folder, batches, schema):
    """A file stream that reads one file a micro-batch, in order."""
    for k, rows in enumerate(batches):
        at = os.path.join(folder, f"{k}.json")
        os.makedirs(folder, exist_ok=True)
        with open(at, "w") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(at, (1_700_000_000 + k, 1_700_000_000 + k))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False)
            .option("maxFileAge", "36500d").json(folder))


def test_heartbeat_sessions_close_after_the_gap(spark, tmp_path):
    """Beats 1 microsecond under the gap apart are one session, the gap apart two;
    a worker is silent from its last beat on."""
    from feedmerge.operators.alarms import heartbeat_gaps
    from feedmerge.streaming import alarms as sa
    day = "2024-01-0"
    beats = [[("a", f"{day}1 00:00:00"), ("a", f"{day}1 00:04:59.999999"), ("b", f"{day}1 00:00:00"), ("a", None)],
             [("a", f"{day}1 00:09:59.999999"), ("b", f"{day}1 00:00:01"), (None, f"{day}1 00:00:00")],
             [("a", f"{day}1 01:00:00"), ("b", f"{day}1 00:30:00"), ("b", f"{day}1 00:30:00")]]
    rows = [[{"worker_id": w, "ts": t} for w, t in batch] for batch in beats]
    stream = _stream_of(spark, str(tmp_path / "in"), rows, "worker_id string, ts timestamp")
    marks, sink = str(tmp_path / "marks"), str(tmp_path / "sink")
    sa.run_to_end(sa.heartbeat_sessions(sa.with_end_mark(stream, marks)), sink, str(tmp_path / "ckpt"), marks)
    sessions = spark.read.parquet(sink).where("worker_id is not null")
    assert sorted((r.worker_id, str(r.first_beat)[11:], str(r.last_beat)[11:], r.beats) for r in sessions.collect()) == [
        ("a", "00:00:00", "00:04:59.999999", 2), ("a", "00:09:59.999999", "00:09:59.999999", 1),
        ("a", "01:00:00", "01:00:00", 1), ("b", "00:00:00", "00:00:01", 2), ("b", "00:30:00", "00:30:00", 2)]
    flat = spark.createDataFrame([b for batch in beats for b in batch if b[0]], "worker_id string, ts string")
    as_of = F.lit(f"{day}1 02:00:00")
    got = sa.silences(sessions, as_of=as_of).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, heartbeat_gaps(flat, as_of=as_of).collect()))


def test_ledger_stream_ignores_redelivered_events(spark, tmp_path):
    """Events over several micro-batches, some delivered again later."""
    from feedmerge.operators.ledger import ERROR_FIELDS, fold_runs
    from feedmerge.streaming.ledger import ledger_stream, run_ledger_stream

    def event(run, seq, status, stage=None, **more):
        return {"run_id": run, "seq": seq, "status": status, "stage": stage,
                "delivered_at": f"2024-01-01 00:{seq:02d}:00", **more}
    first = [event("r1", 1, "QUEUED", "QUEUE"), event("r2", 1, "QUEUED", "QUEUE"), event("r3", 1, "QUEUED", "QUEUE")]
    second = [event("r1", 2, "RUNNING", "NORMALIZE", started_at="2024-01-01 00:02:00"),
              event("r1", 3, "FAILED", "NORMALIZE", error_code="DECODE_ERROR", failed_stage="NORMALIZE"),
              event("r2", 2, "RUNNING", "MERGE_PRICE", artifacts={"summary": "x"}), first[0]]
    third = [event("r1", 4, "RUNNING", "FETCH_INPUTS"), event("r1", 5, "SUCCEEDED", "COMPLETE"), second[1], first[1]]
    schema = ("run_id string, seq bigint, status string, stage string, started_at timestamp, finished_at timestamp, "
              "completed_at timestamp, artifacts map<string,string>, delivered_at timestamp, "
              + ", ".join(f"{c} string" for c in ERROR_FIELDS))
    folder, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    stream = ledger_stream(_stream_of(spark, folder, [first, second, third], schema))
    run_ledger_stream(stream, path, str(tmp_path / "ckpt"), buckets=4)
    got = spark.read.parquet(path).drop("key_bucket")
    once = spark.read.schema(schema).json(folder).dropDuplicates(["run_id", "seq"])
    want = fold_runs(once)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.where("run_id = 'r1'").first().status == "SUCCEEDED"


def test_a_slot_is_one_file_and_emptied_by_tasks(spark, tmp_path, monkeypatch):
    """Rows of a slot that come from many tasks end in one file; slots whose newest
    file has no rows are emptied by the job that writes, not one by one by the driver."""
    from feedmerge.streaming import ingest
    deleted = []
    monkeypatch.setattr(ingest, "delete_path", lambda spark_, path: deleted.append(path))
    root, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")

    def dealt(spark_, paths):
        return _process(spark_, paths).repartition(4)

    def table():
        rows = spark.read.schema("sku string, qty string, tenant_id string, vendor_id string").parquet(out)
        return sorted((r.vendor_id, r.sku) for r in rows.collect())
    vendors = ["a", "b", "c"]
    for v in vendors:
        _feed(root, v, "f1.csv", [(f"S{i}", i) for i in range(40)])
    ingest_stream(spark, root, out, ckpt, dealt, ("tenant_id", "vendor_id"))
    files = [f for _, _, names in os.walk(out) for f in names if f.endswith(".parquet")]
    assert len(files) == 3 and len(table()) == 120 and {v for v, _ in table()} == set(vendors)
    time.sleep(1.1)
    for v in vendors[:2]:
        _feed(root, v, "f2.csv", [])
    ingest_stream(spark, root, out, ckpt, dealt, ("tenant_id", "vendor_id"))
    assert table() == sorted(("c", f"S{i}") for i in range(40))
    assert not [d for d in deleted if "-slots/" not in d]


def test_slot_folders_are_named_as_spark_names_them(spark, tmp_path):
    from feedmerge.streaming.slots import replace_slots
    rows = spark.createDataFrame([("a b", 1), ("c=d", 2), ("e%f/g", 3), (None, 4)], "v string, n int")
    replace_slots(rows, rows.select("v"), str(tmp_path / "ours"), ["v"])
    rows.write.partitionBy("v").parquet(str(tmp_path / "spark"))
    folders = [sorted(d for d in os.listdir(tmp_path / side) if "=" in d) for side in ("ours", "spark")]
    assert folders[0] == folders[1]
    assert sorted(spark.read.parquet(str(tmp_path / "ours")).collect(), key=lambda r: r.n)[2].v == "e%f/g"


def test_ledger_state_lies_in_rocksdb(spark, tmp_path):
    """The state of events and runs is on disk; the session's own setting stays."""
    from feedmerge.streaming import ledger
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with ledger._state_on_disk(spark):
        assert spark.conf.get(key).endswith("RocksDBStateStoreProvider")
    assert spark.conf.get(key, None) == before


def test_slots_are_read_by_tasks(spark, tmp_path, monkeypatch):
    """Slots are as many as feed files: no index of them on the driver."""
    import datetime as dt
    from decimal import Decimal

    from pyspark.sql.readwriter import DataFrameReader

    from feedmerge.streaming.slots import read_slots, replace_slots
    schema = "tenant_id string, bucket bigint, sku string, price decimal(18,6), at timestamp, n int"
    when = dt.datetime(2020, 5, 4, 3, 2, 1, 5)
    made = [(t, b, f"{t}{b}", Decimal("1.25"), when, b) for t in ("a", "b c", "d/e=%", None) for b in (0, 7)]
    rows, out = spark.createDataFrame(made, schema), str(tmp_path / "table")
    slots = rows.select("tenant_id", "bucket")
    replace_slots(rows, slots, out, ["tenant_id", "bucket"])
    (tmp_path / "table" / "_SUCCESS").write_bytes(b"")
    full = spark.createDataFrame([], schema).schema
    order = lambda rs: sorted(rs, key=lambda r: (r[0] or "", r[1]))
    own = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, p: own(self, p) if "listing" in p else 1 / 0)
    assert order(map(tuple, read_slots(spark, out, ["tenant_id", "bucket"], full).collect())) == order(made)
    some = spark.createDataFrame([("a", 7), ("none", 1), ("d/e=%", 0)], "tenant_id string, bucket bigint")
    got = read_slots(spark, out, ["tenant_id", "bucket"], full, some).collect()
    assert order(map(tuple, got)) == order(m for m in made if m[:2] in (("a", 7), ("d/e=%", 0)))
    monkeypatch.setattr(DataFrameReader, "parquet", own)
    assert dict(read_slots(spark, out, ["tenant_id", "bucket"]).dtypes)["at"] == "timestamp"
