"""Latest object per prefix: nested, shared, empty and unmatched prefixes."""

import random

from pyspark.sql import functions as F

from feedmerge.sources.listing import input_manifest, latest_by_prefix, latest_inbound


def _listing(spark, rows):
    plain = [(k, f"e{n}", n, t) for n, (k, t) in enumerate(rows)]
    return spark.createDataFrame(plain, "key string, etag string, size bigint, t bigint").select(
        "key", "etag", "size", F.timestamp_seconds("t").alias("last_modified"))


def _plain(rows, prefix):
    own = [(-t, k) for k, t in rows if k is not None and k.startswith(prefix)]
    return min(own)[1] if own else None


def test_latest_by_prefix_equals_a_scan(spark):
    rng = random.Random(3)
    letters = ["a", "b", "/", "é", "~", "\U0001F600"]
    rows = [("".join(rng.choice(letters) for _ in range(rng.randint(0, 7))), rng.randint(0, 40)) for _ in range(600)]
    rows = list(dict(rows).items()) + [(None, 99)]
    prefixes = ["", "a", "a/", "ab", "abab", "b/é", "é", "~", "zz", "\U0001F600\U0001F600", "a/b", "a/b/", "/"]
    given = spark.createDataFrame([(p,) for p in prefixes * 2], "prefix string")
    got = {r["prefix"]: r["object"]["key"] for r in latest_by_prefix(_listing(spark, rows), given).collect()}
    assert got == {p: k for p in prefixes if (k := _plain(rows, p)) is not None}


def test_vendors_that_share_a_prefix(spark):
    rows = [("in/x/1.csv", 5), ("in/x/2.csv", 9), ("in/y/1.csv", 9), ("in/x/0.csv", 9)]
    vendors = spark.createDataFrame(
        [("t", f"v{k}", "in/x/", True) for k in range(5)] + [("t", "all", None, True), ("u", "file", "in/y/1", False),
                                                             ("u", "none", "out/", False)],
        "tenant_id string, vendor_id string, s3_prefix string, required boolean")
    got = {(r.tenant_id, r.vendor_id): r.key for r in latest_inbound(_listing(spark, rows), vendors).collect()}
    assert got == {**{("t", f"v{k}"): "in/x/0.csv" for k in range(5)}, ("t", "all"): "in/x/0.csv",
                   ("u", "file"): "in/y/1.csv"}
    entries = {r.vendor_id: (r.status, r.reason) for r in input_manifest(_listing(spark, rows), vendors).collect()}
    assert entries["none"] == ("missing", "no_objects_found") and entries["all"] == ("found", None)


def test_no_objects_or_no_vendors(spark):
    vendors = spark.createDataFrame([("t", "v", "in/")], "tenant_id string, vendor_id string, s3_prefix string")
    assert latest_inbound(_listing(spark, []).where("false"), vendors).collect() == []
    assert latest_inbound(_listing(spark, [("in/a", 1)]), vendors.where("false")).collect() == []


def test_objects_are_not_taken_apart(spark):
    """The plan of the search holds no generator over the objects."""
    rows = _listing(spark, [("in/a", 1)])
    prefixes = spark.createDataFrame([("in/",)], "prefix string")
    plan = latest_by_prefix(rows, prefixes)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(key" not in plan and "startswith" in plan.lower()
