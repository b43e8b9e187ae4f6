"""CSV sink determinism and quoting, positional scan details."""

import glob
import os
from datetime import datetime
from decimal import Decimal

from feedmerge.sinks.csv import write_feed
from feedmerge.sources.feeds import scan_feeds


def _read_text(root, sub):
    files = sorted(glob.glob(os.path.join(root, sub, "part-*")))
    return "".join(open(f, encoding="utf-8").read() for f in files)


def test_output_is_sorted_and_formatted(spark, tmpdir_path):
    rows = [("t", "pin-9", "west", Decimal("0.3"), datetime(2021, 6, 5, 4, 3, 2), 0, 1),
            ("t", "nut-4", "west", Decimal("12"), datetime(2021, 6, 5, 4, 3, 2), 0, 2),
            ("t", "nut-4", "east", Decimal("7.125"), datetime(2021, 6, 5, 4, 3, 2), 0, 3)]
    df = spark.createDataFrame(rows, "tenant_id string, sku string, vendor_id string, price decimal(18,6), "
                                     "updated_at timestamp, vendor_ordinal bigint, row_number bigint")
    lay = spark.createDataFrame([("t", ["sku", "vendor_id", "price", "updated_at"])],
                                "tenant_id string, output_columns array<string>")
    write_feed(df, tmpdir_path, lay)
    assert _read_text(tmpdir_path, "tenant_id=t") == (
        "sku,vendor_id,price,updated_at\n"
        "nut-4,east,7.12,2021-06-05T04:03:02Z\n"
        "nut-4,west,12.00,2021-06-05T04:03:02Z\n"
        "pin-9,west,0.30,2021-06-05T04:03:02Z\n")


def test_quoting_round_trip(spark, tmpdir_path):
    title = 'Hex "A2", zinc\nlong'
    df = spark.createDataFrame([("t", "S1", "v", title, 0, 1), ("t", "S2", "v", "", 0, 2)],
                               "tenant_id string, sku string, vendor_id string, title string, "
                               "vendor_ordinal bigint, row_number bigint")
    lay = spark.createDataFrame([("t", ["sku", "title", "missing_col"])], "tenant_id string, output_columns array<string>")
    out = os.path.join(tmpdir_path, "o")
    write_feed(df, out, lay, one_file_per_partition=True)
    text = _read_text(out, "tenant_id=t")
    assert text == 'sku,title,missing_col\nS1,"Hex ""A2"", zinc\nlong",\nS2,,\n'
    files, rows = scan_feeds(spark, glob.glob(os.path.join(out, "tenant_id=t", "part-*")))
    assert files.first().header == ["sku", "title", "missing_col"]
    got = sorted((r.row_number, r.values[0], r.values[1]) for r in rows.collect())
    assert got == [(2, "S1", title), (3, "S2", None)]


def test_positional_scan_rows_headers_and_numbers(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "a.csv")
    with open(a, "w") as f:
        f.write('SKU,QTY,COST\n"A,1",5,"10.5"\n\nB,7\nC,8,9,10\n"D\nx",1,2\n')
    b = os.path.join(tmpdir_path, "b.csv")
    with open(b, "w") as f:
        f.write("Sku,sku,x\n" + "".join(f"s{i},t{i},{i}\n" for i in range(500)))
    files, rows = scan_feeds(spark, [a, b])
    heads = {os.path.basename(r.source_file): r.header for r in files.collect()}
    assert heads == {"a.csv": ["SKU", "QTY", "COST"], "b.csv": ["Sku", "sku", "x"]}
    ra = sorted((r.row_number, [v for v in r.values if v is not None]) for r in rows.collect()
                if r.source_file.endswith("a.csv"))
    # blank line skipped and not counted; short row padded; long row kept whole
    assert ra == [(2, ["A,1", "5", "10.5"]), (3, ["B", "7"]), (4, ["C", "8", "9", "10"]), (5, ["D\nx", "1", "2"])]
    rb = sorted(r.row_number for r in rows.collect() if r.source_file.endswith("b.csv"))
    assert rb == list(range(2, 502))


def test_wide_header_is_read_again_wider(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "w.csv")
    names = [f"c{i}" for i in range(40)]
    with open(p, "w") as f:
        f.write(",".join(names) + "\n" + ",".join(str(i) for i in range(40)) + "\n")
    files, rows = scan_feeds(spark, [p])
    assert files.first().header == names
    assert rows.first().values[39] == "39"


def test_header_case_sensitive_and_last_duplicate_wins(spark):
    from pyspark.sql import functions as F
    from feedmerge.operators.normalize import header_position
    df = spark.createDataFrame([(["SKU", "sku", "Qty", "sku"],)], "header array<string>")
    got = df.select(header_position(F.lit("sku")).alias("a"), header_position(F.lit("SKU")).alias("b"),
                    header_position(F.lit("qty")).alias("c")).first()
    assert (got.a, got.b, got.c) == (4, 1, 0)


def test_filesystem_listing_latest_per_prefix(spark, tmpdir_path):
    import time
    from feedmerge.sources.listing import latest_inbound, list_files
    for vendor, names in (("v1", ["a.csv", "b.csv"]), ("v2", ["c.csv"])):
        d = os.path.join(tmpdir_path, "inbound", vendor)
        os.makedirs(d)
        for n in names:
            with open(os.path.join(d, n), "w") as f:
                f.write("sku\n")
            time.sleep(1.1)
    listing = list_files(spark, os.path.join(tmpdir_path, "inbound"))
    root = "file:" + os.path.join(tmpdir_path, "inbound")
    vendors = spark.createDataFrame([("t", "v1", f"{root}/v1/"), ("t", "v2", f"{root}/v2/"), ("t", "v3", f"{root}/v3/")],
                                    "tenant_id string, vendor_id string, s3_prefix string")
    got = {r.vendor_id: os.path.basename(r.key) for r in latest_inbound(listing, vendors).collect()}
    assert got == {"v1": "b.csv", "v2": "c.csv"}


def test_range_partitioned_parts_concatenate_to_sorted_feed(spark, tmpdir_path):
    from pyspark.sql import functions as F
    df = spark.range(5000).select(
        F.lit("t").alias("tenant_id"), F.format_string("SKU-%05d", (F.col("id") * 7919) % 5000).alias("sku"),
        F.lit("v").alias("vendor_id"), F.lit(0).cast("bigint").alias("vendor_ordinal"),
        F.col("id").alias("row_number")).repartition(6)
    lay = spark.createDataFrame([("t", ["sku", "vendor_id"])], "tenant_id string, output_columns array<string>")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # keep several ranges at this tiny size
    try:
        write_feed(df, tmpdir_path, lay)
    finally:
        spark.conf.set(key, "true")
    parts = sorted(glob.glob(os.path.join(tmpdir_path, "tenant_id=t", "part-*")))
    assert len(parts) > 1
    lines = _read_text(tmpdir_path, "tenant_id=t").splitlines()
    assert lines[0] == "sku,vendor_id"
    assert lines[1:] == sorted(f"SKU-{i:05d},v" for i in range(5000))


def test_columns_outside_the_layout_are_ignored_or_refused(spark, tmpdir_path):
    import pytest
    df = spark.createDataFrame([("t", "cog-1", "east", "Cog", 0, 1)],
                               "tenant_id string, sku string, vendor_id string, title string, "
                               "vendor_ordinal bigint, row_number bigint")
    some, every = (spark.createDataFrame([("t", columns)], "tenant_id string, output_columns array<string>")
                   for columns in (["sku", "vendor_id"], []))
    out = os.path.join(tmpdir_path, "o")
    with pytest.raises(ValueError, match="not in the output of t: title"):
        write_feed(df, out, some, extras="raise")
    assert not os.path.exists(out)
    write_feed(df, out, some)
    assert _read_text(out, "tenant_id=t") == "sku,vendor_id\ncog-1,east\n"
    write_feed(df, out, every, extras="raise")   # an empty list is all columns
    assert "Cog" in _read_text(out, "tenant_id=t")
