"""End-to-end runs through ``run_job``: the golden sample, error
thresholds, missing vendors, encodings and the schema-version gate."""

import glob
import hashlib
import json
import os

from feedmerge.plans.job import run_job

SAMPLE_VENDOR = {
    "inbound": {"type": "local"},
    "parser": {"format": "csv", "delimiter": ",", "encoding": "utf-8",
               "column_map": {"sku": "SKU", "quantity_available": "QTY", "cost": "COST", "map_price": "MAP"}},
}


def sample_config(**over):
    cfg = {
        "schema_version": 1, "tenant_id": "test_tenant", "timezone": "America/Los_Angeles",
        "default_currency": "USD",
        "vendors": [dict(SAMPLE_VENDOR, vendor_id="vendor_1",
                         sku_map={"type": "file", "local_path": "sku_map_vendor_1.csv"}),
                    dict(SAMPLE_VENDOR, vendor_id="vendor_2")],
        "pricing": {"base_margin_pct": 0.20, "min_price": 25.00, "shipping_handling_flat": 9.99,
                    "map_policy": {"enforce": True, "map_floor_behavior": "max(price, map_price)"},
                    "rounding": {"mode": "nearest", "increment": 0.99}},
        "merge": {"strategy": "best_offer", "best_offer": {"sort_by": ["in_stock_desc", "lowest_landed_cost"],
                                                           "landed_cost": {"include_shipping_handling": True},
                                                           "fallback_lead_time_days": 7}},
        "output": {"format": "csv", "columns": ["sku", "quantity_available", "price", "vendor_id", "updated_at"]},
    }
    cfg.update(over)
    return cfg


def _write(path, text, encoding="utf-8"):
    with open(path, "wb") as f:
        f.write(text.encode(encoding) if isinstance(text, str) else text)
    return path


def _run(spark, tmp, configs, feeds, maps=None, run="run-1"):
    cpath = os.path.join(tmp, "configs")
    os.makedirs(cpath, exist_ok=True)
    _write(os.path.join(cpath, "c.json"), "\n".join(json.dumps(c) for c in configs) + "\n")
    fdf = spark.createDataFrame(feeds, "tenant_id string, vendor_id string, path string")
    mdf = spark.createDataFrame(maps or [], "tenant_id string, vendor_id string, path string")
    out = os.path.join(tmp, "out")
    job = run_job(spark, cpath, fdf, out, run_id=run, now="2020-01-01 00:00:00", sku_maps=mdf,
                  one_file_per_tenant=True)
    return job, out


def _merged_text(out, tenant, run="run-1"):
    files = sorted(glob.glob(os.path.join(out, "outputs", "merged_inventory", f"run_id={run}", f"tenant_id={tenant}",
                                          "part-*")))
    return "".join(open(f).read() for f in files)


def test_golden_end_to_end(spark, tmpdir_path):
    v1 = _write(os.path.join(tmpdir_path, "vendor_1.csv"), "SKU,QTY,COST,MAP\nVEND-1,5,10.00,25.00\n")
    v2 = _write(os.path.join(tmpdir_path, "vendor_2.csv"), "SKU,QTY,COST,MAP\nSKU-002,3,15.00,29.99\n")
    m1 = _write(os.path.join(tmpdir_path, "sku_map_vendor_1.csv"), "vendor_sku,sku\nVEND-1,SKU-001\n")
    job, out = _run(spark, tmpdir_path, [sample_config()],
                    [("test_tenant", "vendor_1", v1), ("test_tenant", "vendor_2", v2)],
                    [("test_tenant", "vendor_1", m1)])
    assert [g.status for g in job.gates] == ["SUCCEEDED"]
    assert _merged_text(out, "test_tenant") == (
        "sku,quantity_available,price,vendor_id,updated_at\n"
        "SKU-001,5,25.00,vendor_1,2020-01-01T00:00:00Z\n"
        "SKU-002,3,29.99,vendor_2,2020-01-01T00:00:00Z\n")
    head = "sku,vendor_sku,vendor_id,quantity_available,lead_time_days,cost,map_price,price,msrp,condition,brand," \
           "title,updated_at\n"

    def normalized(vendor):
        files = sorted(glob.glob(os.path.join(out, "normalized", "run_id=run-1", "tenant_id=test_tenant", f"vendor_id={vendor}",
                                              "part-*")))
        return "".join(open(f).read() for f in files)
    assert normalized("vendor_1") == head + "SKU-001,,vendor_1,5,,10.00,25.00,0.00,,,,,2020-01-01T00:00:00Z\n"
    assert normalized("vendor_2") == head + "SKU-002,,vendor_2,3,,15.00,29.99,0.00,,,,,2020-01-01T00:00:00Z\n"


def _policy_config(**policy):
    return sample_config(
        vendors=[{"vendor_id": "vendor-a", "required": policy.pop("required", True), "inbound": {"type": "s3"},
                  "parser": {"format": "csv"}}],
        error_policy=dict(policy), output={"columns": []})


def test_bad_row_within_threshold_succeeds(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"),
               "sku,quantity_available,price\nBOLT,7,2.50\nNUT,seven,0.40\nPIN,3,0.10\n")
    job, _ = _run(spark, tmpdir_path, [_policy_config(max_invalid_rows=2, max_invalid_row_pct=0.4,
                                                      fail_on_missing_required_columns=True)],
                  [("test_tenant", "vendor-a", f)])
    g = job.gates[0]
    assert (g.status, g.invalid_rows, g.total_rows) == ("SUCCEEDED", 1, 3)
    assert "invalid_rows_within_threshold" in g.warnings
    err = job.result.errors.collect()
    assert [(e.row_number, e.reason) for e in err] == [(3, "invalid int: seven")]
    assert err[0].row_data == {"sku": "NUT", "quantity_available": "seven", "price": "0.40"}


def test_bad_row_over_threshold_fails(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"),
               "sku,quantity_available,price\nBOLT,7,2.50\nNUT,seven,0.40\nPIN,3,0.10\n")
    job, out = _run(spark, tmpdir_path, [_policy_config(max_invalid_rows=0, max_invalid_row_pct=0.2)],
                    [("test_tenant", "vendor-a", f)])
    g = job.gates[0]
    assert (g.status, g.stage, g.error_code) == ("FAILED", "MERGE_PRICE", "validation_errors")
    assert _merged_text(out, "test_tenant") == ""


def test_missing_required_column_fails(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), "sku,price\nBOLT,2.50\n")
    job, _ = _run(spark, tmpdir_path, [_policy_config(max_invalid_rows=1, max_invalid_row_pct=0.5,
                                                      fail_on_missing_required_columns=True)],
                  [("test_tenant", "vendor-a", f)])
    g = job.gates[0]
    assert (g.status, g.error_code, g.error_message) == ("FAILED", "missing_required_columns",
                                                         "missing columns: quantity_available")


def test_missing_column_lenient_is_an_error_entry(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), "sku,price\nBOLT,2.50\n")
    job, _ = _run(spark, tmpdir_path, [_policy_config(max_invalid_rows=5, max_invalid_row_pct=1.0,
                                                      fail_on_missing_required_columns=False)],
                  [("test_tenant", "vendor-a", f)])
    err = job.result.errors.collect()
    assert [(e.row_number, e.reason, e.row_data) for e in err] == [
        (0, "missing columns: quantity_available", {"vendor": "vendor-a"})]


def test_required_vendor_missing_fails(spark, tmpdir_path):
    job, _ = _run(spark, tmpdir_path, [_policy_config(max_invalid_rows=1, max_invalid_row_pct=0.5)], [])
    g = job.gates[0]
    assert (g.status, g.stage, g.error_code) == ("FAILED", "FETCH_INPUTS", "REQUIRED_VENDOR_MISSING")
    assert g.error_message == "required vendor inbound missing: vendor-a (expected prefix )"


def test_optional_vendor_missing_warns(spark, tmpdir_path):
    job, _ = _run(spark, tmpdir_path, [_policy_config(max_invalid_rows=1, max_invalid_row_pct=0.5,
                                                      required=False)], [])
    g = job.gates[0]
    assert g.status == "SUCCEEDED"
    assert g.warnings == ["optional_vendor_missing:vendor-a"]


def test_latin1_feed_decodes(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), "sku,quantity_available,price\nSKUé,1,1.00\n",
               encoding="latin-1")
    cfg = _policy_config()
    cfg["vendors"][0]["parser"]["encoding"] = "ISO_8859_1"
    job, _ = _run(spark, tmpdir_path, [cfg], [("test_tenant", "vendor-a", f)])
    assert job.gates[0].status == "SUCCEEDED"
    assert [r.sku for r in job.result.records.collect()] == ["SKUé"]


def test_bad_utf8_is_decode_error(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), "sku,quantity_available,price\nSKUé,1,1.00\n",
               encoding="latin-1")
    job, _ = _run(spark, tmpdir_path, [_policy_config()], [("test_tenant", "vendor-a", f)])
    g = job.gates[0]
    assert (g.status, g.stage, g.error_code) == ("FAILED", "NORMALIZE", "DECODE_ERROR")
    assert "vendor-a" in g.error_message


def test_schema_version_two_is_refused(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), "sku,quantity_available,price\nS,1,1.00\n")
    job, _ = _run(spark, tmpdir_path, [dict(_policy_config(), schema_version=2)], [("test_tenant", "vendor-a", f)])
    assert (job.gates[0].status, job.gates[0].error_code) == ("FAILED", "unsupported_schema_version")


def test_many_tenants_one_job(spark, tmpdir_path):
    fa = _write(os.path.join(tmpdir_path, "a.csv"), "sku,quantity_available,price,cost\nS,1,1.00,10\n")
    fb = _write(os.path.join(tmpdir_path, "b.csv"), "SKU;QTY;COST\nS;2;20\n")
    ca = dict(_policy_config(), tenant_id="ta")
    cb = dict(_policy_config(), tenant_id="tb")
    cb["vendors"] = [{"vendor_id": "vendor-b", "inbound": {"type": "s3"},
                      "parser": {"format": "csv", "delimiter": ";",
                                 "column_map": {"sku": "SKU", "quantity_available": "QTY", "cost": "COST"}}}]
    job, out = _run(spark, tmpdir_path, [ca, cb], [("ta", "vendor-a", fa), ("tb", "vendor-b", fb)])
    assert sorted((g.tenant_id, g.status) for g in job.gates) == [("ta", "SUCCEEDED"), ("tb", "SUCCEEDED")]
    merged = {r.tenant_id: r for r in job.result.merged.collect()}
    assert merged["ta"].quantity_available == 1 and merged["tb"].quantity_available == 2


def test_valid_utf8_with_replacement_char_is_not_a_decode_error(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), "sku,quantity_available,price\nSKU�,1,1.00\n")
    job, _ = _run(spark, tmpdir_path, [_policy_config()], [("test_tenant", "vendor-a", f)])
    assert job.gates[0].status == "SUCCEEDED"
    assert [r.sku for r in job.result.records.collect()] == ["SKU�"]


def test_a_limit_is_passed_only_when_it_is_exceeded(spark, tmpdir_path):
    """Eight rows of hardware, three of them bad in three ways."""
    sizes = [f"HEX-M{k},{k * 12},0.{k}5" for k in range(3, 8)]
    bad = ["HEX-M8,twelve,0.85", ",96,0.95", "HEX-M10,-4,1.05"]
    f = _write(os.path.join(tmpdir_path, "hardware.csv"), "\n".join(["sku,quantity_available,price", *sizes, *bad, ""]))
    outcomes = {}
    for rows, share in ((3, 0.375), (2, 0.375), (3, 0.37)):
        job, _ = _run(spark, tmpdir_path, [_policy_config(max_invalid_rows=rows, max_invalid_row_pct=share)],
                      [("test_tenant", "vendor-a", f)])
        g = job.gates[0]
        assert (g.invalid_rows, g.total_rows) == (3, 8)
        outcomes[rows, share] = g.status
    assert outcomes == {(3, 0.375): "SUCCEEDED", (2, 0.375): "FAILED", (3, 0.37): "FAILED"}
    assert sorted(e.row_number for e in job.result.errors.collect()) == [7, 8, 9]


def _gate(job):
    g = job.gates[0]
    return g.status, g.stage, g.error_code


FEED = "sku,quantity_available,price,cost\nBOLT,7,2.50,1.00\n"


def test_a_second_run_leaves_the_first_untouched(spark, tmpdir_path):
    fa = _write(os.path.join(tmpdir_path, "a.csv"), FEED)
    one = dict(_policy_config(), tenant_id="ta")
    two = dict(_policy_config(), tenant_id="tb")
    _run(spark, tmpdir_path, [one], [("ta", "vendor-a", fa)])
    before = _merged_text(os.path.join(tmpdir_path, "out"), "ta")
    _run(spark, tmpdir_path, [two], [("tb", "vendor-a", fa)], run="run-2")
    _run(spark, tmpdir_path, [two], [("tb", "vendor-a", fa)], run="run-2")
    out = os.path.join(tmpdir_path, "out")
    assert before and _merged_text(out, "ta") == before
    assert _merged_text(out, "tb", "run-2")
    assert {r.run_id for r in spark.read.json(os.path.join(out, "reports", "run_summary")).collect()} == {"run-1", "run-2"}


def test_empty_feed_lacks_every_required_column(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), "")
    job, _ = _run(spark, tmpdir_path, [_policy_config(fail_on_missing_required_columns=True)],
                  [("test_tenant", "vendor-a", f)])
    assert _gate(job) == ("FAILED", "NORMALIZE", "missing_required_columns")


def _mapped_config():
    c = _policy_config(max_invalid_rows=9, max_invalid_row_pct=1.0)
    c["vendors"][0]["sku_map"] = {"type": "file", "s3_key": "maps/a.csv"}
    return c


def test_absent_sku_map_is_an_error_and_an_empty_one_is_not(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), FEED)
    m = _write(os.path.join(tmpdir_path, "m.csv"), "vendor_sku,sku\n")
    for maps, reasons in (([], ["missing sku map"]), ([("test_tenant", "vendor-a", m)], [])):
        job, _ = _run(spark, tmpdir_path, [_mapped_config()], [("test_tenant", "vendor-a", f)], maps)
        assert [e.reason for e in job.result.errors.collect()] == reasons
        assert job.gates[0].status == "SUCCEEDED"


def test_a_sku_map_is_in_the_encoding_of_its_vendor(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), "sku,quantity_available,price,cost\nKÖRNER,7,2.50,1.00\n", "latin-1")
    m = _write(os.path.join(tmpdir_path, "m.csv"), "vendor_sku,sku\nKÖRNER,GRAIN-1\n", "latin-1")
    c = _mapped_config()
    c["vendors"][0]["parser"] = dict(c["vendors"][0]["parser"], encoding="latin-1")
    job, _ = _run(spark, tmpdir_path, [c], [("test_tenant", "vendor-a", f)], [("test_tenant", "vendor-a", m)])
    assert job.gates[0].status == "SUCCEEDED"
    assert [r.sku for r in job.result.records.collect()] == ["GRAIN-1"]


def test_a_broken_sku_map_fails_its_tenant(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), FEED)
    bare = _write(os.path.join(tmpdir_path, "bare.csv"), "sku,price\nBOLT,2.50\n")
    m = _write(os.path.join(tmpdir_path, "m.csv"), b"vendor_sku,sku\nBOLT,K\xd6RNER\n")
    maps = [("test_tenant", "vendor-a", m)]
    job, _ = _run(spark, tmpdir_path, [_mapped_config()], [("test_tenant", "vendor-a", f)], maps)
    assert _gate(job) == ("FAILED", "NORMALIZE", "DECODE_ERROR")
    assert job.gates[0].error_message == "decode error for vendor vendor-a: invalid utf-8 bytes"
    # a feed that lacks columns ends before its map is read
    lenient = _mapped_config()
    lenient["error_policy"] = dict(lenient["error_policy"], fail_on_missing_required_columns=False)
    job, _ = _run(spark, tmpdir_path, [lenient], [("test_tenant", "vendor-a", bare)], maps, run="run-2")
    assert job.gates[0].error_code != "DECODE_ERROR"


def test_unsupported_strategy_is_invalid_input_with_a_failure_report(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), FEED)
    c = _policy_config()
    c["merge"] = dict(c["merge"], strategy="cheapest")
    job, out = _run(spark, tmpdir_path, [c], [("test_tenant", "vendor-a", f)])
    assert _gate(job) == ("FAILED", "NORMALIZE", "invalid_input")
    report = spark.read.json(os.path.join(out, "reports", "errors")).select("error_code", "error_message").collect()
    assert [tuple(r) for r in report] == [("invalid_input", "Unsupported merge strategy")]
    assert not glob.glob(os.path.join(out, "normalized", "run_id=*"))


def test_absent_vendor_gets_no_normalized_feed(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), FEED)
    c = _policy_config()
    c["vendors"].append(dict(c["vendors"][0], vendor_id="vendor-z", required=False))
    job, out = _run(spark, tmpdir_path, [c], [("test_tenant", "vendor-a", f)])
    assert [os.path.basename(p) for p in glob.glob(os.path.join(out, "normalized", "*", "*", "vendor_id=*"))] == [
        "vendor_id=vendor-a"]


def test_two_configs_of_a_tenant_are_refused(spark, tmpdir_path):
    import pytest
    with pytest.raises(ValueError, match="more than one config"):
        _run(spark, tmpdir_path, [_policy_config(), _policy_config()], [])


def test_bad_byte_past_the_header_is_a_decode_error(spark, tmpdir_path):
    f = _write(os.path.join(tmpdir_path, "a.csv"), b"sku,quantity_available,price\nBOLT,1,1.00" + b"," * 30 + b"\xff\n")
    job, _ = _run(spark, tmpdir_path, [_policy_config()], [("test_tenant", "vendor-a", f)])
    assert _gate(job) == ("FAILED", "NORMALIZE", "DECODE_ERROR")


def test_a_header_past_the_first_width_is_read_whole(spark, tmpdir_path):
    head = [f"c{k}" for k in range(297)] + ["sku", "quantity_available", "price"]
    line = ["x"] * 297 + ["BOLT", "4", "1.00"]
    f = _write(os.path.join(tmpdir_path, "a.csv"), ",".join(head) + "\n" + ",".join(line) + "\n")
    job, _ = _run(spark, tmpdir_path, [_policy_config()], [("test_tenant", "vendor-a", f)])
    assert job.gates[0].status == "SUCCEEDED"
    assert [(r.sku, r.quantity_available) for r in job.result.records.collect()] == [("BOLT", 4)]


def test_run_batch_resolves_config_listing_and_writes_reports(spark, tmpdir_path):
    from feedmerge.plans.job import run_batch
    from feedmerge.sources.listing import list_files
    inbound = os.path.join(tmpdir_path, "in")
    os.makedirs(inbound)
    _write(os.path.join(inbound, "a-old.csv"), FEED)
    _write(os.path.join(inbound, "a-new.csv"), FEED.replace("BOLT", "NUT"))
    os.utime(os.path.join(inbound, "a-old.csv"), (1, 1))
    old, new = _policy_config(), _policy_config()
    for c in (old, new):
        c["vendors"][0]["inbound"]["s3_prefix"] = f"file:{inbound}/a"
    new["vendors"][0]["vendor_id"] = "vendor-b"
    versions = spark.createDataFrame([("test_tenant", 1, json.dumps(old), 1), ("test_tenant", 2, json.dumps(new), 2)],
                                     "tenant_id string, config_version bigint, config string, seq bigint")
    requests = spark.createDataFrame([("r1", "test_tenant", 1), ("r2", "nobody", 5)],
                                     "run_id string, tenant_id string, config_version bigint")
    out = os.path.join(tmpdir_path, "out")
    job = run_batch(spark, requests, versions, list_files(spark, inbound), out, now="2020-01-01 00:00:00")
    assert [(g.run_id, g.status, g.config_version) for g in job.gates] == [("r1", "SUCCEEDED", 1)]
    assert "NUT" in _merged_text(out, "test_tenant", "r1") and "BOLT" not in _merged_text(out, "test_tenant", "r1")
    manifest = spark.read.json(os.path.join(out, "reports", "input_manifest")).collect()
    assert [(m.status, m.run_copy_key) for m in manifest] == [
        ("found", "r1/tenants/test_tenant/inbound/vendor-a/a-new.csv")]
    copy = open(os.path.join(out, "runs", manifest[0].run_copy_key), "rb").read()
    assert copy == open(manifest[0].s3_key.removeprefix("file:"), "rb").read()
    assert manifest[0].copy_sha256 == hashlib.sha256(copy).hexdigest() and manifest[0].copy_bytes == len(copy)
    summary = spark.read.json(os.path.join(out, "reports", "run_summary")).first()
    assert summary.vendor_record_counts["vendor-a"] == 1 and summary.config_version == 1
    assert json.loads(spark.read.json(os.path.join(out, "reports", "config_snapshot")).first().config)["tenant_id"] \
        == "test_tenant"
    events = job.events
    state = {r.run_id: (r.status, r.error_code) for r in events.groupBy("run_id").agg(
        {"seq": "max"}).join(events, "run_id").where("seq = `max(seq)`").collect()}
    assert state == {"r1": ("SUCCEEDED", None), "r2": ("FAILED", "missing_tenant_config")}
