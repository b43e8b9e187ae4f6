"""Plan shape: scans read only the needed columns; no Python UDF nodes."""

import re

from conftest import SF_SMALL
from feedmerge.plans.catalog import REGISTRY


def _plan(spark, name):
    return REGISTRY[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def _read_schemas(plan):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


def test_listing_scan_prunes_columns(spark):
    schemas = _read_schemas(_plan(spark, "latest_inbound"))
    orders = [s for s in schemas if "o_orderkey" in s]
    assert orders and all(set(x.split(":")[0] for x in s.split(",")) ==
                          {"o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"} for s in orders)


def test_alarm_scan_prunes_and_pushes_filter(spark):
    plan = _plan(spark, "alarm_sum")
    schemas = _read_schemas(plan)
    assert any(s.startswith("ts:") or "event_type" in s for s in schemas)
    assert all("props" not in s and "event_id" not in s for s in schemas)
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    assert any("EqualTo(event_type,error)" in p for p in pushed)


def test_no_python_in_registered_plans(spark):
    for name in ("ordered_output", "run_ledger", "sku_map_join", "alarm_consecutive"):
        plan = _plan(spark, name)
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_offers_are_ranked_without_pricing_rules(spark, monkeypatch):
    """Every offer is sorted before the shuffle: it carries the merge rules only."""
    from feedmerge.operators import merge
    from feedmerge.plans import catalog
    carried, best = [], merge.best_offer
    for module in (merge, catalog):
        monkeypatch.setattr(module, "best_offer", lambda df, *a: carried.append(df.columns) or best(df, *a))
    for name in ("ordered_output", "project_output"):
        REGISTRY[name](spark, SF_SMALL)
        assert {c for c in carried.pop() if c.startswith("rule_")} == {
            "rule_shipping_handling_flat", "rule_include_shipping_handling", "rule_fallback_lead_time_days"}


def test_scan_splits_are_bounded(spark):
    from feedmerge.session import SCAN_BYTES, SCAN_SPLIT, configure
    given = spark.conf.get(SCAN_BYTES)
    try:
        spark.conf.set(SCAN_BYTES, "128MB")
        assert configure(spark).conf.get(SCAN_BYTES) == str(SCAN_SPLIT)
        spark.conf.set(SCAN_BYTES, "1m")  # a smaller one stays
        assert configure(spark).conf.get(SCAN_BYTES) == "1m"
    finally:
        spark.conf.set(SCAN_BYTES, given)


def test_a_row_is_parsed_once_in_the_plan(spark, monkeypatch):
    """No pattern's parser for the times, and the validators' messages are put
    together once a row, not for every column that needs the reason."""
    from feedmerge.plans import batch
    plans = {}

    def kept(df, name="stage"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, name)
    materialize = batch.materialize
    monkeypatch.setattr(batch, "materialize", kept)
    key = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        assert REGISTRY["vendor_counts"](spark, SF_SMALL).count() > 0
    finally:
        spark.conf.set(key, before)
    assert plans["normalized"].count("concat_ws(") == 1
    assert "gettimestamp(" not in plans["normalized"].lower()
