"""Views over the driver tables standing in for the pipeline's inputs.

* tenants  <- ``region``   (one tenant per region, rules derived from its key)
* vendors  <- ``supplier`` (vendor ``V<suppkey>`` belongs to tenant
  ``T<suppkey % 5>``; its config position is the supplier key)
* offers   <- ``lineitem`` (one canonical record per line item; the vendor is
  the supplier, the SKU the part)

All derivations are per-row expressions over whole tables, so the work grows
with the tables.  The oracle SQL of ``__spark_entry__`` restates them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmerge.schema import MAP_FLOOR_MAX, MONEY

N_TENANTS = 5
SPREAD_SMALL_SCANS = True


# Tables that grow with the scale factor (the others are dimension-sized).
FACT_TABLES = {"lineitem", "orders", "events", "customer", "part"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in FACT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an under-split scan over the available cores.

    A file written as one row group is read by one task however many cores
    there are.  When a scan has fewer partitions than the default
    parallelism, redistribute it once; a large input (many splits) is left
    as it is, so this costs nothing at scale.
    """
    if not SPREAD_SMALL_SCANS:
        return df
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < max(2, target // 2):
        return df.repartition(target)
    return df


def _money_from_cents(cents):
    return (cents.cast("decimal(20,0)") / F.lit(100)).cast(MONEY)


def _pick(index, values: list[str]):
    """``values[index]`` as a string column (index 0-based)."""
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(index == i, F.lit(values[i])).otherwise(out)
    return out


def _round_div100(x):
    """Integer ``round(x / 100)`` half-up for x >= 0, without doubles."""
    shifted = x + 50
    return ((shifted - shifted % 100) / 100).cast("bigint")


def tenant_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rules row per tenant, from ``region``."""
    k = F.col("r_regionkey").cast("int")
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("T"), k.cast("string")).alias("tenant_id"),
        _pick(k % 3, ["0.15", "0.20", "0.25"]).cast("decimal(10,6)").alias("base_margin_pct"),
        F.when(k == 3, F.lit("20000.00")).otherwise(F.lit("25.00")).cast(MONEY).alias("min_price"),
        _pick(k, ["9.99", "7.99", "5.99", "3.99", "1.99"]).cast(MONEY).alias("shipping_handling_flat"),
        (k != 2).alias("map_enforce"),
        F.when(k == 4, F.lit("none")).otherwise(F.lit(MAP_FLOOR_MAX)).alias("map_floor_behavior"),
        _pick(k, ["0.99", "0.01", "0.05", "0", "1.00"]).cast(MONEY).alias("rounding_increment"),
        (k % 2 == 0).alias("include_shipping_handling"),
        (F.lit(7) + k).cast("bigint").alias("fallback_lead_time_days"),
        F.when(k == 0, F.lit(0)).otherwise(F.lit(100000) * k).cast("bigint").alias("max_invalid_rows"),
        _pick(k, ["0.5", "0.4", "0.3", "0.2", "0.1"]).cast("double").alias("max_invalid_row_pct"),
        (k != 1).alias("fail_on_missing_required_columns"),
        F.when(k % 2 == 1, F.lit("warn_only")).otherwise(F.lit("fail")).alias("missing_required_vendor_policy"),
        F.when(k == 2, F.array(*[F.lit(c) for c in ("sku", "quantity_available", "price", "vendor_id", "updated_at")]))
        .otherwise(F.array().cast("array<string>")).alias("output_columns"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed canonical records from ``lineitem`` (plus tenant and order keys).

    cost is the extended price (null on line 7, to exercise the null-cost
    rule); the feed price and the MAP are the cost scaled by the tax rate
    (MAP absent when there is no discount).
    """
    li = table(spark, sf_dir, "lineitem")
    cost_cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    tax_pct = F.round(F.col("l_tax") * 100).cast("bigint")
    no_discount = F.round(F.col("l_discount") * 100).cast("bigint") == 0
    flag = F.col("l_returnflag")
    return li.select(
        F.concat(F.lit("T"), (F.col("l_suppkey") % N_TENANTS).cast("string")).alias("tenant_id"),
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("vendor_sku"),
        F.concat(F.lit("V"), F.col("l_suppkey").cast("string")).alias("vendor_id"),
        F.greatest(F.col("l_quantity").cast("bigint") - 25, F.lit(0).cast("bigint")).alias("quantity_available"),
        F.when(F.col("l_linestatus") == "O", F.lit(None).cast("bigint"))
        .otherwise(F.col("l_linenumber").cast("bigint") * 2).alias("lead_time_days"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast(MONEY))
        .otherwise(_money_from_cents(cost_cents)).alias("cost"),
        F.when(no_discount, F.lit(None).cast(MONEY))
        .otherwise(_money_from_cents(_round_div100(cost_cents * (100 + 5 * tax_pct))))
        .alias("map_price"),
        _money_from_cents(_round_div100(cost_cents * (100 + tax_pct))).alias("price"),
        F.lit(None).cast(MONEY).alias("msrp"),
        F.when(flag == "A", "new").when(flag == "R", "used").otherwise("refurb").alias("condition"),
        F.lit(None).cast("string").alias("brand"),
        F.lit(None).cast("string").alias("title"),
        F.col("l_shipdate").cast("timestamp").alias("updated_at"),
        F.col("l_suppkey").cast("bigint").alias("vendor_ordinal"),
        # input order inside a vendor's feed
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_number"),
    )


# ---------------------------------------------------------------------------
# Raw (string) feeds: the parse path's input.
# ---------------------------------------------------------------------------
# Header layouts of the stand-in vendors (fixed test values).  Style 0 uses
# the canonical names, style 1 renames every column, style 2 reorders,
# mixes case and omits map_price, lead_time_days and condition.
HEADER_STYLES = {
    0: (["sku", "quantity_available", "cost", "map_price", "price", "lead_time_days",
         "condition", "updated_at"], {}),
    1: (["ITEM", "QTY", "COST", "MAP", "PRICE", "LEAD", "COND", "UPDATED"],
        {"sku": "ITEM", "quantity_available": "QTY", "cost": "COST", "map_price": "MAP",
         "price": "PRICE", "lead_time_days": "LEAD", "condition": "COND", "updated_at": "UPDATED"}),
    2: (["Qty", "Sku", "Price", "Cost", "Updated"],
        {"sku": "Sku", "quantity_available": "Qty", "price": "Price", "cost": "Cost",
         "updated_at": "Updated"}),
}
# Field (by canonical name) held by each header position, per style.
STYLE_FIELDS = {
    0: ["sku", "quantity_available", "cost", "map_price", "price", "lead_time_days", "condition", "updated_at"],
    1: ["sku", "quantity_available", "cost", "map_price", "price", "lead_time_days", "condition", "updated_at"],
    2: ["quantity_available", "sku", "price", "cost", "updated_at"],
}
# A vendor whose supplier key is a multiple of this ships a header where the
# quantity column is misnamed ("<name>_OLD"): "missing columns" for it.
MISSING_QTY_EVERY = 23
RUN_NOW = "2020-01-01 00:00:00"


def _lit_array(values):
    return F.array(*[F.lit(v) for v in values])


def _lit_map(d):
    if not d:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def vendor_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vendor: its tenant, config position, header and mapping."""
    s = F.col("s_suppkey")
    style = (s % 3).cast("int")
    misnamed = s % MISSING_QTY_EVERY == 0

    def header_for(st: int):
        names, cmap = HEADER_STYLES[st]
        qty_name = cmap.get("quantity_available", "quantity_available")
        bad = [n + "_OLD" if n == qty_name else n for n in names]
        return F.when(misnamed, _lit_array(bad)).otherwise(_lit_array(names))

    header = F.when(style == 0, header_for(0)).when(style == 1, header_for(1)).otherwise(header_for(2))
    cmap = (F.when(style == 0, _lit_map(HEADER_STYLES[0][1]))
            .when(style == 1, _lit_map(HEADER_STYLES[1][1])).otherwise(_lit_map(HEADER_STYLES[2][1])))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("T"), (s % N_TENANTS).cast("string")).alias("tenant_id"),
        F.concat(F.lit("V"), s.cast("string")).alias("vendor_id"),
        s.cast("bigint").alias("vendor_ordinal"),
        style.alias("style"),
        header.alias("header"),
        cmap.alias("column_map"),
        F.when(s % 4 == 0, F.lit("new")).alias("default_condition"),
        (s % 7 != 0).alias("required"),
    )


def _cents_text(cents):
    """Non-negative integer cents as ``d.dd``."""
    rest = cents % 100
    return F.concat(((cents - rest) / 100).cast("bigint").cast("string"),
                    F.when(rest.between(0, 9), F.lit(".0")).otherwise(F.lit(".")), rest.cast("string"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as the strings a vendor file would hold, with a
    deterministic share of malformed, blank and padded values."""
    li = table(spark, sf_dir, "lineitem")
    ext_c = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    tax = F.round(F.col("l_tax") * 100).cast("bigint")
    # shared intermediate values, computed once
    base = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ext_c.alias("_ext_c"),
        (F.round(F.col("l_discount") * 100).cast("bigint") == 0).alias("_no_disc"),
        (F.col("l_quantity").cast("bigint") - 3).cast("string").alias("_q"),
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("_sku"),
        F.col("l_shipdate").cast("timestamp").alias("_ts"),
        F.expr("(cast(round(l_extendedprice * 100) as bigint) * (100 + 5 * cast(round(l_tax * 100) as bigint)) + 50) div 100").alias("_map_c"),
        F.expr("(cast(round(l_extendedprice * 100) as bigint) * (100 + cast(round(l_tax * 100) as bigint)) + 50) div 100").alias("_price_c"),
    ).withColumn("_cost", _cents_text(F.col("_ext_c")))
    k = F.col("l_orderkey")
    n = F.col("l_linenumber")
    sku, q, cost, ts = F.col("_sku"), F.col("_q"), F.col("_cost"), F.col("_ts")
    cond_pick = (k + n) % 8
    return base.select(
        F.concat(F.lit("V"), F.col("l_suppkey").cast("string")).alias("vendor_id"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(k % 97 == 5, F.lit("")).when(k % 97 == 6, F.concat(F.lit("  "), sku, F.lit("\t")))
        .otherwise(sku).alias("f_sku"),
        F.when(k % 50 == 1, F.lit("n/a")).when(k % 50 == 2, F.lit(""))
        .when(k % 50 == 3, F.concat(F.lit(" "), q, F.lit("\t")))
        .when(k % 50 == 4, F.concat(q, F.lit("_0"))).when(k % 50 == 5, F.concat(q, F.lit(".0")))
        .when(k % 50 == 6, F.concat(F.lit("+"), q)).otherwise(q).alias("f_qty"),
        F.when(k % 70 == 1, F.lit("abc")).when(k % 70 == 2, F.lit("NaN")).when(k % 70 == 3, F.lit(""))
        .when(k % 70 == 4, F.concat(F.col("_ext_c").cast("string"), F.lit("e-2")))
        .when(k % 70 == 5, F.concat(F.lit(" "), cost, F.lit(" ")))
        .when(k % 70 == 6, F.concat(F.lit("1_"), cost)).otherwise(cost).alias("f_cost"),
        F.when(k % 83 == 1, F.lit("Infinity")).when(F.col("_no_disc"), F.lit(""))
        .otherwise(_cents_text(F.col("_map_c"))).alias("f_map"),
        F.when(k % 90 == 1, F.lit("")).when(k % 90 == 2, F.lit("-1.5"))
        .otherwise(_cents_text(F.col("_price_c"))).alias("f_price"),
        F.when(k % 60 == 7, F.lit("3.5")).when(n % 3 == 0, F.lit(""))
        .otherwise((n * 2).cast("string")).alias("f_lead"),
        F.when(cond_pick == 0, F.lit("New")).when(cond_pick == 1, F.lit(" used "))
        .when(cond_pick == 2, F.lit("REFURB")).when(cond_pick == 3, F.lit(""))
        .when(cond_pick == 4, F.lit("new")).when(cond_pick == 5, F.lit("used"))
        .when(cond_pick == 6, F.lit("refurb"))
        .otherwise(F.when(k % 3 == 0, F.lit("broken")).when(k % 3 == 1, F.lit(" ")).otherwise(F.lit("Refurb")))
        .alias("f_cond"),
        F.when(n == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(n == 2, F.date_format(ts, "yyyy-MM-dd"))
        .when(n == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(n == 4, F.date_format(ts, "yyyy-M-d"))
        .when(n == 5, F.when(k % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
              .otherwise(F.date_format(ts, "yyyy-MM-dd")))
        .when(n == 6, F.lit(""))
        .otherwise(F.when(k % 5 == 0, F.date_format(ts, "dd/MM/yyyy"))
                   .otherwise(F.date_format(ts, "yyyy-M-d H:m:s"))).alias("f_upd"),
    )


_FIELD_SOURCE = {"sku": "f_sku", "quantity_available": "f_qty", "cost": "f_cost", "map_price": "f_map",
                 "price": "f_price", "lead_time_days": "f_lead", "condition": "f_cond", "updated_at": "f_upd"}


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows joined to their vendor's file layout: ``header``/``values``
    arrays plus tenant, vendor position and mapping (the shape the CSV
    source produces)."""
    from feedmerge.operators.normalize import resolve_positions

    files = resolve_positions(vendor_feeds(spark, sf_dir))
    lines = raw_lines(spark, sf_dir)

    def values_for(st: int):
        return F.array(*[F.col(_FIELD_SOURCE[f]) for f in STYLE_FIELDS[st]])

    joined = lines.join(files, "vendor_id")
    values = (F.when(F.col("style") == 0, values_for(0)).when(F.col("style") == 1, values_for(1))
              .otherwise(values_for(2)))
    return joined.select(
        *[c for c in joined.columns if not c.startswith("f_")], values.alias("values"))


# ---------------------------------------------------------------------------
# SKU maps: vendors with supplier key = 1 (mod 3) map their codes.
# ---------------------------------------------------------------------------
def has_sku_map(s):
    return s % 3 == 1


def sku_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw map rows from every (supplier, part) line of a mapping vendor.

    Two part codes map to one canonical SKU (``CAN-<partkey div 2>``); lines
    numbered 1 carry a ``-A`` variant, so the last row per code decides;
    some rows are blank or padded.  Vendors with supplier key = 4 (mod 6)
    have a configured map but no map input.
    """
    li = table(spark, sf_dir, "lineitem")
    s, k, n, p = F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    code = F.concat(F.lit("SKU-"), p.cast("string"))
    target = F.concat(F.lit("CAN-"), F.expr("l_partkey div 2").cast("string"),
                      F.when(n == 1, F.lit("-A")).otherwise(F.lit("")))
    return li.where(has_sku_map(s) & (s % 6 != 4)).select(
        F.concat(F.lit("T"), (s % N_TENANTS).cast("string")).alias("tenant_id"),
        F.concat(F.lit("V"), s.cast("string")).alias("vendor_id"),
        F.when(k % 13 == 0, F.concat(F.lit(" "), code, F.lit(" "))).otherwise(code).alias("vendor_sku"),
        F.when(k % 11 == 0, F.lit("")).otherwise(target).alias("sku"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("row_number"),
    )


def vendor_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("T"), (s % N_TENANTS).cast("string")).alias("tenant_id"),
        F.concat(F.lit("V"), s.cast("string")).alias("vendor_id"),
        s.cast("bigint").alias("vendor_ordinal"),
        has_sku_map(s).alias("has_sku_map"),
        (s % 7 != 0).alias("required"),
        F.concat(F.lit("inbound/T"), (s % N_TENANTS).cast("string"), F.lit("/V"), s.cast("string"), F.lit("/"))
        .alias("s3_prefix"),
    )


def ghost_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configured vendor per nation that never sends a file (tenant =
    the nation's region; required when the nation key is a multiple of 5)."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("tenant_id"),
        F.concat(F.lit("VN"), n.cast("string")).alias("vendor_id"),
        (F.lit(1_000_000_000) + n).cast("bigint").alias("vendor_ordinal"),
        F.lit(False).alias("has_sku_map"),
        (n % 5 == 0).alias("required"),
        F.concat(F.lit("inbound/T"), F.col("n_regionkey").cast("string"), F.lit("/VN"), n.cast("string"),
                 F.lit("/")).alias("s3_prefix"),
    )


def configured_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All configured vendors: suppliers (with their feed layout) and the
    ghost vendors (no layout, no feed)."""
    feeds = vendor_feeds(spark, sf_dir).select("vendor_id", "header", "column_map", "default_condition")
    sup = vendor_configs(spark, sf_dir).join(feeds, "vendor_id")
    ghosts = ghost_vendors(spark, sf_dir).select(
        "*", F.lit(None).cast("array<string>").alias("header"),
        F.lit(None).cast("map<string,string>").alias("column_map"),
        F.lit(None).cast("string").alias("default_condition"))
    return sup.unionByName(ghosts)


def inbound_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uploaded object per order: vendor V<(custkey mod 110) + 1>,
    modified at the order date (many same-day ties)."""
    o = table(spark, sf_dir, "orders")
    v = (F.col("o_custkey") % 110 + 1)
    return o.select(
        F.concat(F.lit("inbound/T"), (v % N_TENANTS).cast("string"), F.lit("/V"), v.cast("string"),
                 F.lit("/feed-"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("key"),
        F.md5(F.col("o_orderkey").cast("string")).alias("etag"),
        F.floor(F.col("o_totalprice")).cast("bigint").alias("size"),
        F.col("o_orderdate").cast("timestamp").alias("last_modified"),
    )


# ---------------------------------------------------------------------------
# Config versions and run ledger.
# ---------------------------------------------------------------------------
N_CONFIG_TENANTS = 50


def config_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Config-version writes, one per customer: tenant C<custkey mod 50>,
    version 1-4, content = market segment, write order = customer key."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("C"), (k % N_CONFIG_TENANTS).cast("string")).alias("tenant_id"),
        (F.expr(f"c_custkey div {N_CONFIG_TENANTS}") % 4 + 1).cast("bigint").alias("config_version"),
        F.concat(F.col("c_mktsegment"), F.lit("#"), F.col("c_nationkey").cast("string")).alias("config"),
        k.cast("bigint").alias("seq"),
    )


def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order: tenant C<custkey mod 50>, pinned version 1-5."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("bigint").alias("run_id"),
        F.concat(F.lit("C"), (F.col("o_custkey") % N_CONFIG_TENANTS).cast("string")).alias("tenant_id"),
        (F.col("o_orderkey") % 5 + 1).cast("bigint").alias("config_version"),
        F.col("o_orderdate").cast("timestamp").alias("requested_at"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status updates, one per line item of the run's order, in line order:
    A -> RUNNING, R -> FAILED, N -> SUCCEEDED (shipped) / RUNNING; the line
    number names the stage (7 sets none)."""
    return status_events_of(table(spark, sf_dir, "lineitem"))


def status_events_of(li: DataFrame) -> DataFrame:
    """``status_events`` of line items (a table or a stream)."""
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    status = (F.when(flag == "R", F.lit("FAILED"))
              .when((flag == "N") & (F.col("l_linestatus") == "F"), F.lit("SUCCEEDED"))
              .otherwise(F.lit("RUNNING")))
    from feedmerge.schema import STAGES
    stage = F.lit(None).cast("string")
    for i, st in enumerate(STAGES):
        stage = F.when(n == i + 1, F.lit(st)).otherwise(stage)
    ts = F.col("l_shipdate").cast("timestamp") + F.make_interval(hours=n.cast("int"))
    failed = status == "FAILED"
    return li.select(
        F.col("l_orderkey").cast("bigint").alias("run_id"),
        F.struct(F.col("l_linenumber").cast("bigint").alias("n"), F.col("l_partkey").cast("bigint").alias("p"),
                 F.col("l_suppkey").cast("bigint").alias("s")).alias("seq"),
        status.alias("status"), stage.alias("stage"),
        F.when((status == "RUNNING") & (n <= 2), ts).alias("started_at"),
        F.when(status != "RUNNING", ts).alias("finished_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        F.when(failed, stage).alias("failed_stage"),
        F.when(failed, F.when(F.col("l_partkey") % 2 == 0, F.lit("validation_errors"))
               .otherwise(F.lit("no_rows_parsed"))).alias("error_code"),
        F.when(failed, F.concat(F.lit("failed at line "), n.cast("string"))).alias("error_message"),
        F.when(failed, F.concat(F.lit("run/"), F.col("l_orderkey").cast("string"), F.lit("/errors.json")))
        .alias("errors_artifact_key"),
        F.when(failed, F.concat(F.lit("run/"), F.col("l_orderkey").cast("string"), F.lit("/errors.json")))
        .alias("error_report_key"),
        F.lit(None).cast("map<string,string>").alias("artifacts"),
    )


# ---------------------------------------------------------------------------
# Metric streams from ``events``.
# ---------------------------------------------------------------------------
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RunFailed datapoints: error events are failed runs (1), purchases
    successful ones (0); tenant T<user mod 5>."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    return ev.select(
        F.concat(F.lit("T"), (F.col("user_id") % N_TENANTS).cast("string")).alias("tenant_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "error").cast("double").alias("run_failed"),
        F.col("value").alias("value"), F.col("event_type"))


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("T"), (F.col("user_id") % N_TENANTS).cast("string")).alias("tenant_id"),
        F.col("user_id").cast("bigint").alias("worker_id"),
        F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON config document per tenant (region), vendors = its suppliers
    in key order; some optional fields are left out to exercise defaults;
    tenant T4's document is schema version 2 (refused)."""
    s = F.col("s_suppkey")
    vend = table(spark, sf_dir, "supplier").select(
        (s % N_TENANTS).cast("int").alias("_k"), s.alias("_s"),
        F.struct(
            F.concat(F.lit("V"), s.cast("string")).alias("vendor_id"),
            F.when(s % 2 == 0, F.lit(None).cast("boolean")).otherwise(s % 7 != 0).alias("required"),
            F.struct(F.lit("s3").alias("type"),
                     F.concat(F.lit("inbound/T"), (s % N_TENANTS).cast("string"), F.lit("/V"), s.cast("string"),
                              F.lit("/")).alias("s3_prefix")).alias("inbound"),
            F.struct(F.lit("csv").alias("format"),
                     F.when(s % 4 == 1, F.lit("latin-1")).alias("encoding"),
                     F.when(s % 3 == 1, F.create_map(F.lit("sku"), F.lit("ITEM"), F.lit("quantity_available"),
                                                     F.lit("QTY"))).alias("column_map")).alias("parser"),
            F.when(s % 3 == 1, F.struct(F.lit("s3").alias("type"),
                                        F.concat(F.lit("maps/V"), s.cast("string"), F.lit(".csv")).alias("s3_key")))
            .alias("sku_map")).alias("v"))
    by_key = (lambda a, b: F.when(a["_s"] < b["_s"], -1).when(a["_s"] > b["_s"], 1).otherwise(0))
    per_tenant = vend.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_s", "v")), by_key).alias("_vs"))
    rules = tenant_rules(spark, sf_dir).withColumn("_k", F.expr("cast(substring(tenant_id, 2) as int)"))
    doc = rules.join(per_tenant, "_k").select(
        F.to_json(F.struct(
            F.when(F.col("_k") == 4, F.lit(2)).otherwise(F.lit(1)).alias("schema_version"),
            "tenant_id", F.lit("UTC").alias("timezone"), F.lit("USD").alias("default_currency"),
            F.transform("_vs", lambda x: x["v"]).alias("vendors"),
            F.struct(F.col("base_margin_pct").cast("string").alias("base_margin_pct"),
                     F.col("min_price").cast("string").alias("min_price"),
                     F.col("shipping_handling_flat").cast("string").alias("shipping_handling_flat"),
                     F.struct(F.col("map_enforce").alias("enforce")).alias("map_policy"),
                     F.struct(F.col("rounding_increment").cast("string").alias("increment")).alias("rounding"))
            .alias("pricing"),
            F.struct(F.lit("best_offer").alias("strategy"),
                     F.struct(F.struct(F.col("include_shipping_handling").alias("include_shipping_handling"))
                              .alias("landed_cost")).alias("best_offer")).alias("merge"),
            F.struct(F.col("output_columns").alias("columns")).alias("output"),
        )).alias("value"))
    return doc
