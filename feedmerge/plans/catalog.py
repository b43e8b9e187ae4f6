"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator, each running over whole driver tables (see ``driver_views``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmerge.operators.merge import best_offer, best_priced
from feedmerge.operators.pricing import price_offers
from feedmerge.operators.rules import attach_rules
from feedmerge.plans import driver_views as dv
from feedmerge.session import configure, materialize
from feedmerge.sinks.formatting import sink_value

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

TIEBREAK = ("vendor_ordinal", "row_number")


def register(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return run
    return deco


def _offers_with_rules(spark, sf_dir):
    return attach_rules(dv.offers(spark, sf_dir), dv.tenant_rules(spark, sf_dir))


def _record_view(df: DataFrame, price_col: str = "price") -> DataFrame:
    return df.select(
        "tenant_id", "sku", "vendor_id",
        F.col("quantity_available").cast("bigint").alias("quantity_available"),
        F.col("lead_time_days").cast("bigint").alias("lead_time_days"),
        sink_value(df, "cost"), sink_value(df, "map_price"),
        sink_value(df, price_col).alias("price"),
        "condition", sink_value(df, "updated_at"),
    )


@register("best_offer")
def q_best_offer(spark, sf_dir):
    """M1 + M2: winning offer per (tenant, sku) with lead-time fallback."""
    return _record_view(best_offer(_offers_with_rules(spark, sf_dir), TIEBREAK))


@register("price_offers")
def q_price_offers(spark, sf_dir):
    """F8: sell price of every offer (null cost keeps the feed price)."""
    priced = price_offers(_offers_with_rules(spark, sf_dir))
    return priced.select(
        "tenant_id", "sku", "vendor_id",
        F.col("row_number.l_orderkey").cast("bigint").alias("l_orderkey"),
        F.col("row_number.l_linenumber").cast("bigint").alias("l_linenumber"),
        sink_value(priced, "price"),
    )


def merged_priced(spark, sf_dir) -> DataFrame:
    """The flagship value path: best offer, then pricing."""
    return best_priced(dv.offers(spark, sf_dir), dv.tenant_rules(spark, sf_dir), TIEBREAK)


@register("ordered_output")
def q_ordered_output(spark, sf_dir):
    """Merged, priced feed in sink form, sorted like the output file."""
    merged = merged_priced(spark, sf_dir)
    return _record_view(merged).orderBy("tenant_id", "sku", "vendor_id")


# ---------------------------------------------------------------------------
# Scalar functions (F1-F4, F6, F7, F10, F11) over whole driver tables.
# ---------------------------------------------------------------------------
from feedmerge.functions import (  # noqa: E402
    format_datetime,
    format_money_string,
    landed_cost,
    parse_datetime,
    parse_decimal,
    parse_int,
    round_increment,
    strip_ws,
)
from feedmerge.operators.rules import rule  # noqa: E402
from feedmerge.schema import MONEY  # noqa: E402

LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _keys():
    return [F.col(c).cast("bigint").alias(c) for c in LINE_KEYS]


@register("parse_int")
def q_parse_int(spark, sf_dir):
    """F1 on the quantity text of every line item."""
    lines = dv.raw_lines(spark, sf_dir)
    p = parse_int(F.col("f_qty"))
    return lines.select(*_keys(), F.col("f_qty").alias("raw"), p.value.alias("value"), p.error.alias("error"))


@register("parse_decimal")
def q_parse_decimal(spark, sf_dir):
    """F2 on the cost text of every line item (values are whole cents)."""
    lines = dv.raw_lines(spark, sf_dir)
    p = parse_decimal(F.col("f_cost"))
    return lines.select(*_keys(), F.col("f_cost").alias("raw"),
                        format_money_string(p.value).alias("value"),
                        p.error.alias("error"), p.invalid.alias("invalid"))


@register("parse_datetime")
def q_parse_datetime(spark, sf_dir):
    """F3 on the update-time text of every line item."""
    lines = dv.raw_lines(spark, sf_dir)
    p = parse_datetime(F.col("f_upd"))
    return lines.select(*_keys(), F.col("f_upd").alias("raw"),
                        format_datetime(p.value).alias("value"), p.error.alias("error"))


@register("strip_ws")
def q_strip_ws(spark, sf_dir):
    """padded part names (spaces, tabs, newlines) stripped."""
    part = dv.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    padded = (F.when(k % 4 == 0, F.concat(F.lit("\t "), F.col("p_name"), F.lit(" \n")))
              .when(k % 4 == 1, F.concat(F.lit("  "), F.col("p_name")))
              .when(k % 4 == 2, F.concat(F.col("p_name"), F.lit("\r\n")))
              .otherwise(F.col("p_name")))
    return part.select(F.col("p_partkey").cast("bigint").alias("p_partkey"),
                       padded.alias("raw"), strip_ws(padded).alias("stripped"))


@register("landed_cost")
def q_landed_cost(spark, sf_dir):
    """ranking cost of every offer under its tenant's rules."""
    df = _offers_with_rules(spark, sf_dir)
    lc = landed_cost(F.col("cost"), rule("shipping_handling_flat"), rule("include_shipping_handling"))
    return df.select("tenant_id", "sku", "vendor_id",
                     *[F.col(f"row_number.{c}").cast("bigint").alias(c) for c in LINE_KEYS[:2]],
                     format_money_string(lc).alias("landed_cost"))


@register("round_increment")
def q_round_increment(spark, sf_dir):
    """(cost + shipping) x (1 + margin) rounded half-up to each tenant's
    increment (increment 0 leaves the value)."""
    df = _offers_with_rules(spark, sf_dir)
    cand = (F.col("cost") + rule("shipping_handling_flat")) * (F.lit(1) + rule("base_margin_pct"))
    rounded = round_increment(cand, rule("rounding_increment"))
    return df.select("tenant_id", "sku", "vendor_id",
                     *[F.col(f"row_number.{c}").cast("bigint").alias(c) for c in LINE_KEYS[:2]],
                     F.bround(rounded * 10000, 0).cast("bigint").alias("rounded_units4"))


@register("format_decimal")
def q_format_decimal(spark, sf_dir):
    """discount amounts (4 decimals) printed to cents, half-even."""
    li = dv.table(spark, sf_dir, "lineitem")
    ext_c = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    disc = F.round(F.col("l_discount") * 100).cast("bigint")
    amount = (ext_c * disc).cast("decimal(20,0)") / F.lit(10000)
    return li.select(*_keys(), format_money_string(amount.cast(MONEY)).alias("discount_amount"))


@register("format_datetime")
def q_format_datetime(spark, sf_dir):
    """event times (microseconds) and order dates (whole seconds) as ISO-8601 UTC."""
    ev = dv.table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").cast("bigint").alias("event_id"),
                     format_datetime(F.col("ts")).alias("ts_iso"),
                     format_datetime(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("ts_sec_iso"))


# ---------------------------------------------------------------------------
# Normalisation (P1-P9, U1, U2) over the raw stand-in feeds.
# ---------------------------------------------------------------------------
from feedmerge.operators import normalize as nz  # noqa: E402
from feedmerge.operators.quality import vendor_errors  # noqa: E402


def _now():
    return F.lit(dv.RUN_NOW).cast("timestamp")


def _normalized(spark, sf_dir, feed=None):
    feed = feed if feed is not None else dv.raw_feed(spark, sf_dir)
    good = feed.where(F.col("missing_columns").isNull())
    return materialize(nz.normalize(good, _now()), "normalized")


def _canonical_view(df):
    return df.select(
        "tenant_id", "vendor_id", *_keys(), "sku",
        F.col("quantity_available").cast("bigint").alias("quantity_available"),
        F.col("lead_time_days").cast("bigint").alias("lead_time_days"),
        sink_value(df, "cost"), sink_value(df, "map_price"), sink_value(df, "price"),
        "condition", sink_value(df, "updated_at"))


@register("column_map")
def q_column_map(spark, sf_dir):
    """Each canonical field read through the vendor's header mapping."""
    feed = dv.raw_feed(spark, sf_dir)
    fields = ["sku", "quantity_available", "cost", "map_price", "price", "lead_time_days",
              "condition", "updated_at"]
    return feed.select("vendor_id", *_keys(), *[nz.field_value(f).alias(f"raw_{f}") for f in fields])


@register("missing_columns")
def q_missing_columns(spark, sf_dir):
    """Required columns absent from each vendor's header."""
    files = nz.resolve_positions(dv.vendor_feeds(spark, sf_dir))
    return files.select("tenant_id", "vendor_id", "missing_columns")


@register("defaults")
def q_defaults(spark, sf_dir):
    """Blank quantity/price -> 0, blank condition -> vendor default,
    blank time -> run time."""
    df = _normalized(spark, sf_dir)
    return df.select("tenant_id", "vendor_id", *_keys(),
                     F.col("quantity_available").cast("bigint").alias("quantity_available"),
                     sink_value(df, "price"), "condition", sink_value(df, "updated_at"))


@register("validate_rows")
def q_validate_rows(spark, sf_dir):
    """The reject reason of every row (NULL when valid)."""
    df = _normalized(spark, sf_dir)
    return df.select("tenant_id", "vendor_id", *_keys(), "reason")


@register("split_valid")
def q_split_valid(spark, sf_dir):
    """Valid rows as canonical records."""
    return _canonical_view(nz.split_valid(_normalized(spark, sf_dir)))


@register("split_rejects")
def q_split_rejects(spark, sf_dir):
    """Rejected rows with their reason and raw row."""
    maps = dv.vendor_feeds(spark, sf_dir).select("vendor_id", "column_map")
    rej = nz.split_rejects(_normalized(spark, sf_dir)).join(maps, "vendor_id")
    data = F.col("row_data")
    return rej.select("tenant_id", "vendor_id", *_keys(), "reason",
                      data[F.coalesce(F.col("column_map")["sku"], F.lit("sku"))].alias("raw_sku"),
                      F.size(data).cast("bigint").alias("n_fields"))


@register("union_feeds")
def q_union_feeds(spark, sf_dir):
    """Vendors of every header layout normalised in one pass; the layout is
    a column, so no part is scanned again for each."""
    return nz.split_valid(_normalized(spark, sf_dir)).select("tenant_id", "vendor_id", *_keys(), "sku")


@register("all_errors")
def q_all_errors(spark, sf_dir):
    """Row rejects plus vendor-level entries (missing columns under a
    lenient policy) in one error list."""
    rules = dv.tenant_rules(spark, sf_dir)
    files = nz.resolve_positions(dv.vendor_feeds(spark, sf_dir))
    rows = nz.split_rejects(_normalized(spark, sf_dir)).select(
        "tenant_id", "vendor_id", *_keys(), F.lit(None).cast("bigint").alias("row_number"), "reason")
    vend = vendor_errors(files, rules).select(
        "tenant_id", "vendor_id", *[F.lit(None).cast("bigint").alias(c) for c in LINE_KEYS],
        "row_number", "reason")
    return rows.unionByName(vend)


# ---------------------------------------------------------------------------
# SKU maps (S4/M6, J1, J3).
# ---------------------------------------------------------------------------
from feedmerge.operators import skumap as sm  # noqa: E402


@register("sku_map_clean")
def q_sku_map_clean(spark, sf_dir):
    """Stripped, non-blank map rows, last row per vendor code."""
    return sm.clean_sku_map(dv.sku_map_rows(spark, sf_dir)).select(
        "tenant_id", "vendor_id", "vendor_sku", "sku")


@register("sku_map_join")
def q_sku_map_join(spark, sf_dir):
    """Every offer's sku rewritten through its vendor's map."""
    mapped = sm.apply_sku_map(dv.offers(spark, sf_dir), sm.clean_sku_map(dv.sku_map_rows(spark, sf_dir)))
    return mapped.select("tenant_id", "vendor_id",
                         *[F.col(f"row_number.{c}").cast("bigint").alias(c) for c in LINE_KEYS], "sku")


@register("missing_sku_map")
def q_missing_sku_map(spark, sf_dir):
    """Vendors with a configured map but no map input."""
    return sm.missing_sku_maps(dv.vendor_configs(spark, sf_dir), dv.sku_map_rows(spark, sf_dir)).select(
        "tenant_id", "vendor_id", "row_number", "reason")


# ---------------------------------------------------------------------------
# CSV sources and sinks (S1, S3, S8, P4, K1, K8) on files written from the
# driver tables into the shared scratch folder.
# ---------------------------------------------------------------------------
from feedmerge.plans import feed_files as ff  # noqa: E402
from feedmerge.session import scratch_path  # noqa: E402
from feedmerge.sinks.csv import write_feed  # noqa: E402
from feedmerge.sources import copies  # noqa: E402
from feedmerge.sources import feeds as src  # noqa: E402
from feedmerge.sources import files as fl  # noqa: E402


def _scanned(spark, sf_dir):
    return src.scan(spark, ff.prepared_feed_files(spark, sf_dir))


def _key_values(files_rows):
    def pos(name):
        return nz.header_position(F.lit(name))
    return [F.try_element_at("values", pos(k)).cast("bigint").alias(c)
            for k, c in zip(ff.KEY_FIELDS, LINE_KEYS[:3])]


@register("row_number")
def q_row_number(spark, sf_dir):
    """Dense 1-based line numbers (header = 1) of every record read
    from the vendor files."""
    scan = _scanned(spark, sf_dir)
    joined = scan.rows_of(scan.files.select("*", *ff.file_identity()))
    return joined.select("vendor_id", "bucket", *_key_values(joined),
                         F.col("row_number").cast("bigint").alias("row_number"))


@register("bronze_copy")
def q_bronze_copy(spark, sf_dir):
    """K8: byte copies of the feed files: lines of each copy, and whether the
    bytes read back from copy and file have the digest noted at copying."""
    root = ff.write_feed_files(spark, sf_dir, scratch_path(spark, "feeds"))
    target = scratch_path(spark, "inbound-copies")
    key = F.concat(F.lit("tenant_id="), "tenant_id", F.lit("/vendor_id="), "vendor_id", F.lit("/bucket="),
                   F.col("bucket").cast("string"), F.lit("/"), F.element_at(F.split("path", "/"), -1))

    def found(path):
        read = fl.digests(fl.list_tree(spark, path)).select("*", *ff.file_identity("path"))
        return read.withColumn("key", key)
    keyed = materialize(found(root), "inbound-files")
    noted = copies.copy_files(keyed.select("path", "key", F.col("n_bytes").alias("size")), target)
    copied = materialize(found(target), "copied-files")
    lines = (copied.where("n_lines > 0").groupBy("tenant_id", "vendor_id", "bucket")
             .agg(F.sum("n_lines").alias("n_lines")))
    copied = copied.select("key", F.col("sha256").alias("copied"))
    same = (F.col("sha256") == F.col("copied")) & (F.col("sha256") == F.col("copy_sha256")) & (
        F.col("n_bytes") == F.col("copy_bytes"))
    checked = (keyed.join(noted, "key", "left").join(copied, "key", "left").groupBy("tenant_id", "vendor_id", "bucket")
               .agg(F.every(F.coalesce(same, F.lit(False))).alias("same_bytes")))
    return lines.join(checked, ["tenant_id", "vendor_id", "bucket"])


def _valid_records(spark, sf_dir, scan):
    files = scan.files.select("*", *ff.file_identity())
    vendors = dv.vendor_feeds(spark, sf_dir).select(
        "tenant_id", "vendor_id", "vendor_ordinal", "column_map", "default_condition")
    layout = nz.resolve_positions(files.join(vendors, ["tenant_id", "vendor_id"]))
    feed = scan.rows_of(layout.where(F.col("missing_columns").isNull()))
    feed = feed.select("*", *_key_values(feed))
    valid = nz.split_valid(materialize(nz.normalize(feed, _now()), "normalized"))
    return valid.withColumn("l_suppkey", F.expr("cast(substring(vendor_id, 2) as bigint)"))


def _valid_from_files(spark, sf_dir, scan):
    return _canonical_view(_valid_records(spark, sf_dir, scan))


@register("scan_feed")
def q_scan_feed(spark, sf_dir):
    """S1 + P1-P8 end to end: vendor CSV files -> valid canonical records."""
    return _valid_from_files(spark, sf_dir, _scanned(spark, sf_dir))


def _merged_feed_dir(spark, sf_dir):
    merged = merged_priced(spark, sf_dir)
    rules = dv.tenant_rules(spark, sf_dir)
    out = scratch_path(spark, "merged")
    write_feed(merged, out, rules.select("tenant_id", "output_columns"), one_file_per_partition=True)
    return out


@register("write_feed")
def q_write_feed(spark, sf_dir):
    """K1: every line of the merged feeds as written (header + sorted rows,
    per-tenant column lists)."""
    out = _merged_feed_dir(spark, sf_dir)
    text = spark.read.text(out)
    return text.select(F.regexp_extract(F.col("_metadata.file_path"), r"tenant_id=([^/]+)/", 1).alias("tenant_id"),
                       F.col("value").alias("line"))


@register("roundtrip_csv")
def q_roundtrip_csv(spark, sf_dir):
    """S3: merged feeds read back as strings by header name."""
    out = _merged_feed_dir(spark, sf_dir)
    files, rows = src.scan_feeds(spark, out)
    joined = rows.join(files, "source_file")

    def field(name):
        return F.try_element_at("values", nz.header_position(F.lit(name)))
    return joined.select(
        F.regexp_extract("source_file", r"tenant_id=([^/]+)/", 1).alias("tenant_id"),
        F.col("row_number").cast("bigint").alias("row_number"),
        *[field(c).alias(c) for c in ("sku", "quantity_available", "price", "updated_at")])


@register("decode_guard")
def q_decode_guard(spark, sf_dir):
    """Feed files whose bytes are not valid UTF-8."""
    root = ff.write_encoded_files(spark, sf_dir, scratch_path(spark, "encoded"))
    bad = src.decode_failures(spark, root)
    return bad.select(F.regexp_extract("source_file", r"vendor_id=([^/]+)/", 1).alias("vendor_id"))


# ---------------------------------------------------------------------------
# Run quality (J2, P12, M3, M4, M5, R8, K4) over the whole stand-in run.
# ---------------------------------------------------------------------------
from feedmerge.plans import batch as B  # noqa: E402

STAND_IN_TIEBREAK = ("vendor_ordinal", "row_number", "l_partkey")


def stand_in_inputs(spark, sf_dir) -> B.RunInputs:
    feed = dv.raw_feed(spark, sf_dir)
    rows = feed.select(F.col("vendor_id").alias("source_file"),
                       (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("row_number"),
                       "values", *_keys())
    files = dv.vendor_feeds(spark, sf_dir).select(
        "tenant_id", "vendor_id", F.col("vendor_id").alias("source_file"), "header")
    maps = dv.sku_map_rows(spark, sf_dir)
    return B.RunInputs(rules=dv.tenant_rules(spark, sf_dir), vendors=dv.configured_vendors(spark, sf_dir),
                       files=files, rows=rows, sku_maps=maps)


def stand_in_run(spark, sf_dir) -> B.RunResult:
    return B.engine(stand_in_inputs(spark, sf_dir), _now(), tiebreak=STAND_IN_TIEBREAK)


@register("missing_vendors")
def q_missing_vendors(spark, sf_dir):
    """Configured vendors that sent no file."""
    inp = stand_in_inputs(spark, sf_dir)
    return B.missing_vendors(inp.vendors, inp.files).select(
        "tenant_id", "vendor_id", "required", F.col("s3_prefix").alias("expected_prefix"))


@register("missing_vendor_policy")
def q_missing_vendor_policy(spark, sf_dir):
    """Per tenant, the REQUIRED_VENDOR_MISSING failure or the entries
    and warnings for vendors without input."""
    inp = stand_in_inputs(spark, sf_dir)
    missing = B.missing_vendors(inp.vendors, inp.files)
    fails = B.missing_vendor_failures(missing, inp.rules)
    entries = B.missing_vendor_entries(missing, inp.rules).groupBy("tenant_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct(F.struct("required", "vendor_ordinal").alias("o"), F.col("warning").alias("w")))),
            lambda x: x["w"]), ";").alias("warnings"),
        F.count(F.lit(1)).alias("n_entries"))
    return (inp.rules.select("tenant_id").join(fails, "tenant_id", "left").join(entries, "tenant_id", "left")
            .select("tenant_id",
                    F.when(F.col("error_message").isNotNull(), F.lit("REQUIRED_VENDOR_MISSING")).alias("error_code"),
                    "error_message", F.coalesce("warnings", F.lit("")).alias("warnings"),
                    F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries")))


@register("vendor_counts")
def q_vendor_counts(spark, sf_dir):
    """M3: valid records per configured vendor (0 without input)."""
    return stand_in_run(spark, sf_dir).vendor_counts.select(
        "tenant_id", "vendor_id", F.col("n_valid").cast("bigint").alias("n_valid"))


@register("run_summary")
def q_run_summary(spark, sf_dir):
    """M4: vendor_count, record_count, invalid_rows, total_rows per tenant."""
    return stand_in_run(spark, sf_dir).summary


@register("error_gate")
def q_error_gate(spark, sf_dir):
    """M5 (+ P3, P12): final status of every tenant's run."""
    g = stand_in_run(spark, sf_dir).gates
    return g.select("tenant_id", "status", "stage", "error_code", "error_message",
                    F.array_join("warnings", ";").alias("warnings"))


@register("reject_stats")
def q_reject_stats(spark, sf_dir):
    """Error entries per tenant, vendor and kind of reason."""
    e = stand_in_run(spark, sf_dir).errors
    kind = F.regexp_extract("reason", r"^([^:]+)", 1)
    return e.groupBy("tenant_id", "vendor_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("error_report")
def q_error_report(spark, sf_dir):
    """K4: errors.json entries (missing-vendor entries, then engine errors)
    written as JSON per tenant and read back."""
    from feedmerge.sinks.reports import read_error_report, write_error_report
    run = stand_in_run(spark, sf_dir)
    out = scratch_path(spark, "errors")
    none = F.lit(None).cast("string")
    write_error_report(run, out, run.summary.select(
        "tenant_id", F.lit("stand-in").alias("run_id"), none.alias("failed_stage"), none.alias("error_code"),
        none.alias("error_message")))
    back = read_error_report(spark, out)
    return back.select("tenant_id", F.col("entry_section").cast("bigint").alias("entry_section"), "error_code", "vendor_id",
                       F.col("row_number").cast("bigint").alias("row_number"), "reason")


# ---------------------------------------------------------------------------
# Listings (S6/M7, K6).
# ---------------------------------------------------------------------------
from feedmerge.sources import listing as ls  # noqa: E402


@register("latest_inbound")
def q_latest_inbound(spark, sf_dir):
    """Newest object under each configured vendor's prefix."""
    latest = ls.latest_inbound(dv.inbound_listing(spark, sf_dir), dv.configured_vendors(spark, sf_dir))
    return latest.select("tenant_id", "vendor_id", F.col("key").alias("s3_key"), "etag", "size",
                         format_datetime(F.col("last_modified")).alias("last_modified"))


@register("input_manifest")
def q_input_manifest(spark, sf_dir):
    """K6: found/missing entry per configured vendor."""
    m = ls.input_manifest(dv.inbound_listing(spark, sf_dir), dv.configured_vendors(spark, sf_dir))
    return m.withColumn("last_modified", format_datetime(F.col("last_modified")))


# ---------------------------------------------------------------------------
# Config versions and run ledger.
# ---------------------------------------------------------------------------
from feedmerge.operators import ledger as lg  # noqa: E402


def _ledger(spark, sf_dir):
    req = dv.run_requests(spark, sf_dir)
    events = _created(req).unionByName(dv.status_events(spark, sf_dir))
    return req.select("run_id", "tenant_id").join(lg.fold_runs(events), "run_id")


def _created(req):
    """The first event of each run: queued."""
    return req.select(
        "run_id", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("p"),
                           F.lit(0).cast("bigint").alias("s")).alias("seq"),
        F.lit("QUEUED").alias("status"), F.lit("QUEUE").alias("stage"),
        *[F.lit(None).cast("timestamp").alias(c) for c in ("started_at", "finished_at", "completed_at")],
        *[F.lit(None).cast("string").alias(c) for c in lg.ERROR_FIELDS],
        F.lit(None).cast("map<string,string>").alias("artifacts"))


@register("latest_config")
def q_latest_config(spark, sf_dir):
    """Latest config version per tenant (last write per version wins)
    and the next version number."""
    return lg.latest_config(lg.config_versions(dv.config_puts(spark, sf_dir))).select(
        "tenant_id", "config_version", "config", "next_version")


@register("pinned_config")
def q_pinned_config(spark, sf_dir):
    """Every run joined to the config version it pinned."""
    p = lg.pinned_config(dv.run_requests(spark, sf_dir), lg.config_versions(dv.config_puts(spark, sf_dir)))
    return p.select("run_id", "tenant_id", "config_version", "config_found", "config", "error_code")


@register("run_ledger")
def q_run_ledger(spark, sf_dir):
    """Status events folded into one ledger record per run."""
    return _ledger_rows(_ledger(spark, sf_dir))


def _ledger_rows(ledger):
    return lg.run_view(ledger).select("run_id", "tenant_id", "status", "stage",
                    format_datetime(F.col("started_at")).alias("started_at"),
                    format_datetime(F.col("finished_at")).alias("finished_at"),
                    *lg.ERROR_FIELDS)


@register("active_runs")
def q_active_runs(spark, sf_dir):
    """Run requests blocked by another RUNNING run of the tenant."""
    req = dv.run_requests(spark, sf_dir).select("run_id", "tenant_id")
    return lg.active_runs(req, _ledger(spark, sf_dir))


@register("run_metrics")
def q_run_metrics(spark, sf_dir):
    """Long-form metrics of every finished run."""
    events = dv.status_events(spark, sf_dir).groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows_processed"))
    m = lg.run_metrics(_ledger(spark, sf_dir), events)
    return m.select("tenant_id", "run_id", "metric_name", F.round("value", 3).alias("value"), "unit")


# ---------------------------------------------------------------------------
# Alarms (R6), batch form.  Fixed test parameters: 1-hour periods.
# ---------------------------------------------------------------------------
from feedmerge.operators import alarms as al  # noqa: E402

HOUR = 3600
RUN_START = "2020-01-01 00:00:00"


def _alarm_rows(df, dims=()):
    return df.select(*dims, format_datetime(F.col("window_start")).alias("window_start"),
                     format_datetime(F.col("window_end")).alias("window_end"),
                     F.round("stat", 4).alias("stat"))


@register("alarm_consecutive")
def q_alarm_consecutive(spark, sf_dir):
    """Consecutive failures: RunFailed Maximum >= 1 in 3 of 3 hourly periods,
    per tenant."""
    fired = al.evaluate(dv.run_outcomes(spark, sf_dir), value="run_failed", statistic="Maximum",
                        period_seconds=HOUR, periods=3, threshold=1, dims=("tenant_id",))
    return _alarm_rows(fired, ("tenant_id",)).withColumn(
        "alarm", al.alarm_name("feedmerge", "consecutive-failures", F.col("tenant_id")))


@register("alarm_sum")
def q_alarm_sum(spark, sf_dir):
    """Error rate: Sum of error values >= 100 in one hourly period, per tenant."""
    errors = dv.metric_points(spark, sf_dir).where(F.col("event_type") == "error")
    fired = al.evaluate(errors, value="value", statistic="Sum", period_seconds=HOUR, periods=1,
                        threshold=100, dims=("tenant_id",))
    return _alarm_rows(fired, ("tenant_id",))


@register("alarm_avg")
def q_alarm_avg(spark, sf_dir):
    """Backlog: Average of view values >= 45 in 3 of 3 hourly periods (global)."""
    views = dv.metric_points(spark, sf_dir).where(F.col("event_type") == "view")
    fired = al.evaluate(views, value="value", statistic="Average", period_seconds=HOUR, periods=3,
                        threshold=45)
    return _alarm_rows(fired)


@register("heartbeat_gap")
def q_heartbeat_gap(spark, sf_dir):
    """Missing heartbeat: a worker (user) silent for 3 days or more between
    clicks, or from the last click to the end of the stream."""
    points = dv.metric_points(spark, sf_dir)
    beats = points.where(F.col("event_type") == "click")
    return _gap_rows(al.heartbeat_gaps(beats, min_gap_seconds=3 * 24 * HOUR,
                                       as_of=points.agg(F.max("ts")).scalar()))


def _gap_rows(gaps):
    return gaps.select("worker_id", format_datetime(F.col("gap_start")).alias("gap_start"),
                       format_datetime(F.col("gap_end")).alias("gap_end"),
                       F.round("gap_seconds", 3).alias("gap_seconds"))


# ---------------------------------------------------------------------------
# Streaming (R6 streaming form, R7).
# ---------------------------------------------------------------------------
from feedmerge.streaming import alarms as sa  # noqa: E402
from feedmerge.streaming.ingest import ingest_stream  # noqa: E402
from feedmerge.streaming.merge import MergedFeed  # noqa: E402
from feedmerge.streaming.slots import read_slots  # noqa: E402


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Feed files picked up by a file stream, parsed per micro-batch
    into the normalised table (idempotent partition overwrite), read back."""
    root = ff.write_feed_files(spark, sf_dir, scratch_path(spark, "inbound"))
    out = scratch_path(spark, "normalized-table")

    def process(spark_, paths):
        valid = _valid_from_files(spark_, sf_dir, src.scan(spark_, paths))
        return valid.withColumn("bucket", F.expr(f"l_orderkey div {ff.BUCKET_ORDERS}"))

    # one slot per (tenant, vendor, bucket) file
    slot_cols = ("tenant_id", "vendor_id", "bucket")
    ingest_stream(spark, root, out, scratch_path(spark, "ingest-ckpt"), process, slot_cols)
    return read_slots(spark, out, slot_cols).select(
        "tenant_id", "vendor_id", *[F.col(c).cast("bigint").alias(c) for c in LINE_KEYS], "sku",
        "quantity_available", "lead_time_days", "cost", "map_price", "price", "condition", "updated_at")


@register("merged_stream")
def q_merged_stream(spark, sf_dir):
    """R7 with M1 and F8: every slot is delivered twice, with other SKUs and
    amounts at first; the merged, priced feed is kept up to date per
    micro-batch and must end as the feeds' last state gives it."""
    root, out = scratch_path(spark, "inbound"), scratch_path(spark, "normalized-table")
    slot_cols = ("tenant_id", "vendor_id", "bucket")
    merged = MergedFeed(spark, scratch_path(spark, "merged-feed"), dv.tenant_rules(spark, sf_dir), slot_cols,
                        ("l_suppkey", *LINE_KEYS[:3]))

    def process(spark_, paths):
        valid = _valid_records(spark_, sf_dir, src.scan(spark_, paths))
        return valid.select("tenant_id", "vendor_id", F.expr(f"l_orderkey div {ff.BUCKET_ORDERS}").alias("bucket"),
                            *LINE_KEYS, "sku", "quantity_available", "lead_time_days", "cost", "map_price", "price",
                            "condition", "updated_at")

    for change in (ff.first_delivery, None):
        ff.write_feed_files(spark, sf_dir, root, change, "append")
        ingest_stream(spark, root, out, f"{out}-ckpt", process, slot_cols, merged=merged)
    return _record_view(merged.read())


@register("alarm_stream")
def q_alarm_stream(spark, sf_dir):
    """R6 streaming: consecutive-failure alarm evaluated by a streaming
    query over the events file; the file is the whole stream, so its last
    periods are closed too and the rows are those of ``alarm_consecutive``."""
    schema = dv.table(spark, sf_dir, "events").schema
    points = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
              .where(F.col("event_type").isin("error", "purchase"))
              .select(F.concat(F.lit("T"), (F.col("user_id") % dv.N_TENANTS).cast("string")).alias("tenant_id"),
                      F.col("ts").cast("timestamp").alias("ts"),
                      (F.col("event_type") == "error").cast("double").alias("run_failed")))
    marks = scratch_path(spark, "alarm-end")
    fired = sa.alarm_stream(sa.with_end_mark(points, marks), value="run_failed", statistic="Maximum", period_seconds=HOUR, periods=3,
                            threshold=1, dims=("tenant_id",))
    sink = scratch_path(spark, "alarm-sink")
    sa.run_to_end(fired, sink, scratch_path(spark, "alarm-ckpt"), marks)
    out = spark.read.schema("tenant_id string, window_start timestamp, window_end timestamp").parquet(sink)
    return out.select("tenant_id", format_datetime(F.col("window_start")).alias("window_start"),
                      format_datetime(F.col("window_end")).alias("window_end"))


# ---------------------------------------------------------------------------
# Config documents (S5, P13, P14) and output projection.
# ---------------------------------------------------------------------------
from feedmerge.sources import config as cfg  # noqa: E402


@register("load_config")
def q_load_config(spark, sf_dir):
    """Tenant documents written as JSON, read with the declared schema
    and flattened to the vendors table (defaults applied)."""
    path = scratch_path(spark, "configs")
    dv.config_documents(spark, sf_dir).write.mode("overwrite").text(path)
    configs = cfg.read_configs(spark, path)
    vendors = cfg.vendors_from_configs(configs)
    rules = cfg.rules_from_configs(configs).select("tenant_id", "base_margin_pct", "rounding_increment",
                                                   "fallback_lead_time_days", "merge_ok")
    return (vendors.join(rules, "tenant_id").join(configs.select("tenant_id", "schema_version", "version_ok"),
                                                  "tenant_id")
            .select("tenant_id", "schema_version", "version_ok", "vendor_id", "vendor_ordinal", "required",
                    "s3_prefix", "encoding", F.size("column_map").cast("bigint").alias("n_mapped"),
                    "has_sku_map", format_money_string(F.col("base_margin_pct")).alias("base_margin_pct"),
                    format_money_string(F.col("rounding_increment")).alias("rounding_increment"),
                    "fallback_lead_time_days", "merge_ok"))


@register("project_output")
def q_project_output(spark, sf_dir):
    """Merged records projected on each tenant's output columns (all
    canonical columns when the list is empty), one row per printed value."""
    from feedmerge.sinks.csv import _columns_or_all, _value_map
    from feedmerge.schema import CANONICAL_COLUMNS
    merged = merged_priced(spark, sf_dir)
    rules = dv.tenant_rules(spark, sf_dir).select("tenant_id", "output_columns")
    j = merged.join(rules, "tenant_id")
    vals = _value_map(j, CANONICAL_COLUMNS)
    cols = _columns_or_all(F.col("output_columns"))
    cells = F.transform(cols, lambda c, i: F.struct(i.alias("position"), c.alias("column"),
                                                    F.coalesce(vals[c], F.lit("")).alias("value")))
    return j.select("tenant_id", "sku", F.explode(cells).alias("c")).select(
        "tenant_id", "sku", F.col("c.position").cast("bigint").alias("position"), "c.column", "c.value")


# ---------------------------------------------------------------------------
# Heartbeats and the run ledger as streams.
# ---------------------------------------------------------------------------
from feedmerge.streaming import ledger as sl  # noqa: E402


def _stream(spark, sf_dir, name):
    """A table's file as a stream."""
    return (spark.readStream.schema(dv.table(spark, sf_dir, name).schema)
            .option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


@register("heartbeat_stream")
def q_heartbeat_stream(spark, sf_dir):
    """R6 streaming: sessions of a worker's clicks close after 3 silent days;
    the silences between and after them are those of ``heartbeat_gap``."""
    beats = (_stream(spark, sf_dir, "events").where(F.col("event_type") == "click")
             .select(F.col("user_id").cast("bigint").alias("worker_id"), F.col("ts").cast("timestamp").alias("ts")))
    marks, sink = scratch_path(spark, "beat-end"), scratch_path(spark, "beat-sessions")
    sessions = sa.heartbeat_sessions(sa.with_end_mark(beats, marks), min_gap_seconds=3 * 24 * HOUR)
    sa.run_to_end(sessions, sink, scratch_path(spark, "beat-ckpt"), marks)
    closed = spark.read.schema("worker_id bigint, first_beat timestamp, last_beat timestamp, beats bigint").parquet(sink)
    until = dv.metric_points(spark, sf_dir).agg(F.max("ts")).scalar()
    return _gap_rows(sa.silences(closed, min_gap_seconds=3 * 24 * HOUR, as_of=until))


@register("ledger_stream")
def q_ledger_stream(spark, sf_dir):
    """R3/K12 streaming: status events, each delivered twice, folded by an
    update-mode aggregate into the ledger table; equals ``run_ledger``."""
    requests = dv.run_requests(spark, sf_dir).select("run_id", "tenant_id")
    created = _created(_stream(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("run_id")))
    events = created.unionByName(dv.status_events_of(_stream(spark, sf_dir, "lineitem")))
    # all events of the files are sent at one time
    events = events.withColumn("delivered_at", F.lit(RUN_START).cast("timestamp"))
    path = scratch_path(spark, "ledger")
    sl.run_ledger_stream(sl.ledger_stream(events.unionByName(events)), path, f"{path}-ckpt")
    return _ledger_rows(requests.join(spark.read.parquet(path), "run_id"))
