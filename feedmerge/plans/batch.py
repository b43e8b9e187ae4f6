"""The multi-tenant run: every tenant's feeds parsed, mapped, merged, priced
and gated by one lazy plan (engine + worker rules of the reference).

Inputs are tables, not Python loops: tenant rules (one row per tenant),
configured vendors (one row per tenant and vendor, in config order), feed
files (one row per received file with its header) and feed rows.  The
outputs are DataFrames; nothing but the one-row-per-tenant gate table is
ever collected, and a failing tenant does not stop the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmerge import schema as S
from feedmerge.functions.formatting import stage_index
from feedmerge.operators import normalize as nz
from feedmerge.operators.merge import best_priced
from feedmerge.operators.quality import vendor_entry
from feedmerge.operators.skumap import apply_sku_map, clean_sku_map, missing_sku_maps
from feedmerge.session import materialize

ERROR_COLUMNS = ["tenant_id", "vendor_id", "row_number", "reason", "row_data"]


@dataclass
class RunInputs:
    rules: DataFrame      # one row per tenant (schema.RULE_COLUMNS)
    vendors: DataFrame    # tenant_id, vendor_id, vendor_ordinal, required, s3_prefix,
                          # column_map, default_condition, has_sku_map
    files: DataFrame      # received files: tenant_id, vendor_id, source_file, header
    rows: DataFrame       # source_file, row_number, values (+ pass-through columns)
    sku_maps: DataFrame | None = None   # tenant_id, vendor_id, vendor_sku, sku, row_number
    decode_errors: DataFrame | None = None  # tenant_id, vendor_id, error_message
    map_decode_errors: DataFrame | None = None  # the same of SKU maps
    schema_versions: DataFrame | None = None  # tenant_id, schema_version
    received: DataFrame | None = None  # tenant_id, vendor_id with an input (default: files)
    maps_received: DataFrame | None = None  # tenant_id, vendor_id with a map file, even an empty one


@dataclass
class RunResult:
    records: DataFrame    # valid records per vendor after SKU mapping (normalised output)
    errors: DataFrame     # engine error entries (vendor-level and row rejects)
    vendor_missing: DataFrame  # worker entries for vendors without input
    merged: DataFrame     # best offer per SKU, priced
    summary: DataFrame    # one row per tenant
    gates: DataFrame      # one row per tenant: status, failed_stage, error_code, ...
    vendor_counts: DataFrame  # valid records per configured vendor (0 if none)


def missing_vendors(vendors: DataFrame, files: DataFrame) -> DataFrame:
    """Configured vendors without any received file (left anti join)."""
    received = files.select("tenant_id", "vendor_id").distinct()
    return vendors.join(received, ["tenant_id", "vendor_id"], "left_anti")


def missing_vendor_entries(missing: DataFrame, rules: DataFrame) -> DataFrame:
    """Worker entries and warnings for vendors without input.

    Optional vendors always give an ``OPTIONAL_VENDOR_MISSING`` entry;
    required vendors give ``REQUIRED_VENDOR_MISSING`` entries only under
    the ``warn_only`` policy (otherwise the tenant fails, see
    ``missing_vendor_failures``)."""
    m = missing.join(rules.select("tenant_id", "missing_required_vendor_policy"), "tenant_id")
    warn_only = F.col("missing_required_vendor_policy") == "warn_only"
    prefix = F.coalesce(F.col("s3_prefix"), F.lit(""))
    kept = m.where(~F.col("required") | warn_only)
    return kept.select(
        "tenant_id", "vendor_id", "vendor_ordinal",
        F.when(F.col("required"), F.lit(S.REQUIRED_VENDOR_MISSING))
        .otherwise(F.lit(S.OPTIONAL_VENDOR_MISSING)).alias("error_code"),
        F.concat(F.when(F.col("required"), F.lit("required")).otherwise(F.lit("optional")),
                 F.lit(" vendor inbound missing for "), F.col("vendor_id"),
                 F.lit(" (expected prefix "), prefix, F.lit(")")).alias("error_message"),
        prefix.alias("expected_prefix"),
        F.concat(F.when(F.col("required"), F.lit("required_vendor_missing:"))
                 .otherwise(F.lit("optional_vendor_missing:")), F.col("vendor_id")).alias("warning"),
        F.col("required"),
    )


def _ordered_join(items: Column, sep: str) -> Column:
    """Join ``struct(ord, text)`` items in ``ord`` order."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), sep)


def missing_vendor_failures(missing: DataFrame, rules: DataFrame) -> DataFrame:
    """Tenants failing with ``REQUIRED_VENDOR_MISSING``: the message names
    every missing required vendor in config order (a per-tenant list, bounded
    by the tenant's configuration)."""
    strict = rules.where(F.col("missing_required_vendor_policy") != "warn_only").select("tenant_id")
    req = missing.where(F.col("required")).join(strict, "tenant_id", "left_semi")
    item = F.struct(F.col("vendor_ordinal").alias("ord"),
                    F.concat(F.col("vendor_id"), F.lit(" (expected prefix "),
                             F.coalesce(F.col("s3_prefix"), F.lit("")), F.lit(")")).alias("text"))
    return req.groupBy("tenant_id").agg(
        F.concat(F.lit("required vendor inbound missing: "),
                 _ordered_join(F.collect_list(item), ", ")).alias("error_message"))


def engine(inputs: RunInputs, now: Column, *, worker_flow: bool = True,
           tiebreak: tuple[str, ...] = ("vendor_ordinal", "row_number")) -> RunResult:
    rules, vendors, files = inputs.rules, inputs.vendors, inputs.files

    # -- inputs present / missing -------------------------------------------------
    missing = missing_vendors(vendors, inputs.received if inputs.received is not None else files)
    vendor_missing = missing_vendor_entries(missing, rules)

    # -- header check per file (one row per file) --------------------------------
    layout = nz.resolve_positions(
        files.join(vendors.drop("header"), ["tenant_id", "vendor_id"]))
    lenient = rules.where(~F.col("fail_on_missing_required_columns")).select("tenant_id")
    col_errors = (layout.where(F.col("missing_columns").isNotNull())
                  .join(lenient, "tenant_id", "left_semi")
                  .select("tenant_id", "vendor_id", F.lit(0).cast("bigint").alias("row_number"),
                          F.col("missing_columns").alias("reason"), vendor_entry().alias("row_data")))

    # -- parse + validate, once ---------------------------------------------------
    good = layout.where(F.col("missing_columns").isNull()).select(
        "tenant_id", "vendor_id", "vendor_ordinal", "default_condition", "source_file", "header",
        *[f"pos_{f}" for f in nz.FEED_FIELDS])
    # one row per input file, small beside the rows: Spark broadcasts it by its
    # measured size, or shuffles and splits a huge file's rows (skew join)
    feed = inputs.rows.join(good, "source_file")
    normalized = materialize(nz.normalize(feed, now), "normalized")
    valid = nz.split_valid(normalized)
    rejects = nz.split_rejects(normalized).select(*ERROR_COLUMNS)

    # -- SKU maps -------------------------------------------------------------------
    # checked for vendors whose file passed the header check; a map file
    # without rows is there all the same
    parsed = good.select("tenant_id", "vendor_id").distinct()
    with_map = inputs.maps_received if inputs.maps_received is not None else inputs.sku_maps
    expected = vendors.join(parsed, ["tenant_id", "vendor_id"], "left_semi")
    map_errors = missing_sku_maps(expected, with_map)
    parsed_rows = valid
    if inputs.sku_maps is not None:
        valid = apply_sku_map(valid, clean_sku_map(inputs.sku_maps))

    # -- engine-level missing inbound entries (direct engine calls only) ---------
    parts = [col_errors, map_errors]
    if not worker_flow:
        strict_missing = missing.join(
            (rules.where(F.col("missing_required_vendor_policy") != "warn_only")
                        .select("tenant_id")), "tenant_id", "left_semi").where(F.col("required"))
        parts.append(strict_missing.select("tenant_id", "vendor_id", F.lit(0).cast("bigint").alias("row_number"),
                                           F.lit(S.REASON_MISSING_INBOUND).alias("reason"),
                                           vendor_entry().alias("row_data")))
    parts.append(rejects)
    errors = parts[0]
    for p in parts[1:]:
        errors = errors.unionByName(p)

    # -- merge + price --------------------------------------------------------------
    merged = best_priced(valid, rules, tiebreak)

    # -- counts and summary ---------------------------------------------------------
    vendor_counts = vendors.select("tenant_id", "vendor_id").join(
        parsed_rows.groupBy("tenant_id", "vendor_id").agg(F.count(F.lit(1)).alias("n_valid")),
        ["tenant_id", "vendor_id"], "left").fillna(0, ["n_valid"])
    error_counts = errors.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("invalid_rows"),
        F.count(F.when(F.col("reason") != S.REASON_MISSING_INBOUND, 1)).alias("_counted_errors"))
    valid_counts = vendor_counts.groupBy("tenant_id").agg(F.sum("n_valid").alias("_valid"))
    # one merged record for each SKU: counted without ranking and pricing
    merged_counts = (valid.select("tenant_id", "sku").distinct()
                     .groupBy("tenant_id").agg(F.count(F.lit(1)).alias("record_count")))
    configured = vendors.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("vendor_count"))
    summary = (
        rules.select("tenant_id").join(configured, "tenant_id", "left")
        .join(merged_counts, "tenant_id", "left").join(error_counts, "tenant_id", "left")
        .join(valid_counts, "tenant_id", "left")
        .select("tenant_id",
                F.coalesce("vendor_count", F.lit(0)).cast("bigint").alias("vendor_count"),
                F.coalesce("record_count", F.lit(0)).cast("bigint").alias("record_count"),
                F.coalesce("invalid_rows", F.lit(0)).cast("bigint").alias("invalid_rows"),
                (F.coalesce("_valid", F.lit(0)) + F.coalesce("_counted_errors", F.lit(0)))
                .cast("bigint").alias("total_rows"))
    )

    gates = _gates(inputs, summary, missing, vendor_missing, layout)
    return RunResult(records=valid, errors=errors, vendor_missing=vendor_missing, merged=merged,
                     summary=summary, gates=gates, vendor_counts=vendor_counts)


def _first_by_vendor_order(df: DataFrame, message: Column) -> DataFrame:
    return df.groupBy("tenant_id").agg(F.min_by(message, F.col("vendor_ordinal")).alias("error_message"))


def _gates(inputs: RunInputs, summary: DataFrame, missing: DataFrame, vendor_missing: DataFrame,
           layout: DataFrame) -> DataFrame:
    """One row per tenant: final status, stage reached, failure and warnings.

    Failure order follows the worker: required vendor missing, unsupported
    schema version (both FETCH_INPUTS), then the first vendor (config order)
    with a decode error or missing required columns (NORMALIZE), then no
    rows parsed and too many invalid rows (MERGE_PRICE)."""
    rules = inputs.rules
    fail_vendor = missing_vendor_failures(missing, rules).withColumn("_code", F.lit(S.REQUIRED_VENDOR_MISSING))
    strict = rules.where(F.col("fail_on_missing_required_columns")).select("tenant_id")
    col_fail = layout.where(F.col("missing_columns").isNotNull()).join(strict, "tenant_id", "left_semi")
    normalize_fail = col_fail.select("tenant_id", "vendor_ordinal",
                                     F.lit(S.MISSING_REQUIRED_COLUMNS).alias("_c"),
                                     F.col("missing_columns").alias("_m"))
    decode_errors = inputs.decode_errors
    if inputs.map_decode_errors is not None:
        # a map is read after its vendor's feed: not if that had no usable header
        read = layout.where(F.col("missing_columns").isNull()).select("tenant_id", "vendor_id")
        broken = inputs.map_decode_errors.join(read, ["tenant_id", "vendor_id"], "left_semi")
        decode_errors = broken if decode_errors is None else decode_errors.unionByName(broken)
    if decode_errors is not None:
        dec = decode_errors.join(inputs.vendors.select("tenant_id", "vendor_id", "vendor_ordinal"),
                                 ["tenant_id", "vendor_id"])
        normalize_fail = normalize_fail.unionByName(dec.select(
            "tenant_id", "vendor_ordinal", F.lit(S.DECODE_ERROR).alias("_c"),
            F.concat(F.lit("decode error for vendor "), F.col("vendor_id"), F.lit(": "),
                     F.col("error_message")).alias("_m")))
    if "merge_ok" in rules.columns:
        # refused when merging, that is after every vendor has been parsed
        bad = rules.where(~F.coalesce(F.col("merge_ok"), F.lit(False)))
        normalize_fail = normalize_fail.unionByName(bad.select(
            "tenant_id", F.lit(2**62).cast("bigint").alias("vendor_ordinal"), F.lit(S.INVALID_INPUT).alias("_c"),
            F.lit("Unsupported merge strategy").alias("_m")))
    first_norm = normalize_fail.groupBy("tenant_id").agg(
        F.min_by(F.struct("_c", "_m"), "vendor_ordinal").alias("_f"))
    version_fail = None
    if inputs.schema_versions is not None:
        version_fail = inputs.schema_versions.where(
            ~F.col("schema_version").isin(*S.SUPPORTED_SCHEMA_VERSIONS)).select(
            "tenant_id", F.concat(F.lit("unsupported schema_version "),
                                  F.col("schema_version").cast("string")).alias("_vm"))
    warn = vendor_missing.groupBy("tenant_id").agg(
        F.collect_list(F.struct(F.struct(F.col("required"), F.col("vendor_ordinal")).alias("ord"),
                                F.col("warning").alias("text"))).alias("_w"),
        F.count(F.lit(1)).alias("_n_missing_entries"))

    g = (summary.join(rules.select("tenant_id", "max_invalid_rows", "max_invalid_row_pct"), "tenant_id")
         .join(fail_vendor, "tenant_id", "left").join(first_norm, "tenant_id", "left")
         .join(warn, "tenant_id", "left"))
    if version_fail is not None:
        g = g.join(version_fail, "tenant_id", "left")
    else:
        g = g.withColumn("_vm", F.lit(None).cast("string"))
    invalid, total = F.col("invalid_rows"), F.col("total_rows")
    ratio = F.when(total > 0, invalid / total).otherwise(F.lit(0.0))
    too_many = (invalid > 0) & ((invalid > F.col("max_invalid_rows")) | (ratio > F.col("max_invalid_row_pct")))
    no_rows = (total == 0) & F.coalesce(F.col("_n_missing_entries") == 0, F.lit(True))
    code = (F.when(F.col("error_message").isNotNull(), F.lit(S.REQUIRED_VENDOR_MISSING))
            .when(F.col("_vm").isNotNull(), F.lit(S.UNSUPPORTED_SCHEMA_VERSION))
            .when(F.col("_f").isNotNull(), F.col("_f._c"))
            .when(no_rows, F.lit(S.NO_ROWS_PARSED))
            .when(too_many, F.lit(S.VALIDATION_ERRORS)))
    message = (F.when(F.col("error_message").isNotNull(), F.col("error_message"))
               .when(F.col("_vm").isNotNull(), F.col("_vm"))
               .when(F.col("_f").isNotNull(), F.col("_f._m"))
               .when(no_rows, F.lit("no rows parsed"))
               .when(too_many, F.lit("validation errors")))
    stage = (F.when(F.col("error_message").isNotNull() | F.col("_vm").isNotNull(), F.lit("FETCH_INPUTS"))
             .when(F.col("_f").isNotNull(), F.lit("NORMALIZE"))
             .when(no_rows | too_many, F.lit("MERGE_PRICE")))
    warnings_missing = F.transform(F.array_sort(F.coalesce(F.col("_w"), F.array())), lambda x: x["text"])
    warnings = F.when(invalid > 0, F.concat(warnings_missing, F.array(F.lit("invalid_rows_within_threshold")))) \
        .otherwise(warnings_missing)
    failed = code.isNotNull()
    return g.select(
        "tenant_id",
        F.when(failed, F.lit("FAILED")).otherwise(F.lit("SUCCEEDED")).alias("status"),
        F.when(failed, stage).otherwise(F.lit("COMPLETE")).alias("stage"),
        stage.alias("failed_stage"),
        code.alias("error_code"),
        message.alias("error_message"),
        F.when(failed, warnings_missing).otherwise(warnings).alias("warnings"),
        "vendor_count", "record_count", "invalid_rows", "total_rows",
        stage_index(F.when(failed, stage).otherwise(F.lit("COMPLETE"))).alias("stage_index"),
    )
