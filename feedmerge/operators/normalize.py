"""Rename, convert, default and validate raw feed rows.

Input rows carry ``header`` (the file's header fields, in order), ``values``
(the row's fields, positional) and the vendor's ``column_map`` (canonical
name -> header name; unmapped fields use their canonical name).  Header
matching is exact and case-sensitive; when a header name repeats, the last
column wins (as a dict built from the header would).

Conversions run in a fixed order and the first failure is the row's
reason; otherwise the validator messages are reported together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmerge.functions.parsing import parse_datetime, parse_decimal, parse_int
from feedmerge.functions.text import strip_ws
from feedmerge.schema import CANONICAL_COLUMNS, CONDITIONS, MONEY, REQUIRED_HEADER_FIELDS

# Fields read from the feed (vendor_id comes from the config).
FEED_FIELDS = [c for c in CANONICAL_COLUMNS if c != "vendor_id"]
# Order in which conversion errors short-circuit a row.
CONVERSION_ORDER = ("quantity_available", "cost", "map_price", "msrp",
                    "lead_time_days", "price", "updated_at")


def mapped_name(field: str, column_map: str = "column_map") -> Column:
    return F.coalesce(F.col(column_map).getItem(field), F.lit(field))


def header_position(name: Column, header: str = "header") -> Column:
    """1-based index of the *last* ``name`` in the header, 0 when absent."""
    from_end = F.array_position(F.reverse(F.col(header)), name)
    return F.when(from_end > 0, F.size(F.col(header)) - from_end + 1).otherwise(F.lit(0)).cast("int")


def resolve_positions(files: DataFrame, header: str = "header",
                      column_map: str = "column_map") -> DataFrame:
    """Per file: where each canonical field sits in its header (``pos_<field>``)
    and the missing-required-columns message (``missing_columns``).

    Run on the one-row-per-file table, so rows never repeat the lookup."""
    return files.select(
        "*",
        *[header_position(mapped_name(f, column_map), header).alias(f"pos_{f}") for f in FEED_FIELDS],
        missing_columns(header, column_map).alias("missing_columns"),
    )


def missing_columns(header: str = "header", column_map: str = "column_map") -> Column:
    """``missing columns: A, B`` (mapped names, required-field order) or NULL."""
    required = F.array(*[mapped_name(f, column_map) for f in REQUIRED_HEADER_FIELDS])
    missing = F.filter(required, lambda x: ~F.coalesce(F.array_contains(F.col(header), x), F.lit(False)))
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", ")))


def field_value(field: str, values: str = "values") -> Column:
    pos = F.col(f"pos_{field}")
    return F.when(pos > 0, F.try_element_at(F.col(values), pos))


def row_data(header: str = "header", values: str = "values") -> Column:
    """The raw row as a header -> value map (short rows give NULL values,
    fields past the header are dropped)."""
    pairs = F.arrays_zip(F.col(header).alias("k"), F.col(values).alias("v"))
    kept = F.filter(pairs, lambda e: e["k"].isNotNull())
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))))


def normalize(rows: DataFrame, now: Column, *, values: str = "values",
              header: str = "header") -> DataFrame:
    """Typed canonical columns plus ``reason`` (NULL for a valid row).

    ``rows`` needs ``vendor_id``, ``pos_<field>`` columns (``resolve_positions``),
    ``values``, ``header`` and optionally ``default_condition``.  Other columns
    pass through; ``header``/``values``/``column_map`` are replaced by
    ``row_data`` (the raw row as a map, kept for rejected rows only).

    Valid and rejected rows are both read from the result: materialise it
    once (``feedmerge.session.materialize``) before splitting, otherwise the
    split filter is pushed below the projections and every row is parsed
    twice.

    The work is staged in projections (raw fields, stripped text, converted
    values, validator messages) so every expression is computed once and
    each generated code block stays small.
    """
    keep = [c for c in rows.columns
            if (c == "vendor_id" or c not in set(CANONICAL_COLUMNS)) and not c.startswith("pos_")]
    if "default_condition" not in rows.columns:
        rows = rows.withColumn("default_condition", F.lit(None).cast("string"))
        keep.append("default_condition")
    # 1. raw text of every field
    staged = rows.select(*keep, *[field_value(f, values).alias(f"_raw_{f}") for f in FEED_FIELDS])
    raw = {f: F.col(f"_raw_{f}") for f in FEED_FIELDS}
    # 2. stripped text of the converted fields and the condition input
    cond_in = F.when(F.coalesce(raw["condition"], F.lit("")) == "",
                     F.col("default_condition")).otherwise(raw["condition"])
    staged = staged.select(
        "*",
        *[strip_ws(raw[f]).alias(f"_s_{f}") for f in CONVERSION_ORDER],
        strip_ws(F.coalesce(raw["sku"], F.lit(""))).alias("_s_sku"),
        cond_in.alias("_cond_in"),
    )
    st = {f: F.col(f"_s_{f}") for f in CONVERSION_ORDER}
    qty = parse_int(raw["quantity_available"], st["quantity_available"])
    cost = parse_decimal(raw["cost"], stripped=st["cost"])
    map_price = parse_decimal(raw["map_price"], stripped=st["map_price"])
    msrp = parse_decimal(raw["msrp"], stripped=st["msrp"])
    lead = parse_int(raw["lead_time_days"], st["lead_time_days"])
    price = parse_decimal(raw["price"], stripped=st["price"])
    updated = parse_datetime(raw["updated_at"], st["updated_at"])
    parsed = {"quantity_available": qty, "cost": cost, "map_price": map_price, "msrp": msrp,
              "lead_time_days": lead, "price": price, "updated_at": updated}
    # 3. converted values, the first conversion error and model-level flags
    staged = staged.select(
        *keep, "_raw_vendor_sku", "_raw_brand", "_raw_title", "_s_sku",
        F.lower(strip_ws(F.col("_cond_in"))).alias("_condition"), strip_ws(F.col("vendor_id")).alias("_s_vendor"),
        *[parsed[f].value.alias(f"_v_{f}") for f in CONVERSION_ORDER],
        F.coalesce(*[parsed[f].error for f in CONVERSION_ORDER]).alias("_conversion_error"),
        *[parsed[f].invalid.alias(f"_i_{f}") for f in ("cost", "map_price", "price", "msrp")],
    )
    v = {f: F.col(f"_v_{f}") for f in CONVERSION_ORDER}
    quantity = F.coalesce(v["quantity_available"], F.lit(0).cast("bigint"))
    cond_ok = F.col("_condition").isNull() | F.col("_condition").isin(*CONDITIONS)
    validator_errors = [
        F.when(F.col("_s_sku") == "", F.lit("sku: value is required")),
        F.when(F.coalesce("_s_vendor", F.lit("")) == "", F.lit("vendor_id: value is required")),
        F.when(quantity < 0, F.lit("quantity_available: quantity_available must be >= 0")),
        *[F.when(F.col(f"_i_{f}").isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f"_i_{f}")))
          for f in ("cost", "map_price", "price", "msrp")],
        F.when(~cond_ok, F.lit("condition: condition must be new, used, or refurb")),
    ]
    staged = staged.select("*", F.concat_ws("; ", *validator_errors).alias("_validation"))
    reason = F.coalesce(F.col("_conversion_error"), F.when(F.col("_validation") != "", F.col("_validation")))
    dropped = {"vendor_id", header, values, "column_map"}
    out = staged.select(
        *[c for c in keep if c not in dropped],
        F.col("_s_sku").alias("sku"),
        F.col("_raw_vendor_sku").alias("vendor_sku"),
        F.col("_s_vendor").alias("vendor_id"),
        quantity.alias("quantity_available"),
        v["lead_time_days"].alias("lead_time_days"),
        v["cost"].alias("cost"),
        v["map_price"].alias("map_price"),
        F.coalesce(v["price"], F.lit(0).cast(MONEY)).alias("price"),
        v["msrp"].alias("msrp"),
        F.col("_condition").alias("condition"),
        F.col("_raw_brand").alias("brand"),
        F.col("_raw_title").alias("title"),
        F.coalesce(v["updated_at"], now.cast("timestamp")).alias("updated_at"),
        reason.alias("reason"),
        F.when(reason.isNotNull(), row_data(header, values)).alias("row_data"),
    )
    return out


def split_valid(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reason").isNull()).drop("reason", "row_data")


def split_rejects(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reason").isNotNull())
