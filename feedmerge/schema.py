"""Fixed schemas, column lists and vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 6)      # internal money type
MONEY_OUT = T.DecimalType(18, 2)  # money at the sinks

# Canonical record, in output order.
CANONICAL_COLUMNS = [
    "sku",
    "vendor_sku",
    "vendor_id",
    "quantity_available",
    "lead_time_days",
    "cost",
    "map_price",
    "price",
    "msrp",
    "condition",
    "brand",
    "title",
    "updated_at",
]

CANONICAL_SCHEMA = T.StructType([
    T.StructField("sku", T.StringType(), False),
    T.StructField("vendor_sku", T.StringType(), True),
    T.StructField("vendor_id", T.StringType(), False),
    T.StructField("quantity_available", T.LongType(), False),
    T.StructField("lead_time_days", T.LongType(), True),
    T.StructField("cost", MONEY, True),
    T.StructField("map_price", MONEY, True),
    T.StructField("price", MONEY, False),
    T.StructField("msrp", MONEY, True),
    T.StructField("condition", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("updated_at", T.TimestampType(), False),
])

DECIMAL_FIELDS = ("cost", "map_price", "price", "msrp")
DATETIME_FIELDS = ("updated_at",)
REQUIRED_HEADER_FIELDS = ("sku", "quantity_available")

# Fixed values that must equal the reference's for identical results.
CONDITIONS = ("new", "used", "refurb")
STAGES = ("QUEUE", "FETCH_INPUTS", "NORMALIZE", "MERGE_PRICE", "WRITE_OUTPUTS", "COMPLETE")
RUN_STATUSES = ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED")
MAP_FLOOR_MAX = "max(price, map_price)"
SUPPORTED_SCHEMA_VERSIONS = (1,)
# Accepted encoding spellings (after strip, lower-case, "_" -> "-") and the
# charset each one decodes with.
ENCODINGS = {
    "utf-8": "UTF-8",
    "utf8": "UTF-8",
    "latin-1": "ISO-8859-1",
    "iso-8859-1": "ISO-8859-1",
    "iso8859-1": "ISO-8859-1",
}

# Error codes of run failures and report entries (fixed vocabulary).
MISSING_TENANT_CONFIG = "missing_tenant_config"
REQUIRED_VENDOR_MISSING = "REQUIRED_VENDOR_MISSING"
OPTIONAL_VENDOR_MISSING = "OPTIONAL_VENDOR_MISSING"
UNSUPPORTED_SCHEMA_VERSION = "unsupported_schema_version"
DECODE_ERROR = "DECODE_ERROR"
MISSING_REQUIRED_COLUMNS = "missing_required_columns"
INVALID_INPUT = "invalid_input"
NO_ROWS_PARSED = "no_rows_parsed"
VALIDATION_ERRORS = "validation_errors"

# Row-level reasons that are not conversion or validator errors.
REASON_MISSING_INBOUND = "missing inbound file"
REASON_MISSING_SKU_MAP = "missing sku map"

# Rejected rows: one per bad record (row_number >= 2) or per vendor-level
# problem (row_number 0).
REJECT_SCHEMA = T.StructType([
    T.StructField("tenant_id", T.StringType(), False),
    T.StructField("vendor_id", T.StringType(), True),
    T.StructField("row_number", T.LongType(), False),
    T.StructField("reason", T.StringType(), False),
    T.StructField("row_data", T.MapType(T.StringType(), T.StringType()), True),
])

# ---------------------------------------------------------------------------
# Tenant configuration document (JSON; YAML is converted upstream).
# ---------------------------------------------------------------------------
VENDOR_CONFIG = T.StructType([
    T.StructField("vendor_id", T.StringType()),
    T.StructField("required", T.BooleanType()),
    T.StructField("inbound", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("s3_prefix", T.StringType()),
    ])),
    T.StructField("parser", T.StructType([
        T.StructField("format", T.StringType()),
        T.StructField("delimiter", T.StringType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("column_map", T.MapType(T.StringType(), T.StringType())),
    ])),
    T.StructField("sku_map", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("s3_key", T.StringType()),
        T.StructField("local_path", T.StringType()),
    ])),
])

TENANT_CONFIG = T.StructType([
    T.StructField("schema_version", T.LongType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("timezone", T.StringType()),
    T.StructField("default_currency", T.StringType()),
    T.StructField("vendors", T.ArrayType(VENDOR_CONFIG)),
    T.StructField("pricing", T.StructType([
        T.StructField("base_margin_pct", T.StringType()),
        T.StructField("min_price", T.StringType()),
        T.StructField("shipping_handling_flat", T.StringType()),
        T.StructField("map_policy", T.StructType([
            T.StructField("enforce", T.BooleanType()),
            T.StructField("map_floor_behavior", T.StringType()),
        ])),
        T.StructField("rounding", T.StructType([
            T.StructField("mode", T.StringType()),
            T.StructField("increment", T.StringType()),
        ])),
    ])),
    T.StructField("merge", T.StructType([
        T.StructField("strategy", T.StringType()),
        T.StructField("best_offer", T.StructType([
            T.StructField("sort_by", T.ArrayType(T.StringType())),
            T.StructField("landed_cost", T.StructType([
                T.StructField("include_shipping_handling", T.BooleanType()),
            ])),
            T.StructField("fallback_lead_time_days", T.LongType()),
        ])),
    ])),
    T.StructField("output", T.StructType([
        T.StructField("format", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
    ])),
    T.StructField("error_policy", T.StructType([
        T.StructField("max_invalid_rows", T.LongType()),
        T.StructField("max_invalid_row_pct", T.DoubleType()),
        T.StructField("fail_on_missing_required_columns", T.BooleanType()),
        T.StructField("missing_required_vendor_policy", T.StringType()),
    ])),
])

# Flattened per-tenant rules: one row per tenant (what pricing/merge/gates
# read as columns).
RULE_COLUMNS = [
    "tenant_id",
    "base_margin_pct",
    "min_price",
    "shipping_handling_flat",
    "map_enforce",
    "map_floor_behavior",
    "rounding_increment",
    "include_shipping_handling",
    "fallback_lead_time_days",
    "max_invalid_rows",
    "max_invalid_row_pct",
    "fail_on_missing_required_columns",
    "missing_required_vendor_policy",
    "output_columns",
]
