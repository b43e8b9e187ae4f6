"""Tenant configuration documents (S5) as tables.

Documents (JSON; YAML is converted upstream) are read with a declared
schema -- never inferred -- and flattened into two tables the plans join:
``rules`` (one row per tenant) and ``vendors`` (one row per tenant and
vendor, ``vendor_ordinal`` = position in the document).  Defaults of the
reference's config model are applied with ``coalesce``.  Only
``schema_version`` 1 is accepted (``version_ok``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmerge.schema import MAP_FLOOR_MAX, MONEY, SUPPORTED_SCHEMA_VERSIONS, TENANT_CONFIG


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(TENANT_CONFIG).option("multiLine", False).json(path)
    version = F.coalesce(F.col("schema_version"), F.lit(1))
    return docs.withColumn("schema_version", version).withColumn(
        "version_ok", version.isin(*SUPPORTED_SCHEMA_VERSIONS))


def rules_from_configs(configs: DataFrame) -> DataFrame:
    """One rules row per tenant (schema.RULE_COLUMNS)."""
    p, m, e = F.col("pricing"), F.col("merge"), F.col("error_policy")
    return configs.select(
        "tenant_id",
        p["base_margin_pct"].cast("decimal(10,6)").alias("base_margin_pct"),
        p["min_price"].cast(MONEY).alias("min_price"),
        p["shipping_handling_flat"].cast(MONEY).alias("shipping_handling_flat"),
        F.coalesce(p["map_policy"]["enforce"], F.lit(True)).alias("map_enforce"),
        F.coalesce(p["map_policy"]["map_floor_behavior"], F.lit(MAP_FLOOR_MAX)).alias("map_floor_behavior"),
        F.coalesce(p["rounding"]["increment"], F.lit("0.01")).cast(MONEY).alias("rounding_increment"),
        F.coalesce(m["best_offer"]["landed_cost"]["include_shipping_handling"], F.lit(True))
        .alias("include_shipping_handling"),
        F.coalesce(m["best_offer"]["fallback_lead_time_days"], F.lit(7)).cast("bigint")
        .alias("fallback_lead_time_days"),
        F.coalesce(e["max_invalid_rows"], F.lit(0)).cast("bigint").alias("max_invalid_rows"),
        F.coalesce(e["max_invalid_row_pct"], F.lit(0.0)).cast("double").alias("max_invalid_row_pct"),
        F.coalesce(e["fail_on_missing_required_columns"], F.lit(True)).alias("fail_on_missing_required_columns"),
        F.coalesce(e["missing_required_vendor_policy"], F.lit("fail")).alias("missing_required_vendor_policy"),
        F.coalesce(F.col("output.columns"), F.array().cast("array<string>")).alias("output_columns"),
        ((m["strategy"] == "best_offer") & m["best_offer"].isNotNull()).alias("merge_ok"),
    )


def vendors_from_configs(configs: DataFrame) -> DataFrame:
    """One row per configured vendor, in document order."""
    v = configs.select("tenant_id", F.posexplode("vendors").alias("vendor_ordinal", "v"))
    return v.select(
        "tenant_id",
        F.col("v.vendor_id").alias("vendor_id"),
        F.col("vendor_ordinal").cast("bigint").alias("vendor_ordinal"),
        F.coalesce(F.col("v.required"), F.lit(True)).alias("required"),
        F.col("v.inbound.s3_prefix").alias("s3_prefix"),
        F.coalesce(F.col("v.parser.delimiter"), F.lit(",")).alias("delimiter"),
        F.coalesce(F.col("v.parser.encoding"), F.lit("utf-8")).alias("encoding"),
        F.coalesce(F.col("v.parser.column_map"), F.create_map().cast("map<string,string>")).alias("column_map"),
        F.col("v.sku_map.s3_key").isNotNull().alias("has_sku_map"),
        F.col("v.sku_map.s3_key").alias("sku_map_key"),
        F.lit(None).cast("string").alias("default_condition"),
    )
