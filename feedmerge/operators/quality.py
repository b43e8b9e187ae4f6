"""Run quality: vendor-level errors, missing vendors, counts, summaries and
the error-threshold gate (P3, P11, P12, M3-M5, R8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def vendor_entry(vendor_col="vendor_id"):
    """``row_data`` of a vendor-level error: ``{"vendor": <id>}``."""
    return F.create_map(F.lit("vendor"), F.col(vendor_col))


def vendor_errors(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Missing-columns entries for tenants whose policy does not fail the run
    (row 0; the vendor contributes no records)."""
    lenient = rules.where(~F.col("fail_on_missing_required_columns")).select("tenant_id")
    return (
        files.where(F.col("missing_columns").isNotNull())
        .join(lenient, "tenant_id", "left_semi")
        .select("tenant_id", "vendor_id", F.lit(0).cast("bigint").alias("row_number"),
                F.col("missing_columns").alias("reason"), vendor_entry().alias("row_data"))
    )
