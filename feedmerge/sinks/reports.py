"""JSON reports of a run: error report, run summary, input manifest and
config snapshot, written per tenant (``tenant_id=<id>/``) by one job each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_entries(run) -> DataFrame:
    """errors.json entries: missing-vendor entries first (optional before
    required, config order), then engine errors (vendor-level and rows)."""
    missing = run.vendor_missing.select(
        "tenant_id", F.lit(0).alias("entry_section"),
        F.struct(F.col("required"), F.col("vendor_ordinal")).alias("_order"),
        "error_code", "error_message", "vendor_id", "expected_prefix",
        F.lit(None).cast("bigint").alias("row_number"), F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("map<string,string>").alias("row_data"))
    engine = run.errors.select(
        "tenant_id", F.lit(1).alias("entry_section"),
        F.struct(F.lit(False).alias("required"), F.lit(0).cast("bigint").alias("vendor_ordinal")).alias("_order"),
        F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"),
        "vendor_id", F.lit(None).cast("string").alias("expected_prefix"),
        F.col("row_number").cast("bigint").alias("row_number"), "reason", "row_data")
    return missing.unionByName(engine)


def write_error_report(run, path: str, gates: DataFrame) -> None:
    """JSON lines per run and tenant in report order; ``gates``: run_id,
    tenant_id, failed_stage, error_code, error_message.

    A tenant that failed before merging gets the failure form, one entry with
    ``error_code`` and ``error_message``; the others their entries.
    Range-partitioned on the report order, so a tenant with a huge number of
    rejects is written by many tasks (its part files, read in name order, are
    the report) instead of one."""
    early = F.coalesce(F.col("failed_stage").isin("FETCH_INPUTS", "NORMALIZE", "MERGE_PRICE")
                       & (F.col("error_code") != "validation_errors"), F.lit(False))
    entries = error_entries(run)
    normal = entries.join(gates.where(~early).select("run_id", "tenant_id"), "tenant_id")
    blank = [c for c in entries.columns if c not in ("tenant_id", "entry_section", "error_code", "error_message")]
    failed = gates.where(early).select(
        "tenant_id", F.lit(0).alias("entry_section"), "error_code", "error_message",
        *[F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in blank], "run_id")
    (normal.unionByName(failed).orderBy("run_id", "tenant_id", "entry_section", "_order", "vendor_id", "row_number")
     .drop("_order").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "tenant_id").json(path))


ERROR_REPORT_SCHEMA = (
    "entry_section int, error_code string, error_message string, vendor_id string, "
    "expected_prefix string, row_number bigint, reason string, row_data map<string,string>"
)


def read_error_report(spark, path: str) -> DataFrame:
    """Read error reports back with their declared schema (``row_data`` keys
    are vendor headers and may differ only by case)."""
    return spark.read.schema(ERROR_REPORT_SCHEMA).json(path)
