"""SKU mapping tables: cleaning, lookup join and missing-map check
(S4/M6, J1, J3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmerge import schema as S
from feedmerge.functions.text import strip_ws
from feedmerge.operators.quality import vendor_entry

MAP_KEYS = ("tenant_id", "vendor_id")


def clean_sku_map(raw: DataFrame, order: str = "row_number") -> DataFrame:
    """Strip both codes, drop rows where either is blank, and keep the last
    row (by ``order``) per vendor code.

    ``raw``: tenant_id, vendor_id, vendor_sku, sku, <order>.  The dedup is a
    hash aggregate with a partial (map-side) step, so a code repeated in a
    third of the rows is collapsed before the shuffle.
    """
    stripped = raw.select(
        *MAP_KEYS,
        strip_ws(F.coalesce(F.col("vendor_sku"), F.lit(""))).alias("vendor_sku"),
        strip_ws(F.coalesce(F.col("sku"), F.lit(""))).alias("sku"),
        F.col(order).alias("_order"),
    ).where((F.col("vendor_sku") != "") & (F.col("sku") != ""))
    return stripped.groupBy(*MAP_KEYS, "vendor_sku").agg(F.max_by("sku", "_order").alias("sku"))


def apply_sku_map(records: DataFrame, sku_map: DataFrame) -> DataFrame:
    """Rewrite ``sku`` through the vendor's map (exact, case-sensitive match
    on the record's stripped sku); unmatched records keep their sku.

    A left join on (tenant, vendor, code): the map is broadcast when AQE
    measures it small, otherwise both sides shuffle on the key (skewed keys
    are split by AQE's skew-join handling).
    """
    m = sku_map.select(*MAP_KEYS, F.col("vendor_sku").alias("_code"), F.col("sku").alias("_mapped"))
    joined = records.join(
        m,
        (records["tenant_id"] == m["tenant_id"]) & (records["vendor_id"] == m["vendor_id"])
        & (records["sku"] == m["_code"]),
        "left",
    ).drop(m["tenant_id"]).drop(m["vendor_id"])
    return joined.withColumn("sku", F.coalesce(F.col("_mapped"), F.col("sku"))).drop("_code", "_mapped")


def missing_sku_maps(vendors: DataFrame, received: DataFrame | None) -> DataFrame:
    """Vendors configured with a map whose map input is absent: one error
    entry each (row 0, "missing sku map"); their records stay unmapped.
    ``received``: the vendors with a map file (None: there is no map at all)."""
    configured = vendors.where(F.col("has_sku_map"))
    if received is not None:
        configured = configured.join(received.select(*MAP_KEYS).distinct(), list(MAP_KEYS), "left_anti")
    return configured.select(
        "tenant_id", "vendor_id", F.lit(0).cast("bigint").alias("row_number"),
        F.lit(S.REASON_MISSING_SKU_MAP).alias("reason"), vendor_entry().alias("row_data"))
