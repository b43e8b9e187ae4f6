"""Small builders for unit tests: canonical records and rules rows."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from feedmerge.schema import MONEY

RULES_DDL = ("tenant_id string, base_margin_pct decimal(10,6), min_price decimal(18,6), "
             "shipping_handling_flat decimal(18,6), map_enforce boolean, map_floor_behavior string, "
             "rounding_increment decimal(18,6), include_shipping_handling boolean, "
             "fallback_lead_time_days bigint, max_invalid_rows bigint, max_invalid_row_pct double, "
             "fail_on_missing_required_columns boolean, missing_required_vendor_policy string, "
             "output_columns array<string>")


def rules(spark, *, margin="0.20", min_price="25.00", ship="9.99", enforce=True,
          behavior="max(price, map_price)", increment="0.01", include_ship=True, fallback=7,
          max_rows=0, max_pct=0.0, fail_cols=True, vendor_policy="fail", columns=None, tenant="t1"):
    row = (tenant, Decimal(margin), Decimal(min_price), Decimal(ship), enforce, behavior, Decimal(increment),
           include_ship, fallback, max_rows, max_pct, fail_cols, vendor_policy, columns or [])
    return spark.createDataFrame([row], RULES_DDL)


RECORD_DDL = ("tenant_id string, sku string, vendor_sku string, vendor_id string, quantity_available bigint, "
              "lead_time_days bigint, cost decimal(18,6), map_price decimal(18,6), price decimal(18,6), "
              "msrp decimal(18,6), condition string, brand string, title string, updated_at timestamp, "
              "vendor_ordinal bigint, row_number bigint")


def records(spark, rows):
    """rows: dicts with sku, vendor_id, quantity_available, cost, ... (others default)."""
    out = []
    for i, r in enumerate(rows):
        d = lambda k: (Decimal(str(r[k])) if r.get(k) is not None else None)
        out.append((r.get("tenant_id", "t1"), r["sku"], r.get("vendor_sku"), r["vendor_id"],
                    r.get("quantity_available", 0), r.get("lead_time_days"), d("cost"), d("map_price"),
                    d("price") if r.get("price") is not None else Decimal("0"), d("msrp"), r.get("condition"),
                    r.get("brand"), r.get("title"), r.get("updated_at", datetime(2020, 1, 1)),
                    r.get("vendor_ordinal", 0), r.get("row_number", i + 2)))
    return spark.createDataFrame(out, RECORD_DDL)


def money(c):
    return F.col(c).cast(MONEY)
