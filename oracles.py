"""DuckDB oracle SQL for the registered queries.

Independent restatements over the driver tables.  Money is computed in
integers (cents, or 1e-4 units after a margin), because DuckDB divides
decimals into doubles; rounding to an increment is ``(2v + inc) // (2 inc)``
(half-up for v >= 0) and cents are printed with half-even rounding, as the
Spark sinks do.
"""

from __future__ import annotations


def cents_str(c: str) -> str:
    """Print an integer number of cents (may be NULL) as ``d.dd``."""
    return (f"CASE WHEN ({c}) IS NULL THEN NULL ELSE "
            f"(CASE WHEN ({c}) < 0 THEN '-' ELSE '' END) || CAST(abs({c}) // 100 AS VARCHAR) || '.' || "
            f"lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0') END")


def units4_to_cents(u: str) -> str:
    """1e-4 units -> cents, half-even (u >= 0)."""
    return (f"(({u}) // 100 + CASE WHEN ({u}) % 100 > 50 OR (({u}) % 100 = 50 AND (({u}) // 100) % 2 = 1) "
            f"THEN 1 ELSE 0 END)")


def iso_ts(t: str) -> str:
    return (f"CASE WHEN epoch_us({t}) % 1000000 = 0 THEN strftime({t}, '%Y-%m-%dT%H:%M:%SZ') "
            f"ELSE strftime({t}, '%Y-%m-%dT%H:%M:%S.%fZ') END")


RULES_CTE = """
rules AS (
  SELECT 'T' || CAST(r_regionkey AS VARCHAR) AS tenant_id,
         CASE r_regionkey % 3 WHEN 0 THEN 15 WHEN 1 THEN 20 ELSE 25 END AS margin_pct,
         CASE WHEN r_regionkey = 3 THEN 2000000 ELSE 2500 END AS min_c,
         CASE r_regionkey WHEN 0 THEN 999 WHEN 1 THEN 799 WHEN 2 THEN 599 WHEN 3 THEN 399 ELSE 199 END AS ship_c,
         r_regionkey <> 2 AS map_enforce,
         r_regionkey <> 4 AS floor_is_max,
         CASE r_regionkey WHEN 0 THEN 99 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 0 ELSE 100 END AS inc_c,
         r_regionkey % 2 = 0 AS incl_ship,
         7 + r_regionkey AS fallback_lt,
         CASE WHEN r_regionkey = 0 THEN 0 ELSE 100000 * r_regionkey END AS max_invalid_rows,
         CASE r_regionkey WHEN 0 THEN 0.5 WHEN 1 THEN 0.4 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 ELSE 0.1 END
           AS max_invalid_row_pct,
         r_regionkey <> 1 AS fail_on_missing_cols,
         CASE WHEN r_regionkey % 2 = 1 THEN 'warn_only' ELSE 'fail' END AS vendor_policy
  FROM region)"""

OFFERS_CTE = """
li AS (
  SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS ext_c,
         CAST(round(l_tax * 100) AS BIGINT) AS tax_pct
  FROM lineitem),
offers AS (
  SELECT 'T' || CAST(l_suppkey % 5 AS VARCHAR) AS tenant_id,
         'SKU-' || CAST(l_partkey AS VARCHAR) AS sku,
         'V' || CAST(l_suppkey AS VARCHAR) AS vendor_id,
         greatest(CAST(l_quantity AS BIGINT) - 25, 0) AS quantity_available,
         CASE WHEN l_linestatus = 'O' THEN NULL ELSE CAST(l_linenumber AS BIGINT) * 2 END AS lead_time_days,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE ext_c END AS cost_c,
         CASE WHEN CAST(round(l_discount * 100) AS BIGINT) = 0 THEN NULL
              ELSE (ext_c * (100 + 5 * tax_pct) + 50) // 100 END AS map_c,
         (ext_c * (100 + tax_pct) + 50) // 100 AS price_c,
         CASE l_returnflag WHEN 'A' THEN 'new' WHEN 'R' THEN 'used' ELSE 'refurb' END AS condition,
         CAST(l_shipdate AS TIMESTAMP) AS updated_at,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM li)"""

PRICED_CTE = """
ranked AS (
  SELECT o.*, r.*,
         CASE WHEN cost_c IS NULL THEN 0 WHEN incl_ship THEN cost_c + ship_c ELSE cost_c END AS landed_c
  FROM offers o JOIN rules r USING (tenant_id)),
cand AS (
  SELECT *, greatest((cost_c + ship_c) * (100 + margin_pct), min_c * 100) AS cand_u FROM ranked),
rounded AS (
  SELECT *, CASE WHEN inc_c <= 0 THEN cand_u
                 ELSE ((2 * cand_u + inc_c * 100) // (2 * inc_c * 100)) * inc_c * 100 END AS rounded_u
  FROM cand),
priced AS (
  SELECT *, CASE WHEN cost_c IS NULL THEN price_c * 100
                 WHEN map_enforce AND floor_is_max AND map_c IS NOT NULL AND map_c * 100 > rounded_u
                   THEN map_c * 100
                 ELSE rounded_u END AS sell_u
  FROM rounded)"""

BEST_CTE = """
best AS (
  SELECT * FROM priced
  QUALIFY row_number() OVER (
    PARTITION BY tenant_id, sku
    ORDER BY CASE WHEN quantity_available > 0 THEN 1 ELSE 0 END DESC, landed_c, vendor_id,
             l_suppkey, l_orderkey, l_linenumber, l_partkey) = 1)"""


def _record_select(src: str, price_expr: str) -> str:
    return f"""
SELECT tenant_id, sku, vendor_id, quantity_available,
       coalesce(lead_time_days, fallback_lt) AS lead_time_days,
       {cents_str('cost_c')} AS cost, {cents_str('map_c')} AS map_price,
       {price_expr} AS price, condition, {iso_ts('updated_at')} AS updated_at
FROM {src}"""


_WITH = "WITH " + ",".join([RULES_CTE, OFFERS_CTE, PRICED_CTE, BEST_CTE])

ORACLES: dict[str, str] = {}

ORACLES["best_offer"] = _WITH + _record_select("best", cents_str("price_c"))

ORACLES["price_offers"] = _WITH + f"""
SELECT tenant_id, sku, vendor_id, CAST(l_orderkey AS BIGINT) AS l_orderkey,
       CAST(l_linenumber AS BIGINT) AS l_linenumber,
       {cents_str(units4_to_cents('sell_u'))} AS price
FROM priced"""

ORACLES["ordered_output"] = _WITH + _record_select(
    "best", cents_str(units4_to_cents("sell_u"))) + "\nORDER BY tenant_id, sku, vendor_id"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def cents_text(c: str) -> str:
    return f"(CAST(({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0'))"


RAW_LINES_CTE = f"""
rl0 AS (
  SELECT l.*, CAST(round(l_extendedprice * 100) AS BIGINT) AS ext_c,
         CAST(round(l_tax * 100) AS BIGINT) AS tax_pct,
         CAST(round(l_discount * 100) AS BIGINT) AS disc_pct,
         'SKU-' || CAST(l_partkey AS VARCHAR) AS sku0,
         CAST(CAST(l_quantity AS BIGINT) - 3 AS VARCHAR) AS q0,
         CAST(l_shipdate AS TIMESTAMP) AS ts0
  FROM lineitem l),
rl AS (
  SELECT 'V' || CAST(l_suppkey AS VARCHAR) AS vendor_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_orderkey % 97 = 5 THEN '' WHEN l_orderkey % 97 = 6 THEN '  ' || sku0 || chr(9) ELSE sku0 END AS f_sku,
    CASE l_orderkey % 50 WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN ' ' || q0 || chr(9)
         WHEN 4 THEN q0 || '_0' WHEN 5 THEN q0 || '.0' WHEN 6 THEN '+' || q0 ELSE q0 END AS f_qty,
    CASE l_orderkey % 70 WHEN 1 THEN 'abc' WHEN 2 THEN 'NaN' WHEN 3 THEN ''
         WHEN 4 THEN CAST(ext_c AS VARCHAR) || 'e-2' WHEN 5 THEN ' ' || {cents_text('ext_c')} || ' '
         WHEN 6 THEN '1_' || {cents_text('ext_c')} ELSE {cents_text('ext_c')} END AS f_cost,
    CASE WHEN l_orderkey % 83 = 1 THEN 'Infinity' WHEN disc_pct = 0 THEN ''
         ELSE {cents_text('(ext_c * (100 + 5 * tax_pct) + 50) // 100')} END AS f_map,
    CASE WHEN l_orderkey % 90 = 1 THEN '' WHEN l_orderkey % 90 = 2 THEN '-1.5'
         ELSE {cents_text('(ext_c * (100 + tax_pct) + 50) // 100')} END AS f_price,
    CASE WHEN l_orderkey % 60 = 7 THEN '3.5' WHEN l_linenumber % 3 = 0 THEN ''
         ELSE CAST(l_linenumber * 2 AS VARCHAR) END AS f_lead,
    CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 'New' WHEN 1 THEN ' used ' WHEN 2 THEN 'REFURB'
         WHEN 3 THEN '' WHEN 4 THEN 'new' WHEN 5 THEN 'used' WHEN 6 THEN 'refurb'
         ELSE CASE l_orderkey % 3 WHEN 0 THEN 'broken' WHEN 1 THEN ' ' ELSE 'Refurb' END END AS f_cond,
    CASE l_linenumber WHEN 1 THEN strftime(ts0, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts0, '%Y-%m-%d')
         WHEN 3 THEN strftime(ts0, '%Y-%m-%dT%H:%M:%S') WHEN 4 THEN strftime(ts0, '%Y-%-m-%-d')
         WHEN 5 THEN CASE WHEN l_orderkey % 4 = 0 THEN strftime(ts0, '%Y-%m-%dT%H:%M:%SZ')
                          ELSE strftime(ts0, '%Y-%m-%d') END
         WHEN 6 THEN ''
         ELSE CASE WHEN l_orderkey % 5 = 0 THEN strftime(ts0, '%d/%m/%Y')
                   ELSE strftime(ts0, '%Y-%-m-%-d %-H:%-M:%-S') END END AS f_upd
  FROM rl0)"""

KEYS = ("CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
        "CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey")


def int_value(raw: str) -> str:
    s = strip_sql(raw)
    return (f"CASE WHEN regexp_full_match({s}, '[+-]?[0-9]+(_[0-9]+)*') "
            f"THEN try_cast(replace({s}, '_', '') AS BIGINT) END")


def int_error(raw: str) -> str:
    return (f"CASE WHEN {raw} IS NOT NULL AND {strip_sql(raw)} <> '' AND ({int_value(raw)}) IS NULL "
            f"THEN 'invalid int: ' || {raw} END")


def _dec_t(raw: str) -> str:
    return f"replace({strip_sql(raw)}, '_', '')"


def dec_value(raw: str) -> str:
    t = _dec_t(raw)
    return (f"CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN try_cast({t} AS DECIMAL(18,6)) END")


def dec_nonfinite(raw: str) -> str:
    return f"regexp_full_match(lower({_dec_t(raw)}), '[+-]?(inf|infinity|s?nan[0-9]*)')"


def dec_error(raw: str) -> str:
    return (f"CASE WHEN {raw} IS NOT NULL AND {_dec_t(raw)} <> '' AND NOT {dec_nonfinite(raw)} "
            f"AND ({dec_value(raw)}) IS NULL THEN 'invalid decimal: ' || {raw} END")


def dec_invalid(raw: str) -> str:
    return f"CASE WHEN {dec_nonfinite(raw)} THEN 'Input should be a finite number' END"


def ts_value(raw: str) -> str:
    s = strip_sql(raw)
    return (f"coalesce(try_strptime({s}, '%Y-%m-%d %H:%M:%S'), try_strptime({s}, '%Y-%m-%d'), "
            f"try_strptime({s}, '%Y-%m-%dT%H:%M:%S'))")


def ts_error(raw: str) -> str:
    return (f"CASE WHEN {raw} IS NOT NULL AND {strip_sql(raw)} <> '' AND ({ts_value(raw)}) IS NULL "
            f"THEN 'invalid datetime: ' || {raw} END")


ORACLES["parse_int"] = f"""WITH {RAW_LINES_CTE}
SELECT {KEYS}, f_qty AS raw, {int_value('f_qty')} AS value, {int_error('f_qty')} AS error FROM rl"""

ORACLES["parse_decimal"] = f"""WITH {RAW_LINES_CTE}
SELECT {KEYS}, f_cost AS raw, {cents_str(f"CAST(({dec_value('f_cost')}) * 100 AS BIGINT)")} AS value,
       {dec_error('f_cost')} AS error, {dec_invalid('f_cost')} AS invalid FROM rl"""

ORACLES["parse_datetime"] = f"""WITH {RAW_LINES_CTE}
SELECT {KEYS}, f_upd AS raw, {iso_ts(ts_value('f_upd'))} AS value, {ts_error('f_upd')} AS error FROM rl"""

ORACLES["strip_ws"] = f"""
WITH p AS (
  SELECT CAST(p_partkey AS BIGINT) AS p_partkey,
         CASE p_partkey % 4 WHEN 0 THEN chr(9) || ' ' || p_name || ' ' || chr(10)
                            WHEN 1 THEN '  ' || p_name
                            WHEN 2 THEN p_name || chr(13) || chr(10)
                            ELSE p_name END AS raw
  FROM part)
SELECT p_partkey, raw, {strip_sql('raw')} AS stripped FROM p"""

ORACLES["landed_cost"] = _WITH + f"""
SELECT tenant_id, sku, vendor_id, CAST(l_orderkey AS BIGINT) AS l_orderkey,
       CAST(l_linenumber AS BIGINT) AS l_linenumber, {cents_str('landed_c')} AS landed_cost
FROM priced"""

ORACLES["round_increment"] = _WITH + """
SELECT tenant_id, sku, vendor_id, CAST(l_orderkey AS BIGINT) AS l_orderkey,
       CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(CASE WHEN inc_c <= 0 THEN (cost_c + ship_c) * (100 + margin_pct)
                 ELSE ((2 * (cost_c + ship_c) * (100 + margin_pct) + inc_c * 100) // (2 * inc_c * 100)) * inc_c * 100
            END AS BIGINT) AS rounded_units4
FROM priced"""

ORACLES["format_decimal"] = f"""
WITH x AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) AS amt_u
           FROM lineitem)
SELECT {KEYS}, {cents_str(units4_to_cents('amt_u'))} AS discount_amount FROM x"""

ORACLES["format_datetime"] = f"""
SELECT CAST(event_id AS BIGINT) AS event_id, {iso_ts('CAST(ts AS TIMESTAMP)')} AS ts_iso,
       {iso_ts("date_trunc('second', CAST(ts AS TIMESTAMP))")} AS ts_sec_iso
FROM events"""


# ---------------------------------------------------------------------------
# Normalisation over the raw stand-in feeds.
# ---------------------------------------------------------------------------
VENDORS_CTE = """
vend AS (
  SELECT 'T' || CAST(s_suppkey % 5 AS VARCHAR) AS tenant_id, 'V' || CAST(s_suppkey AS VARCHAR) AS vendor_id,
         CAST(s_suppkey AS BIGINT) AS vendor_ordinal, s_suppkey % 3 AS style, s_suppkey % 23 = 0 AS misnamed,
         CASE WHEN s_suppkey % 4 = 0 THEN 'new' END AS default_condition,
         s_suppkey % 7 <> 0 AS required,
         CASE WHEN s_suppkey % 23 = 0 THEN 'missing columns: ' ||
              CASE s_suppkey % 3 WHEN 0 THEN 'quantity_available' WHEN 1 THEN 'QTY' ELSE 'Qty' END END
           AS missing_columns
  FROM supplier)"""

FIELDS_CTE = """
fv AS (
  SELECT v.tenant_id, v.vendor_ordinal, v.default_condition, v.missing_columns, v.style, r.*,
         f_sku AS r_sku, CASE WHEN misnamed THEN NULL ELSE f_qty END AS r_qty, f_cost AS r_cost,
         CASE WHEN style = 2 THEN NULL ELSE f_map END AS r_map, f_price AS r_price,
         CASE WHEN style = 2 THEN NULL ELSE f_lead END AS r_lead,
         CASE WHEN style = 2 THEN NULL ELSE f_cond END AS r_cond, f_upd AS r_upd
  FROM rl r JOIN vend v USING (vendor_id))"""

NORM_CTE = f"""
nz0 AS (
  SELECT *,
    {int_value('r_qty')} AS qty_v, {int_error('r_qty')} AS qty_e,
    {dec_value('r_cost')} AS cost_v, {dec_error('r_cost')} AS cost_e, {dec_nonfinite('r_cost')} AS cost_nf,
    {dec_value('r_map')} AS map_v, {dec_error('r_map')} AS map_e, coalesce({dec_nonfinite('r_map')}, false) AS map_nf,
    {int_value('r_lead')} AS lead_v, {int_error('r_lead')} AS lead_e,
    {dec_value('r_price')} AS price_v, {dec_error('r_price')} AS price_e, {dec_nonfinite('r_price')} AS price_nf,
    {ts_value('r_upd')} AS upd_v, {ts_error('r_upd')} AS upd_e,
    CASE WHEN coalesce(r_cond, '') = '' THEN default_condition ELSE r_cond END AS cond_in
  FROM fv WHERE missing_columns IS NULL),
nz AS (
  SELECT *,
    {strip_sql("coalesce(r_sku, '')")} AS sku,
    coalesce(qty_v, 0) AS quantity_available,
    lead_v AS lead_time_days,
    CAST(cost_v * 100 AS BIGINT) AS cost_c, CAST(map_v * 100 AS BIGINT) AS map_c,
    CAST(coalesce(price_v, 0) * 100 AS BIGINT) AS price_c,
    CASE WHEN cond_in IS NOT NULL THEN lower({strip_sql('cond_in')}) END AS condition,
    coalesce(upd_v, TIMESTAMP '2020-01-01 00:00:00') AS updated_at,
    coalesce(qty_e, cost_e, map_e, lead_e, price_e, upd_e,
      nullif(concat_ws('; ',
        CASE WHEN {strip_sql("coalesce(r_sku, '')")} = '' THEN 'sku: value is required' END,
        CASE WHEN coalesce(qty_v, 0) < 0 THEN 'quantity_available: quantity_available must be >= 0' END,
        CASE WHEN cost_nf THEN 'cost: Input should be a finite number' END,
        CASE WHEN map_nf THEN 'map_price: Input should be a finite number' END,
        CASE WHEN price_nf THEN 'price: Input should be a finite number' END,
        CASE WHEN cond_in IS NOT NULL AND lower({strip_sql('cond_in')}) NOT IN ('new', 'used', 'refurb')
             THEN 'condition: condition must be new, used, or refurb' END), '')) AS reason
  FROM nz0)"""

_NWITH = "WITH " + ",".join([RULES_CTE, RAW_LINES_CTE, VENDORS_CTE, FIELDS_CTE, NORM_CTE])

CANON_SELECT = f"""tenant_id, vendor_id, {KEYS}, sku, CAST(quantity_available AS BIGINT) AS quantity_available,
       CAST(lead_time_days AS BIGINT) AS lead_time_days, {cents_str('cost_c')} AS cost,
       {cents_str('map_c')} AS map_price, {cents_str('price_c')} AS price, condition,
       {iso_ts('updated_at')} AS updated_at"""

ORACLES["column_map"] = f"""WITH {RAW_LINES_CTE}, {VENDORS_CTE}, {FIELDS_CTE}
SELECT vendor_id, {KEYS}, r_sku AS raw_sku, r_qty AS raw_quantity_available, r_cost AS raw_cost,
       r_map AS raw_map_price, r_price AS raw_price, r_lead AS raw_lead_time_days, r_cond AS raw_condition,
       r_upd AS raw_updated_at
FROM fv"""

ORACLES["missing_columns"] = f"""WITH {VENDORS_CTE}
SELECT tenant_id, vendor_id, missing_columns FROM vend"""

ORACLES["defaults"] = _NWITH + f"""
SELECT tenant_id, vendor_id, {KEYS}, CAST(quantity_available AS BIGINT) AS quantity_available,
       {cents_str('price_c')} AS price, condition, {iso_ts('updated_at')} AS updated_at
FROM nz"""

ORACLES["validate_rows"] = _NWITH + f"""
SELECT tenant_id, vendor_id, {KEYS}, reason FROM nz"""

ORACLES["split_valid"] = _NWITH + f"""
SELECT {CANON_SELECT} FROM nz WHERE reason IS NULL"""

ORACLES["split_rejects"] = _NWITH + f"""
SELECT tenant_id, vendor_id, {KEYS}, reason, r_sku AS raw_sku,
       CAST(CASE WHEN style = 2 THEN 5 ELSE 8 END AS BIGINT) AS n_fields
FROM nz WHERE reason IS NOT NULL"""

ORACLES["union_feeds"] = _NWITH + f"""
SELECT tenant_id, vendor_id, {KEYS}, sku FROM nz WHERE reason IS NULL"""

ORACLES["all_errors"] = _NWITH + f"""
SELECT tenant_id, vendor_id, {KEYS}, CAST(NULL AS BIGINT) AS row_number, reason
FROM nz WHERE reason IS NOT NULL
UNION ALL
SELECT v.tenant_id, v.vendor_id, NULL, NULL, NULL, NULL, CAST(0 AS BIGINT), v.missing_columns
FROM vend v JOIN rules r USING (tenant_id)
WHERE v.missing_columns IS NOT NULL AND NOT r.fail_on_missing_cols"""


# ---------------------------------------------------------------------------
# SKU maps.
# ---------------------------------------------------------------------------
SKU_MAP_CTE = f"""
smr AS (
  SELECT 'T' || CAST(l_suppkey % 5 AS VARCHAR) AS tenant_id, 'V' || CAST(l_suppkey AS VARCHAR) AS vendor_id,
         CASE WHEN l_orderkey % 13 = 0 THEN ' ' || 'SKU-' || CAST(l_partkey AS VARCHAR) || ' '
              ELSE 'SKU-' || CAST(l_partkey AS VARCHAR) END AS vendor_sku,
         CASE WHEN l_orderkey % 11 = 0 THEN ''
              ELSE 'CAN-' || CAST(l_partkey // 2 AS VARCHAR) || CASE WHEN l_linenumber = 1 THEN '-A' ELSE '' END
         END AS sku,
         l_orderkey, l_linenumber, l_partkey
  FROM lineitem WHERE l_suppkey % 3 = 1 AND l_suppkey % 6 <> 4),
smc AS (
  SELECT tenant_id, vendor_id, {strip_sql('vendor_sku')} AS vendor_sku, {strip_sql('sku')} AS sku
  FROM smr
  WHERE {strip_sql('vendor_sku')} <> '' AND {strip_sql('sku')} <> ''
  QUALIFY row_number() OVER (PARTITION BY tenant_id, vendor_id, {strip_sql('vendor_sku')}
                             ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1)"""

ORACLES["sku_map_clean"] = f"WITH {SKU_MAP_CTE}\nSELECT tenant_id, vendor_id, vendor_sku, sku FROM smc"

ORACLES["sku_map_join"] = f"""WITH {SKU_MAP_CTE}
SELECT 'T' || CAST(l.l_suppkey % 5 AS VARCHAR) AS tenant_id, 'V' || CAST(l.l_suppkey AS VARCHAR) AS vendor_id,
       {KEYS.replace('CAST(l_', 'CAST(l.l_')},
       coalesce(m.sku, 'SKU-' || CAST(l.l_partkey AS VARCHAR)) AS sku
FROM lineitem l LEFT JOIN smc m
  ON m.vendor_id = 'V' || CAST(l.l_suppkey AS VARCHAR) AND m.vendor_sku = 'SKU-' || CAST(l.l_partkey AS VARCHAR)"""

ORACLES["missing_sku_map"] = """
SELECT 'T' || CAST(s_suppkey % 5 AS VARCHAR) AS tenant_id, 'V' || CAST(s_suppkey AS VARCHAR) AS vendor_id,
       CAST(0 AS BIGINT) AS row_number, 'missing sku map' AS reason
FROM supplier
WHERE s_suppkey % 3 = 1
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_suppkey % 6 <> 4)"""


# ---------------------------------------------------------------------------
# CSV sources and sinks.
# ---------------------------------------------------------------------------
ORACLES["row_number"] = """
SELECT 'V' || CAST(l_suppkey AS VARCHAR) AS vendor_id, CAST(l_orderkey // 1000000 AS BIGINT) AS bucket,
       CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(l_partkey AS BIGINT) AS l_partkey,
       CAST(row_number() OVER (PARTITION BY l_suppkey, l_orderkey // 1000000
                               ORDER BY l_orderkey, l_linenumber, l_partkey) + 1 AS BIGINT) AS row_number
FROM lineitem"""

ORACLES["bronze_copy"] = """
SELECT 'T' || CAST(l_suppkey % 5 AS VARCHAR) AS tenant_id, 'V' || CAST(l_suppkey AS VARCHAR) AS vendor_id,
       CAST(l_orderkey // 1000000 AS BIGINT) AS bucket, CAST(count(*) + 1 AS BIGINT) AS n_lines,
       true AS same_bytes
FROM lineitem GROUP BY ALL"""

ORACLES["scan_feed"] = ORACLES["split_valid"]

_ALL_COLS = ("sku,vendor_sku,vendor_id,quantity_available,lead_time_days,cost,map_price,price,msrp,"
             "condition,brand,title,updated_at")
_T2_COLS = "sku,quantity_available,price,vendor_id,updated_at"
_SELL = cents_str(units4_to_cents("sell_u"))

ORACLES["write_feed"] = _WITH + f""",
lines AS (
  SELECT tenant_id,
    CASE WHEN tenant_id = 'T2' THEN
      concat_ws(',', sku, CAST(quantity_available AS VARCHAR), {_SELL}, vendor_id, {iso_ts('updated_at')})
    ELSE concat_ws(',', sku, 'P' || CAST(l_partkey AS VARCHAR), vendor_id, CAST(quantity_available AS VARCHAR),
      CAST(coalesce(lead_time_days, fallback_lt) AS VARCHAR), coalesce({cents_str('cost_c')}, ''),
      coalesce({cents_str('map_c')}, ''), {_SELL}, '', condition, '', '', {iso_ts('updated_at')}) END AS line
  FROM best)
SELECT tenant_id, line FROM lines
UNION ALL
SELECT tenant_id, CASE WHEN tenant_id = 'T2' THEN '{_T2_COLS}' ELSE '{_ALL_COLS}' END FROM rules"""

ORACLES["roundtrip_csv"] = _WITH + f"""
SELECT tenant_id, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY sku) + 1 AS BIGINT) AS row_number,
       sku, CAST(quantity_available AS VARCHAR) AS quantity_available, {_SELL} AS price,
       {iso_ts('updated_at')} AS updated_at
FROM best"""

ORACLES["decode_guard"] = """
SELECT 'V' || CAST(s_suppkey AS VARCHAR) AS vendor_id FROM supplier WHERE s_suppkey % 11 = 0"""



# ---------------------------------------------------------------------------
# Run quality over the stand-in run.
# ---------------------------------------------------------------------------
CONFIG_CTE = """
ghosts AS (
  SELECT 'T' || CAST(n_regionkey AS VARCHAR) AS tenant_id, 'VN' || CAST(n_nationkey AS VARCHAR) AS vendor_id,
         CAST(1000000000 + n_nationkey AS BIGINT) AS vendor_ordinal, n_nationkey % 5 = 0 AS required,
         'inbound/T' || CAST(n_regionkey AS VARCHAR) || '/VN' || CAST(n_nationkey AS VARCHAR) || '/' AS s3_prefix
  FROM nation),
configured AS (
  SELECT tenant_id, vendor_id, vendor_ordinal, required,
         'inbound/' || tenant_id || '/' || vendor_id || '/' AS s3_prefix, misnamed, style
  FROM vend
  UNION ALL
  SELECT tenant_id, vendor_id, vendor_ordinal, required, s3_prefix, false, NULL FROM ghosts),
missing_entries AS (
  SELECT g.*, CASE WHEN required THEN 'required_vendor_missing:' ELSE 'optional_vendor_missing:' END || vendor_id
           AS warning
  FROM ghosts g JOIN rules r USING (tenant_id)
  WHERE NOT g.required OR r.vendor_policy = 'warn_only'),
missing_fail AS (
  SELECT g.tenant_id, 'required vendor inbound missing: ' ||
         string_agg(g.vendor_id || ' (expected prefix ' || g.s3_prefix || ')', ', ' ORDER BY g.vendor_ordinal)
           AS error_message
  FROM ghosts g JOIN rules r USING (tenant_id)
  WHERE g.required AND r.vendor_policy <> 'warn_only' GROUP BY g.tenant_id),
missing_warn AS (
  SELECT tenant_id, string_agg(warning, ';' ORDER BY required, vendor_ordinal) AS warnings, count(*) AS n_entries
  FROM missing_entries GROUP BY tenant_id)"""

RUN_CTE = f"""
valid AS (
  SELECT n.*, coalesce(m.sku, n.sku) AS mapped_sku
  FROM nz n LEFT JOIN smc m ON m.vendor_id = n.vendor_id AND m.vendor_sku = n.sku
  WHERE n.reason IS NULL),
map_missing AS (
  SELECT v.tenant_id, v.vendor_id, CAST(0 AS BIGINT) AS row_number, 'missing sku map' AS reason
  FROM vend v
  WHERE v.vendor_ordinal % 3 = 1 AND NOT v.misnamed
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = v.vendor_ordinal AND l_suppkey % 6 <> 4)),
errs AS (
  SELECT tenant_id, vendor_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS row_number, reason
  FROM nz WHERE reason IS NOT NULL
  UNION ALL
  SELECT v.tenant_id, v.vendor_id, CAST(0 AS BIGINT), v.missing_columns
  FROM vend v JOIN rules r USING (tenant_id) WHERE v.missing_columns IS NOT NULL AND NOT r.fail_on_missing_cols
  UNION ALL
  SELECT * FROM map_missing),
summary AS (
  SELECT r.tenant_id,
    CAST((SELECT count(*) FROM configured c WHERE c.tenant_id = r.tenant_id) AS BIGINT) AS vendor_count,
    CAST((SELECT count(DISTINCT mapped_sku) FROM valid v WHERE v.tenant_id = r.tenant_id) AS BIGINT)
      AS record_count,
    CAST((SELECT count(*) FROM errs e WHERE e.tenant_id = r.tenant_id) AS BIGINT) AS invalid_rows,
    CAST((SELECT count(*) FROM errs e WHERE e.tenant_id = r.tenant_id)
       + (SELECT count(*) FROM valid v WHERE v.tenant_id = r.tenant_id) AS BIGINT) AS total_rows
  FROM rules r),
col_fail AS (
  SELECT v.tenant_id, arg_min(v.missing_columns, v.vendor_ordinal) AS message
  FROM vend v JOIN rules r USING (tenant_id)
  WHERE v.missing_columns IS NOT NULL AND r.fail_on_missing_cols GROUP BY v.tenant_id),
gate AS (
  SELECT s.*, f.error_message AS fail_msg, c.message AS col_msg, coalesce(w.warnings, '') AS wm,
         coalesce(w.n_entries, 0) AS n_entries, r.max_invalid_rows, r.max_invalid_row_pct,
         s.total_rows = 0 AND coalesce(w.n_entries, 0) = 0 AS no_rows,
         s.invalid_rows > 0 AND (s.invalid_rows > r.max_invalid_rows OR
           (CASE WHEN s.total_rows > 0 THEN s.invalid_rows / s.total_rows ELSE 0.0 END) > r.max_invalid_row_pct)
           AS too_many
  FROM summary s JOIN rules r USING (tenant_id) LEFT JOIN missing_fail f USING (tenant_id)
  LEFT JOIN col_fail c USING (tenant_id) LEFT JOIN missing_warn w USING (tenant_id))"""

_RWITH = "WITH " + ",".join([RULES_CTE, RAW_LINES_CTE, VENDORS_CTE, FIELDS_CTE, NORM_CTE, SKU_MAP_CTE,
                             CONFIG_CTE, RUN_CTE])

ORACLES["missing_vendors"] = _RWITH + """
SELECT tenant_id, vendor_id, required, s3_prefix AS expected_prefix FROM ghosts"""

ORACLES["missing_vendor_policy"] = _RWITH + """
SELECT r.tenant_id, CASE WHEN f.error_message IS NOT NULL THEN 'REQUIRED_VENDOR_MISSING' END AS error_code,
       f.error_message, coalesce(w.warnings, '') AS warnings, CAST(coalesce(w.n_entries, 0) AS BIGINT) AS n_entries
FROM rules r LEFT JOIN missing_fail f USING (tenant_id) LEFT JOIN missing_warn w USING (tenant_id)"""

ORACLES["vendor_counts"] = _RWITH + """
SELECT c.tenant_id, c.vendor_id,
       CAST((SELECT count(*) FROM valid v WHERE v.vendor_id = c.vendor_id AND v.tenant_id = c.tenant_id) AS BIGINT)
         AS n_valid
FROM configured c"""

ORACLES["run_summary"] = _RWITH + "\nSELECT * FROM summary"

ORACLES["error_gate"] = _RWITH + """
SELECT tenant_id,
  CASE WHEN fail_msg IS NOT NULL OR col_msg IS NOT NULL OR no_rows OR too_many THEN 'FAILED' ELSE 'SUCCEEDED' END
    AS status,
  CASE WHEN fail_msg IS NOT NULL THEN 'FETCH_INPUTS' WHEN col_msg IS NOT NULL THEN 'NORMALIZE'
       WHEN no_rows OR too_many THEN 'MERGE_PRICE' ELSE 'COMPLETE' END AS stage,
  CASE WHEN fail_msg IS NOT NULL THEN 'REQUIRED_VENDOR_MISSING' WHEN col_msg IS NOT NULL THEN 'missing_required_columns'
       WHEN no_rows THEN 'no_rows_parsed' WHEN too_many THEN 'validation_errors' END AS error_code,
  CASE WHEN fail_msg IS NOT NULL THEN fail_msg WHEN col_msg IS NOT NULL THEN col_msg
       WHEN no_rows THEN 'no rows parsed' WHEN too_many THEN 'validation errors' END AS error_message,
  CASE WHEN fail_msg IS NOT NULL OR col_msg IS NOT NULL OR no_rows OR too_many THEN wm
       ELSE concat_ws(';', nullif(wm, ''), CASE WHEN invalid_rows > 0 THEN 'invalid_rows_within_threshold' END)
  END AS warnings
FROM gate"""

ORACLES["reject_stats"] = _RWITH + """
SELECT tenant_id, vendor_id, regexp_extract(reason, '^([^:]+)', 1) AS kind, count(*) AS n
FROM errs GROUP BY ALL"""

ORACLES["error_report"] = _RWITH + """
SELECT tenant_id, CAST(0 AS BIGINT) AS entry_section,
       CASE WHEN required THEN 'REQUIRED_VENDOR_MISSING' ELSE 'OPTIONAL_VENDOR_MISSING' END AS error_code,
       vendor_id, CAST(NULL AS BIGINT) AS row_number, CAST(NULL AS VARCHAR) AS reason
FROM missing_entries
UNION ALL
SELECT tenant_id, CAST(1 AS BIGINT), NULL, vendor_id, row_number, reason FROM errs"""


# ---------------------------------------------------------------------------
# Listings.
# ---------------------------------------------------------------------------
LISTING_CTE = """
listing AS (
  SELECT 'inbound/T' || CAST((o_custkey % 110 + 1) % 5 AS VARCHAR) || '/V' || CAST(o_custkey % 110 + 1 AS VARCHAR)
           || '/feed-' || CAST(o_orderkey AS VARCHAR) || '.csv' AS key,
         md5(CAST(o_orderkey AS VARCHAR)) AS etag, CAST(floor(o_totalprice) AS BIGINT) AS size,
         CAST(o_orderdate AS TIMESTAMP) AS last_modified
  FROM orders),
cfg AS (
  SELECT 'T' || CAST(s_suppkey % 5 AS VARCHAR) AS tenant_id, 'V' || CAST(s_suppkey AS VARCHAR) AS vendor_id,
         s_suppkey % 7 <> 0 AS required,
         'inbound/T' || CAST(s_suppkey % 5 AS VARCHAR) || '/V' || CAST(s_suppkey AS VARCHAR) || '/' AS s3_prefix
  FROM supplier
  UNION ALL
  SELECT 'T' || CAST(n_regionkey AS VARCHAR), 'VN' || CAST(n_nationkey AS VARCHAR), n_nationkey % 5 = 0,
         'inbound/T' || CAST(n_regionkey AS VARCHAR) || '/VN' || CAST(n_nationkey AS VARCHAR) || '/'
  FROM nation),
latest AS (
  SELECT c.tenant_id, c.vendor_id, l.*
  FROM cfg c JOIN listing l ON starts_with(l.key, c.s3_prefix)
  QUALIFY row_number() OVER (PARTITION BY c.tenant_id, c.vendor_id ORDER BY l.last_modified DESC, l.key) = 1)"""

ORACLES["latest_inbound"] = "WITH " + LISTING_CTE + f"""
SELECT tenant_id, vendor_id, key AS s3_key, etag, size, {iso_ts('last_modified')} AS last_modified FROM latest"""

ORACLES["input_manifest"] = "WITH " + LISTING_CTE + f"""
SELECT c.tenant_id, c.vendor_id, CASE WHEN l.key IS NOT NULL THEN 'found' ELSE 'missing' END AS status,
       c.s3_prefix, c.required, c.s3_prefix AS expected_prefix, l.key AS s3_key, l.etag, l.size,
       {iso_ts('l.last_modified')} AS last_modified,
       CASE WHEN l.key IS NOT NULL THEN 'latest_by_last_modified' END AS selection,
       CASE WHEN l.key IS NULL THEN 'no_objects_found' END AS reason
FROM cfg c LEFT JOIN latest l USING (tenant_id, vendor_id)"""


# ---------------------------------------------------------------------------
# Config versions and run ledger.
# ---------------------------------------------------------------------------
LEDGER_CTE = """
puts AS (
  SELECT 'C' || CAST(c_custkey % 50 AS VARCHAR) AS tenant_id, CAST((c_custkey // 50) % 4 + 1 AS BIGINT) AS config_version,
         c_mktsegment || '#' || CAST(c_nationkey AS VARCHAR) AS config, c_custkey AS seq
  FROM customer),
versions AS (
  SELECT tenant_id, config_version, arg_max(config, seq) AS config FROM puts GROUP BY ALL),
req AS (
  SELECT CAST(o_orderkey AS BIGINT) AS run_id, 'C' || CAST(o_custkey % 50 AS VARCHAR) AS tenant_id,
         CAST(o_orderkey % 5 + 1 AS BIGINT) AS config_version
  FROM orders),
ev AS (
  SELECT CAST(o_orderkey AS BIGINT) AS run_id, {'n': 0, 'p': 0, 's': 0} AS seq, 'QUEUED' AS status,
         'QUEUE' AS stage, CAST(NULL AS TIMESTAMP) AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at,
         CAST(NULL AS VARCHAR) AS failed_stage, CAST(NULL AS VARCHAR) AS error_code,
         CAST(NULL AS VARCHAR) AS error_message, CAST(NULL AS VARCHAR) AS errors_artifact_key,
         CAST(NULL AS VARCHAR) AS error_report_key
  FROM orders
  UNION ALL
  SELECT l_orderkey, {'n': CAST(l_linenumber AS BIGINT), 'p': l_partkey, 's': l_suppkey}, st,
         CASE l_linenumber WHEN 1 THEN 'QUEUE' WHEN 2 THEN 'FETCH_INPUTS' WHEN 3 THEN 'NORMALIZE'
              WHEN 4 THEN 'MERGE_PRICE' WHEN 5 THEN 'WRITE_OUTPUTS' WHEN 6 THEN 'COMPLETE' END,
         CASE WHEN st = 'RUNNING' AND l_linenumber <= 2 THEN ts END,
         CASE WHEN st <> 'RUNNING' THEN ts END,
         CASE WHEN st = 'FAILED' THEN CASE l_linenumber WHEN 1 THEN 'QUEUE' WHEN 2 THEN 'FETCH_INPUTS'
              WHEN 3 THEN 'NORMALIZE' WHEN 4 THEN 'MERGE_PRICE' WHEN 5 THEN 'WRITE_OUTPUTS' WHEN 6 THEN 'COMPLETE' END END,
         CASE WHEN st = 'FAILED' THEN CASE WHEN l_partkey % 2 = 0 THEN 'validation_errors' ELSE 'no_rows_parsed' END END,
         CASE WHEN st = 'FAILED' THEN 'failed at line ' || CAST(l_linenumber AS VARCHAR) END,
         CASE WHEN st = 'FAILED' THEN 'run/' || CAST(l_orderkey AS VARCHAR) || '/errors.json' END,
         CASE WHEN st = 'FAILED' THEN 'run/' || CAST(l_orderkey AS VARCHAR) || '/errors.json' END
  FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'FAILED'
                       WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'SUCCEEDED' ELSE 'RUNNING' END AS st,
               CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_linenumber AS BIGINT)) AS ts
        FROM lineitem)),
folded AS (
  SELECT run_id, arg_max(status, seq) AS status,
    max(list_position(['QUEUE','FETCH_INPUTS','NORMALIZE','MERGE_PRICE','WRITE_OUTPUTS','COMPLETE'], stage))
      FILTER (WHERE stage IS NOT NULL) AS stage_pos,
    arg_min(started_at, seq) FILTER (WHERE started_at IS NOT NULL) AS started_at,
    arg_max(finished_at, seq) FILTER (WHERE finished_at IS NOT NULL) AS finished_at,
    max(seq) FILTER (WHERE status = 'SUCCEEDED') AS cleared,
    arg_max(failed_stage, seq) FILTER (WHERE failed_stage IS NOT NULL) AS fs_v,
    max(seq) FILTER (WHERE failed_stage IS NOT NULL) AS fs_s,
    arg_max(error_code, seq) FILTER (WHERE error_code IS NOT NULL) AS ec_v,
    max(seq) FILTER (WHERE error_code IS NOT NULL) AS ec_s,
    arg_max(error_message, seq) FILTER (WHERE error_message IS NOT NULL) AS em_v,
    max(seq) FILTER (WHERE error_message IS NOT NULL) AS em_s,
    arg_max(errors_artifact_key, seq) FILTER (WHERE errors_artifact_key IS NOT NULL) AS ea_v,
    max(seq) FILTER (WHERE errors_artifact_key IS NOT NULL) AS ea_s,
    arg_max(error_report_key, seq) FILTER (WHERE error_report_key IS NOT NULL) AS er_v,
    max(seq) FILTER (WHERE error_report_key IS NOT NULL) AS er_s,
    count(*) - 1 AS n_events
  FROM ev GROUP BY run_id),
ledger AS (
  SELECT r.tenant_id, f.run_id, f.status,
    ['QUEUE','FETCH_INPUTS','NORMALIZE','MERGE_PRICE','WRITE_OUTPUTS','COMPLETE'][f.stage_pos] AS stage,
    f.started_at, f.finished_at,
    CASE WHEN cleared IS NULL OR fs_s > cleared THEN fs_v END AS failed_stage,
    CASE WHEN cleared IS NULL OR ec_s > cleared THEN ec_v END AS error_code,
    CASE WHEN cleared IS NULL OR em_s > cleared THEN em_v END AS error_message,
    CASE WHEN cleared IS NULL OR ea_s > cleared THEN ea_v END AS errors_artifact_key,
    CASE WHEN cleared IS NULL OR er_s > cleared THEN er_v END AS error_report_key,
    f.n_events
  FROM req r JOIN folded f USING (run_id))"""

_LWITH = "WITH " + LEDGER_CTE

ORACLES["latest_config"] = _LWITH + """
SELECT tenant_id, max(config_version) AS config_version, arg_max(config, config_version) AS config,
       max(config_version) + 1 AS next_version
FROM versions GROUP BY tenant_id"""

ORACLES["pinned_config"] = _LWITH + """
SELECT r.run_id, r.tenant_id, r.config_version, v.config IS NOT NULL AS config_found, v.config,
       CASE WHEN v.config IS NULL THEN 'missing_tenant_config' END AS error_code
FROM req r LEFT JOIN versions v USING (tenant_id, config_version)"""

ORACLES["run_ledger"] = _LWITH + f"""
SELECT run_id, tenant_id, status, stage, {iso_ts('started_at')} AS started_at,
       {iso_ts('finished_at')} AS finished_at, failed_stage, error_code, error_message,
       errors_artifact_key, error_report_key
FROM ledger"""

ORACLES["active_runs"] = _LWITH + """
SELECT r.run_id, r.tenant_id,
       (SELECT min(l.run_id) FROM ledger l WHERE l.tenant_id = r.tenant_id AND l.status = 'RUNNING'
          AND l.run_id <> r.run_id) IS NOT NULL AS blocked,
       (SELECT min(l.run_id) FROM ledger l WHERE l.tenant_id = r.tenant_id AND l.status = 'RUNNING'
          AND l.run_id <> r.run_id) AS active_run_id
FROM req r"""

ORACLES["run_metrics"] = _LWITH + """,
done AS (
  SELECT tenant_id, run_id, CASE WHEN status = 'SUCCEEDED' THEN 1.0 ELSE 0.0 END AS ok,
         coalesce((epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 0.0) AS duration,
         CAST(n_events AS DOUBLE) AS rows_processed
  FROM ledger WHERE status IN ('SUCCEEDED', 'FAILED'))
SELECT tenant_id, run_id, 'RunSucceeded' AS metric_name, round(ok, 3) AS value, 'Count' AS unit FROM done
UNION ALL SELECT tenant_id, run_id, 'RunFailed', round(1 - ok, 3), 'Count' FROM done
UNION ALL SELECT tenant_id, run_id, 'RunDurationSeconds', round(duration, 3), 'Seconds' FROM done
UNION ALL SELECT tenant_id, run_id, 'RowsProcessed', round(rows_processed, 3), 'Count' FROM done"""


# ---------------------------------------------------------------------------
# Alarms (hourly periods).
# ---------------------------------------------------------------------------
def _alarm_sql(source: str, stat: str, threshold: str, periods: int, dims: str) -> str:
    part = f"PARTITION BY {dims}" if dims else ""
    dsel = f"{dims}, " if dims else ""
    return f"""
WITH src AS ({source}),
per AS (
  SELECT {dsel}time_bucket(INTERVAL '1 hour', ts) AS ws, CAST({stat} AS DOUBLE) AS stat
  FROM src GROUP BY ALL),
br AS (SELECT * FROM per WHERE stat >= {threshold}),
fired AS (
  SELECT *, lag(ws, {periods - 1}) OVER ({part} ORDER BY ws) AS first_ws FROM br)
SELECT {dsel}{iso_ts('ws')} AS window_start, {iso_ts("ws + INTERVAL '1 hour'")} AS window_end,
       round(stat, 4) AS stat
FROM fired WHERE {'true' if periods == 1 else f"first_ws = ws - INTERVAL '{periods - 1} hour'"}"""


_RUN_OUTCOMES = ("SELECT 'T' || CAST(user_id % 5 AS VARCHAR) AS tenant_id, CAST(ts AS TIMESTAMP) AS ts, "
                 "CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS run_failed, value "
                 "FROM events WHERE event_type IN ('error', 'purchase')")

ORACLES["alarm_consecutive"] = (
    _alarm_sql(_RUN_OUTCOMES, "max(run_failed)", "1", 3, "tenant_id").replace(
        "round(stat, 4) AS stat",
        "round(stat, 4) AS stat, 'feedmerge-' || tenant_id || '-consecutive-failures' AS alarm"))

ORACLES["alarm_sum"] = _alarm_sql(
    "SELECT 'T' || CAST(user_id % 5 AS VARCHAR) AS tenant_id, CAST(ts AS TIMESTAMP) AS ts, value "
    "FROM events WHERE event_type = 'error'", "sum(value)", "100", 1, "tenant_id")

ORACLES["alarm_avg"] = _alarm_sql(
    "SELECT CAST(ts AS TIMESTAMP) AS ts, value FROM events WHERE event_type = 'view'",
    "avg(value)", "45", 3, "")

ORACLES["heartbeat_gap"] = f"""
WITH b AS (
  SELECT CAST(user_id AS BIGINT) AS worker_id, CAST(ts AS TIMESTAMP) AS ts,
         lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) AS prev
  FROM events WHERE event_type = 'click')
SELECT worker_id, {iso_ts('prev')} AS gap_start, {iso_ts('ts')} AS gap_end,
       round((epoch_us(ts) - epoch_us(prev)) / 1e6, 3) AS gap_seconds
FROM b WHERE prev IS NOT NULL AND epoch_us(ts) - epoch_us(prev) >= CAST(3 * 24 * 3600 AS BIGINT) * 1000000
UNION ALL
SELECT worker_id, {iso_ts('last')}, {iso_ts('until')}, round((epoch_us("until") - epoch_us(last)) / 1e6, 3)
FROM (SELECT worker_id, max(ts) AS last FROM b GROUP BY worker_id)
CROSS JOIN (SELECT max(CAST(ts AS TIMESTAMP)) AS "until" FROM events)
WHERE epoch_us("until") - epoch_us(last) >= CAST(3 * 24 * 3600 AS BIGINT) * 1000000"""

ORACLES["stream_ingest"] = ORACLES["split_valid"]

ORACLES["heartbeat_stream"] = ORACLES["heartbeat_gap"]

ORACLES["ledger_stream"] = ORACLES["run_ledger"]

_FEED_OFFERS_CTE = """
offers AS (
  SELECT tenant_id, sku, vendor_id, quantity_available, lead_time_days, cost_c, map_c, price_c, condition, updated_at,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM nz WHERE reason IS NULL)"""

ORACLES["merged_stream"] = (_NWITH + "," + ",".join([_FEED_OFFERS_CTE, PRICED_CTE, BEST_CTE])
                            + _record_select("best", cents_str(units4_to_cents("sell_u"))))

ORACLES["alarm_stream"] = (
    "SELECT tenant_id, window_start, window_end FROM (" + ORACLES["alarm_consecutive"] + ")")

ORACLES["load_config"] = """
WITH s AS (
  SELECT *, s_suppkey % 5 AS k, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) - 1 AS pos
  FROM supplier)
SELECT 'T' || CAST(k AS VARCHAR) AS tenant_id, CAST(CASE WHEN k = 4 THEN 2 ELSE 1 END AS BIGINT) AS schema_version,
       k <> 4 AS version_ok, 'V' || CAST(s_suppkey AS VARCHAR) AS vendor_id, CAST(pos AS BIGINT) AS vendor_ordinal,
       CASE WHEN s_suppkey % 2 = 0 THEN true ELSE s_suppkey % 7 <> 0 END AS required,
       'inbound/T' || CAST(k AS VARCHAR) || '/V' || CAST(s_suppkey AS VARCHAR) || '/' AS s3_prefix,
       CASE WHEN s_suppkey % 4 = 1 THEN 'latin-1' ELSE 'utf-8' END AS encoding,
       CAST(CASE WHEN s_suppkey % 3 = 1 THEN 2 ELSE 0 END AS BIGINT) AS n_mapped,
       s_suppkey % 3 = 1 AS has_sku_map,
       CASE k % 3 WHEN 0 THEN '0.15' WHEN 1 THEN '0.20' ELSE '0.25' END AS base_margin_pct,
       CASE k WHEN 0 THEN '0.99' WHEN 1 THEN '0.01' WHEN 2 THEN '0.05' WHEN 3 THEN '0.00' ELSE '1.00' END
         AS rounding_increment,
       CAST(7 AS BIGINT) AS fallback_lead_time_days, true AS merge_ok
FROM s"""

_CELLS_ALL = [("sku", "sku"), ("vendor_sku", "'P' || CAST(l_partkey AS VARCHAR)"), ("vendor_id", "vendor_id"),
              ("quantity_available", "CAST(quantity_available AS VARCHAR)"),
              ("lead_time_days", "CAST(coalesce(lead_time_days, fallback_lt) AS VARCHAR)"),
              ("cost", f"coalesce({cents_str('cost_c')}, '')"), ("map_price", f"coalesce({cents_str('map_c')}, '')"),
              ("price", _SELL), ("msrp", "''"), ("condition", "condition"), ("brand", "''"), ("title", "''"),
              ("updated_at", iso_ts("updated_at"))]
_CELLS_T2 = ["sku", "quantity_available", "price", "vendor_id", "updated_at"]
_cell_sql = dict(_CELLS_ALL)
ORACLES["project_output"] = _WITH + "\n" + "\nUNION ALL\n".join(
    [f"SELECT tenant_id, sku, CAST({i} AS BIGINT) AS position, '{c}' AS column, {e} AS value "
     f"FROM best WHERE tenant_id <> 'T2'" for i, (c, e) in enumerate(_CELLS_ALL)]
    + [f"SELECT tenant_id, sku, CAST({i} AS BIGINT), '{c}', {_cell_sql[c]} FROM best WHERE tenant_id = 'T2'"
       for i, c in enumerate(_CELLS_T2)])
