"""Scalar functions (Column -> Column), all built-in Spark expressions."""

from feedmerge.functions.text import basename, strip_ws
from feedmerge.functions.parsing import Parsed, parse_datetime, parse_decimal, parse_int
from feedmerge.functions.money import compute_price, landed_cost, round_increment
from feedmerge.functions.formatting import (
    format_datetime,
    format_decimal,
    format_money_string,
    stage_index,
)

__all__ = [
    "Parsed",
    "basename",
    "compute_price",
    "format_datetime",
    "format_decimal",
    "format_money_string",
    "landed_cost",
    "parse_datetime",
    "parse_decimal",
    "parse_int",
    "round_increment",
    "stage_index",
    "strip_ws",
]
