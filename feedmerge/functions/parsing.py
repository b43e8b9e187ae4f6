"""Text-to-value conversions with per-row error messages.

Pass ``stripped`` when the caller already holds the stripped text (a column
computed once in an earlier projection keeps generated code small).

Each parser returns a :class:`Parsed` triple of Columns:

* ``value`` -- the converted value, NULL when the input is blank or bad;
* ``error`` -- the conversion error text, NULL when the input converts or
  is blank (a blank field is simply absent);
* ``invalid`` -- a model-level message for a value that converts but is not
  acceptable (non-finite decimals).  Conversion errors short-circuit a row;
  model-level messages are reported together with the validators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedmerge.functions.text import strip_ws
from feedmerge.schema import MONEY

# Python int(): optional sign, ASCII digits, single underscores between digits.
_INT_PATTERN = r"^[+-]?[0-9]+(_[0-9]+)*$"
# Python Decimal(): underscores are dropped first, then sign, digits with an
# optional point, optional exponent; or a special value.
_NONFINITE_PATTERN = r"(?i)^[+-]?(inf|infinity|s?nan[0-9]*)$"
# datetime.strptime formats %Y-%m-%d %H:%M:%S, %Y-%m-%d, %Y-%m-%dT%H:%M:%S
# (four-digit year, one- or two-digit fields, no zone, no fraction).  Spark's cast
# reads these forms, among others, and costs a fraction of a pattern's parser.
_DATETIME_PATTERN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})?$"


@dataclass(frozen=True)
class Parsed:
    value: Column
    error: Column
    invalid: Column


def _blank(raw: Column, stripped: Column) -> Column:
    return raw.isNull() | (stripped == "")


def parse_int(raw: Column, stripped: Column | None = None) -> Parsed:
    s = strip_ws(raw) if stripped is None else stripped
    # Without underscores Spark's cast accepts exactly Python's int() text
    # (sign, ASCII digits); with them, check the grouping first.
    value = (F.when(~s.contains("_"), s.try_cast("bigint"))
             .when(s.rlike(_INT_PATTERN), F.replace(s, F.lit("_"), F.lit("")).try_cast("bigint")))
    error = F.when(~_blank(raw, s) & value.isNull(), F.concat(F.lit("invalid int: "), raw))
    return Parsed(value, error, F.lit(None).cast("string"))


def parse_decimal(raw: Column, dtype=MONEY, stripped: Column | None = None) -> Parsed:
    s = F.replace(strip_ws(raw) if stripped is None else stripped, F.lit("_"), F.lit(""))
    # Spark's decimal cast reads the same finite grammar as Python's
    # Decimal() (sign, digits, point, exponent) once underscores are gone.
    value = s.try_cast(dtype)
    nonfinite = value.isNull() & s.rlike(_NONFINITE_PATTERN)
    # Out of the fixed-point range counts as unparseable (documented divergence).
    error = F.when(~_blank(raw, s) & ~nonfinite & value.isNull(),
                   F.concat(F.lit("invalid decimal: "), raw))
    invalid = F.when(nonfinite, F.lit("Input should be a finite number"))
    return Parsed(value, error, invalid)


def parse_datetime(raw: Column, stripped: Column | None = None) -> Parsed:
    s = strip_ws(raw) if stripped is None else stripped
    value = F.when(s.rlike(_DATETIME_PATTERN), s.try_cast("timestamp"))
    error = F.when(~_blank(raw, s) & value.isNull(),
                   F.concat(F.lit("invalid datetime: "), raw))
    return Parsed(value, error, F.lit(None).cast("string"))
