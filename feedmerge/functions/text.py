"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (those for which
# str.isspace() is true), by code point:
# 0x09-0x0D, 0x1C-0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x2000-0x200A, 0x2028,
# 0x2029, 0x202F, 0x205F, 0x3000.
PY_WHITESPACE = "".join(chr(c) for c in [
    *range(0x09, 0x0E), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
])


def strip_ws(c: Column) -> Column:
    """Trim leading/trailing whitespace of every kind (tabs, newlines, NBSP).

    Spark's one-argument ``trim`` removes only blanks; the two-argument form
    with the whole whitespace set does the job without a regular expression.
    It looks both ends up in the set, so a text that has visible ASCII
    characters there, as most have, is taken as it is.
    """
    c = F.col(c) if isinstance(c, str) else c
    clean = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(clean, c).otherwise(F.trim(c, F.lit(PY_WHITESPACE)))


def basename(key: Column) -> Column:
    """Last path segment of an object key, or ``inbound`` when there is none."""
    name = F.regexp_extract(key, r"([^/]+)/*$", 1)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("inbound")).otherwise(name)
