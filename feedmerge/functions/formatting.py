"""Sink formatting: money to cents (half-even), timestamps to ISO-8601 UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedmerge.schema import MONEY_OUT, STAGES


def format_decimal(c: Column) -> Column:
    """Quantize to 0.01 with banker's rounding (the default decimal context).

    A plain cast to decimal(18,2) would round half-up, so ``bround`` is used.
    """
    return F.bround(c, 2).cast(MONEY_OUT)


def format_money_string(c: Column) -> Column:
    return format_decimal(c).cast("string")


def format_datetime(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``, with ``.ffffff`` only for a non-zero fraction.

    Timestamps are rendered in UTC (session time zone UTC).
    """
    ts = ts.cast("timestamp")
    whole = F.unix_micros(ts) % 1_000_000 == 0
    return (
        F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )


def stage_index(stage: Column) -> Column:
    """Ordinal of a run stage (0 = QUEUE ... 5 = COMPLETE); -1 if unknown."""
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage) - 1
