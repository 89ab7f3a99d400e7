"""Instant arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def utc_month(instant: Column | str) -> Column:
    """``yyyy-MM`` of an instant in UTC."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(F.col(instant) if isinstance(instant, str) else instant) / F.lit(DAY_US)).cast("int"))
    return F.concat(F.lpad(F.year(day).cast("string"), 4, "0"), F.lit("-"), F.lpad(F.month(day).cast("string"), 2, "0"))
