"""Text to typed values: NULL where a text cannot be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(32,3)"
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d")  # M and d read padded and unpadded numbers
DATETIME_FORMAT = "yyyy/M/d H:m:s"
MINUTE_FORMAT = "yyyy/M/d H:m"


def no_thousands(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def whole(c: Column, kind: str) -> Column:
    """Whole numbers as they are; decimals rounded once, half away from zero, exponents read; ``''`` and the rest NULL. A cast
    that fails costs an exception, a hundred times a good one, so a pattern keeps such texts from it."""
    digits = F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), c.try_cast(kind))
    return F.coalesce(digits, F.when(c.rlike("[0-9]"), F.round(c.try_cast("decimal(38,18)"), 0).try_cast(kind)))


def to_long(c: Column) -> Column:
    return whole(c, "bigint")


def to_int(c: Column) -> Column:
    return whole(c, "int")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_price(c: Column) -> Column:
    return c.try_cast(PRICE)


def to_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that reads the text."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def to_timestamp(c: Column, fmt: str = DATETIME_FORMAT) -> Column:
    """Wall-clock time, kept as it is written."""
    return F.try_to_timestamp(c, F.lit(fmt))


def updated_at(c: Column, zone: str = "Asia/Tokyo") -> Column:
    """``2026/08/08 00:10 UPDATE`` as an instant."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(c, " UPDATE$", ""), F.lit(MINUTE_FORMAT)), zone)


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
