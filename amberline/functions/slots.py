"""Half-hours of a day, fiscal years (April to March) and their predicates."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Tokyo"
SLOTS = 48


def instant(day: Column, minutes: Column, zone: str = ZONE) -> Column:
    """The instant so many minutes after the local day's start. The zone has no summer time."""
    local = day.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))
    return F.to_utc_timestamp(local, zone)


def slot_instant(day: Column, time_code: Column, minutes: int = 30) -> Column:
    """Slot 1 starts with the local day; a slot is named by its start."""
    return instant(day, (time_code - 1) * minutes)


def slot_of(ts: Column, minutes: int = 30) -> Column:
    return ((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int") + 1


def slot_label(time_code: Column) -> Column:
    """1 is 00:00, 48 is 23:30."""
    return F.format_string("%02d:%02d", F.floor((time_code - 1) / 2).cast("int"), ((time_code - 1) % 2 * 30).cast("int"))


def fiscal_year(day: Column) -> Column:
    return F.year(day) - (F.month(day) < 4).cast("int")


def fiscal_year_of(day: dt.date) -> int:
    return day.year - (day.month < 4)


@dataclass(frozen=True)
class Window:
    """Days from lo to hi; hi itself is in it only if closed."""

    lo: dt.date
    hi: dt.date
    closed: bool = True

    @staticmethod
    def fiscal(year: int) -> Window:
        return Window(dt.date(year, 4, 1), dt.date(year + 1, 4, 1), closed=False)

    @staticmethod
    def days(lo: dt.date, hi: dt.date | None = None) -> Window:
        return Window(lo, hi or lo)

    @property
    def last(self) -> dt.date:
        return self.hi if self.closed else self.hi - dt.timedelta(days=1)

    def holds(self, day: Column) -> Column:
        """Ranges on the column itself reach the Parquet scan; a CASE over it would not."""
        upper = day <= F.lit(self.hi) if self.closed else day < F.lit(self.hi)
        return (day >= F.lit(self.lo)) & upper

    def years(self) -> list[int]:
        return list(range(self.lo.year, self.last.year + 1))


def in_fiscal_years(day: Column, years: list[int]) -> Column:
    """OR of ranges; false for no years."""
    out = F.lit(False)
    for y in years:
        out = out | Window.fiscal(y).holds(day)
    return out
