"""Japanese national holidays by rule: fixed days, Mondays, equinoxes, substitutes and days between two holidays.

Covers 2003 (when the last days moved to Mondays) to 2099. One-off changes are listed as they were enacted."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Month, day, first and last year of holidays on a fixed day.
FIXED = [(1, 1, 0, 9999), (2, 11, 0, 9999), (2, 23, 2020, 9999), (4, 29, 0, 9999), (5, 3, 0, 9999), (5, 4, 2007, 9999), (5, 5, 0, 9999), (8, 11, 2016, 9999), (11, 3, 0, 9999), (11, 23, 0, 9999), (12, 23, 0, 2018)]
# Month and which Monday of it.
MONDAYS = [(1, 2), (7, 3), (9, 3), (10, 2)]
# Days enacted for single years: enthronement 2019, and the three that moved in 2020 and 2021.
ENACTED = {2019: [(5, 1), (10, 22)], 2020: [(7, 23), (7, 24), (8, 10)], 2021: [(7, 22), (7, 23), (8, 8)]}
MOVED = {2020: [(7, 3), (10, 2), (8, 11)], 2021: [(7, 3), (10, 2), (8, 11)]}


def monday(year: int, month: int, n: int) -> dt.date:
    first = dt.date(year, month, 1)
    return first + dt.timedelta(days=(7 - first.weekday()) % 7 + 7 * (n - 1))


def equinox(year: int, spring: bool) -> dt.date:
    """The usual approximation, exact for 1980 to 2099."""
    day = int((20.8431 if spring else 23.2488) + 0.242194 * (year - 1980)) - (year - 1980) // 4
    return dt.date(year, 3 if spring else 9, day)


@lru_cache(maxsize=256)
def holidays(year: int) -> frozenset[dt.date]:
    moved = MOVED.get(year, [])
    days = {dt.date(year, m, d) for m, d, lo, hi in FIXED if lo <= year <= hi and (m, d) not in moved}
    days |= {monday(year, m, n) for m, n in MONDAYS if (m, n) not in moved}
    days |= {equinox(year, True), equinox(year, False)} | {dt.date(year, m, d) for m, d in ENACTED.get(year, [])}
    one = dt.timedelta(days=1)
    extra = set()
    for d in sorted(days):
        if d.weekday() == 6:  # the next day that is none; before 2007 only the Monday
            s = d + one
            while s in days and year >= 2007:
                s += one
            if s not in days:
                extra.add(s)
        between = d + one
        if d + 2 * one in days and between not in days and between.weekday() != 6:
            extra.add(between)
    return frozenset(days | extra)


def holiday_table(spark: SparkSession, lo: dt.date, hi: dt.date) -> DataFrame:
    """holiday date: those from lo to hi, at most some 30 a year."""
    rows = [d.isoformat() for y in range(lo.year, hi.year + 1) for d in sorted(holidays(y)) if lo <= d <= hi]
    return spark.sql("SELECT CAST(d AS date) AS holiday FROM (SELECT explode(split(:days, ',')) AS d) WHERE d <> ''", args={"days": ",".join(rows)})
