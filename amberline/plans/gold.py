"""Silver prices to the three gold tables, and the queries a dashboard asks of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.functions import slots, stats
from amberline.functions.casts import PRICE
from amberline.functions.slots import Window
from amberline.operators import rows


def joined(area: DataFrame, base: DataFrame, window: Window | None = None) -> DataFrame:
    """Area prices with the system price of their slot; a slot without one drops out. The window is asked of both sides, so
    both scans are pruned."""
    if window:
        area, base = (x.filter(window.holds(F.col("delivery_date"))) for x in (area, base))
    both = area.join(base.select("delivery_date", "time_code", "system_price"), ["delivery_date", "time_code"])
    return both.withColumn("spread", (F.col("area_price") - F.col("system_price")).cast(PRICE))


def price_stats() -> list[Column]:
    p = F.col("area_price")
    return [
        stats.mean(p).alias("avg_price"),
        stats.quantile(p, 0.5).alias("median_price"),
        stats.quantile(p, 0.05).alias("p05_price"),
        stats.quantile(p, 0.95).alias("p95_price"),
        stats.mean(F.col("system_price")).alias("avg_system_price"),
        stats.mean(F.col("spread")).alias("avg_spread"),
    ]


def event_counts(unit: str) -> list[Column]:
    return [
        stats.count_where(stats.is_split(F.col("spread"))).alias(f"split_{unit}_count"),
        stats.count_where(stats.is_spike(F.col("area_price"))).alias(f"spike_{unit}_count"),
        stats.count_where(stats.is_floor(F.col("area_price"))).alias(f"floor_{unit}_count"),
    ]


def daily(prices: DataFrame) -> DataFrame:
    p = F.col("area_price")
    return prices.groupBy("delivery_date", "area_name").agg(
        *price_stats(),
        F.min(p).alias("min_price"),
        F.max(p).alias("max_price"),
        stats.thousandths(F.stddev_pop(p.cast("double"))).alias("stddev_price"),
        (F.max(p) - F.min(p)).cast(PRICE).alias("intraday_range"),
        F.max(F.abs("spread")).alias("max_abs_spread"),
        *event_counts("time_code"),
        F.count(F.lit(1)).cast("int").alias("time_code_count"),
    )


def day_type(day: Column, holiday: Column) -> Column:
    return F.when((F.weekday(day) >= 5) | holiday.isNotNull(), "holiday").otherwise("weekday")


def period_profile(prices: DataFrame, holidays: DataFrame) -> DataFrame:
    """holidays: at most some thirty dates for each year of the window, so they are broadcast."""
    marked = prices.join(F.broadcast(holidays), prices["delivery_date"] == holidays["holiday"], "left")
    marked = marked.withColumn("profile_month", F.trunc("delivery_date", "MM")).withColumn("day_type", day_type(F.col("delivery_date"), F.col("holiday")))
    return marked.groupBy("profile_month", "area_name", "day_type", "time_code").agg(*price_stats(), F.count(F.lit(1)).cast("int").alias("observation_count"), *event_counts("observation"))


def area_spread(prices: DataFrame) -> DataFrame:
    return prices.select("delivery_date", "time_code", "area_name", "delivery_datetime", "area_price", "system_price", "spread", stats.is_split(F.col("spread")).alias("is_split"))


def incomplete_days(of_day: DataFrame, n: int = 10) -> DataFrame:
    return of_day.filter(F.col("time_code_count") != slots.SLOTS).select("delivery_date", "area_name", "time_code_count").orderBy("delivery_date", "area_name").limit(n)


def day_range(df: DataFrame, column: str = "delivery_date") -> tuple[dt.date, dt.date] | None:
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    return None if lo is None else (lo, hi)


# ---- dashboard --------------------------------------------------------------------------------------------------


def areas(of_day: DataFrame) -> DataFrame:
    return of_day.select("area_name").distinct().orderBy("area_name")


def fiscal_years(of_day: DataFrame) -> DataFrame:
    return of_day.select(slots.fiscal_year(F.col("delivery_date")).alias("fiscal_year")).distinct().orderBy("fiscal_year")


def price_heatmap(spread: DataFrame, area: str, year: int) -> DataFrame:
    here = spread.filter((F.col("area_name") == area) & Window.fiscal(year).holds(F.col("delivery_date")))
    return here.select("delivery_date", "time_code", "area_price", "spread", "is_split").orderBy("delivery_date", "time_code")


def heatmap_wide(heatmap: DataFrame, value: str = "area_price") -> DataFrame:
    return rows.pivot_wide(heatmap, "delivery_date", "time_code", range(1, slots.SLOTS + 1), value).orderBy("delivery_date")


def split_rates(of_day: DataFrame) -> DataFrame:
    """Split slots of all slots, by fiscal year and area: sums first, then the ratio."""
    by = of_day.groupBy(slots.fiscal_year(F.col("delivery_date")).alias("fiscal_year"), "area_name")
    return by.agg(stats.ratio_of_sums(F.col("split_time_code_count"), F.col("time_code_count")).alias("split_rate_pct")).orderBy("fiscal_year", "area_name")


def intraday_profile(profile: DataFrame, area: str, kind: str, years: list[int]) -> DataFrame:
    """Mean price of each slot by fiscal year, each month weighted by its days. No years, no rows."""
    here = profile.filter((F.col("area_name") == area) & (F.col("day_type") == kind) & slots.in_fiscal_years(F.col("profile_month"), years))
    by = here.groupBy(slots.fiscal_year(F.col("profile_month")).alias("fiscal_year"), "time_code")
    return by.agg(stats.weighted_mean(F.col("avg_price"), F.col("observation_count")).alias("avg_price")).orderBy("fiscal_year", "time_code")


def heatmap_bounds(heatmap: DataFrame, value: str = "area_price") -> DataFrame:
    """99th percentile by nearest rank, to clip colours at, and the maximum."""
    v = F.col(value).cast("double")
    n = heatmap.count()
    rank = int((n - 1) * 0.99 + 0.5) if n else 0
    top = heatmap.select(v.alias("v")).orderBy(F.desc("v")).limit(max(1, n - rank))
    return top.agg(F.min("v").alias("clip"), F.max("v").alias("most"))
