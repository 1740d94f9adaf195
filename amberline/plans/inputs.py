"""Market-shaped inputs made from the test tables: ``events`` as half-hourly prices of its event types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.functions import slots, stats
from amberline.plans import gold

TYPES = ("click", "error", "purchase", "signup", "view")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.to_date("ts").alias("delivery_date"), slots.slot_of(F.col("ts")).alias("time_code"), F.col("event_type").alias("area_name"), F.col("value").cast("decimal(12,2)").alias("v"), "user_id")


def mean_price() -> Column:
    return stats.thousandths(F.sum("v").cast("double") / F.count("v"))


def area(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = slotted(spark, sf_dir).groupBy("delivery_date", "time_code", "area_name").agg(mean_price().alias("area_price"))
    return out.withColumn("delivery_datetime", slots.slot_instant(F.col("delivery_date"), F.col("time_code")))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slotted(spark, sf_dir).groupBy("delivery_date", "time_code").agg(mean_price().alias("system_price"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.joined(area(spark, sf_dir), base(spark, sf_dir))


SLOTTED = """slotted AS (SELECT CAST(ts AS DATE) AS delivery_date,
  CAST((extract(hour FROM ts) * 60 + extract(minute FROM ts)) // 30 + 1 AS INTEGER) AS time_code,
  event_type AS area_name, CAST(value AS DECIMAL(12,2)) AS v, user_id FROM events)"""
AREA = SLOTTED + """, area AS (SELECT delivery_date, time_code, area_name, CAST(CAST(sum(v) AS DOUBLE) / count(v) AS DECIMAL(32,3)) AS area_price,
  delivery_date + (time_code - 1) * INTERVAL 30 MINUTE - INTERVAL 9 HOUR AS delivery_datetime FROM slotted GROUP BY ALL)"""
BASE = "base AS (SELECT delivery_date, time_code, CAST(CAST(sum(v) AS DOUBLE) / count(v) AS DECIMAL(32,3)) AS system_price FROM slotted GROUP BY ALL)"
PRICES = f"""{AREA}, {BASE}, prices AS (SELECT area.*, system_price, CAST(area_price - system_price AS DECIMAL(32,3)) AS spread
  FROM area JOIN base USING (delivery_date, time_code))"""


def sql_mean(c: str) -> str:
    return f"CAST(avg({c}) AS DECIMAL(32,3))"


SQL_STATS = f"""{sql_mean("area_price")} AS avg_price, CAST(median(area_price) AS DECIMAL(32,3)) AS median_price,
  CAST(quantile_cont(area_price, 0.05) AS DECIMAL(32,3)) AS p05_price, CAST(quantile_cont(area_price, 0.95) AS DECIMAL(32,3)) AS p95_price,
  {sql_mean("system_price")} AS avg_system_price, {sql_mean("spread")} AS avg_spread"""


def sql_events(unit: str) -> str:
    return f"""CAST(count(*) FILTER (WHERE abs(spread) >= 0.01) AS INTEGER) AS split_{unit}_count,
  CAST(count(*) FILTER (WHERE area_price >= 50.0) AS INTEGER) AS spike_{unit}_count,
  CAST(count(*) FILTER (WHERE area_price <= 0.01) AS INTEGER) AS floor_{unit}_count"""


DAILY = f"""{PRICES}, daily AS (SELECT delivery_date, area_name, {SQL_STATS}, min(area_price) AS min_price, max(area_price) AS max_price,
  CAST(stddev_pop(CAST(area_price AS DOUBLE)) AS DECIMAL(32,3)) AS stddev_price, CAST(max(area_price) - min(area_price) AS DECIMAL(32,3)) AS intraday_range,
  max(abs(spread)) AS max_abs_spread, {sql_events("time_code")}, CAST(count(*) AS INTEGER) AS time_code_count FROM prices GROUP BY delivery_date, area_name)"""
