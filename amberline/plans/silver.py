"""Bronze texts to typed, validated, latest rows. Every function goes from DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.functions import casts, slots
from amberline.functions.slots import Window
from amberline.operators import rows

# ---- spot prices ------------------------------------------------------------------------------------------------

AREAS = ("hokkaido", "tohoku", "tokyo", "chubu", "hokuriku", "kansai", "chugoku", "shikoku", "kyushu")
VOLUMES = ("selling_bid_volume", "purchase_bid_volume", "contracted_volume")
BLOCKS = ("block_selling_bid_volume", "block_selling_contracted_volume", "block_purchase_bid_volume", "block_purchase_contracted_volume")
AREA_PRICES = tuple(f"area_price_{a}" for a in AREAS)


def spot_rules(areas: tuple[str, ...] = AREA_PRICES) -> dict[str, Column]:
    code = F.col("time_code")
    return {
        "delivery_date_null": F.col("delivery_date").isNull(),
        "time_code_null": code.isNull(),
        "time_code_out_of_range": ~code.between(1, slots.SLOTS),
        "system_price_negative": F.col("system_price") < 0,
        "area_price_negative": rows.list_min([F.col(c) for c in areas]) < 0,
    }


def stage_spot(bronze: DataFrame, window: Window | None = None) -> DataFrame:
    """Typed, in the window, latest revision of each slot, with violations and instant. The window comes first: rows whose date
    cannot be read are in none."""
    number = lambda c: casts.to_long(casts.no_thousands(F.col(c))).alias(c)
    price = lambda c: casts.to_price(casts.no_thousands(F.col(c))).alias(c)
    typed = bronze.select(
        casts.to_date(F.col("delivery_date")).alias("delivery_date"),
        casts.to_int(F.col("time_code")).alias("time_code"),
        *map(number, VOLUMES),
        price("system_price"),
        *map(price, AREA_PRICES),
        *map(number, BLOCKS),
        "ingestion_time",
        "execution_id",
    )
    if window:
        typed = typed.filter(window.holds(F.col("delivery_date")))
    newest = rows.latest(typed, ["delivery_date", "time_code"], ["ingestion_time", "execution_id"])
    return newest.withColumn("violations", rows.violation_list(spot_rules())).withColumn("delivery_datetime", slots.slot_instant(F.col("delivery_date"), F.col("time_code")))


KEY = ("delivery_date", "time_code", "delivery_datetime")


def spot_base(staged: DataFrame) -> DataFrame:
    return rows.valid(staged).select(*KEY, *VOLUMES, "system_price")


def spot_block(staged: DataFrame) -> DataFrame:
    return rows.valid(staged).select(*KEY, *BLOCKS)


def spot_area(staged: DataFrame) -> DataFrame:
    """A row for each area that has a price."""
    long = rows.unpivot(rows.valid(staged), KEY, AREA_PRICES, "_column", "area_price", keep_nulls=False)
    return long.withColumn("area_name", F.split_part("_column", F.lit("_"), F.lit(3))).drop("_column")


# ---- generation by unit -----------------------------------------------------------------------------------------

#: Named by their ends: 00:30 to 24:00.
UNIT_SLOTS = tuple(f"timeslot_{m // 60:02d}_{m % 60:02d}" for m in range(30, 24 * 60 + 1, 30))


def unit_rules() -> dict[str, Column]:
    values = [F.col(c) for c in UNIT_SLOTS]
    return {
        "target_date_null": F.col("target_date").isNull(),
        "power_plant_code_null": F.col("power_plant_code").isNull(),
        "generation_negative": rows.list_min(values) < 0,
        "all_timeslots_null": F.size(F.filter(F.array(*values), lambda x: x.isNotNull())) == 0,
    }


def stage_units(bronze: DataFrame, window: Window | None = None) -> DataFrame:
    number = lambda c: casts.to_long(casts.no_thousands(F.col(c))).alias(c)
    typed = bronze.select(
        "power_plant_code",
        casts.or_empty(F.col("unit_name")).alias("unit_name"),
        casts.to_date(F.col("target_date")).alias("target_date"),
        "area",
        "power_plant_name",
        "power_generation_method_and_fuel_type",
        casts.to_timestamp(F.col("updated_datetime")).alias("updated_datetime"),  # wall clock, kept as written
        *map(number, (*UNIT_SLOTS, "daily_amount")),
        "ingestion_time",
        "execution_id",
    )
    if window:
        typed = typed.filter(window.holds(F.col("target_date")))
    newest = rows.latest(typed, ["power_plant_code", "unit_name", "target_date"], ["updated_datetime", "ingestion_time", "execution_id"])
    return newest.withColumn("violations", rows.violation_list(unit_rules()))


def unit_generation(staged: DataFrame) -> DataFrame:
    """48 rows for each valid one, missing values included."""
    ids = ("power_plant_code", "unit_name", "target_date", "area", "power_plant_name", "power_generation_method_and_fuel_type", "updated_datetime")
    long = rows.unpivot(rows.valid(staged), ids, UNIT_SLOTS, "_column", "generation_kwh", keep_nulls=True)
    long = long.withColumn("time_code", rows.position_of("_column", UNIT_SLOTS)).drop("_column")
    return long.withColumn("delivery_datetime", slots.slot_instant(F.col("target_date"), F.col("time_code")))


def amount_mismatches(staged: DataFrame) -> DataFrame:
    """One row over all staged rows: how many daily amounts differ from the sum of their slots, and by how much at most."""
    total = rows.list_sum([F.col(c) for c in UNIT_SLOTS])
    return staged.select(total.alias("total"), "daily_amount").agg(
        F.count_if(~F.col("total").eqNullSafe(F.col("daily_amount"))).alias("mismatches"),
        F.max(F.abs(F.col("total") - F.col("daily_amount"))).alias("largest"),
    )


# ---- power usage reports ----------------------------------------------------------------------------------------

HOUR_METRICS = {"actual_demand": casts.to_long, "forecasted_demand": casts.to_long, "usage_rate_pct": casts.to_double, "supply_capacity": casts.to_long}
FIVE_METRICS = {"actual_demand": casts.to_long, "solar_generation_actual": casts.to_long}


def hour_column(hour: int, metric: str) -> str:
    return f"hourly_{hour:02d}_00_{metric}"


def five_column(slot: int, metric: str) -> str:
    """slot from 0."""
    return f"interval5_{slot // 12:02d}_{slot % 12 * 5:02d}_{metric}"


def latest_report(bronze: DataFrame, window: Window | None) -> DataFrame:
    """The newest report of each day; the window comes after, so the result differs from spot prices only for dates that
    cannot be read."""
    dated = bronze.withColumn("_day", casts.to_date(F.col("target_date"), ("yyyy-M-d",))).withColumn("_updated", casts.updated_at(F.col("file_updated_at")))
    newest = rows.latest_wide(dated, ["target_date"], ["_updated", "ingestion_time"])
    return newest.filter(window.holds(F.col("_day"))) if window else newest


def summary_cast(name: str) -> Column:
    """By the column's ending."""
    if name.endswith(("_capacity", "_demand")):
        return casts.to_long(F.col(name))
    if name.endswith("_pct"):
        return casts.to_double(F.col(name))
    if name.endswith(("_time_range", "_updated_date", "_updated_time")):
        return F.col(name)
    raise ValueError(f"no rule for the column {name}")


def usage_summary(bronze: DataFrame, fields: tuple[str, ...], window: Window | None = None) -> DataFrame:
    return latest_report(bronze, window).select(F.col("_day").alias("target_date"), F.col("_updated").alias("file_updated_at"), *[summary_cast(c).alias(c) for c in fields])


def usage_hourly(bronze: DataFrame, window: Window | None = None) -> DataFrame:
    cells = {h: {m: to(F.col(hour_column(h, m))) for m, to in HOUR_METRICS.items()} for h in range(24)}
    long = rows.unpivot_metrics(latest_report(bronze, window).filter("_day IS NOT NULL"), ["_day"], cells, "hour_of_day")
    return long.withColumnRenamed("_day", "target_date").withColumn("delivery_datetime", slots.instant(F.col("target_date"), F.col("hour_of_day") * 60))


def usage_five_minutes(bronze: DataFrame, window: Window | None = None) -> DataFrame:
    cells = {i + 1: {m: to(F.col(five_column(i, m))) for m, to in FIVE_METRICS.items()} for i in range(288)}
    long = rows.unpivot_metrics(latest_report(bronze, window).filter("_day IS NOT NULL"), ["_day"], cells, "slot_index")
    return long.withColumnRenamed("_day", "target_date").withColumn("delivery_datetime", slots.slot_instant(F.col("target_date"), F.col("slot_index"), 5))


# ---- supply and demand by company -------------------------------------------------------------------------------

DEMAND = {"actual_demand_10k_kw": casts.to_long}
CAPACITY = DEMAND | {"supply_capacity_forecast_10k_kw": casts.to_long}
COMPANIES = {"tohoku": DEMAND, "chugoku": DEMAND, "shikoku": CAPACITY}


def supply_demand(bronze: DataFrame, company: str, window: Window | None = None) -> DataFrame:
    """The newest row of each hour. An hour that is no number is an error."""
    dated = bronze.withColumn("_day", casts.to_date(F.col("target_date"), ("yyyy-M-d",))).withColumn("_hour", F.split_part("target_time", F.lit(":"), F.lit(1)).cast("int"))
    newest = rows.latest(dated, ["target_date", "_hour"], ["ingestion_time"])
    if window:
        newest = newest.filter(window.holds(F.col("_day")))
    day, hour = F.col("_day").alias("target_date"), F.col("_hour").alias("hour_of_day")
    return newest.select(day, hour, slots.instant(F.col("_day"), F.col("_hour") * 60).alias("delivery_datetime"), *[to(F.col(c)).alias(c) for c, to in COMPANIES[company].items()])
