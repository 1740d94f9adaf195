"""Declared tables: bronze all text as the source has it, silver and gold typed."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

from amberline.operators.tables import TableSpec, audit_fields
from amberline.plans import silver
from amberline.sources import reports


def bronze(name: str, columns: dict[str, str], keys: tuple[str, ...] = ()) -> TableSpec:
    """columns: name by the header in the source."""
    fields = [StructField(c, StringType(), c not in keys, {"field_id": i}) for i, c in enumerate(columns.values(), 1)]
    return TableSpec(f"bronze.{name}", StructType(fields + audit_fields()), keys, None, dict(columns))


def typed(name: str, columns: str, partition: tuple[str, str] | None = None) -> TableSpec:
    return TableSpec.of(name, columns, partition, audit=True)


# Headers of the spot price files.
SPOT_AREAS = {"北海道": "hokkaido", "東北": "tohoku", "東京": "tokyo", "中部": "chubu", "北陸": "hokuriku", "関西": "kansai", "中国": "chugoku", "四国": "shikoku", "九州": "kyushu"}
SPOT_COLUMNS = {
    "受渡日": "delivery_date",
    "時刻コード": "time_code",
    "売り入札量(kWh)": "selling_bid_volume",
    "買い入札量(kWh)": "purchase_bid_volume",
    "約定総量(kWh)": "contracted_volume",
    "システムプライス(円/kWh)": "system_price",
    **{f"エリアプライス{k}(円/kWh)": f"area_price_{v}" for k, v in SPOT_AREAS.items()},
    "売りブロック入札総量(kWh)": "block_selling_bid_volume",
    "売りブロック約定総量(kWh)": "block_selling_contracted_volume",
    "買いブロック入札総量(kWh)": "block_purchase_bid_volume",
    "買いブロック約定総量(kWh)": "block_purchase_contracted_volume",
}
# Headers of the unit generation files.
UNIT_COLUMNS = {
    "発電所コード": "power_plant_code",
    "エリア": "area",
    "発電所名": "power_plant_name",
    "ユニット名": "unit_name",
    "発電方式・燃種": "power_generation_method_and_fuel_type",
    "対象日": "target_date",
    **{f"{c[9:11]}:{c[12:14]}[kWh]": c for c in silver.UNIT_SLOTS},
    "日量[kWh]": "daily_amount",
    "更新日時": "updated_datetime",
}

SPOT = bronze("jepx_spot_price", SPOT_COLUMNS, ("delivery_date", "time_code"))
UNITS = bronze("occto_unit_generation_actuals", UNIT_COLUMNS)
USAGE_SUMMARY = bronze("power_usage_hokuriku_daily_summary", {c: c for c in (*reports.KEYS, *reports.SUMMARY_FIELDS)}, reports.KEYS)
USAGE_HOURLY = bronze("power_usage_hokuriku_hourly", {c: c for c in (*reports.KEYS, *(silver.hour_column(h, m) for h in range(24) for m in silver.HOUR_METRICS))}, reports.KEYS)
USAGE_FIVE = bronze("power_usage_hokuriku_interval5", {c: c for c in (*reports.KEYS, *(silver.five_column(i, m) for i in range(288) for m in silver.FIVE_METRICS))}, reports.KEYS)
DEMANDS = {c: bronze(f"supply_demand_actuals_{c}", {"DATE": "target_date", "TIME": "target_time"} | {m: m for m in metrics}, ("target_date", "target_time")) for c, metrics in silver.COMPANIES.items()}

_SLOT = "delivery_date date required key, time_code int required key, delivery_datetime timestamptz required"
SPOT_BASE = typed("silver.jepx_spot_price_base", f"{_SLOT}, " + ", ".join(f"{c} long" for c in silver.VOLUMES) + ", system_price decimal", ("delivery_date", "year"))
SPOT_BLOCK = typed("silver.jepx_spot_price_block", f"{_SLOT}, " + ", ".join(f"{c} long" for c in silver.BLOCKS), ("delivery_date", "year"))
SPOT_AREA = typed("silver.jepx_spot_price_area", f"{_SLOT}, area_name string required key, area_price decimal", ("delivery_date", "year"))
UNIT_GENERATION = typed(
    "silver.occto_unit_generation_actuals",
    "power_plant_code string required key, unit_name string required key, target_date date required key, time_code int required key, delivery_datetime timestamptz required, generation_kwh long, area string, power_plant_name string, power_generation_method_and_fuel_type string, updated_datetime timestamptz",
    ("target_date", "day"),
)


def _summary_type(c: str) -> str:
    return "long" if c.endswith(("_capacity", "_demand")) else "double" if c.endswith("_pct") else "string"


USED_SUMMARY = typed("silver.power_usage_hokuriku_daily_summary", "target_date date required key, file_updated_at timestamptz, " + ", ".join(f"{c} {_summary_type(c)}" for c in reports.SUMMARY_FIELDS), ("target_date", "year"))
USED_HOURLY = typed("silver.power_usage_hokuriku_hourly", "target_date date required key, hour_of_day int required key, delivery_datetime timestamptz required, actual_demand long, forecasted_demand long, usage_rate_pct double, supply_capacity long", ("target_date", "year"))
USED_FIVE = typed("silver.power_usage_hokuriku_interval5", "target_date date required key, slot_index int required key, delivery_datetime timestamptz required, actual_demand long, solar_generation_actual long", ("target_date", "year"))
DEMANDED = {c: typed(f"silver.supply_demand_actuals_{c}", "target_date date required key, hour_of_day int required key, delivery_datetime timestamptz required, " + ", ".join(f"{m} long" for m in metrics), ("target_date", "year")) for c, metrics in silver.COMPANIES.items()}

_STATS = "avg_price decimal, median_price decimal, p05_price decimal, p95_price decimal, avg_system_price decimal, avg_spread decimal"
GOLD_DAILY = typed("gold.jepx_spot_price_daily", f"delivery_date date required key, area_name string required key, {_STATS}, min_price decimal, max_price decimal, stddev_price decimal, intraday_range decimal, max_abs_spread decimal, split_time_code_count int required, spike_time_code_count int required, floor_time_code_count int required, time_code_count int required")
GOLD_PROFILE = typed("gold.jepx_spot_price_period_profile", f"profile_month date required key, area_name string required key, day_type string required key, time_code int required key, {_STATS}, observation_count int required, split_observation_count int required, spike_observation_count int required, floor_observation_count int required")
GOLD_SPREAD = typed("gold.jepx_spot_price_area_spread", "delivery_date date required key, time_code int required key, area_name string required key, delivery_datetime timestamptz required, area_price decimal, system_price decimal, spread decimal, is_split boolean required", ("delivery_date", "year"))
RUN_LOG = typed("metadata.pipeline_run_log", "run_id string required key, step_seq int required key, pipeline_name string required, step_name string required, step_status string required, started_at timestamptz, ended_at timestamptz, duration_seconds double, expected_row_count long, actual_row_count long, target_scope string, detail string, logged_date date required", ("logged_date", "month"))

TABLES = {t.name: t for t in (SPOT, UNITS, USAGE_SUMMARY, USAGE_HOURLY, USAGE_FIVE, *DEMANDS.values(), SPOT_BASE, SPOT_BLOCK, SPOT_AREA, UNIT_GENERATION, USED_SUMMARY, USED_HOURLY, USED_FIVE, *DEMANDED.values(), GOLD_DAILY, GOLD_PROFILE, GOLD_SPREAD, RUN_LOG)}
