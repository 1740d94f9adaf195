"""The market pipelines as registered queries. Bronze texts are made from ``orders`` by expressions that Spark and DuckDB read alike;
what follows runs through the silver plans and the table layer, and its SQL is written from the contract."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.functions.slots import Window
from amberline.operators import rows
from amberline.operators.tables import Lake, TableSpec, stamp
from amberline.plans import declared, silver
from amberline.plans.inputs import load
from amberline.plans.registry import query, text
from amberline.sources import reports

K, C = "o_orderkey", "o_custkey"


def string(x: str) -> str:
    return f"CAST({x} AS STRING)"


def made(spark: SparkSession, d: str, columns: dict[str, str], where: str = "true") -> DataFrame:
    return load(spark, d, "orders").filter(where).selectExpr(*[f"{x} AS {c}" for c, x in columns.items()])


def made_sql(columns: dict[str, str], where: str = "true") -> str:
    return "SELECT " + ", ".join(f"{x} AS {c}" for c, x in columns.items()) + f" FROM orders WHERE {where}"


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see; below a machine's own only on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="amberline-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


NEWEST = {"ingestion_time": K, "execution_id": f"lpad({string(K)}, 12, '0')"}

# ---- spot prices ------------------------------------------------------------------------------------------------

SPOT = {
    "delivery_date": f"CASE WHEN {K} % 29 = 0 THEN 'unknown' WHEN {K} % 2 = 0 THEN concat('2024/4/', {string(f'1 + {C} % 30')}) ELSE concat('2024-4-', {string(f'1 + {C} % 30')}) END",
    "time_code": f"CASE WHEN {K} % 41 = 0 THEN 'x' ELSE {string(f'{K} % 50')} END",
    **{c: f"CASE WHEN {K} % {13 + i} = 0 THEN '' ELSE concat({string(f'1 + {K} % 9')}, ',', lpad({string(f'({K} * {7 + i}) % 1000')}, 3, '0')) END" for i, c in enumerate((*silver.VOLUMES, *silver.BLOCKS))},
    "system_price": f"concat({string(f'{K} % 60 - 2')}, '.', lpad({string(f'{C} % 100')}, 2, '0'))",
    **{c: f"CASE WHEN {K} % {17 + i} = 0 THEN '-' ELSE concat({string(f'{K} % {50 + i} - 1')}, '.', lpad({string(f'{C} % 100')}, 2, '0')) END" for i, c in enumerate(silver.AREA_PRICES)},
    **NEWEST,
}


def _long(c: str) -> str:
    return f"TRY_CAST(replace({c}, ',', '') AS BIGINT) AS {c}"


def _price(c: str) -> str:
    return f"TRY_CAST({c} AS DECIMAL(32,3)) AS {c}"


_DAY = "CAST(coalesce(try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%Y/%m/%d')) AS DATE)"
_SPOT = f"""WITH b AS ({made_sql(SPOT)}), t AS (SELECT {_DAY.format("delivery_date")} AS delivery_date, TRY_CAST(time_code AS INTEGER) AS time_code,
  {", ".join(map(_long, (*silver.VOLUMES, *silver.BLOCKS)))}, {", ".join(map(_price, ("system_price", *silver.AREA_PRICES)))}, ingestion_time, execution_id FROM b),
s AS (SELECT * EXCLUDE (ingestion_time, execution_id), delivery_date + (time_code - 1) * INTERVAL 30 MINUTE - INTERVAL 9 HOUR AS began,
  concat_ws(',', CASE WHEN delivery_date IS NULL THEN 'delivery_date_null' END, CASE WHEN time_code IS NULL THEN 'time_code_null' END,
    CASE WHEN time_code < 1 OR time_code > 48 THEN 'time_code_out_of_range' END, CASE WHEN system_price < 0 THEN 'system_price_negative' END,
    CASE WHEN {" OR ".join(f"{c} < 0" for c in silver.AREA_PRICES)} THEN 'area_price_negative' END) AS violations
  FROM t QUALIFY row_number() OVER (PARTITION BY delivery_date, time_code ORDER BY ingestion_time DESC, execution_id DESC) = 1),
v AS (SELECT *, strftime(began, '%Y-%m-%d %H:%M:%S') AS delivery_datetime FROM s WHERE violations = '') """


def _spot(spark: SparkSession, d: str, window: Window | None = None) -> DataFrame:
    return silver.stage_spot(made(spark, d, SPOT), window)


def _told(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({c: text(F.col(c)) for c in times or ("delivery_datetime",)})


@query(_SPOT + f"SELECT delivery_date, time_code, {', '.join((*silver.VOLUMES, *silver.BLOCKS))}, system_price, {', '.join(silver.AREA_PRICES)}, violations FROM s")
def spot_staging(spark, d):
    return _spot(spark, d).drop("delivery_datetime", "ingestion_time", "execution_id").withColumn("violations", F.concat_ws(",", "violations"))


@query(_SPOT + "SELECT violation, count(*) AS rows FROM (SELECT unnest(string_split(violations, ',')) AS violation FROM s WHERE violations <> '') GROUP BY 1")
def spot_violations(spark, d):
    return rows.violation_summary(_spot(spark, d))


@query(_SPOT + f"SELECT delivery_date, time_code, delivery_datetime, {', '.join(silver.VOLUMES)}, system_price FROM v")
def spot_base_extract(spark, d):
    return _told(silver.spot_base(_spot(spark, d)))


@query(_SPOT + f"SELECT delivery_date, time_code, delivery_datetime, {', '.join(silver.BLOCKS)} FROM v WHERE delivery_date >= DATE '2024-04-10' AND delivery_date <= DATE '2024-04-20'")
def spot_block_extract(spark, d):
    return _told(silver.spot_block(_spot(spark, d, Window.days(dt.date(2024, 4, 10), dt.date(2024, 4, 20)))))


@query(_SPOT + " UNION ALL ".join(f"SELECT delivery_date, time_code, delivery_datetime, '{a}' AS area_name, area_price_{a} AS area_price FROM v WHERE area_price_{a} IS NOT NULL" for a in silver.AREAS))
def spot_area_extract(spark, d):
    return _told(silver.spot_area(_spot(spark, d)))


# ---- generation by unit -----------------------------------------------------------------------------------------


def _slot_text(i: int | str) -> str:
    """Of slot i: nothing at all in some rows, one value in others (whose daily amounts agree), else values that differ."""
    return f"CASE WHEN {K} % 37 = 0 OR ({K} % 4 <> 1 AND ({K} + {i}) % 11 = 0) THEN NULL WHEN {K} % 4 = 1 THEN {string(f'{K} % 7')} WHEN {K} % 50 = 0 AND {i} = 9 THEN '-5' ELSE concat('1,', lpad({string(f'({K} * {i}) % 900')}, 3, '0')) END"


UNIT_IDS = {
    "power_plant_code": f"CASE WHEN {K} % 23 = 0 THEN NULL ELSE concat('P', {string(f'{C} % 20')}) END",
    "unit_name": f"CASE WHEN {K} % 3 = 0 THEN NULL ELSE concat('U', {string(f'{K} % 3')}) END",
    "target_date": f"CASE WHEN {K} % 31 = 0 THEN '' ELSE concat('2024/8/', {string(f'1 + {C} % 7')}) END",
    "area": f"concat('area ', {string(f'{C} % 9')})",
    "power_plant_name": f"concat('plant ', {string(f'{C} % 20')})",
    "power_generation_method_and_fuel_type": "'gas'",
    "updated_datetime": f"CASE WHEN {K} % 19 = 0 THEN NULL ELSE concat('2024/9/', {string(f'1 + {K} % 28')}, ' ', {string(f'{K} % 24')}, ':05:00') END",
    "daily_amount": f"CASE WHEN {K} % 4 = 1 THEN {string(f'{K} % 7 * 48')} ELSE {string(f'{K} % 90000')} END",
    **NEWEST,
}
UNITS = UNIT_IDS | {c: _slot_text(i) for i, c in enumerate(silver.UNIT_SLOTS, 1)}
_UNIT_KEPT = "power_plant_code, unit_name, target_date, area, power_plant_name, power_generation_method_and_fuel_type"
_UNITS = f"""WITH n AS (SELECT o_orderkey, row_number() OVER (PARTITION BY power_plant_code, unit_name, target_date ORDER BY updated DESC NULLS LAST, ingestion_time DESC) AS place, *
  FROM (SELECT *, try_strptime(updated_datetime, '%Y/%m/%d %H:%M:%S') AS updated FROM (SELECT o_orderkey, * FROM ({made_sql({"o_orderkey": K} | UNIT_IDS)})))),
l AS (SELECT power_plant_code, coalesce(unit_name, '') AS unit_name, CAST(try_strptime(target_date, '%Y/%m/%d') AS DATE) AS target_date, area, power_plant_name, power_generation_method_and_fuel_type, updated,
  CAST(daily_amount AS BIGINT) AS daily_amount, i, o_orderkey, TRY_CAST(replace({_slot_text("i")}, ',', '') AS BIGINT) AS generation_kwh FROM n, (SELECT CAST(unnest(range(1, 49)) AS INTEGER) AS i) WHERE place = 1),
s AS (SELECT o_orderkey, power_plant_code, unit_name, target_date, max(daily_amount) AS daily_amount, CAST(sum(generation_kwh) AS BIGINT) AS total,
  concat_ws(',', CASE WHEN target_date IS NULL THEN 'target_date_null' END, CASE WHEN power_plant_code IS NULL THEN 'power_plant_code_null' END,
    CASE WHEN min(generation_kwh) < 0 THEN 'generation_negative' END, CASE WHEN count(generation_kwh) = 0 THEN 'all_timeslots_null' END) AS violations FROM l GROUP BY 1, 2, 3, 4) """


def _units(spark: SparkSession, d: str) -> DataFrame:
    return silver.stage_units(made(spark, d, UNITS))


@query(_UNITS + "SELECT power_plant_code, unit_name, target_date, daily_amount, violations FROM s")
def unit_staging(spark, d):
    return _units(spark, d).select("power_plant_code", "unit_name", "target_date", "daily_amount", F.concat_ws(",", "violations").alias("violations"))


@query(_UNITS + f"""SELECT {_UNIT_KEPT}, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated_datetime, generation_kwh, i AS time_code,
  strftime(target_date + (i - 1) * INTERVAL 30 MINUTE - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS delivery_datetime FROM l WHERE o_orderkey IN (SELECT o_orderkey FROM s WHERE violations = '')""")
def unit_generation_long(spark, d):
    return _told(silver.unit_generation(_units(spark, d)), "delivery_datetime", "updated_datetime")


@query(_UNITS + "SELECT count(*) FILTER (WHERE total IS DISTINCT FROM daily_amount) AS mismatches, max(abs(total - daily_amount)) AS largest FROM s")
def unit_amount_mismatches(spark, d):
    return silver.amount_mismatches(_units(spark, d))


# ---- power usage reports ----------------------------------------------------------------------------------------

REPORT = {
    "target_date": f"concat('2024-', {string(f'1 + {C} % 12')}, '-', {string(f'1 + {C} % 28')})",
    "file_updated_at": f"CASE WHEN {K} % 11 = 0 THEN 'later' ELSE concat('2025/1/', {string(f'1 + {K} % 28')}, ' 00:10 UPDATE') END",
    "ingestion_time": K,
}


def _summary_text(i: int, c: str) -> str:
    if c.endswith(("_capacity", "_demand")):
        return f"CASE WHEN {K} % 7 = {i % 7} THEN '' ELSE {string(f'({K} * {i + 1}) % 5000')} END"
    return string(f"({K} + {i}) % 100") if c.endswith("_pct") else f"concat({string(f'{K} % 24')}, ':{i:02d}')"


SUMMARY = {c: _summary_text(i, c) for i, c in enumerate(reports.SUMMARY_FIELDS)}


def _cell(metric: str, i: int | str) -> str:
    """Of the i-th hour or five minutes."""
    n = list(silver.HOUR_METRICS | silver.FIVE_METRICS).index(metric) + 1
    whole = string(f"({K} * {n} + {i}) % 700")
    return f"concat({whole}, '.5')" if metric.endswith("_pct") else f"CASE WHEN ({K} + {i}) % 13 = {n} THEN NULL ELSE {whole} END"


HOURS = REPORT | {silver.hour_column(h, m): _cell(m, h) for h in range(24) for m in silver.HOUR_METRICS}
FIVES = REPORT | {silver.five_column(i, m): _cell(m, i) for i in range(288) for m in silver.FIVE_METRICS}
_REPORTS = f"""WITH n AS (SELECT *, CAST(try_strptime(target_date, '%Y-%m-%d') AS DATE) AS day, try_strptime(replace(file_updated_at, ' UPDATE', ''), '%Y/%m/%d %H:%M') - INTERVAL 9 HOUR AS updated
  FROM ({made_sql({"o_orderkey": K} | REPORT | SUMMARY)}) QUALIFY row_number() OVER (PARTITION BY target_date ORDER BY updated DESC NULLS LAST, ingestion_time DESC) = 1) """
_USED = {c: f"TRY_CAST({c} AS BIGINT)" if c.endswith(("_capacity", "_demand")) else f"CAST({c} AS DOUBLE)" if c.endswith("_pct") else c for c in reports.SUMMARY_FIELDS}


@query(_REPORTS + "SELECT day AS target_date, strftime(updated, '%Y-%m-%d %H:%M:%S') AS file_updated_at, " + ", ".join(f"{x} AS {c}" for c, x in _USED.items()) + " FROM n")
def usage_daily_summary(spark, d):
    return _told(silver.usage_summary(made(spark, d, REPORT | SUMMARY), reports.SUMMARY_FIELDS), "file_updated_at")


def _usage_sql(n: int, name: str, first: int, minutes: int, metrics: dict) -> str:
    kind = lambda m: "DOUBLE" if m.endswith("_pct") else "BIGINT"
    cells = ", ".join(f"CAST({_cell(m, 'i')} AS {kind(m)}) AS {m}" for m in metrics)
    return _REPORTS + f"""SELECT day AS target_date, CAST(i + {first} AS INTEGER) AS {name}, strftime(day + i * INTERVAL {minutes} MINUTE - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS delivery_datetime, {cells}
FROM n, (SELECT CAST(unnest(range(0, {n})) AS INTEGER) AS i) WHERE day >= DATE '2024-03-01' AND day <= DATE '2024-09-30'"""


_USAGE_DAYS = Window.days(dt.date(2024, 3, 1), dt.date(2024, 9, 30))


@query(_usage_sql(24, "hour_of_day", 0, 60, silver.HOUR_METRICS))
def usage_hours(spark, d):
    return _told(silver.usage_hourly(made(spark, d, HOURS), _USAGE_DAYS))


@query(_usage_sql(288, "slot_index", 1, 5, silver.FIVE_METRICS))
def usage_five_minute_slots(spark, d):
    return _told(silver.usage_five_minutes(made(spark, d, FIVES), _USAGE_DAYS))


# ---- supply and demand by company -------------------------------------------------------------------------------

HOURLY = {
    "target_date": f"concat('2024-0', {string(f'1 + {C} % 9')}, '-', {string(f'10 + {C} % 15')})",
    "target_time": f"concat({string(f'{K} % 24')}, ':00')",
    **{c: f"CASE WHEN {K} % 9 = {i} THEN '' ELSE concat({string(f'{K} % 800')}, '.', {string(f'{K} % 10')}) END" for i, c in enumerate(silver.CAPACITY)},
    "ingestion_time": K,
}


def _demand_sql(company: str) -> str:
    metrics = ", ".join(f"CAST(round(TRY_CAST({c} AS DECIMAL(18,6)), 0) AS BIGINT) AS {c}" for c in silver.COMPANIES[company])
    return f"""WITH n AS (SELECT *, CAST(split_part(target_time, ':', 1) AS INTEGER) AS hour_of_day, CAST(target_date AS DATE) AS day FROM ({made_sql(HOURLY)})
  QUALIFY row_number() OVER (PARTITION BY target_date, hour_of_day ORDER BY ingestion_time DESC) = 1)
SELECT day AS target_date, hour_of_day, strftime(day + hour_of_day * INTERVAL 1 HOUR - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS delivery_datetime, {metrics} FROM n"""


@query(_demand_sql("tohoku"))
def supply_demand_tohoku(spark, d):
    return _told(silver.supply_demand(made(spark, d, HOURLY), "tohoku"))


@query(_demand_sql("chugoku"))
def supply_demand_chugoku(spark, d):
    return _told(silver.supply_demand(made(spark, d, HOURLY), "chugoku"))


@query(_demand_sql("shikoku"))
def supply_demand_shikoku(spark, d):
    return _told(silver.supply_demand(made(spark, d, HOURLY), "shikoku"))


# ---- the table layer --------------------------------------------------------------------------------------------

_NARROW = TableSpec.of("silver.kept", "order_date date required key, order_key long required key", partition=("order_date", "month"))
_WIDE = TableSpec.of("silver.kept", "order_date date required key, order_key long required key, price decimal", partition=("order_date", "month"))


def _kept(spark: SparkSession, d: str, where: str) -> DataFrame:
    return load(spark, d, "orders").filter(where).select(F.to_date("o_orderdate").alias("order_date"), F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").cast("decimal(32,3)").alias("price"))


def _lake(spark: SparkSession, name: str) -> Lake:
    return Lake(spark, own_folder(spark, name))


_KEPT = "SELECT CAST(o_orderdate AS DATE) AS order_date, o_orderkey AS order_key, {} AS price FROM orders WHERE {}"


@query(_KEPT.format("CAST(NULL AS DECIMAL(32,3))", "o_orderkey % 2 = 0") + " UNION ALL " + _KEPT.format("CAST(o_totalprice AS DECIMAL(32,3))", "o_orderkey % 2 <> 0"))
def append_after_new_column(spark, d):
    """Rows are appended, the declaration gains a column, more rows are appended: the first have NULL there."""
    lake = _lake(spark, "append")
    lake.append(_NARROW, _kept(spark, d, "o_orderkey % 2 = 0"))
    lake.provision(_WIDE)
    lake.append(_WIDE, _kept(spark, d, "o_orderkey % 2 <> 0"))
    return lake.read(_WIDE)


@query(_KEPT.format("CAST(o_totalprice AS DECIMAL(32,3))", "o_orderdate >= DATE '1995-01-15' AND o_orderdate < DATE '1996-01-16'"))
def evolved_partition_window(spark, d):
    """A table without partitions gets them and is read by days."""
    lake = _lake(spark, "evolve")
    lake.append(TableSpec(_WIDE.name, _WIDE.schema, _WIDE.keys), _kept(spark, d, "true"))
    lake.evolve_partition(_WIDE)
    return lake.read(_WIDE, Window.days(dt.date(1995, 1, 15), dt.date(1996, 1, 15)))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0) AS first_rows, count(*) FILTER (WHERE o_orderkey % 3 <> 2) AS last_rows, true AS expired, true AS orphans_after_drop, true AS pinned_readable FROM orders")
def expired_versions_and_orphans(spark, d):
    """Two appends, the first pinned; all rows replaced; then old versions and their files go, pinned ones stay readable."""
    lake, name = _lake(spark, "expire"), _WIDE.name
    first = lake.append(_WIDE, _kept(spark, d, "o_orderkey % 3 = 0"))
    lake.pin(name, "month_end", first.number)
    lake.append(_WIDE, _kept(spark, d, "o_orderkey % 3 = 1"))
    both = lake.read(_WIDE)
    lake.replace_window(_WIDE, both, None)
    none, now = dt.timedelta(0), dt.datetime.now(dt.UTC) + dt.timedelta(minutes=1)
    gone = lake.expire(name, none, delete=True, now=now)
    left = lake.numbers(name)
    lake.delete_orphans(name, older_than=dt.timedelta(minutes=-1))
    found = {
        "first_rows": lake.read(name, number=first.number).count(),
        "last_rows": lake.read(_WIDE).count(),
        "expired": bool(gone) and not set(gone) & set(left),
        "orphans_after_drop": lake.orphans(name, dt.timedelta(minutes=-1)) == [],
        "pinned_readable": first.number in left,
    }
    return spark.range(1).select(*[F.lit(x).cast("bigint" if isinstance(x, int) and not isinstance(x, bool) else "boolean").alias(c) for c, x in found.items()])


@query("SELECT o_orderkey, 'new' AS status, 'orders.csv' AS source_data, 'run 1' AS execution_id, DATE '2024-05-06' AS ingestion_date, '2024-05-06 07:08:09' AS ingestion_time FROM orders")
def audit_columns(spark, d):
    now = dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.UTC)
    return _told(stamp(load(spark, d, "orders").select("o_orderkey"), "new", "run 1", "orders.csv", now), "ingestion_time")


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 7) AS is_there, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = -7) AS is_not")
def filtered_existence(spark, d):
    lake = _lake(spark, "probe")
    lake.append(_WIDE, _kept(spark, d, "true"))
    return spark.range(1).select(F.lit(lake.has_rows(_WIDE, order_key=7)).alias("is_there"), F.lit(lake.has_rows(_WIDE, order_key=-7)).alias("is_not"))


_FISCAL = "delivery_date >= DATE '2024-04-01' AND delivery_date < DATE '2025-04-01'"
_AREA_ROWS = " + ".join(f"count({c})" for c in silver.AREA_PRICES)


@query(_SPOT + f"""SELECT '{declared.SPOT_BASE.name}' AS table_name, count(*) AS written FROM v WHERE {_FISCAL} UNION ALL SELECT '{declared.SPOT_BLOCK.name}', count(*) FROM v WHERE {_FISCAL}
UNION ALL SELECT '{declared.SPOT_AREA.name}', {_AREA_ROWS} FROM v WHERE {_FISCAL}""")
def silver_rows_written(spark, d):
    """Bronze texts are landed and built; of each table the rows that its committed files have."""
    from amberline.plans.steps import Workspace

    w = Workspace(spark, own_folder(spark, "silver"))
    bronze = made(spark, d, SPOT | {"k": K})
    landed = stamp(bronze.drop("ingestion_time", "execution_id"), "new", "run", "orders").withColumn("ingestion_time", F.timestamp_seconds("k")).drop("k")
    w.lake.append(declared.SPOT, landed)
    counts = w.silver_spot(2024)
    names = [declared.SPOT_BASE.name, declared.SPOT_BLOCK.name, declared.SPOT_AREA.name]
    return spark.createDataFrame([(n, counts.written[n]) for n in names], "table_name string, written bigint")


# ---- sampling ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat('0:', CAST(o_orderkey AS STRING))), o_orderkey LIMIT 500")
def seeded_sample(spark, d):
    return rows.sample(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500, seed=0)
