"""Every registered query of the engine and the same as DuckDB SQL. Instants are compared as text without a zone."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Order
from pyspark.sql import functions as F

from amberline.functions import casts, slots, stats
from amberline.functions.holidays import holiday_table, holidays
from amberline.functions.slots import Window
from amberline.operators import rows
from amberline.plans import gold, silver
from amberline.plans import inputs as at
from amberline.plans.inputs import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---- projections, casts, parsing --------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem WHERE l_quantity >= 45 AND l_shipdate < TIMESTAMP '1998-09-02'")
def scan_project_filter(spark, d):
    return load(spark, d, "lineitem").filter((F.col("l_quantity") >= 45) & (F.col("l_shipdate") < F.lit(dt.datetime(1998, 9, 2)).cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_orderkey % 7 WHEN 5 THEN '0.4999999' WHEN 6 THEN '-0.49999999999' WHEN 0 THEN format('{:,}', CAST(l_extendedprice * 100 AS BIGINT)) WHEN 1 THEN CAST(l_quantity AS BIGINT)::VARCHAR || '.5' WHEN 2 THEN '' WHEN 3 THEN 'abc' ELSE '1e3' END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRY_CAST(replace(s, ',', '') AS BIGINT) AS as_long, TRY_CAST(replace(s, ',', '') AS DECIMAL(32,3)) AS as_price,
  round(TRY_CAST(replace(s, ',', '') AS DOUBLE), 6) AS as_double FROM t""")
def try_cast_numeric(spark, d):
    k = F.col("l_orderkey") % 7
    s = F.when(k == 5, "0.4999999").when(k == 6, "-0.49999999999").when(k == 0, F.format_number((F.col("l_extendedprice") * 100).cast("decimal(20,0)"), 0)).when(k == 1, F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(".5"))).when(k == 2, "").when(k == 3, "abc").otherwise("1e3")
    t = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", casts.no_thousands(s).alias("s"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", casts.to_long(F.col("s")).alias("as_long"), casts.to_price(F.col("s")).alias("as_price"), F.round(casts.to_double(F.col("s")), 6).alias("as_double"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
  WHEN 2 THEN year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) ELSE 'no date' END AS s FROM orders)
SELECT o_orderkey, CAST(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y/%m/%d')) AS DATE) AS day FROM t""")
def parse_multi_format_date(spark, d):
    k, t = F.col("o_orderkey") % 4, F.col("o_orderdate")
    s = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "yyyy/MM/dd")).when(k == 2, F.date_format(t, "yyyy/M/d")).otherwise("no date")
    return load(spark, d, "orders").select("o_orderkey", casts.to_date(s).alias("day"))


@query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE strftime(o_orderdate + (o_orderkey % 1440) * INTERVAL 1 MINUTE, '%Y/%m/%d %H:%M') || ' UPDATE' END AS s FROM orders)
SELECT o_orderkey, strftime(try_strptime(regexp_replace(s, ' UPDATE$', ''), '%Y/%m/%d %H:%M') - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS updated FROM t""")
def suffix_strip_timestamp(spark, d):
    moved = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"), F.lit(0))
    s = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.concat(F.date_format(moved, "yyyy/MM/dd HH:mm"), F.lit(" UPDATE")))
    return load(spark, d, "orders").select("o_orderkey", text(casts.updated_at(s)).alias("updated"))


@query("SELECT event_id, strftime(CAST(ts AS DATE) + (extract(hour FROM ts) * 2) * INTERVAL 30 MINUTE - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS instant FROM events")
def slot_to_instant_jst(spark, d):
    return load(spark, d, "events").select("event_id", text(slots.slot_instant(F.to_date("ts"), F.hour("ts") * 2 + 1)).alias("instant"))


@query("SELECT event_id, CAST(split_part(extract(hour FROM ts) || ':00', ':', 1) AS INTEGER) AS hour_of_day FROM events")
def hour_split_part(spark, d):
    return load(spark, d, "events").select("event_id", F.split_part(F.concat(F.hour("ts").cast("string"), F.lit(":00")), F.lit(":"), F.lit(1)).cast("int").alias("hour_of_day"))


@query("SELECT DISTINCT CAST((extract(hour FROM ts) * 60 + extract(minute FROM ts)) // 30 + 1 AS INTEGER) AS time_code, printf('%02d:%02d', (extract(hour FROM ts))::INT, (extract(minute FROM ts) // 30 * 30)::INT) AS label FROM events")
def slot_label(spark, d):
    return load(spark, d, "events").select(slots.slot_of(F.col("ts")).alias("time_code")).distinct().select("time_code", slots.slot_label(F.col("time_code")).alias("label"))


@query("SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS fiscal_year FROM orders")
def fiscal_year_expr(spark, d):
    return load(spark, d, "orders").select("o_orderkey", slots.fiscal_year(F.col("o_orderdate")).alias("fiscal_year"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1997-04-01' AND o_orderdate < DATE '1998-04-01'")
def fiscal_year_scope(spark, d):
    return load(spark, d, "orders").filter(Window.fiscal(1997).holds(F.col("o_orderdate"))).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, '') AS unit_name FROM orders")
def null_to_empty_key(spark, d):
    return load(spark, d, "orders").select("o_orderkey", casts.or_empty(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))).alias("unit_name"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = $$F$$ AND o_orderpriority = $$1-URGENT$$")
def parameterised_predicate(spark, d):
    return spark.sql("SELECT o_orderkey, o_orderstatus, o_totalprice FROM {t} WHERE o_orderstatus = :status AND o_orderpriority = :priority", args={"status": "F", "priority": "1-URGENT"}, t=load(spark, d, "orders"))


# ---- latest revisions, violations, keys -------------------------------------------------------------------------

_TIES = "l_shipdate DESC NULLS LAST, l_extendedprice DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST, l_quantity DESC NULLS LAST, l_tax DESC NULLS LAST, l_discount DESC NULLS LAST"
_TIE_COLUMNS = [x.split()[0] for x in _TIES.split(", ")]


@query(f"SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_TIES}) = 1")
def dedup_latest_1key(spark, d):
    return rows.latest(load(spark, d, "lineitem"), ["l_orderkey"], _TIE_COLUMNS).select("l_orderkey", "l_partkey", "l_extendedprice")


@query(f"SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag ORDER BY {_TIES}) = 1")
def dedup_latest_3key(spark, d):
    return rows.latest(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"], _TIE_COLUMNS).select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_extendedprice")


def _flawed(spark, d):
    t = load(spark, d, "lineitem")
    price = F.when(F.col("l_orderkey") % 7 == 0, -F.col("l_extendedprice")).when(F.col("l_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("l_extendedprice"))
    t = t.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") != 3, F.to_date("l_shipdate")).alias("day"), (F.col("l_linenumber") * 10).alias("code"), price.alias("price"))
    rules = {"day_null": F.col("day").isNull(), "code_out_of_range": ~F.col("code").between(1, 48), "price_negative": F.col("price") < 0}
    return t.withColumn("violations", rows.violation_list(rules))


_FLAWED = """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 3 THEN CAST(l_shipdate AS DATE) END AS day, l_linenumber * 10 AS code,
  CASE WHEN l_orderkey % 7 = 0 THEN -l_extendedprice WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS price FROM lineitem),
v AS (SELECT *, list_filter([CASE WHEN day IS NULL THEN 'day_null' END, CASE WHEN code NOT BETWEEN 1 AND 48 THEN 'code_out_of_range' END,
  CASE WHEN price < 0 THEN 'price_negative' END], lambda x: x IS NOT NULL) AS violations FROM t)"""


@query(_FLAWED + " SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(violations, ',') AS violations FROM v")
def violations_list(spark, d):
    return _flawed(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("violations", ",").alias("violations"))


@query(_FLAWED + ", u AS (SELECT unnest(violations) AS violation FROM v) SELECT violation, count(*) AS rows FROM u GROUP BY violation")
def violations_summary(spark, d):
    return rows.violation_summary(_flawed(spark, d))


@query(_FLAWED + " SELECT count(*) AS staged, count(*) FILTER (WHERE len(violations) > 0) AS dropped FROM v")
def dropped_count(spark, d):
    return _flawed(spark, d).agg(F.count(F.lit(1)).alias("staged"), rows.dropped().alias("dropped"))


@query(_FLAWED + " SELECT l_orderkey, l_linenumber, l_partkey, price FROM v WHERE len(violations) = 0")
def valid_rows(spark, d):
    return rows.valid(_flawed(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "price")


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS surplus, count(*) AS keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1")
def unique_key_violations(spark, d):
    n = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.agg(F.sum(F.col("n") - 1).alias("surplus"), F.count(F.lit(1)).alias("keys"))


@query("SELECT count(*) FILTER (WHERE o_orderpriority IS NULL) AS priority_nulls, count(*) FILTER (WHERE nullif(o_orderstatus, 'F') IS NULL) AS status_nulls, count(*) AS n FROM orders")
def null_counts(spark, d):
    return load(spark, d, "orders").agg(F.count_if(F.col("o_orderpriority").isNull()).alias("priority_nulls"), F.count_if(F.nullif("o_orderstatus", F.lit("F")).isNull()).alias("status_nulls"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT o_orderstatus) AS one, count(DISTINCT (o_custkey, o_orderstatus)) AS two FROM orders")
def n_unique_composite(spark, d):
    return load(spark, d, "orders").agg(F.count_distinct("o_orderstatus").alias("one"), F.count_distinct(F.struct("o_custkey", "o_orderstatus")).alias("two"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT NULL")
def drop_nulls(spark, d):
    return load(spark, d, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("F"))).na.drop(subset=["s"]).select("o_orderkey", "o_totalprice")


# ---- reshaping --------------------------------------------------------------------------------------------------


def _wide(spark, d):
    """A row for each day and slot, a price column for each type, as text; some missing."""
    a = at.area(spark, d)
    columns = [F.max(F.when(F.col("area_name") == t, F.col("area_price"))).cast("string").alias(f"area_price_{t}") for t in at.TYPES]
    return a.groupBy("delivery_date", "time_code").agg(*columns)


_WIDE = f"""WITH {at.AREA}, wide AS (SELECT delivery_date, time_code, {", ".join(f"CAST(max(CASE WHEN area_name = '{t}' THEN area_price END) AS VARCHAR) AS area_price_{t}" for t in at.TYPES)} FROM area GROUP BY delivery_date, time_code)"""
_COLUMNS = [f"area_price_{t}" for t in at.TYPES]


@query(_WIDE + f" SELECT delivery_date, time_code, split_part(c, '_', 3) AS area_name, CAST(p AS DECIMAL(32,3)) AS area_price FROM (UNPIVOT wide ON {', '.join(_COLUMNS)} INTO NAME c VALUE p)")
def unpivot_exclude_nulls(spark, d):
    out = rows.unpivot(_wide(spark, d), ["delivery_date", "time_code"], _COLUMNS, "c", "p", keep_nulls=False)
    return out.select("delivery_date", "time_code", F.split_part("c", F.lit("_"), F.lit(3)).alias("area_name"), F.col("p").cast("decimal(32,3)").alias("area_price"))


@query(_WIDE + f" SELECT delivery_date, time_code, c, p FROM (UNPIVOT INCLUDE NULLS wide ON {', '.join(_COLUMNS)} INTO NAME c VALUE p)".replace("UNPIVOT INCLUDE NULLS wide ON", "FROM wide UNPIVOT INCLUDE NULLS (p FOR c IN (").replace(" INTO NAME c VALUE p)", ")))"))
def unpivot_include_nulls(spark, d):
    return rows.unpivot(_wide(spark, d), ["delivery_date", "time_code"], _COLUMNS, "c", "p", keep_nulls=True)


@query("WITH h AS (SELECT CAST(ts AS DATE) AS day, CAST(extract(hour FROM ts) AS INTEGER) AS hour_of_day, count(*) AS n, max(value) AS most FROM events GROUP BY ALL), days AS (SELECT DISTINCT day FROM h)"
       " SELECT day, hours.h::INTEGER AS hour_of_day, n, most FROM days CROSS JOIN (SELECT unnest(range(24)) AS h) hours LEFT JOIN h USING (day) WHERE false UNION ALL"
       " SELECT g.day, g.k::INTEGER, h.n, h.most FROM (SELECT day, unnest(range(24)) AS k FROM days) g LEFT JOIN h ON h.day = g.day AND h.hour_of_day = g.k")
def unpivot_multi_metric(spark, d):
    e = load(spark, d, "events").select(F.to_date("ts").alias("day"), F.hour("ts").alias("h"), "value")
    wide = e.groupBy("day").agg(*[x for h in range(24) for x in (F.nullif(F.count_if(F.col("h") == h), F.lit(0).cast("bigint")).alias(f"n_{h}"), F.max(F.when(F.col("h") == h, F.col("value"))).alias(f"most_{h}"))])
    return rows.unpivot_metrics(wide, ["day"], {h: {"n": F.col(f"n_{h}"), "most": F.col(f"most_{h}")} for h in range(24)}, "hour_of_day")


@query(_WIDE + f", long AS (FROM wide UNPIVOT INCLUDE NULLS (p FOR c IN ({', '.join(_COLUMNS)}))) SELECT delivery_date, time_code, CAST(CASE c {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {i + 1}' for i, c in enumerate(_COLUMNS))} END AS INTEGER) AS position FROM long")
def slot_position_map(spark, d):
    out = rows.unpivot(_wide(spark, d), ["delivery_date", "time_code"], _COLUMNS, "c", "p", keep_nulls=True)
    return out.select("delivery_date", "time_code", rows.position_of("c", _COLUMNS).alias("position"))


_CENTS = ", ".join(f"CAST(CAST({c} AS DECIMAL(32,3)) * 1000 AS BIGINT)" for c in _COLUMNS)


@query(_WIDE + f", t AS (SELECT *, list_filter([{_CENTS}], lambda x: x IS NOT NULL) AS v, CASE WHEN time_code % 2 = 0 THEN CAST(CAST(area_price_click AS DECIMAL(32,3)) * 1000 AS BIGINT) END AS amount FROM wide)"
       " SELECT count(*) FILTER (WHERE list_sum(v)::BIGINT IS DISTINCT FROM amount) AS mismatches, CAST(max(abs(list_sum(v) - amount)) AS BIGINT) AS largest, min(list_min(v)) AS least FROM t")
def list_min_sum_reconcile(spark, d):
    cents = [(F.col(c).cast("decimal(32,3)") * 1000).cast("bigint") for c in _COLUMNS]
    t = _wide(spark, d).select(rows.list_sum(cents).alias("total"), rows.list_min(cents).alias("low"), F.when(F.col("time_code") % 2 == 0, cents[0]).alias("amount"))
    return t.agg(F.count_if(~F.col("total").eqNullSafe(F.col("amount"))).alias("mismatches"), F.max(F.abs(F.col("total") - F.col("amount"))).alias("largest"), F.min("low").alias("least"))


@query("""SELECT o_orderkey AS key, o_totalprice AS amount, o_orderstatus AS status, NULL::VARCHAR AS segment FROM orders
UNION ALL SELECT c_custkey, c_acctbal, NULL, c_mktsegment FROM customer""")
def union_by_name_nullfill(spark, d):
    a = load(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    b = load(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("key"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT CAST(c_custkey AS INTEGER) AS c_custkey, NULL::DATE AS since, c_name, CAST(c_acctbal AS DECIMAL(32,3)) AS c_acctbal FROM customer")
def align_schema(spark, d):
    from pyspark.sql.types import StructType

    return rows.align(load(spark, d, "customer"), StructType.fromDDL("c_custkey int, since date, c_name string, c_acctbal decimal(32,3)"))


# ---- gold -------------------------------------------------------------------------------------------------------


@query(f"WITH {at.PRICES} SELECT delivery_date, time_code, area_name, area_price, system_price, spread FROM prices")
def inner_join_price_base(spark, d):
    return at.prices(spark, d).select("delivery_date", "time_code", "area_name", "area_price", "system_price", "spread")


def _order_years(first: int = 1995, last: int = 2002) -> list[dt.date]:
    return sorted(x for y in range(first, last + 1) for x in holidays(y))


@query("WITH h AS (SELECT unnest([" + ", ".join(f"DATE '{x}'" for x in _order_years()) + "]) AS holiday)"
       " SELECT o_orderkey, CASE WHEN isodow(o_orderdate) IN (6, 7) OR holiday IS NOT NULL THEN 'holiday' ELSE 'weekday' END AS day_type FROM orders LEFT JOIN h ON CAST(o_orderdate AS DATE) = holiday")
def left_join_holiday_daytype(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    h = holiday_table(spark, dt.date(1995, 1, 1), dt.date(2002, 12, 31))
    return o.join(F.broadcast(h), F.col("day") == F.col("holiday"), "left").select("o_orderkey", gold.day_type(F.col("day"), F.col("holiday")).alias("day_type"))


@query(f"WITH {at.DAILY} SELECT * FROM daily")
def gold_daily(spark, d):
    return gold.daily(at.prices(spark, d))


_EVENT_HOLIDAYS = ", ".join(f"DATE '{x}'" for y in (2023, 2024, 2025) for x in sorted(holidays(y)))
_PROFILE = f"""{at.PRICES}, profile AS (SELECT CAST(date_trunc('month', delivery_date) AS DATE) AS profile_month, area_name,
  CASE WHEN isodow(delivery_date) IN (6, 7) OR delivery_date IN ({_EVENT_HOLIDAYS}) THEN 'holiday' ELSE 'weekday' END AS day_type, time_code,
  {at.SQL_STATS}, CAST(count(*) AS INTEGER) AS observation_count, {at.sql_events("observation")} FROM prices GROUP BY 1, 2, 3, 4)"""


def _profile(spark, d):
    return gold.period_profile(at.prices(spark, d), holiday_table(spark, dt.date(2023, 1, 1), dt.date(2025, 12, 31)))


@query(f"WITH {_PROFILE} SELECT * FROM profile")
def gold_period_profile(spark, d):
    return _profile(spark, d)


_SPREAD = f"{at.PRICES}, spreads AS (SELECT *, abs(spread) >= 0.01 AS is_split FROM prices)"


@query(f"WITH {_SPREAD} SELECT delivery_date, time_code, area_name, strftime(delivery_datetime, '%Y-%m-%d %H:%M:%S') AS delivery_datetime, area_price, system_price, spread, is_split FROM spreads")
def gold_area_spread(spark, d):
    return gold.area_spread(at.prices(spark, d)).withColumn("delivery_datetime", text(F.col("delivery_datetime")))


@query(f"WITH {at.AREA} SELECT delivery_date, area_name, CAST(median(area_price) AS DECIMAL(32,3)) AS mid, CAST(quantile_cont(area_price, 0.05) AS DECIMAL(32,3)) AS low, CAST(quantile_cont(area_price, 0.95) AS DECIMAL(32,3)) AS high FROM area GROUP BY ALL")
def decimal_quantile_exact(spark, d):
    p = F.col("area_price")
    return at.area(spark, d).groupBy("delivery_date", "area_name").agg(stats.quantile(p, 0.5).alias("mid"), stats.quantile(p, 0.05).alias("low"), stats.quantile(p, 0.95).alias("high"))


@query(f"WITH {at.AREA} SELECT delivery_date, time_code, area_name, CAST(stddev_pop(CAST(area_price AS DOUBLE)) AS DECIMAL(32,3)) AS deviation FROM area GROUP BY ALL")
def stddev_pop_single_row(spark, d):
    return at.area(spark, d).groupBy("delivery_date", "time_code", "area_name").agg(stats.thousandths(F.stddev_pop(F.col("area_price").cast("double"))).alias("deviation"))


@query(f"WITH {at.DAILY} SELECT delivery_date, area_name, time_code_count FROM daily WHERE time_code_count <> 48 ORDER BY 1, 2 LIMIT 10")
def incomplete_days_topn(spark, d):
    return gold.incomplete_days(gold.daily(at.prices(spark, d)))


@query(f"WITH {at.DAILY} SELECT count(*) AS staged, count(*) FILTER (WHERE time_code_count <> 48) AS incomplete, count(DISTINCT delivery_date) FILTER (WHERE time_code_count <> 48) AS days, min(delivery_date) AS lo, max(delivery_date) AS hi FROM daily")
def staged_day_range(spark, d):
    odd = F.col("time_code_count") != 48
    return gold.daily(at.prices(spark, d)).agg(F.count(F.lit(1)).alias("staged"), F.count_if(odd).alias("incomplete"), F.count_distinct(F.when(odd, F.col("delivery_date"))).alias("days"), F.min("delivery_date").alias("lo"), F.max("delivery_date").alias("hi"))


# ---- dashboard --------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT event_type AS area_name FROM events")
def distinct_areas(spark, d):
    return gold.areas(load(spark, d, "events").select(F.col("event_type").alias("area_name")))


@query("SELECT DISTINCT CAST(CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS fiscal_year FROM orders")
def distinct_fiscal_years(spark, d):
    return gold.fiscal_years(load(spark, d, "orders").select(F.col("o_orderdate").alias("delivery_date")))


_SLICE = f"WITH {_SPREAD} SELECT delivery_date, time_code, area_price, spread, is_split FROM spreads WHERE area_name = 'click' AND delivery_date >= DATE '2023-04-01' AND delivery_date < DATE '2024-04-01'"


@query(_SLICE)
def price_heatmap(spark, d):
    return gold.price_heatmap(gold.area_spread(at.prices(spark, d)), "click", 2023)


@query(f"SELECT delivery_date, {', '.join(f'max(CASE WHEN time_code = {i} THEN area_price END) AS {chr(34)}{i}{chr(34)}' for i in range(1, 49))} FROM ({_SLICE}) GROUP BY delivery_date")
def price_heatmap_pivot(spark, d):
    return gold.heatmap_wide(price_heatmap(spark, d))


_RATES = f"WITH {at.DAILY} SELECT CAST(CASE WHEN month(delivery_date) >= 4 THEN year(delivery_date) ELSE year(delivery_date) - 1 END AS INTEGER) AS fiscal_year, area_name, round(100.0 * sum(split_time_code_count)::DOUBLE / sum(time_code_count)::DOUBLE, 6) AS split_rate_pct FROM daily GROUP BY 1, 2"


@query(_RATES)
def split_rate_matrix(spark, d):
    return gold.split_rates(gold.daily(at.prices(spark, d))).withColumn("split_rate_pct", F.round("split_rate_pct", 6))


@query(f"SELECT fiscal_year, {', '.join(f'max(CASE WHEN area_name = {chr(39)}{t}{chr(39)} THEN split_rate_pct END) AS {chr(34)}{t}{chr(34)}' for t in at.TYPES)} FROM ({_RATES}) GROUP BY fiscal_year")
def split_rate_pivot(spark, d):
    return rows.pivot_wide(split_rate_matrix(spark, d), "fiscal_year", "area_name", at.TYPES, "split_rate_pct")


@query(f"WITH {_PROFILE} SELECT 2023 AS fiscal_year, time_code, round(sum(avg_price::DOUBLE * observation_count) / sum(observation_count)::DOUBLE, 6) AS avg_price FROM profile WHERE area_name = 'view' AND day_type = 'weekday' AND profile_month >= DATE '2023-04-01' AND profile_month < DATE '2024-04-01' GROUP BY time_code")
def intraday_profile_weighted(spark, d):
    return gold.intraday_profile(_profile(spark, d), "view", "weekday", [2023]).withColumn("avg_price", F.round("avg_price", 6))


@query(f"SELECT min(v) AS clip, max(v) AS most FROM (SELECT area_price::DOUBLE AS v, row_number() OVER (ORDER BY area_price) AS i, count(*) OVER () AS n FROM ({_SLICE})) WHERE i >= floor((n - 1) * 0.99 + 0.5) + 1")
def heatmap_bounds(spark, d):
    return gold.heatmap_bounds(price_heatmap(spark, d))


# ---- analyses ---------------------------------------------------------------------------------------------------


@query("SELECT s_name, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name ORDER BY total DESC, s_name LIMIT 20")
def group_total_rank20(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_name")
    t = load(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return t.groupBy("s_name").agg(F.round(F.sum("l_extendedprice"), 2).alias("total")).orderBy(F.desc("total"), "s_name").limit(20)


@query("""WITH top AS (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY sum(CAST(l_quantity AS BIGINT)) DESC, l_suppkey LIMIT 5)
SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM top) GROUP BY 1, 2""")
def top5_daily_trend(spark, d):
    t = load(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), F.col("l_quantity").cast("bigint").alias("q"))
    top = t.groupBy("l_suppkey").agg(F.sum("q").alias("q")).orderBy(F.desc("q"), "l_suppkey").limit(5).select("l_suppkey")
    return t.join(F.broadcast(top), "l_suppkey", "left_semi").groupBy("day", "l_suppkey").agg(F.sum("q").alias("quantity"))


@query("SELECT CAST(ts AS DATE) AS day, round(sum(value) / 1e6, 6) AS total_millions FROM events GROUP BY 1")
def daily_total(spark, d):
    return load(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value") / 1e6, 6).alias("total_millions"))


@query("SELECT CAST((extract(hour FROM ts) * 60 + extract(minute FROM ts)) // 30 + 1 AS INTEGER) AS time_code, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY 1")
def intraday_mean_std(spark, d):
    return load(spark, d, "events").groupBy(slots.slot_of(F.col("ts")).alias("time_code")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("deviation"))


@query("""SELECT round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS deviation, min(l_extendedprice) AS least, max(l_extendedprice) AS most,
round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75 FROM lineitem""")
def describe_price(spark, d):
    p = F.col("l_extendedprice")
    t, q = load(spark, d, "lineitem"), {"median": 0.5, "p25": 0.25, "p75": 0.75}
    found = zip(q, stats.quantiles(t, "l_extendedprice", list(q.values())), strict=True)
    return t.agg(F.round(F.avg(p), 6).alias("mean"), F.round(F.stddev_samp(p), 6).alias("deviation"), F.min(p).alias("least"), F.max(p).alias("most"), *[F.round(F.lit(v).cast("double"), 6).alias(n) for n, v in found])


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def corr_volume_price(spark, d):
    return load(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("SELECT isodow(ts)::INTEGER AS weekday, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def weekday_mean(spark, d):
    return load(spark, d, "events").groupBy((F.weekday("ts") + 1).alias("weekday")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def tail_rows(spark, d):
    return load(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("event_id", "value")


# ---- operations -------------------------------------------------------------------------------------------------

_LOG = "WITH log AS (SELECT o_orderkey, o_custkey % 50 AS scope, o_orderdate, o_orderstatus AS bronze_status FROM orders), m AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_latest FROM log)"


def _log(spark, d):
    log = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("scope"), "o_orderdate", F.col("o_orderstatus").alias("bronze_status"))
    newest = Order.partitionBy("scope").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return log.withColumn("is_latest", F.row_number().over(newest) == 1)


@query(_LOG + " SELECT o_orderkey, scope, is_latest AND scope <> 7 AS is_latest FROM m UNION ALL SELECT -1, 7, true")
def supersede_latest_flag(spark, d):
    from amberline.sources.rawlog import supersede

    new = spark.range(1).select(F.lit(-1).cast("bigint").alias("o_orderkey"), F.lit(7).cast("bigint").alias("scope"), F.lit(True).alias("is_latest"))
    return supersede(_log(spark, d), new, F.col("scope") == 7).select("o_orderkey", "scope", "is_latest")


@query(_LOG + " SELECT o_orderkey, scope FROM m WHERE is_latest AND scope = 3 AND bronze_status <> 'X' ORDER BY o_orderdate DESC LIMIT 1")
def latest_object_resolution(spark, d):
    from amberline.sources.rawlog import newest

    return newest(_log(spark, d), (F.col("scope") == 3) & (F.col("bronze_status") != "X"), "o_orderdate").select("o_orderkey", "scope")


@query(_LOG + " SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'processed' ELSE bronze_status END AS bronze_status FROM m")
def mark_processed(spark, d):
    from amberline.sources.rawlog import marked

    return marked(_log(spark, d), F.col("o_orderkey") % 10 == 0, bronze_status=F.lit("processed")).select("o_orderkey", "bronze_status")


@query(f"""WITH {at.AREA} SELECT delivery_date, time_code, area_name, CAST(CASE WHEN delivery_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-15' THEN area_price * 2 ELSE area_price END AS DECIMAL(32,3)) AS area_price
FROM area WHERE NOT (delivery_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-15' AND area_name = 'error')""")
def replace_window_result(spark, d):
    """A table is written, days in its middle are replaced by other rows, and the table is read again."""
    from amberline.operators.tables import Lake, TableSpec
    from amberline.plans.market import own_folder

    lake = Lake(spark, own_folder(spark, "replace"))
    spec = TableSpec.of("silver.area", "delivery_date date required key, time_code int required key, area_name string required key, area_price decimal", partition=("delivery_date", "month"))
    a = at.area(spark, d).select("delivery_date", "time_code", "area_name", "area_price")
    lake.replace_window(spec, a, None)
    window = Window.days(dt.date(2024, 1, 10), dt.date(2024, 1, 15))
    lake.replace_window(spec, a.filter(window.holds(F.col("delivery_date")) & (F.col("area_name") != "error")).withColumn("area_price", F.col("area_price") * 2), window)
    return lake.read(spec).select("delivery_date", "time_code", "area_name", "area_price")


@query("SELECT o_custkey AS run_id, count(*) AS steps, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, max(o_orderdate) - min(o_orderdate) > INTERVAL 1 DAY AS is_long FROM orders GROUP BY 1")
def run_log_rollup(spark, d):
    o = load(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("run_id")).agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), ((F.max("o_orderdate") - F.min("o_orderdate")) > F.expr("interval 1 day")).alias("is_long"))


@query("SELECT p.p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey AND l_quantity > 49)")
def orphan_anti_join(spark, d):
    used = load(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return load(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


from amberline.plans import market  # noqa: E402,F401  the market pipelines register themselves
