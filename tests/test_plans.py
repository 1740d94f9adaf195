import datetime as dt
from decimal import Decimal

import pytest

from amberline.functions.holidays import holiday_table
from amberline.functions.slots import Window
from amberline.plans import declared, gold, silver
from amberline.sources import reports

NOW = dt.datetime(2026, 7, 30, 14, 58)


def spot(day="2024/04/01", code="1", price="10.00", area="20.25", later=0, **more):
    row = {c: "1,000" for c in (*silver.VOLUMES, *silver.BLOCKS)} | {c: area for c in silver.AREA_PRICES}
    return row | {"delivery_date": day, "time_code": code, "system_price": price, "ingestion_time": NOW + dt.timedelta(hours=later), "execution_id": f"e{later}"} | more


def frame(spark, rows):
    names = list(rows[0])
    kind = {"ingestion_time": "timestamp"}
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"`{n}` {kind.get(n, 'string')}" for n in names))


def test_spot_staging(spark):
    staged = silver.stage_spot(frame(spark, [spot(), spot(price="11", later=1), spot(code="0"), spot(day=None), spot(code="48", area="-1"), spot(code="2", area_price_tokyo=None)]))
    found = {(r.delivery_date, r.time_code): r for r in staged.collect()}
    first = found[dt.date(2024, 4, 1), 1]
    assert first.system_price == Decimal("11.000") and first.selling_bid_volume == 1000 and first.violations == []
    assert first.delivery_datetime == dt.datetime(2024, 3, 31, 15)
    assert found[dt.date(2024, 4, 1), 0].violations == ["time_code_out_of_range"]
    assert found[None, 1].violations == ["delivery_date_null"] and found[dt.date(2024, 4, 1), 48].violations == ["area_price_negative"]
    assert silver.spot_base(staged).count() == 2 and silver.spot_block(staged).count() == 2
    area = silver.spot_area(staged)
    assert area.count() == 17 and area.filter("time_code = 2 and area_name = 'tokyo'").isEmpty()  # a missing price is no row


def test_the_window_comes_before_what_is_newest(spark):
    rows = frame(spark, [spot(day="nonsense"), spot(day="2024/03/31"), spot(day="2024-04-01")])
    assert silver.stage_spot(rows, Window.fiscal(2024)).count() == 1 and silver.stage_spot(rows).count() == 3


def unit(**more):
    row = {c: "1" for c in silver.UNIT_SLOTS} | {"power_plant_code": "10001", "unit_name": "u", "target_date": "2026/08/07", "area": "01", "power_plant_name": "p", "power_generation_method_and_fuel_type": "f", "daily_amount": "48", "updated_datetime": "2026/08/07 15:30:00", "ingestion_time": NOW, "execution_id": "e"}
    return row | more


def test_units(spark):
    empty = dict.fromkeys(silver.UNIT_SLOTS)
    rows = [unit(), unit(unit_name=None, timeslot_00_30=None, daily_amount="47"), unit(power_plant_code="2", timeslot_24_00="-5"), unit(power_plant_code="3", **empty), unit(daily_amount="50", ingestion_time=NOW + dt.timedelta(hours=1))]
    staged = silver.stage_units(frame(spark, rows))
    assert sorted((r.power_plant_code, r.unit_name, *r.violations) for r in staged.collect()) == [("10001", ""), ("10001", "u"), ("2", "u", "generation_negative"), ("3", "u", "all_timeslots_null")]
    long = silver.unit_generation(staged)
    assert long.count() == 96 and long.filter("generation_kwh IS NULL").count() == 1
    last = long.filter("unit_name = 'u' AND time_code = 48").first()
    assert last.delivery_datetime == dt.datetime(2026, 8, 7, 14, 30) and last.updated_datetime == dt.datetime(2026, 8, 7, 15, 30)
    n, most = silver.amount_mismatches(staged).first()
    assert (n, most) == (3, 6)  # the newer amount, the negative slot, and one with nothing to sum


def report(day="2026/08/08 00:10 UPDATE", separator="", empty_next_day=False):
    one = lambda n: ["header", ",".join(map(str, range(n))) if not empty_next_day else ",".join(["1"] * n)]
    out = [day]
    for i, form in enumerate(reports.LAYOUT):
        out.append(separator)
        if isinstance(form[0], int):
            out += ["DATE,TIME,x", *[f"d,t,{','.join(str(r) for _ in form[1])}" for r in range(form[0])]]
        elif empty_next_day and i in (6, 7, 8, 9):
            out += ["header", "," * (len(form) - 1)]
        else:
            out += one(len(form))
    return "\n".join(out)


@pytest.mark.parametrize("text", [report(), report(separator=",,,,,"), report(empty_next_day=True), report().replace("header\n", "header,,\n").replace("0,1,2,3\n", "0,1,2,3,,\n")])
def test_reports(text):
    summary, hours, fives = reports.read_report(text, dt.date(2026, 8, 7))
    assert (len(summary), len(hours), len(fives)) == (44, 98, 578) and fives["interval5_23_55_actual_demand"] == "287"
    assert hours["target_date"] == "2026-08-07" and hours["file_updated_at"] == "2026/08/08 00:10 UPDATE"


@pytest.mark.parametrize("text", ["", report().replace("\n\nDATE", "\nDATE", 1), report() + ",9"])
def test_bad_reports(text):
    with pytest.raises(reports.BadReport):
        reports.read_report(text, dt.date(2026, 8, 7))


def test_usage(spark):
    made = [reports.read_report(report(), dt.date(2026, 8, 7)), reports.read_report(report("2026/08/08 01:10 UPDATE").replace("d,t,5,5,5,5", "d,t,,5,5,5"), dt.date(2026, 8, 7))]
    summary, hours, fives = (frame(spark, [x[i] | {"ingestion_time": NOW, "execution_id": "e"} for x in made]) for i in range(3))
    got = silver.usage_summary(summary, reports.SUMMARY_FIELDS).first()
    assert got.today_peak_supply_capacity == 0 and got.today_peak_supply_usage_rate_pct == 5.0 and got.file_updated_at == dt.datetime(2026, 8, 7, 16, 10)
    long = silver.usage_hourly(hours)
    assert long.count() == 24 and long.filter("hour_of_day = 5").first().actual_demand is None  # the newer report, an empty cell
    assert long.filter("hour_of_day = 0").first().delivery_datetime == dt.datetime(2026, 8, 6, 15)
    five = silver.usage_five_minutes(fives, Window.days(dt.date(2026, 8, 7)))
    assert five.count() == 288 and five.filter("slot_index = 288").first().delivery_datetime == dt.datetime(2026, 8, 7, 14, 55)
    with pytest.raises(ValueError, match="no rule"):
        silver.summary_cast("today_other")


def test_supply_demand(spark):
    rows = [{"target_date": "2026-08-14", "target_time": t, "actual_demand_10k_kw": v, "supply_capacity_forecast_10k_kw": "295", "ingestion_time": NOW + dt.timedelta(hours=h)} for t, v, h in (("00:00", "1", 0), ("00:00", "676", 1), ("23:00", "", 0))]
    out = {r.hour_of_day: r for r in silver.supply_demand(frame(spark, rows), "shikoku").collect()}
    assert out[0].actual_demand_10k_kw == 676 and out[23].actual_demand_10k_kw is None and out[23].supply_capacity_forecast_10k_kw == 295
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        silver.supply_demand(frame(spark, [rows[0] | {"target_time": "x:00"}]), "tohoku").collect()


def prices(spark, area, base):
    a = spark.createDataFrame([(dt.date.fromisoformat(d), c, n, p) for d, c, n, p in area], "delivery_date date, time_code int, area_name string, p string").selectExpr("delivery_date", "time_code", "area_name", "CAST(p AS decimal(32,3)) AS area_price", "TIMESTAMP'2024-01-01' AS delivery_datetime")
    b = spark.createDataFrame([(dt.date.fromisoformat(d), c, p) for d, c, p in base], "delivery_date date, time_code int, p string").selectExpr("delivery_date", "time_code", "CAST(p AS decimal(32,3)) AS system_price")
    return gold.joined(a, b)


def test_gold_daily(spark):
    p = prices(spark, [("2024-01-01", 1, "tokyo", "8"), ("2024-01-01", 2, "tokyo", "12"), ("2024-01-01", 3, "tokyo", "60"), ("2024-01-02", 1, "tokyo", "10.01"), ("2024-01-03", 1, "kyushu", "0.01")], [("2024-01-01", 1, "10"), ("2024-01-01", 2, "10"), ("2024-01-02", 1, "10.00"), ("2024-01-03", 1, "0.005")])
    out = {(str(r.delivery_date), r.area_name): r for r in gold.daily(p).collect()}
    first = out["2024-01-01", "tokyo"]  # slot 3 has no system price and drops out
    assert (first.avg_price, first.stddev_price, first.intraday_range, first.p05_price, first.time_code_count) == tuple(map(Decimal, ("10", "2", "4", "8.2"))) + (2,)
    assert out["2024-01-02", "tokyo"].split_time_code_count == 1 and out["2024-01-02", "tokyo"].stddev_price == 0
    low = out["2024-01-03", "kyushu"]
    assert (low.floor_time_code_count, low.split_time_code_count, low.spike_time_code_count) == (1, 0, 0)
    assert [str(r.delivery_date) for r in gold.incomplete_days(gold.daily(p)).collect()] == ["2024-01-01", "2024-01-02", "2024-01-03"]


def test_day_types(spark):
    p = prices(spark, [(d, 1, "tokyo", "10") for d in ("2024-02-09", "2024-02-10", "2024-02-12")], [(d, 1, "10") for d in ("2024-02-09", "2024-02-10", "2024-02-12")])
    out = gold.period_profile(p, holiday_table(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31)))
    assert {(r.day_type, r.observation_count) for r in out.collect()} == {("weekday", 1), ("holiday", 2)}


def test_dashboard(spark):
    profile = spark.createDataFrame([(dt.date(2024, 4, 1), "a", "weekday", 1, 10.0, 10), (dt.date(2024, 5, 1), "a", "weekday", 1, 20.0, 2), (dt.date(2023, 5, 1), "a", "weekday", 1, 5.0, 2)], "profile_month date, area_name string, day_type string, time_code int, avg_price double, observation_count int")
    got = gold.intraday_profile(profile, "a", "weekday", [2024]).collect()
    assert [(r.fiscal_year, r.avg_price) for r in got] == [(2024, pytest.approx(140 / 12))]
    empty = gold.intraday_profile(profile, "a", "weekday", [])
    assert empty.count() == 0 and empty.columns == ["fiscal_year", "time_code", "avg_price"]
    days = spark.createDataFrame([(dt.date(2024, 4, 1), "a", 1, 1), (dt.date(2024, 4, 2), "a", 0, 48)], "delivery_date date, area_name string, split_time_code_count int, time_code_count int")
    assert gold.split_rates(days).first().split_rate_pct == pytest.approx(100 / 49)
    assert [r[0] for r in gold.fiscal_years(days).collect()] == [2024] and [r[0] for r in gold.areas(days).collect()] == ["a"]


def test_declared_tables_fit_the_plans(spark):
    staged = silver.stage_spot(frame(spark, [spot()]))
    for spec, df in ((declared.SPOT_BASE, silver.spot_base(staged)), (declared.SPOT_BLOCK, silver.spot_block(staged)), (declared.SPOT_AREA, silver.spot_area(staged))):
        assert set(df.columns) == set(spec.schema.names[:-5])
    assert [c for c in declared.UNIT_COLUMNS.values() if c.startswith("timeslot")] == list(silver.UNIT_SLOTS) and len(declared.UNIT_COLUMNS) == 56
    assert all(f.dataType.simpleString() == "string" for f in declared.SPOT.schema.fields[:19])
    assert declared.UNIT_COLUMNS["24:00[kWh]"] == "timeslot_24_00"
