import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amberline.functions import casts, slots, stats
from amberline.functions.holidays import holiday_table, holidays
from amberline.functions.slots import Window


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'date' if isinstance(v, dt.date) else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "value"), [("12.7", 13), ("12.5", 13), ("-12.5", -13), ("1e3", 1000), ("", None), ("abc", None), (" 5 ", 5), (None, None), ("1,234", None)])
def test_long(spark, text, value):
    assert one(spark, casts.to_long(F.col("s")), s=text) == value


@pytest.mark.parametrize(("text", "value"), [("2026-04-01", dt.date(2026, 4, 1)), ("2026/4/1", dt.date(2026, 4, 1)), ("2026/04/01", dt.date(2026, 4, 1)), ("2026/04/01 x", None), ("", None), (None, None)])
def test_dates(spark, text, value):
    assert one(spark, casts.to_date(F.col("s")), s=text) == value


def test_thousands_and_prices(spark):
    assert one(spark, casts.to_long(casts.no_thousands(F.col("s"))), s="17,741,050") == 17741050
    assert one(spark, casts.to_price(F.col("s")), s="12.3456") == Decimal("12.346")


@pytest.mark.parametrize(("code", "instant"), [(1, dt.datetime(2024, 3, 31, 15)), (48, dt.datetime(2024, 4, 1, 14, 30))])
def test_slot_instants(spark, code, instant):
    assert one(spark, slots.slot_instant(F.col("d"), F.col("c")), d=dt.date(2024, 4, 1), c=code) == instant


def test_updated_at(spark):
    assert one(spark, casts.updated_at(F.col("s")), s="2026/08/08 00:10 UPDATE") == dt.datetime(2026, 8, 7, 15, 10)


@pytest.mark.parametrize(("day", "year"), [(dt.date(2025, 3, 31), 2024), (dt.date(2025, 4, 1), 2025), (dt.date(2026, 3, 31), 2025)])
def test_fiscal_years(spark, day, year):
    assert one(spark, slots.fiscal_year(F.col("d")), d=day) == year == slots.fiscal_year_of(day)
    assert one(spark, Window.fiscal(year).holds(F.col("d")), d=day)
    assert not one(spark, Window.fiscal(year + 1).holds(F.col("d")), d=day)


def test_fiscal_predicate_reaches_the_scan(spark, tmp_path):
    spark.range(3).select(F.lit(dt.date(2024, 5, 1)).alias("d")).write.parquet(f"{tmp_path}/t")
    plan = spark.read.parquet(f"{tmp_path}/t").filter(Window.fiscal(2024).holds(F.col("d")))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d,2024-04-01)" in plan and "LessThan(d,2025-04-01)" in plan


def test_slot_labels(spark):
    assert one(spark, slots.slot_label(F.col("c")), c=1) == "00:00"
    assert one(spark, slots.slot_label(F.col("c")), c=48) == "23:30"


def test_holidays():
    assert dt.date(2024, 2, 12) in holidays(2024)  # the Monday after a holiday on Sunday
    assert dt.date(2015, 9, 22) in holidays(2015)  # between two holidays
    assert dt.date(2019, 4, 30) in holidays(2019) and dt.date(2019, 5, 2) in holidays(2019)
    assert dt.date(2020, 7, 24) in holidays(2020) and dt.date(2020, 10, 12) not in holidays(2020)
    assert dt.date(2021, 8, 9) in holidays(2021) and dt.date(2018, 12, 24) in holidays(2018)
    assert dt.date(2024, 3, 20) in holidays(2024) and dt.date(2024, 9, 23) in holidays(2024)
    assert dt.date(2024, 6, 3) not in holidays(2024)


def test_holiday_table(spark):
    got = [r[0] for r in holiday_table(spark, dt.date(2025, 1, 1), dt.date(2025, 2, 1)).collect()]
    assert got == [dt.date(2025, 1, 1), dt.date(2025, 1, 13)]
    assert holiday_table(spark, dt.date(2025, 6, 1), dt.date(2025, 6, 2)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-5000, 900_000), min_size=1, max_size=48), st.sampled_from([0.05, 0.5, 0.95]))
def test_quantiles_are_the_oracles(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "v int").select((F.col("v").cast("decimal(32,0)") / 1000).cast("decimal(32,3)").alias("p"))
    mine = df.agg(stats.quantile(F.col("p"), q).alias("x"), stats.mean(F.col("p")).alias("m")).first()
    theirs = duckdb.execute("SELECT CAST(quantile_cont(p, ?) AS DECIMAL(32,3)), CAST(avg(p) AS DECIMAL(32,3)) FROM (SELECT CAST(unnest(?) AS DECIMAL(32,3)) AS p)", [q, [f"{Decimal(v) / 1000}" for v in values]]).fetchone()
    assert (mine["x"], mine["m"]) == theirs


def test_sums_before_ratios(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 10), (0, 48, 20.0, 2)], "a int, b int, p double, n int")
    got = df.agg(stats.ratio_of_sums(F.col("a"), F.col("b")).alias("r"), stats.weighted_mean(F.col("p"), F.col("n")).alias("w")).first()
    assert got["r"] == pytest.approx(100 / 49) and got["w"] == pytest.approx(140 / 12)


def test_nearest_quantile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert df.agg(stats.nearest_quantile(F.col("v"), 0.99)).first()[0] == 99.0


def test_texts_round_once(spark):
    texts = ["0.4999999", "-0.4999999", "0.5", "-0.5", "1e3", "12.5e-1", "9223372036854775807", "9223372036854775808", "1e40", "", "x", None, "7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(casts.to_long(F.col("t")))
    assert [r[0] for r in df.collect()] == [0, 0, 1, -1, 1000, 1, 9223372036854775807, None, None, None, None, None, 7]


@pytest.mark.parametrize(
    "values",
    [[], [None], [3.5], [2.0] * 9, [1.0, None, 2.0, 4.0], [0.0, -0.0, 5e-324, 1e-323], [-1.7e308, 1.7e308, 1.0, 2.0, 1e-300], [10.0**k for k in range(-300, 300, 7)], [float("inf"), float("-inf"), 1.0, float("nan"), 2.0], [i % 977 + i / 8192 for i in range(5000)]],
)
def test_quantiles_are_those_of_percentile(spark, values):
    df, qs = spark.createDataFrame([(v,) for v in values], "c double").repartition(3), [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]
    theirs = df.agg(*[F.percentile("c", q) for q in qs]).first()
    assert str(stats.quantiles(df, "c", qs)) == str([v if v is None else v + 0.0 for v in theirs])  # one zero


def test_describe_price_holds_no_table_of_all_values(spark):
    from amberline.plans.registry import QUERIES

    plan = QUERIES["describe_price"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan
