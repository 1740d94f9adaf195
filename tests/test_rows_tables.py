import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from amberline.functions.slots import Window
from amberline.operators import rows
from amberline.operators.tables import HEADER, Lake, TableSpec, stamp, validate_then_write

SPEC = TableSpec.of("silver.t", "day date required key, slot int required key, v long", ("day", "month"))


def frame(spark, *values):
    return spark.createDataFrame([(dt.date.fromisoformat(d), s, v) for d, s, v in values], "day date, slot int, v bigint")


def content(lake, window=None):
    return sorted((str(r.day), r.slot, r.v) for r in lake.read(SPEC, window).collect())


def test_latest_takes_nulls_as_oldest_and_null_keys_as_equal(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (None, 1, "c"), (None, 3, "d")], "k int, t int, v string")
    assert sorted(r.v for r in rows.latest(df, ["k"], ["t"]).collect()) == ["b", "d"]


def test_latest_prunes_groups_early(spark):
    df = spark.createDataFrame([(1, 1)], "k int, t int")
    assert "WindowGroupLimit" in rows.latest(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()


def test_unknown_answers_are_no_violations(spark):
    df = spark.createDataFrame([(None,), (-1,), (1,)], "v int").withColumn("violations", rows.violation_list({"null": F.col("v").isNull(), "negative": F.col("v") < 0}))
    assert [r.violations for r in df.collect()] == [["null"], ["negative"], []]
    assert rows.valid(df).count() == 1 and df.agg(rows.dropped()).first()[0] == 2
    assert {r.violation: r["rows"] for r in rows.violation_summary(df).collect()} == {"null": 1, "negative": 1}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.none() | st.integers(0, 99), st.none() | st.integers(0, 99)), min_size=1, max_size=6, unique_by=lambda x: x[0]))
def test_pivot_undoes_unpivot(spark, data):
    df = spark.createDataFrame(data, "k int, a bigint, b bigint")
    long = rows.unpivot(df, ["k"], ["a", "b"], "c", "v", keep_nulls=True)
    assert long.count() == 2 * len(data)
    back = rows.pivot_wide(long, "k", "c", ["a", "b"], "v")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(data, key=str)


def test_unpivot_metrics_needs_no_join(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "k int, x0 int, y0 int, x1 int, y1 int")
    out = rows.unpivot_metrics(df, ["k"], {0: {"x": F.col("x0"), "y": F.col("y0")}, 1: {"x": F.col("x1"), "y": F.col("y1")}}, "slot")
    assert sorted(map(tuple, out.collect())) == [(1, 0, 2, 3), (1, 1, 4, 5)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_list_sums(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, 2)], "a bigint, b bigint")
    assert [r[0] for r in df.select(rows.list_sum([F.col("a"), F.col("b")])).collect()] == [None, 1, 3]


def test_unique_keys(spark):
    df = frame(spark, ("2024-01-01", 1, 1), ("2024-01-01", 1, 2), ("2024-01-01", 1, 3), ("2024-01-02", 1, 1))
    assert rows.surplus_rows(df, ["day", "slot"]) == 2
    with pytest.raises(rows.DuplicateKeys, match="2 rows"):
        rows.require_unique(df, ["day", "slot"], "t")


def test_align(spark):
    out = rows.align(spark.createDataFrame([(1, "x")], "b int, extra string"), StructType.fromDDL("a date, b bigint"))
    assert out.columns == ["a", "b"] and tuple(out.first()) == (None, 1)


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, f"file://{tmp_path}/lake")


def test_replace_window(spark, lake):
    lake.replace_window(SPEC, frame(spark, ("2024-01-01", 1, 1), ("2024-01-31", 1, 2), ("2024-02-01", 1, 3), ("2024-03-01", 1, 4)), None)
    before = dict(lake.version(SPEC.name).files)
    window = Window.days(dt.date(2024, 1, 31), dt.date(2024, 2, 28))
    lake.replace_window(SPEC, frame(spark, ("2024-02-02", 5, 9)), window)
    assert content(lake) == [("2024-01-01", 1, 1), ("2024-02-02", 5, 9), ("2024-03-01", 1, 4)]
    after = dict(lake.version(SPEC.name).files)
    assert [p for p, part in before.items() if part == "2024-03"][0] in after  # a month aside is not rewritten
    assert content(lake, Window.days(dt.date(2024, 3, 1))) == [("2024-03-01", 1, 4)]


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(1, 28), st.integers(1, 2)), st.integers(0, 9), min_size=1, max_size=6), st.integers(1, 28), st.integers(0, 9))
def test_replacing_twice_is_replacing_once(spark, tmp_path_factory, data, lo, length):
    lake = Lake(spark, f"file://{tmp_path_factory.mktemp('lake')}")
    lake.replace_window(SPEC, frame(spark, *[(f"2024-05-{d:02d}", s, -1) for d in range(1, 29, 9) for s in (1, 2)]), None)
    window = Window.days(dt.date(2024, 5, lo), dt.date(2024, 5, min(28, lo + length)))
    inside = [(f"2024-05-{d:02d}", s, v) for (d, s), v in data.items() if lo <= d <= min(28, lo + length)]
    if inside:
        lake.replace_window(SPEC, frame(spark, *inside), window)
        once = content(lake)
        lake.replace_window(SPEC, frame(spark, *inside), window)
        assert content(lake) == once
        assert [x for x in once if window.lo.isoformat() <= x[0] <= window.hi.isoformat()] == sorted(inside)


def test_no_rows_delete_nothing(spark, lake):
    lake.replace_window(SPEC, frame(spark, ("2024-01-01", 1, 1)), None)
    assert lake.replace_window(SPEC, frame(spark, ("2024-01-01", 1, 1)).filter("false"), Window.days(dt.date(2024, 1, 1))) is None
    assert content(lake) == [("2024-01-01", 1, 1)]


def test_nothing_is_written_if_a_later_table_is_bad(spark, lake):
    good, bad = frame(spark, ("2024-01-01", 1, 1)), frame(spark, ("2024-01-01", 1, 1), ("2024-01-01", 1, 1))
    other = TableSpec.of("silver.u", "day date required key, slot int required key, v long")
    with pytest.raises(rows.DuplicateKeys):
        validate_then_write(lake, [(SPEC, good, None), (other, bad, None)])
    assert not lake.exists(SPEC.name)


def test_versions_know_the_rows_written_and_failures_leave_no_files(spark, lake):
    rows_ = [("2024-01-01", 1, 1), ("2024-01-01", 2, 1), ("2024-02-01", 1, 1)]
    assert lake.replace_window(SPEC, frame(spark, *rows_), None).rows == 3
    assert lake.append(SPEC, frame(spark, ("2024-03-01", 1, 1))).rows == 1
    with pytest.raises(rows.DuplicateKeys):
        lake.replace_window(SPEC, frame(spark, rows_[0], rows_[0]), None)
    assert not lake.orphans(SPEC.name, dt.timedelta(0)) and len(content(lake)) == 4


def test_required_columns(spark, lake):
    with pytest.raises(ValueError, match="required"):
        lake.append(SPEC, frame(spark, ("2024-01-01", 1, 1)).withColumn("slot", F.lit(None).cast("int")))


def test_append_and_probe(spark, lake):
    lake.append(SPEC, frame(spark, ("2024-01-01", 1, 1)))
    lake.append(SPEC, frame(spark, ("2024-01-01", 1, 1)))
    assert len(content(lake)) == 2 and lake.has_rows(SPEC, slot=1) and not lake.has_rows(SPEC, slot=2)


def test_columns_are_added_and_never_removed(spark, lake, caplog):
    lake.append(SPEC, frame(spark, ("2024-01-01", 1, 1)))
    wider = TableSpec.of("silver.t", "day date required key, slot int required key, w decimal", ("day", "month"))
    lake.append(wider, frame(spark, ("2024-01-02", 1, 1)).select("day", "slot", F.lit("1.5").alias("w")))
    assert sorted(map(tuple, lake.read(SPEC.name).collect())) == [(dt.date(2024, 1, 1), 1, 1, None), (dt.date(2024, 1, 2), 1, None, Decimal("1.500"))]
    assert "no longer declared" in caplog.text


def test_two_writers_cannot_both_win(spark, lake):
    v = lake.provision(SPEC)
    lake.commit(SPEC.name, v, SPEC.schema, SPEC.partition, [])
    with pytest.raises(Exception, match="exists"):
        lake.commit(SPEC.name, v, SPEC.schema, SPEC.partition, [])


def test_expiry_and_orphans(spark, lake):
    for i in range(3):
        lake.replace_window(SPEC, frame(spark, ("2024-01-01", 1, i)), None)
    late = dt.datetime.now(dt.UTC) + dt.timedelta(days=8)
    assert not lake.orphans(SPEC.name)
    lake.pin(SPEC.name, "audit", 2)
    assert lake.expire(SPEC.name, dt.timedelta(days=9), now=late) == []
    assert lake.expire(SPEC.name, dt.timedelta(days=7), now=late) == [1, 3] and lake.numbers(SPEC.name) == [1, 2, 3, 4]
    lake.expire(SPEC.name, dt.timedelta(days=7), delete=True, now=late)
    assert lake.numbers(SPEC.name) == [2, 4]
    assert not lake.orphans(SPEC.name) and lake.delete_orphans(SPEC.name) == 0  # young files may be a running writer's
    now = dt.timedelta(0)
    assert len(lake.orphans(SPEC.name, now)) == 1 == lake.delete_orphans(SPEC.name, older_than=now)
    assert content(lake) == [("2024-01-01", 1, 2)] and lake.read(SPEC, number=2).count() == 1


def test_evolving_the_layout(spark, lake):
    plain = TableSpec.of("silver.t", "day date required key, slot int required key, v long")
    lake.append(plain, frame(spark, ("2024-01-01", 1, 1), ("2025-01-01", 1, 2)))
    assert lake.evolve_partition(SPEC) == ["month(day)"] and lake.evolve_partition(SPEC) == []
    assert {p for _, p in lake.version(SPEC.name).files} == {"2024-01", "2025-01"} and len(content(lake)) == 2


def test_namespaces(lake, spark):
    lake.create_namespace("bronze")
    lake.append(SPEC, frame(spark, ("2024-01-01", 1, 1)))
    assert lake.namespaces() == ["bronze", "silver"] and lake.tables("silver") == ["silver.t"]
    assert not lake.drop_namespace("silver") and lake.drop("silver.t") and not lake.drop("silver.t") and lake.drop_namespace("silver")


def test_declarations():
    head = ",".join(HEADER)
    spec = TableSpec.from_csv("silver.x", f"{head}\n1,d,date,TRUE,true,the day,month,Date,\n,,,,,,,,\n2,p,decimal,no,,,,Price,\n")
    assert spec.keys == ("d",) and spec.partition == ("d", "month") and spec.sources == {"Date": "d", "Price": "p"}
    assert spec.required == ["d"] and spec.schema["p"].dataType.simpleString() == "decimal(32,3)"
    assert spec.schema.names[2:] == ["source_data", "status", "ingestion_time", "ingestion_date", "execution_id"] and spec.schema[-1].metadata["field_id"] == 9005
    with pytest.raises(ValueError, match="unknown type"):
        TableSpec.from_csv("x", f"{head}\n1,d,text,,,,,,\n")
    with pytest.raises(ValueError, match="lacks"):
        TableSpec.from_csv("x", f"{head}\n,d,date,,,,,,\n")
    with pytest.raises(ValueError, match="no date"):
        TableSpec.of("x", "a int", ("a", "year"))


def test_stamp_uses_one_time(spark):
    out = stamp(spark.range(2).toDF("x"), source="s", execution_id="e").collect()
    assert out[0].ingestion_time == out[1].ingestion_time and out[0].source_data == "s" and out[0].status == "loaded"


@pytest.mark.parametrize("few", [100_000, 1])
def test_latest_of_wide_rows_is_latest(spark, monkeypatch, few):
    monkeypatch.setattr(rows, "FEW", few)
    values = [(k, a, b, f"{k}{a}{b}") for k in ("x", "y", None) for a in (None, 1, 2) for b in (None, 3, 5)] + [("z", None, None, "z")]
    df = spark.createDataFrame([*values, ("y", 2, 5, "y25")], "k string, a int, b int, v string")
    assert sorted(map(str, rows.latest_wide(df, ["k"], ["a", "b"]).collect())) == sorted(map(str, rows.latest(df, ["k"], ["a", "b"]).collect()))


def test_wide_reports_are_sorted_only_where_they_are_the_newest(spark):
    from amberline.plans.registry import QUERIES

    plan = QUERIES["usage_five_minute_slots"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("row_number()") < plan.index("Join LeftSemi")  # from the top down: what is sorted has passed the join
