import datetime as dt
import gzip
import json

import pytest

import __spark_entry__
from amberline import cli
from amberline.functions.slots import Window
from amberline.plans import declared, orchestrate, silver
from amberline.plans.orchestrate import FAILED, SKIPPED, SUCCESS, Counts, Step, verdict
from amberline.plans.steps import Workspace, year_rows
from amberline.sources.fetch import FEEDS, FolderFetcher
from amberline.sources.raw import read_csv

DAY = dt.date(2026, 8, 14)


def spot_file(folder, year, price="10.00", slots=48):
    head = ",".join(declared.SPOT_COLUMNS)
    rows = [f"{year}/04/01,{c},1,2,3,{price},{','.join(['12.5'] * 9)},1,2,3,4" for c in range(1, slots + 1)]
    (folder / f"spot_summary_{year}.csv").write_bytes("\n".join([head, *rows]).encode("cp932"))


def unit_file(folder, day, value="1"):
    head = ",".join(declared.UNIT_COLUMNS)
    rows = [f"100,01,plant,{u},gas,{day:%Y/%m/%d},{','.join([value] * 48)},{48 * int(value)},{day:%Y/%m/%d} 23:00:00" for u in ("a", "")]
    (folder / FEEDS["occto_unit_generation_actuals"].file_name(day)).write_bytes(("﻿" + "\n".join([head, *rows])).encode())


@pytest.fixture
def site(tmp_path):
    folder = tmp_path / "site"
    folder.mkdir()
    return folder


@pytest.fixture
def w(spark, tmp_path, site):
    return Workspace(spark, f"file://{tmp_path}/root", FolderFetcher(str(site)))


def test_spot_from_source_to_gold(w, site):
    spot_file(site, 2024)
    steps = orchestrate.run_spot(w, 2024, with_gold=True, run_id="r1")
    assert [(s.name, s.status) for s in steps] == [(n, SUCCESS) for n in ("source_to_raw", "raw_to_bronze", "bronze_to_silver", "silver_to_gold")]
    assert w.lake.read(declared.SPOT_AREA).count() == 48 * 9 and w.lake.read(declared.GOLD_SPREAD).count() == 48 * 9
    day = w.lake.read(declared.GOLD_DAILY).filter("area_name = 'tokyo'").first()
    assert float(day.avg_price) == 12.5 and day.split_time_code_count == 48 and day.execution_id == "r1" and day.status == "loaded"
    # an unchanged file is not landed again
    again = orchestrate.run_spot(w, 2024, run_id="r2")
    assert [s.status for s in again] == [SUCCESS, SKIPPED, SUCCESS] and w.lake.read(declared.SPOT).count() == 48
    # a revision is, and the newest wins
    spot_file(site, 2024, price="11.00")
    orchestrate.run_spot(w, 2024, run_id="r3")
    assert w.lake.read(declared.SPOT).count() == 96 and {float(r[0]) for r in w.lake.read(declared.SPOT_BASE).select("system_price").collect()} == {11.0}
    log = w.lake.read(declared.RUN_LOG)
    assert log.count() == 10 and log.filter("run_id = 'r1' AND step_name = 'bronze_to_silver'").first().actual_row_count == 96
    raw = w.raw.log()
    assert raw.count() == 2 and raw.filter("is_latest").count() == 1 and {r.bronze_status for r in raw.collect()} == {"processed"}


def test_backfill_goes_on_after_a_year_that_fails(w, site):
    spot_file(site, 2023)
    spot_file(site, 2025)
    steps = orchestrate.backfill_spot(w, 2023, 2025, pause=0)
    assert [(s.scope, s.status) for s in steps if s.name == "source_to_raw"] == [("2023", SUCCESS), ("2024", FAILED), ("2025", SUCCESS)]
    assert steps[-1].status == SUCCESS and orchestrate.any_failed(steps)
    assert w.lake.read(declared.SPOT_BASE, Window.fiscal(2025)).count() == 48


def test_units(w, site):
    for d in (DAY, DAY + dt.timedelta(days=1)):
        unit_file(site, d)
    steps = orchestrate.run_units(w, DAY, DAY + dt.timedelta(days=1))
    assert not orchestrate.any_failed(steps) and w.lake.read(declared.UNIT_GENERATION).count() == 2 * 2 * 48
    assert len({p for _, p in w.lake.version(declared.UNIT_GENERATION.name).files}) == 2


def test_usage_and_demand(w, site):
    from tests.test_plans import report

    (site / f"juyo_05_{DAY:%Y%m%d}.csv").write_bytes(report().encode("cp932"))
    w.scrape("power_usage_hokuriku", DAY)
    assert w.land("power_usage_hokuriku", w.resolve("power_usage_hokuriku", DAY), DAY) == 3
    assert w.land("power_usage_hokuriku", w.resolve("power_usage_hokuriku", DAY), DAY) == 0  # it was done
    counts = w.silver_usage(DAY)
    assert [counts.due[t.name] for t in (declared.USED_SUMMARY, declared.USED_HOURLY, declared.USED_FIVE)] == [1, 24, 288]
    assert counts.written == counts.due and verdict(counts)[0] == SUCCESS
    assert w.lake.read(declared.USED_FIVE).count() == 288 and w.lake.read(declared.USED_SUMMARY).count() == 1
    (site / "juyo_shikoku_2026.csv").write_bytes("2026/8/15 UPDATE\n\nDATE,TIME,当日実績(万kW),供給力想定値(万kW)\n2026/8/14,0:00,300,400\n2026/08/14,23:00,310,410\n2026/8/15,0:00,1,2\n".encode("cp932"))
    w.scrape("supply_demand_actuals_shikoku", DAY)
    assert w.land("supply_demand_actuals_shikoku", w.resolve("supply_demand_actuals_shikoku", DAY), DAY) == 2
    counts = w.silver_demand("shikoku", DAY)
    got = {r.hour_of_day: r.supply_capacity_forecast_10k_kw for r in w.lake.read(declared.DEMANDED["shikoku"]).collect()}
    assert got == {0: 400, 23: 410} and verdict(counts) == (SUCCESS, "")


def test_year_tables(spark):
    text = "x UPDATE\nDATE,TIME,actual\n2026/1/1,0:00,933\n2026/01/01,9:00,934\n2026/1/2,0:00,1\n"
    assert [tuple(r) for r in year_rows(spark, text, "tohoku", dt.date(2026, 1, 1)).collect()] == [("2026-01-01", "00:00", "933"), ("2026-01-01", "09:00", "934")]
    with pytest.raises(ValueError):
        year_rows(spark, text.replace("2026/1/2", "someday"), "tohoku", dt.date(2026, 1, 1))


def test_packed_cp932(spark, tmp_path):
    (tmp_path / "x.csv.gz").write_bytes(gzip.compress("受渡日,b\n1,2\n".encode("cp932")))
    assert read_csv(spark, f"file://{tmp_path}/x.csv.gz").columns == ["受渡日", "b"]


def test_raw_snapshots(w):
    a = w.raw.put("d", "f.csv", b"1", day=DAY)
    assert a.changed and not w.raw.put("d", "f.csv", b"1", day=DAY).changed and w.raw.put("d", "f.csv", b"2", day=DAY).changed
    assert w.raw.latest("d", day=DAY) != a.path and not w.raw.mark_processed("nowhere") and w.raw.mark_processed(w.raw.latest("d", day=DAY))
    with pytest.raises(ValueError, match="no raw object"):
        w.raw.latest("d", day=DAY, unprocessed=True)
    assert json.loads(w.raw.files.read(a.path.rsplit("/", 1)[0] + "/metadata.json"))["content_length"] == 1


@pytest.mark.parametrize(("counts", "status"), [(Counts(), FAILED), (Counts(staged=2, due={"t": 0}), FAILED), (Counts(staged=2, due={"t": 2}, written={"t": 1}), FAILED), (Counts(staged=2, due={"t": 2}, written={"t": 2}), SUCCESS)])
def test_verdicts(counts, status):
    assert verdict(counts)[0] == status


def test_a_run_log_that_cannot_be_written_is_no_failure(w, monkeypatch):
    monkeypatch.setattr(w.lake, "append", lambda *_: 1 / 0)
    assert orchestrate.record(w, "r", "p", [Step("s", SUCCESS)]) is False


def test_requests():
    assert [s.method for s in FEEDS["occto_unit_generation_actuals"].steps("http://x", DAY)] == ["GET", "POST", "POST", "GET"]
    consent, search, file = FEEDS["occto_unit_generation_actuals"].steps("http://x", DAY)[1:]
    assert consent.form == {"agreed": "0"} and search.form == file.query and search.form["tgtDateDateFrom"] == f"{DAY:%Y/%m/%d}"
    step = FEEDS["jepx_spot_price"].steps("http://x", 2024)[0]
    assert step.form == {"dir": "spot_summary", "file": "spot_summary_2024.csv"} and "timestamp" in step.query and "Referer" in step.headers
    names = {c: FEEDS[f"supply_demand_actuals_{c}"].file_name(dt.date(2025, 1, 2)) for c in ("tohoku", "chugoku", "shikoku")}
    assert names == {"tohoku": "juyo_2025_tohoku.csv", "chugoku": "juyo-2025.csv", "shikoku": "juyo_shikoku_2025.csv"}


def test_command_line(w, site, capsys):
    assert len({c.name for c in cli.COMMANDS}) == 30
    assert cli.main([], w) == 0 and w.lake.namespaces() == ["bronze", "gold", "metadata", "silver"]
    with pytest.raises(SystemExit) as e:
        cli.main(["run-jepx-orchestrator", "--fiscal-year", "2024", "--all"], w)
    assert e.value.code == 2 and not w.raw.files.exists(f"{w.raw.root}/raw")
    assert cli.main(["run-jepx-orchestrator", "--fiscal-year", "2024"], w) == 1  # there is no file
    spot_file(site, 2024)
    for args in (["scrape-jepx", "--fiscal-year", "2024"], ["ingest-jepx-raw-to-bronze", "--fiscal-year", "2024"], ["ingest-jepx-bronze-to-silver"], ["ingest-jepx-silver-to-gold"], ["expire-silver-snapshots"], ["provision-silver-tables"], ["evolve-silver-partition-spec"], ["table", "--action", "recreate", "--name", "gold.jepx_spot_price_daily"], ["namespace", "--action", "view"]):
        assert cli.main(args, w) == 0, args
    assert w.lake.read(declared.SPOT_BLOCK).count() == 48
    with pytest.raises(SystemExit):
        cli.main(["ingest-occto-bronze-to-silver", "--to-date", "2026-01-01"], w)


def test_streaming(spark, w, tmp_path):
    from amberline.plans.silver import stage_spot
    from amberline.streaming.arrivals import replace_as_it_comes
    from tests.test_plans import frame, spot

    def run():
        q = replace_as_it_comes(spark, folder, schema, lambda df: df.selectExpr("to_date(delivery_date, 'yyyy/MM/dd') AS day"), lambda df, window: silver.spot_base(stage_spot(df, window)), w.lake, declared.SPOT_BASE, f"file://{tmp_path}/check")
        q.awaitTermination(120)
        assert q.exception() is None

    folder, first = f"file://{tmp_path}/arrivals", frame(spark, [spot(), spot(code="2")])
    schema = first.schema
    first.write.mode("append").parquet(folder)
    run()
    frame(spark, [spot(price="11", later=1)]).write.mode("append").parquet(folder)
    run()
    assert sorted((r.time_code, float(r.system_price)) for r in w.lake.read(declared.SPOT_BASE).collect()) == [(1, 11.0), (2, 10.0)]


def test_the_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 55
