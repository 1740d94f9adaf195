"""Pipelines of steps: verdicts, the run log, daily runs and backfills."""

from __future__ import annotations

import datetime as dt
import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from amberline.functions.slots import fiscal_year_of
from amberline.operators.tables import stamp
from amberline.plans import declared
from amberline.plans.steps import Counts, Workspace
from amberline.sources.fetch import days

log = logging.getLogger(__name__)
SUCCESS, FAILED, SKIPPED = "success", "failed", "skipped"


@dataclass(frozen=True)
class Step:
    name: str
    status: str
    scope: str = ""
    detail: str = ""
    due: int | None = None
    written: int | None = None
    started: dt.datetime | None = None
    ended: dt.datetime | None = None

    @property
    def seconds(self) -> float | None:
        return (self.ended - self.started).total_seconds() if self.started and self.ended else None


def verdict(counts: Counts) -> tuple[str, str]:
    """Nothing staged, nothing due or another number of rows than due is a failure."""
    if not counts.staged:
        return FAILED, "no rows were staged"
    for table, n in (counts.due | counts.long_due).items():
        if not n:
            return FAILED, f"{table}: no rows were due"
        if counts.written.get(table) != n:
            return FAILED, f"{table}: {n} rows were due, {counts.written.get(table)} were written"
    return SUCCESS, "; ".join(counts.notes)


def timed(name: str, scope: str, work: Callable[[], Step]) -> Step:
    """Runs a step; an exception is a failed step, not the end of the run."""
    started = dt.datetime.now(dt.UTC)
    try:
        out = work()
    except Exception as e:
        log.exception("%s failed", name)
        out = Step(name, FAILED, scope, f"{type(e).__name__}: {e}"[:500])
    return replace(out, started=started, ended=dt.datetime.now(dt.UTC))


def counted(name: str, scope: str, work: Callable[[], Counts]) -> Step:
    def run() -> Step:
        counts = work()
        status, detail = verdict(counts)
        return Step(name, status, scope, detail, sum(counts.due.values()), sum(counts.written.get(t, 0) for t in counts.due))

    return timed(name, scope, run)


def any_failed(steps: list[Step]) -> bool:
    return any(s.status == FAILED for s in steps)


def record(w: Workspace, run_id: str, pipeline: str, steps: list[Step]) -> bool:
    """One row for each step. If it cannot be written, that is logged and the run goes on."""
    today = dt.datetime.now(dt.UTC).date()
    rows = [(run_id, i, pipeline, s.name, s.status, s.started, s.ended, s.seconds, s.due, s.written, s.scope, s.detail, today) for i, s in enumerate(steps, 1)]
    schema = declared.RUN_LOG.schema
    try:
        df = w.spark.createDataFrame(rows, type(schema)(schema.fields[:13]))
        w.lake.append(declared.RUN_LOG, stamp(df, execution_id=run_id))
    except Exception:
        log.exception("the run log was not written")
        return False
    return True


def raw_and_bronze(w: Workspace, dataset: str, scope: int | dt.date, run_id: str) -> list[Step]:
    day = scope if isinstance(scope, dt.date) else None

    def fetch() -> Step:
        s = w.scrape(dataset, scope, run_id)
        return Step("source_to_raw", SUCCESS, str(scope), s.path or "unchanged")

    def land() -> Step:
        try:
            path = w.resolve(dataset, scope, unprocessed=True)
        except ValueError as e:
            return Step("raw_to_bronze", SKIPPED, str(scope), str(e))
        n = w.land(dataset, path, day, run_id)
        return Step("raw_to_bronze", SUCCESS, str(scope), path, n, n)

    first = timed("source_to_raw", str(scope), fetch)
    return [first] if first.status == FAILED else [first, timed("raw_to_bronze", str(scope), land)]


def run_spot(w: Workspace, fiscal_year: int | None = None, all_years: bool = False, with_gold: bool = False, run_id: str | None = None) -> list[Step]:
    """A year's prices from the source to silver, and to gold if asked for. Later steps take the year just fetched, or all."""
    run_id = run_id or str(uuid.uuid4())
    year = fiscal_year if fiscal_year is not None else fiscal_year_of(dt.datetime.now(dt.UTC).date())
    steps = raw_and_bronze(w, "jepx_spot_price", year, run_id)
    scope = None if all_years else year
    name = "all" if scope is None else str(scope)
    if not any_failed(steps):
        steps.append(counted("bronze_to_silver", name, lambda: w.silver_spot(scope, run_id)))
    if with_gold and not any_failed(steps):
        steps.append(counted("silver_to_gold", name, lambda: w.gold_spot(scope, run_id)))
    record(w, run_id, "jepx_spot_price", steps)
    return steps


def backfill_spot(w: Workspace, first: int, last: int, pause: float = 3.0, run_id: str | None = None) -> list[Step]:
    """Raw and bronze year by year - a year that fails does not stop the next - and silver once over all."""
    run_id = run_id or str(uuid.uuid4())
    steps: list[Step] = []
    for year in range(first, last + 1):
        if year > first and pause:
            time.sleep(pause)
        steps += raw_and_bronze(w, "jepx_spot_price", year, run_id)
    steps.append(counted("bronze_to_silver", "all", lambda: w.silver_spot(None, run_id)))
    record(w, run_id, "jepx_spot_price_backfill", steps)
    return steps


def run_units(w: Workspace, lo: dt.date, hi: dt.date | None = None, all_days: bool = False, run_id: str | None = None) -> list[Step]:
    """Raw and bronze day by day, silver once over the days, or over all."""
    run_id, hi = run_id or str(uuid.uuid4()), hi or lo
    steps: list[Step] = []
    for day in days(lo, hi):
        steps += raw_and_bronze(w, "occto_unit_generation_actuals", day, run_id)
    if any(s.status == SUCCESS for s in steps if s.name == "raw_to_bronze") or all_days:
        steps.append(counted("bronze_to_silver", "all" if all_days else f"{lo}..{hi}", lambda: w.silver_units(None if all_days else lo, None if all_days else hi, run_id)))
    record(w, run_id, "occto_unit_generation_actuals", steps)
    return steps
