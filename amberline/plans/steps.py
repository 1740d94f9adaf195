"""Steps of the pipelines: source to raw, raw to bronze, bronze to silver, silver to gold. Each returns what it counted."""

from __future__ import annotations

import csv
import datetime as dt
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.functions.holidays import holiday_table
from amberline.functions.slots import Window
from amberline.operators import rows
from amberline.operators.tables import Lake, TableSpec, stamp, validate_then_write
from amberline.plans import declared, gold, silver
from amberline.sources import reports
from amberline.sources.fetch import FEEDS, Fetcher
from amberline.sources.raw import RawStore, Snapshot, read_csv

log = logging.getLogger(__name__)


@dataclass
class Counts:
    """Rows staged and dropped, and of each table the rows due and written. long_due: of tables that have several rows for a
    staged one; a verdict looks at them, the run log does not count them."""

    staged: int = 0
    dropped: int = 0
    due: dict[str, int] = field(default_factory=dict)
    written: dict[str, int] = field(default_factory=dict)
    long_due: dict[str, int] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    @property
    def valid(self) -> int:
        return self.staged - self.dropped


class Workspace:
    """A session, the lake and the raw store, and where feeds come from."""

    def __init__(self, spark: SparkSession, root: str, fetcher: Fetcher | None = None, base: str = ""):
        self.spark, self.lake, self.raw, self.fetcher, self.base = spark, Lake(spark, f"{root.rstrip('/')}/lake"), RawStore(spark, f"{root.rstrip('/')}/store"), fetcher, base

    # -- raw --

    def scrape(self, dataset: str, scope: int | dt.date, execution_id: str | None = None) -> Snapshot:
        """Fetches a scope's file (a fiscal year for spot prices, a day otherwise); keeps it if it is new."""
        feed = FEEDS[dataset]
        data = self.fetcher.fetch(feed.steps(self.base or feed.site, scope))
        where = {"fiscal_year": scope} if isinstance(scope, int) else {"day": scope}
        return self.raw.put(dataset, feed.file_name(scope), data, compress=feed.compress, execution_id=execution_id, **where)

    def resolve(self, dataset: str, scope: int | dt.date, unprocessed: bool = False) -> str:
        return self.raw.latest(dataset, fiscal_year=scope, unprocessed=unprocessed) if isinstance(scope, int) else self.raw.latest(dataset, day=scope, unprocessed=unprocessed)

    # -- bronze --

    def land(self, dataset: str, path: str, day: dt.date | None = None, execution_id: str | None = None, force: bool = False) -> int:
        """An object's rows as text, appended to the dataset's bronze tables, once for each object (or day of a yearly file)
        unless forced; how many."""
        frames = self.parse(dataset, path, day)
        done = 0
        for spec, df in frames:
            seen = {"target_date": day.isoformat()} if dataset.startswith("supply_demand") else {"source_data": path}
            if not force and self.lake.has_rows(spec, **seen):
                log.info("%s is in %s already", seen, spec.name)
                continue
            self.lake.append(spec, stamp(df, "new", execution_id, path))
            done += df.count()
        self.raw.mark_processed(path)
        return done

    def parse(self, dataset: str, path: str, day: dt.date | None) -> list[tuple[TableSpec, DataFrame]]:
        feed, spark = FEEDS[dataset], self.spark
        if dataset in ("jepx_spot_price", "occto_unit_generation_actuals"):
            spec = declared.SPOT if dataset == "jepx_spot_price" else declared.UNITS
            df = read_csv(spark, path, feed.charset)
            df = df.select(*[F.col(f"`{h}`").alias(spec.sources[h]) for h in df.columns if h in spec.sources])
            return [(spec, df.withColumn("unit_name", F.coalesce("unit_name", F.lit(""))) if "unit_name" in df.columns else df)]
        text = self.raw.text(path, feed.charset)
        if dataset == "power_usage_hokuriku":
            specs = (declared.USAGE_SUMMARY, declared.USAGE_HOURLY, declared.USAGE_FIVE)
            return [(s, spark.createDataFrame([x], ", ".join(f"`{c}` string" for c in x))) for s, x in zip(specs, reports.read_report(text, day), strict=True)]
        company = dataset.rsplit("_", 1)[1]
        return [(declared.DEMANDS[company], year_rows(spark, text, company, day))]

    # -- silver --

    def silver_spot(self, fiscal_year: int | None = None, execution_id: str | None = None) -> Counts:
        window = Window.fiscal(fiscal_year) if fiscal_year is not None else None
        staged = silver.stage_spot(self.lake.read(declared.SPOT), window).cache()
        try:
            out = self._write(staged, [(declared.SPOT_BASE, silver.spot_base(staged)), (declared.SPOT_BLOCK, silver.spot_block(staged)), (declared.SPOT_AREA, silver.spot_area(staged))], window, execution_id)
            del out.due[declared.SPOT_AREA.name]
            out.long_due[declared.SPOT_AREA.name] = rows.valid(staged).agg(sum((F.count(c) for c in silver.AREA_PRICES), F.lit(0))).first()[0]
            return out
        finally:
            staged.unpersist()

    def silver_units(self, lo: dt.date | None = None, hi: dt.date | None = None, execution_id: str | None = None) -> Counts:
        window = Window.days(lo, hi) if lo else None
        staged = silver.stage_units(self.lake.read(declared.UNITS), window).cache()
        try:
            out = self._write(staged, [(declared.UNIT_GENERATION, silver.unit_generation(staged))], window, execution_id)
            out.due = {declared.UNIT_GENERATION.name: out.valid * 48}
            n, most = silver.amount_mismatches(staged).first()
            if n:
                out.notes.append(f"{n} daily amounts differ from their slots, by {most} at most")
            return out
        finally:
            staged.unpersist()

    def silver_usage(self, lo: dt.date | None = None, hi: dt.date | None = None, execution_id: str | None = None) -> Counts:
        window, read = Window.days(lo, hi) if lo else None, self.lake.read
        made = [
            (declared.USED_SUMMARY, silver.usage_summary(read(declared.USAGE_SUMMARY), reports.SUMMARY_FIELDS, window)),
            (declared.USED_HOURLY, silver.usage_hourly(read(declared.USAGE_HOURLY), window)),
            (declared.USED_FIVE, silver.usage_five_minutes(read(declared.USAGE_FIVE), window)),
        ]
        days = silver.latest_report(read(declared.USAGE_SUMMARY), window).filter("_day IS NOT NULL").count()
        due = {declared.USED_SUMMARY.name: days, declared.USED_HOURLY.name: days * 24, declared.USED_FIVE.name: days * 288}
        return self._write(None, made, window, execution_id, due)

    def silver_demand(self, company: str, lo: dt.date | None = None, hi: dt.date | None = None, execution_id: str | None = None) -> Counts:
        window = Window.days(lo, hi) if lo else None
        spec, made = declared.DEMANDED[company], silver.supply_demand(self.lake.read(declared.DEMANDS[company]), company, window)
        return self._write(None, [(spec, made)], window, execution_id, {spec.name: made.count()})

    def _write(self, staged: DataFrame | None, made: list[tuple[TableSpec, DataFrame]], window: Window | None, execution_id: str | None, due: dict[str, int] | None = None) -> Counts:
        """due: of each table, where it is not every valid staged row. What was written is counted in the committed files."""
        out = Counts(due=dict(due or {}))
        if staged is not None:
            out.staged, out.dropped = staged.agg(F.count(F.lit(1)), rows.dropped()).first()
            out.due = {spec.name: out.valid for spec, _ in made}
            if out.dropped:
                out.notes += [f"{r['violation']}: {r['rows']}" for r in rows.violation_summary(staged).collect()]
        else:
            out.staged = max(out.due.values(), default=0)
        out.written = self._commit([(spec, stamp(df, "loaded", execution_id), window) for spec, df in made])
        return out

    def _commit(self, jobs: list[tuple[TableSpec, DataFrame, Window | None]]) -> dict[str, int]:
        versions = validate_then_write(self.lake, jobs)
        return {spec.name: v.rows if v else 0 for (spec, _, _), v in zip(jobs, versions, strict=True)}

    # -- gold --

    def gold_spot(self, fiscal_year: int | None = None, execution_id: str | None = None) -> Counts:
        """All three tables from one join; the fact table takes the window that the daily rows have."""
        window = Window.fiscal(fiscal_year) if fiscal_year is not None else None
        prices = gold.joined(self.lake.read(declared.SPOT_AREA, window), self.lake.read(declared.SPOT_BASE, window), window).cache()
        try:
            daily = gold.daily(prices)
            found = gold.day_range(prices)
            if found is None:
                return Counts()
            span = window or Window.days(*found)
            profile = gold.period_profile(prices, holiday_table(self.spark, *found))
            months = Window.days(found[0].replace(day=1), found[1]) if window is None else window
            made = [(declared.GOLD_DAILY, daily, span), (declared.GOLD_PROFILE, profile, months), (declared.GOLD_SPREAD, gold.area_spread(prices), span)]
            out = Counts(due={s.name: df.count() for s, df, _ in made})
            out.staged = out.due[declared.GOLD_DAILY.name]
            out.notes = [f"{r['delivery_date']} {r['area_name']}: {r['time_code_count']} slots" for r in gold.incomplete_days(daily).collect()]
            out.written = self._commit([(s, stamp(df, "loaded", execution_id, "silver.jepx_spot_price_area+silver.jepx_spot_price_base"), w) for s, df, w in made])
            return out
        finally:
            prices.unpersist()


def year_rows(spark: SparkSession, text: str, company: str, day: dt.date) -> DataFrame:
    """One day's rows of a yearly table, dates and hours written alike; cells may be quoted. A date that cannot be read is an
    error. A year's file has some thousand lines, of which one day's become rows."""
    lines = csv.reader(text.splitlines()[reports.YEAR_SKIP[company] :])
    header, metrics = next(lines), list(silver.COMPANIES[company])
    found = []
    for cells in filter(any, lines):
        when = dt.datetime.strptime(cells[header.index("DATE")], "%Y/%m/%d").date()
        if when == day:
            hour, minute = cells[header.index("TIME")].split(":")[:2]
            values = [c for h, c in zip(header, cells, strict=False) if h not in reports.YEAR_COLUMNS][: len(metrics)]
            found.append((when.isoformat(), f"{int(hour):02d}:{minute}", *values))
    return spark.createDataFrame(found, ", ".join(f"{c} string" for c in ("target_date", "target_time", *metrics)))
