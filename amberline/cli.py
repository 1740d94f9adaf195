"""Command line: ``python -m amberline.cli COMMAND``; without a command, ``bootstrap-storage``."""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Command:
    name: str
    help: str
    options: tuple[str, ...]
    run: Callable[[argparse.Namespace, object], object]


COMPANIES = ("tohoku", "chugoku", "shikoku")


def day(text: str) -> dt.date:
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text!r} is no date, as 2026-04-01 is one") from None


#: Arguments by name; each is asked for by the commands that take it.
OPTIONS: dict[str, dict] = {
    "fiscal-year": {"type": int, "help": "starts in April"},
    "from-year": {"type": int, "required": True},
    "to-year": {"type": int, "required": True},
    "pause": {"type": float, "default": 3.0, "help": "seconds between years"},
    "from-date": {"type": day},
    "to-date": {"type": day, "help": "from-date if left out"},
    "target-date": {"type": day, "required": True},
    "all": {"action": "store_true", "help": "all that is there, not only what was fetched"},
    "run-gold-step": {"action": "store_true"},
    "force": {"action": "store_true", "help": "again, though it was done"},
    "path": {"help": "of a raw object; the newest if left out"},
    "delete": {"action": "store_true", "help": "without it, only what would go is told"},
    "older-than-days": {"type": int, "default": 7},
    "action": {"choices": ("create", "drop", "view", "recreate"), "required": True},
    "name": {"help": "of a table or namespace"},
}


def this_year() -> int:
    from amberline.functions.slots import fiscal_year_of

    return fiscal_year_of(dt.date.today())


def span(a: argparse.Namespace) -> tuple[dt.date | None, dt.date | None]:
    lo, hi = a.from_date, a.to_date
    if hi and not lo:
        raise SystemExit("to-date needs from-date")
    if lo and hi and hi < lo:
        raise SystemExit("to-date is before from-date")
    return lo, hi


def scrape_days(dataset: str):
    def run(a, w):
        from amberline.sources.fetch import days

        return [w.scrape(dataset, d) for d in days(a.target_date, a.to_date)]

    return run


def land_day(dataset: str):
    def run(a, w):
        return w.land(dataset, a.path or w.resolve(dataset, a.target_date), a.target_date, force=a.force)

    return run


def land_spot(a, w):
    return w.land("jepx_spot_price", a.path or w.resolve("jepx_spot_price", a.fiscal_year or this_year()), force=a.force)


def raw_spot(a, w):
    from amberline.plans.orchestrate import raw_and_bronze

    return raw_and_bronze(w, "jepx_spot_price", a.fiscal_year or this_year(), "cli")


def orchestrate_spot(a, w):
    from amberline.plans.orchestrate import run_spot

    return run_spot(w, a.fiscal_year, a.all, a.run_gold_step)


def backfill(a, w):
    from amberline.plans.orchestrate import backfill_spot

    return backfill_spot(w, a.from_year, a.to_year, a.pause)


def orchestrate_units(a, w):
    from amberline.plans.orchestrate import run_units

    lo, hi = span(a)
    return run_units(w, lo or dt.date.today() - dt.timedelta(days=1), hi, a.all)


def bootstrap(a, w):
    for n in ("bronze", "silver", "gold", "metadata"):
        w.lake.create_namespace(n)
    return w.lake.namespaces()


def provision(prefix: str):
    def run(a, w):
        from amberline.plans.declared import TABLES

        return [w.lake.provision(t).number for n, t in TABLES.items() if n.startswith(prefix)]

    return run


def evolve(a, w):
    from amberline.plans.declared import TABLES

    return {n: w.lake.evolve_partition(t) for n, t in TABLES.items() if n.startswith("silver.") and w.lake.exists(n)}


def expire(a, w):
    out = {}
    for n in w.lake.tables("silver"):
        old = w.lake.expire(n, dt.timedelta(days=a.older_than_days), a.delete)
        out[n] = (len(old), w.lake.delete_orphans(n) if a.delete else len(w.lake.orphans(n)))
    return out


def namespace(a, w):
    if a.action == "view":
        return {n: w.lake.tables(n) for n in w.lake.namespaces()}
    return w.lake.create_namespace(a.name) if a.action == "create" else w.lake.drop_namespace(a.name)


def one_table(a, w):
    from amberline.plans.declared import TABLES

    if a.action in ("drop", "recreate"):
        w.lake.drop(a.name)
    return w.lake.provision(TABLES[a.name]).number if a.action in ("create", "recreate") else None


RANGE = ("from-date", "to-date")
SPOT_SCOPE = ("fiscal-year", "all")
COMMANDS = [
    Command("bootstrap-storage", "make the namespaces", (), bootstrap),
    Command("scrape-jepx", "fetch a year of spot prices", ("fiscal-year",), lambda a, w: w.scrape("jepx_spot_price", a.fiscal_year or this_year())),
    Command("ingest-jepx-raw-to-bronze", "a raw object to bronze", ("fiscal-year", "path", "force"), land_spot),
    Command("run-jepx-raw-pipeline", "fetch, then bronze", ("fiscal-year",), raw_spot),
    Command("run-jepx-orchestrator", "fetch to silver, or gold", (*SPOT_SCOPE, "run-gold-step"), orchestrate_spot),
    Command("ingest-jepx-bronze-to-silver", "bronze to silver", ("fiscal-year",), lambda a, w: w.silver_spot(a.fiscal_year)),
    Command("ingest-jepx-silver-to-gold", "silver to gold", ("fiscal-year",), lambda a, w: w.gold_spot(a.fiscal_year)),
    Command("backfill-jepx", "several years", ("from-year", "to-year", "pause"), backfill),
    Command("scrape-occto", "fetch days of unit generation", ("target-date", "to-date"), scrape_days("occto_unit_generation_actuals")),
    Command("ingest-occto-raw-to-bronze", "a raw object to bronze", ("target-date", "path", "force"), land_day("occto_unit_generation_actuals")),
    Command("ingest-occto-bronze-to-silver", "bronze to silver", RANGE, lambda a, w: w.silver_units(*span(a))),
    Command("run-occto-orchestrator", "fetch to silver", (*RANGE, "all"), orchestrate_units),
    Command("scrape-power-usage-hokuriku", "fetch usage reports", ("target-date", "to-date"), scrape_days("power_usage_hokuriku")),
    Command("ingest-power-usage-hokuriku-raw-to-bronze", "a report to bronze", ("target-date", "path", "force"), land_day("power_usage_hokuriku")),
    Command("ingest-power-usage-hokuriku-bronze-to-silver", "bronze to silver", RANGE, lambda a, w: w.silver_usage(*span(a))),
    *[c for x in COMPANIES for c in (
        Command(f"scrape-supply-demand-actuals-{x}", "fetch a yearly table", ("target-date", "to-date"), scrape_days(f"supply_demand_actuals_{x}")),
        Command(f"ingest-supply-demand-actuals-raw-to-bronze-{x}", "a day of it to bronze", ("target-date", "path", "force"), land_day(f"supply_demand_actuals_{x}")),
        Command(f"ingest-supply-demand-actuals-bronze-to-silver-{x}", "bronze to silver", RANGE, lambda a, w, x=x: w.silver_demand(x, *span(a))),
    )],
    Command("provision-silver-tables", "make or widen the silver tables", (), provision("silver.")),
    Command("evolve-silver-partition-spec", "lay tables out as declared", (), evolve),
    Command("expire-silver-snapshots", "drop old versions and orphans", ("older-than-days", "delete"), expire),
    Command("provision-metadata-tables", "make the run log", (), provision("metadata.")),
    Command("namespace", "create, drop or view namespaces", ("action", "name"), namespace),
    Command("table", "create, drop or recreate a table", ("action", "name"), one_table),
]


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("amberline", description=__doc__)
    p.add_argument("--root", default="file:///tmp/amberline-lake", help="folder of the lake and the raw store")
    p.add_argument("--source-folder", help="answer fetches from files here")
    p.add_argument("--base-url", default="", help="of the site that is fetched from")
    sub = p.add_subparsers(dest="command")
    for c in COMMANDS:
        s = sub.add_parser(c.name, help=c.help)
        for o in c.options:
            s.add_argument(f"--{o}", **OPTIONS[o])
    return p


def main(argv: list[str] | None = None, workspace=None) -> int:
    """0, or 1 if a step failed. Conflicting options end it (2) before anything is done."""
    argv = sys.argv[1:] if argv is None else argv
    p = build_parser()
    a = p.parse_args(argv if any(not x.startswith("-") for x in argv) or argv else ["bootstrap-storage"])
    if a.command is None:
        a = p.parse_args([*argv, "bootstrap-storage"])
    if getattr(a, "all", False) and (getattr(a, "fiscal_year", None) is not None or getattr(a, "from_date", None)):
        p.error("--all and a scope exclude each other")
    command = next(c for c in COMMANDS if c.name == a.command)
    if workspace is None:
        from amberline.plans.steps import Workspace
        from amberline.session import build_session
        from amberline.sources.fetch import FolderFetcher, HttpFetcher

        workspace = Workspace(build_session(), a.root, FolderFetcher(a.source_folder) if a.source_folder else HttpFetcher(), a.base_url)
    out = command.run(a, workspace)
    print(out)
    from amberline.plans.orchestrate import FAILED, Counts, Step, any_failed, verdict

    if isinstance(out, Counts):
        status, detail = verdict(out)
        print(status, detail)
        return int(status == FAILED)
    return int(isinstance(out, list) and bool(out) and isinstance(out[0], Step) and any_failed(out))


if __name__ == "__main__":
    sys.exit(main())
