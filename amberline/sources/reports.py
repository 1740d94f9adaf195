"""Daily usage reports: one text of eleven blocks, and yearly hour tables with lines before the header. Pure functions."""

from __future__ import annotations

import datetime as dt

from amberline.plans.silver import FIVE_METRICS, HOUR_METRICS, five_column, hour_column

# The columns that a report's summary blocks have, in the order of their cells.
_SUPPLY = ("capacity", "time_range", "updated_date", "updated_time", "reserve_margin_pct", "usage_rate_pct")
_DEMAND = ("demand", "time_range", "updated_date", "updated_time")
# The four summary blocks of a day, by what their columns begin with.
_BLOCKS = (("peak_supply", _SUPPLY), ("forecasted_peak", _DEMAND), ("usage_rate_peak_supply", _SUPPLY), ("usage_rate_peak_forecasted", _DEMAND))


def _summary(day: str) -> list[tuple[str, ...]]:
    return [tuple(f"{day}_{block}_{c}" for c in cells) for block, cells in _BLOCKS]


MOST_USED = ("today_max_usage_rate_pct", "today_max_usage_rate_time_range")
SUMMARY_FIELDS = (*(c for b in _summary("today") for c in b), *MOST_USED, *(c for b in _summary("next_day") for c in b))
KEYS = ("target_date", "file_updated_at")
#: What stands in each block, in order: columns of one line, or (rows, metrics, naming) of a table.
LAYOUT = [*_summary("today"), (24, tuple(HOUR_METRICS), hour_column), MOST_USED, *_summary("next_day"), (288, tuple(FIVE_METRICS), five_column)]


class BadReport(ValueError):
    """The text is no report."""


def cells(line: str, n: int, skip: int = 0) -> list[str]:
    """n cells after those skipped; more are allowed where they are empty."""
    found = line.split(",")[skip:]
    if len(found) < n or any(found[n:]):
        raise BadReport(f"{n} cells are due, not {len(found)}: {line[:80]!r}")
    return found[:n]


def blocks(lines: list[str], padded: bool) -> list[list[str]]:
    """Runs of lines between separators: empty lines, or lines of empty cells where every line is padded."""
    out: list[list[str]] = [[]]
    for line in lines:
        if (line.strip(",") if padded else line) == "":
            out.append([])
        else:
            out[-1].append(line)
    return [b for b in out if b]


def read_blocks(found: list[list[str]]) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    if len(found) != len(LAYOUT):
        raise BadReport(f"{len(LAYOUT)} blocks are due, not {len(found)}")
    summary: dict[str, str] = {}
    tables: list[dict[str, str]] = []
    for block, form in zip(found, LAYOUT, strict=True):
        body = block[1:]  # the header's wording has changed over the years: columns go by position
        if isinstance(form[0], int):
            n, metrics, name = form
            if len(body) != n:
                raise BadReport(f"{n} lines are due, not {len(body)}")
            tables.append({name(i, m): v for i, line in enumerate(body) for m, v in zip(metrics, cells(line, len(metrics), skip=2), strict=True)})
        else:
            if len(body) != 1:
                raise BadReport(f"one line is due, not {len(body)}")
            summary |= dict(zip(form, cells(body[0], len(form)), strict=True))
    return summary, tables[0], tables[1]


def read_report(text: str, day: dt.date) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Summary, hours and five minutes of one report, each one wide row. Separators are empty lines; only if these do not fit,
    lines of empty cells, as an unpublished day is such a line too."""
    lines = text.splitlines()
    if not lines:
        raise BadReport("the text is empty")
    try:
        found = read_blocks(blocks(lines[1:], padded=False))
    except BadReport:
        found = read_blocks(blocks(lines[1:], padded=True))
    keys = dict(zip(KEYS, (day.isoformat(), lines[0]), strict=True))
    return tuple(keys | x for x in found)


# Lines before the header in a company's yearly table.
YEAR_SKIP = {"tohoku": 1, "chugoku": 2, "shikoku": 2}
YEAR_COLUMNS = {"DATE": "target_date", "TIME": "target_time"}
