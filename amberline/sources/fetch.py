"""Where raw bytes come from: requests that a site needs, and fetchers that answer them."""

from __future__ import annotations

import datetime as dt
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol


@dataclass(frozen=True)
class Request:
    """One step of a fetch; only the last step's answer counts."""

    url: str
    method: str = "GET"
    query: dict[str, str | list[str]] = field(default_factory=dict)
    form: dict[str, str | list[str]] = field(default_factory=dict)
    headers: dict[str, str] = field(default_factory=dict)
    file: str = ""  # the name of what it answers with, where the address does not say it


class Fetcher(Protocol):
    def fetch(self, steps: list[Request]) -> bytes: ...


class HttpFetcher:
    """Keeps cookies between the steps; an error status raises."""

    def __init__(self, timeout: float = 30.0):
        self.timeout, self.opener = timeout, urllib.request.build_opener(urllib.request.HTTPCookieProcessor())

    def fetch(self, steps: list[Request]) -> bytes:
        data = b""
        for s in steps:
            url = s.url + ("?" + urllib.parse.urlencode(s.query, doseq=True) if s.query else "")
            body = urllib.parse.urlencode(s.form, doseq=True).encode() if s.method == "POST" else None
            with self.opener.open(urllib.request.Request(url, body, dict(s.headers), method=s.method), timeout=self.timeout) as answer:
                data = answer.read()
        return data


class FolderFetcher:
    """Answers from files: the last step's file name, below a folder."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def fetch(self, steps: list[Request]) -> bytes:
        last = steps[-1]
        return (self.folder / (last.file or last.url.rsplit("/", 1)[-1])).read_bytes()


@dataclass(frozen=True)
class Feed:
    """A dataset's source: its site, its file name and steps for a scope (a fiscal year or a day), charset, whether it is packed."""

    dataset: str
    site: str
    charset: str
    file_name: Callable[[object], str]
    steps: Callable[[str, object], list[Request]]  # of the base address and the scope
    compress: bool = True


# The sites' addresses, file names and form fields.

SPOT_SITE, SPOT_PAGE = "https://www.jepx.jp", "/electricpower/market-data/spot/"
UNIT_SITE = "https://hatsuden-kokai.occto.or.jp/hks-web-public"
UNIT_AREAS = ["99", "01", "02", "03", "04", "05", "06", "07", "08", "09", "10"]
UNIT_METHODS = ["99", "01", "02", "03", "04", "05", "06", "07", "08", "09"]
UNIT_AGREED = "0"  # what the site's own page sends for consent
USAGE_SITE = "https://www.rikuden.co.jp/nw/denki-yoho/csv"
DEMAND_SITES = {
    "tohoku": ("https://setsuden.nw.tohoku-epco.co.jp/common/demand", "juyo_{}_tohoku.csv"),
    "chugoku": ("https://www.energia.co.jp/nw/jukyuu/sys", "juyo-{}.csv"),
    "shikoku": ("https://www.yonden.co.jp/nw/denkiyoho/csv", "juyo_shikoku_{}.csv"),
}


def spot_feed() -> Feed:
    def name(year: int) -> str:
        return f"spot_summary_{year}.csv"

    def steps(base: str, year: int) -> list[Request]:
        now = dt.datetime.now(dt.UTC).timestamp()
        headers = {"Content-Type": "application/x-www-form-urlencoded", "Referer": SPOT_SITE + SPOT_PAGE}
        return [Request(f"{base}/_download.php", "POST", {"timestamp": str(int(now * 1000))}, {"dir": "spot_summary", "file": name(year)}, headers, name(year))]

    return Feed("jepx_spot_price", SPOT_SITE, "cp932", name, steps)


def unit_feed() -> Feed:
    """Home, consent, search, file: the site hands out its file only in this order. Areas and methods that are not listed are
    left out of the answer, so all are."""

    def name(day: dt.date) -> str:
        return f"ユニット別発電実績_{day.isoformat()}.csv"

    def steps(base: str, day: dt.date) -> list[Request]:
        at = f"{day:%Y/%m/%d}"
        asked = {"htdnsCd": "", "htdnsNm": "", "unitNm": "", "areaCheckbox": UNIT_AREAS, "hatudenHosikiCheckbox": UNIT_METHODS, "tgtDateDateFrom": at, "tgtDateDateTo": at}
        consent = Request(f"{base}/disclaimer-agree/next", "POST", form={"agreed": UNIT_AGREED})
        return [Request(f"{base}/home"), consent, Request(f"{base}/info/hks/search", "POST", form=asked), Request(f"{base}/info/hks/downloadCsv", query=asked, file=name(day))]

    return Feed("occto_unit_generation_actuals", UNIT_SITE, "utf-8-sig", name, steps)


def usage_feed() -> Feed:
    name = lambda day: f"juyo_05_{day:%Y%m%d}.csv"
    return Feed("power_usage_hokuriku", USAGE_SITE, "cp932", name, lambda base, day: [Request(f"{base}/{name(day)}")])


def demand_feed(company: str) -> Feed:
    site, pattern = DEMAND_SITES[company]
    name = lambda day: pattern.format(day.year)
    return Feed(f"supply_demand_actuals_{company}", site, "cp932", name, lambda base, day: [Request(f"{base}/{name(day)}")])


FEEDS: dict[str, Feed] = {f.dataset: f for f in (spot_feed(), unit_feed(), usage_feed(), *map(demand_feed, DEMAND_SITES))}


def days(lo: dt.date, hi: dt.date | None = None) -> Iterator[dt.date]:
    at = lo
    while at <= (hi or lo):
        yield at
        at += dt.timedelta(days=1)
