"""Secret scans: fixed patterns, and windows of high entropy.

Candidate strings are runs of letters, digits, ``+ / _ -`` of at least WINDOW characters. A window slides over each; for each
character class (hex digits; letters, digits and signs) its Shannon entropy follows from counts that change by one
character in and one out. Where a window lies wholly in a class and reaches the class's threshold, the candidate is a
span of kind ``entropy``. Suppressed are: candidates inside a span that a pattern gave, and those on the allow-list
(UUIDs, placeholders, paths, plain words, runs that ascend). Patterns stay as they are.

A null text counts as empty and has no spans. Only the key and the text are read. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm.common import map_rows, table, text_or_empty

KINDS = ("assign", "access", "hex", "entropy")

# Expression of each kind, the group whose length counts, and the least length.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),  # a run of 32 or more is the run that [0-9a-f]+ finds
}

WINDOW = 20
#: Bits a character; windows of WINDOW characters of random hex digits have about 3.4, of random letters and digits 4.1.
THRESHOLD = {"hex": 3.0, "base64": 3.8}
CLASS = {"hex": frozenset("0123456789abcdefABCDEF"), "base64": frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % WINDOW)
ALLOW = [
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"[0-9+/_-]+"),  # numbers and dates
]
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|your[_-]|dummy|sample|xxxx|0123456789|abcdefgh")
JOINT, WORD, NUMBER = re.compile(r"[/_+-]"), re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*"), re.compile(r"[0-9]{1,4}")
#: c * log2(c) for each count a window can have, and one more before the oldest character goes.
TERM = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 2)]


def window_entropy(candidate: str, kind: str) -> float:
    """The highest entropy of a window that lies in the class; 0 if none does."""
    allowed, counts, total, run, best = CLASS[kind], {}, 0.0, 0, 0.0
    for i, c in enumerate(candidate):
        if c not in allowed:
            counts, total, run = {}, 0.0, 0
            continue
        n = counts.get(c, 0)
        total += TERM[n + 1] - TERM[n]
        counts[c] = n + 1
        run += 1
        if run > WINDOW:
            old = candidate[i - WINDOW]
            n = counts[old]
            total -= TERM[n] - TERM[n - 1]
            counts[old] = n - 1
        if run >= WINDOW:
            best = max(best, math.log2(WINDOW) - total / WINDOW)
    return best


def is_slug(candidate: str) -> bool:
    """Words, paths, slugs: between joints, words of one case or, after the first, short numbers. Each piece is looked at once."""
    first, *rest = JOINT.split(candidate)
    return bool(WORD.fullmatch(first)) and all(WORD.fullmatch(x) or NUMBER.fullmatch(x) for x in rest)


def is_allowed(candidate: str) -> bool:
    return bool(any(x.fullmatch(candidate) for x in ALLOW) or PLACEHOLDER.search(candidate) or is_slug(candidate))


def is_secret(candidate: str) -> bool:
    if is_allowed(candidate):
        return False
    has_digit = any(c.isdigit() for c in candidate)
    has_upper, has_lower = any("A" <= c <= "Z" for c in candidate), any("a" <= c <= "z" for c in candidate)
    if window_entropy(candidate, "hex") >= THRESHOLD["hex"] and has_digit and (has_upper or has_lower):
        return True
    return has_digit + has_upper + has_lower == 3 and window_entropy(candidate, "base64") >= THRESHOLD["base64"]


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) in code points, leftmost and non-overlapping within each kind."""
    out = []
    for k, (pattern, group, least) in enumerate(PATTERNS.values()):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def entropy_spans(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """found: sorted spans of the patterns. Candidates and spans are gone through once, side by side."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while i < len(found) and found[i][0] < m.end():
            reach = max(reach, found[i][2])
            i += 1
        if reach <= m.start() and is_secret(m[0]):
            out.append((m.start(), 3, m.end()))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", with_spans: bool = False) -> DataFrame:
    """key, n_assign, n_access, n_hex, n_entropy, base_sha256, spans; with_spans adds found, an array of (kind, from, to)."""

    def make():
        def work(rows: dict[str, list]) -> dict[str, list]:
            base = [pattern_spans(t) for t in rows["t"]]
            more = [entropy_spans(t, b) for t, b in zip(rows["t"], base, strict=True)]
            every = [sorted(b + m) for b, m in zip(base, more, strict=True)]
            out = {"k": rows["k"]}
            out |= {f"n_{name}": [sum(s[1] == k for s in x) for x in every] for k, name in enumerate(KINDS)}
            out |= {"base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b in base], "spans": [written(x) for x in every]}
            if with_spans:
                out["found"] = [[{"kind": KINDS[k], "from": s, "to": e} for s, k, e in x] for x in every]
            return out

        return work

    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string" + (", found array<struct<kind: string, `from`: int, `to`: int>>" if with_spans else "")
    return map_rows(df.select(F.col(key).alias("k"), text_or_empty(text).alias("t")), make, schema).withColumnRenamed("k", key)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
