"""Chat formatting: transcripts parsed by a hidden Markov model, roles recovered by Viterbi, turns rendered canonically.

A transcript is a conversation's rows in order, each split into lines. A line shows: the speaker its marker names (the role
column on a row's first line, or a marker such as ``User:`` at the line's start), whether it starts a row, whether it asks,
its length, whether it looks like a list or code. States are (role, first or later line of a turn). How roles follow each
other and which lines they write is counted on the rows whose role is known. A row whose role is known stays whole: its lines
are of that role, unless a line of it has a marker of its own. Such markers, and those in rows of no known role, are trusted
up to a fixed doubt, so a missing, unknown or contradicted marker is decided by what stands around it.

Conversations are cut into parts of PART turns, by turn number. The best path through a part is, for each state before it
and each state at its end, a number; these small matrices, combined in order, give the states at the borders, and each
part is then decoded on its own. The result is that of one Viterbi run over the whole conversation, and no task holds
more than a part. The result's key is (conversation, part): a conversation of more than PART turns has several rows, and
``continues`` says whether a part's first turn goes on from the part before.

A null text is an empty line. A null or unknown role is no marker. Rows with a null turn come first, equal turns in the order of
role and text. A null conversation is a conversation of its own. Extra columns are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from amberline.llm.common import join_by_size, table

ROLES = ("system", "user", "assistant")
#: Names that markers use, by role.
NAMES = {"system": ("system", "developer", "instruction", "instructions", "context"), "user": ("user", "human", "customer", "prompter", "question", "q"), "assistant": ("assistant", "ai", "bot", "gpt", "model", "agent", "answer", "a")}
ROLE_OF = {name: ROLES.index(role) for role, names in NAMES.items() for name in names}
MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|<\||\[)?([A-Za-z]{1,12})(?:\*\*|\|>|\])?\s*:\s?(?:\*\*\s?)?|^\s*(?:#{2,4}\s*|<\||\[)([A-Za-z]{2,12})(?:\|>|\])?\s*$")
LISTED = re.compile(r"^\s*(?:[-*+•]\s|\d{1,3}[.)]\s|```|\||    \S)")
PART = 512
DOUBT = 0.02  # how often a marker names another role than the one who speaks
FEATURES = {"asks": 2, "size": 5, "listed": 2}
SIZES = (40, 120, 300, 800)


def marker(line: str) -> tuple[int | None, str]:
    """The role that a marker at the line's start names, and the line without it."""
    m = MARKER.match(line)
    role = ROLE_OF.get((m[1] or m[2]).lower()) if m else None
    return (None, line) if role is None else (role, line[m.end() :])


def features(line: str) -> dict[str, int]:
    return {"asks": int(line.rstrip().endswith("?")), "size": sum(len(line) >= s for s in SIZES), "listed": int(bool(LISTED.match(line)))}


class Model:
    """States 0..2: first line of a turn of a role; 3..5: a later line of it. Everything in logs."""

    def __init__(self, first: np.ndarray, follow: np.ndarray, lines: dict[str, np.ndarray], stay: np.ndarray):
        """first: counts of the role that begins. follow: of role after role. lines: by feature, role x value. stay: by role,
        later lines and turns."""
        share = lambda x: np.log((x + 1) / (x + 1).sum(-1, keepdims=True))
        more = (stay[:, 0] + 1) / (stay.sum(1) + 2)
        self.start = np.concatenate([share(first), np.full(3, -np.inf)])
        self.step = np.full((6, 6), -np.inf)
        follows = np.log((1 - DOUBT) * np.exp(share(follow)) + DOUBT / 3)  # a role may follow itself, though it never has
        for a in range(6):
            self.step[a, :3] = np.log1p(-more[a % 3]) + follows[a % 3]
            self.step[a, 3 + a % 3] = math.log(more[a % 3])
        self.lines = {k: np.tile(share(v), (2, 1)) for k, v in lines.items()}
        self.marks = np.full((4, 6), 0.0)  # by marked role, or none
        for r in range(3):
            self.marks[r] = np.log(DOUBT / 3)
            self.marks[r, r] = math.log1p(-DOUBT)
        self.row = np.zeros((2, 6))  # a row's first line begins a turn, other lines seldom do
        self.row[1, 3:] = math.log(DOUBT)
        self.row[0, :3] = math.log(DOUBT)

    def emission(self, mark: int | None, first: bool, inline: bool, line: str, held: bool) -> np.ndarray:
        f = features(line)
        out = self.marks[3 if mark is None else mark] + self.row[int(first or inline)] + sum(self.lines[k][:, v] for k, v in f.items())
        if held:  # the row's role is known, and the line has no marker of its own
            out = np.where(np.arange(6) % 3 == mark if first else np.arange(6) > 2, out, -np.inf)
        return out


def known_role(role: str | None) -> int | None:
    return ROLE_OF.get((role or "").strip().lower())


def lines_of(rows: list[tuple[str | None, str | None]]) -> list[tuple[int | None, bool, bool, str, bool]]:
    """(marked role, starts a row, has its own marker, text, whether the row's known role holds) of each line of (role, text)
    rows."""
    out = []
    for role, text in rows:
        known = known_role(role)
        for n, line in enumerate((text or "").split("\n")):
            own, rest = marker(line)
            mark = own if own is not None else known if not n else None
            out.append((mark, not n, own is not None, rest, known is not None and own is None))
    return out


def forward(model: Model, lines: list, begin: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """begin: rows of log weights of the state before, by which the start differs. Best weight of each end state for each
    row, and where each came from."""
    now, back = begin, []
    for i, line in enumerate(lines):
        e = model.emission(*line)
        if i or begin.shape[1] == 6:
            ways = now[:, :, None] + model.step[None]
            back.append(ways.argmax(1))
            now = ways.max(1) + e
        else:
            now = model.start[None] + e
    return now, back


def decode(model: Model, rows: list[tuple[str | None, str | None]], before: int | None = None, after: int | None = None) -> tuple[list[int], list]:
    """State of each line on the best path; before and after: the states that border it, where known."""
    lines = lines_of(rows)
    begin = np.zeros((1, 0)) if before is None else np.where(np.arange(6) == before, 0.0, -np.inf)[None]
    now, back = forward(model, lines, begin)
    state = int(now[0].argmax()) if after is None else after
    path = [state]
    for b in reversed(back[1:] if before is not None else back):
        path.append(int(b[0, path[-1]]))
    return path[::-1], lines


def matrix(model: Model, rows: list, is_first: bool) -> list[float]:
    """Best weight from each state before the rows to each state at their end; one row only if nothing is before."""
    with np.errstate(invalid="ignore"):
        begin = np.zeros((1, 0)) if is_first else np.where(np.eye(6) > 0, 0.0, -np.inf)
        return forward(model, lines_of(rows), begin)[0].ravel().tolist()


def borders(parts: list[int], matrices: list[list[float]]) -> list[tuple[int, int | None, int]]:
    """(part, state before it, state at its end) of one conversation's parts in order."""
    best, back = np.array(matrices[0])[None], []
    for m in matrices[1:]:
        ways = best[0][:, None] + np.array(m).reshape(6, 6)
        back.append(ways.argmax(0))
        best = ways.max(0)[None]
    ends = [int(best[0].argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return [(p, None if not i else ends[i - 1], ends[i]) for i, p in enumerate(parts)]


def turns(path: list[int], lines: list, opened: bool = True) -> list[tuple[str, str]]:
    """(role, text) of the turns on a path; opened: whether the first line begins one whatever its state."""
    out: list[tuple[str, list[str]]] = []
    for i, (state, line) in enumerate(zip(path, lines, strict=True)):
        if state < 3 or (not i and opened) or not out:
            out.append((ROLES[state % 3], []))
        out[-1][1].append(line[3].rstrip())
    return [(role, "\n".join(text).strip()) for role, text in out]


def render(found: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in found)


def fit(rows: DataFrame) -> Model:
    """Counts over all rows with a known role; what comes to the driver are 3 x 3 and 3 x value tables."""
    known = rows.withColumn("r", F.element_at(F.create_map(*[F.lit(x) for name, r in ROLE_OF.items() for x in (name, r)]), F.lower(F.trim("role")))).filter("r is not null")
    first, follow, stay = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 2))
    for r in known.filter("turn = 0").groupBy("r").count().collect():
        first[r["r"]] = r["count"]
    at = known.groupBy("conv_id", "turn", "r").agg(F.count(F.lit(1)).alias("n"))  # repeated turns: at most a row for each role
    ahead = at.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("r").alias("before"), F.col("n").alias("m"))
    for r in at.join(ahead, ["conv_id", "turn"]).groupBy("before", "r").agg(F.sum(F.least("n", "m")).alias("count")).collect():
        follow[r["before"], r["r"]] = r["count"]
    line = F.col("line")
    listed = line.rlike(LISTED.pattern)
    size = sum((F.length(line) >= s).cast("int") for s in SIZES)
    shown = known.select("r", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    counts = shown.groupBy("r", (F.col("i") > 0).cast("int").alias("later"), F.endswith(F.rtrim("line"), F.lit("?")).cast("int").alias("asks"), size.alias("size"), listed.cast("int").alias("listed")).count().collect()
    by = {k: np.zeros((3, n)) for k, n in FEATURES.items()}
    for r in counts:
        stay[r["r"], 1 - r["later"]] += r["count"]
        for k in FEATURES:
            by[k][r["r"], r[k]] += r["count"]
    return Model(first, follow, by, stay)


def format_chats(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each part of each conversation (most have one): conv_id, part, n_rows, n_turns, roles, rendered,
    rendered_sha256, continues, n_changed (rows whose given role was unknown and is now recovered, or of which a line with a
    marker of its own made a part another role's)."""
    rows = df.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    model = fit(rows)
    rows = rows.withColumn("part", F.coalesce(F.greatest(F.expr(f"turn div {PART}"), F.lit(0)), F.lit(0)).cast("bigint"))
    spark, kind = df.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    # conversations of several parts: their borders first
    long = rows.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
    work = rows
    if not long.isEmpty():
        of_long = join_by_size(rows, long.select(F.col("conv_id").alias("c"), "lo"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
        made = sorted_parts(of_long, ["lo"]).mapInArrow(lambda b: parts_done(b, shared, "matrix"), f"conv_id {kind}, part bigint, cells array<double>")
        chained = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "cells"))).alias("all"))
        border = chained.mapInArrow(border_rows, f"c {kind}, p bigint, before int, after int")
        work = rows.join(border, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").drop("c", "p")
    else:
        work = work.withColumn("before", F.lit(None).cast("int")).withColumn("after", F.lit(None).cast("int"))
    schema = f"conv_id {kind}, part bigint, n_rows bigint, n_turns bigint, roles string, rendered string, rendered_sha256 string, continues boolean, n_changed bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return sorted_parts(work, ["before", "after"]).mapInArrow(lambda b: parts_done(b, shared, "turns", arrow), schema)


def sorted_parts(rows: DataFrame, extra: list[str]) -> DataFrame:
    order = ["conv_id", "part", "turn", "role", "text"]
    return rows.select(*order, *extra).repartition("conv_id", "part").sortWithinPartitions(*order)


def border_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"c": [], "p": [], "before": [], "after": []}
        for r in batch.to_pylist():
            for part, before, after in borders([x["part"] for x in r["all"]], [x["cells"] for x in r["all"]]):
                for k, v in zip(out, (r["conv_id"], part, before, after), strict=True):
                    out[k].append(v)
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


def parts_done(batches: Iterator[pa.RecordBatch], shared, what: str, arrow: pa.Schema | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted rows, part after part: their matrices, or their turns."""
    model, held, at = shared.value, [], None

    def done() -> dict:
        given = [(r["role"], r["text"]) for r in held]
        first = held[0]
        if what == "matrix":
            return {"conv_id": first["conv_id"], "part": first["part"], "cells": matrix(model, given, first["part"] == first["lo"])}
        path, lines = decode(model, given, first["before"], first["after"])
        found = turns(path, lines, opened=first["before"] is None)
        text = render(found)
        roles: list[set[int]] = []  # of each row's lines
        for s, line in zip(path, lines, strict=True):
            if line[1]:
                roles.append(set())
            roles[-1].add(s % 3)
        changed = sum(found_roles != {known_role(role)} if known_role(role) is not None else True for (role, _), found_roles in zip(given, roles, strict=True))
        return {"conv_id": first["conv_id"], "part": first["part"], "n_rows": len(held), "n_turns": len(found), "roles": ",".join(r for r, _ in found), "rendered": text, "rendered_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), "continues": first["before"] is not None and path[0] > 2, "n_changed": changed}

    out: list[dict] = []
    for batch in batches:
        if arrow is None:
            arrow = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int64()), ("cells", pa.list_(pa.float64()))])
        for start in range(0, batch.num_rows, 512):
            for r in batch.slice(start, 512).to_pylist():
                if at is not None and (r["conv_id"], r["part"]) != at:
                    out.append(done())
                    held.clear()
                at = (r["conv_id"], r["part"])
                held.append(r)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
    if held:
        out.append(done())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=arrow)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
