"""Versioned Parquet tables: a list of files for each version, replaced whole.

A version is one JSON file that names the table's columns, its partitioning and its data files with their partition. Writing
puts new files beside the old ones and then a new version; readers hold to the version they began with, and a failed job
leaves nothing but orphans. Windows prune by the files' partitions before Spark lists anything.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import logging
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DataType, StructField, StructType

from amberline.functions.slots import Window
from amberline.operators import rows

log = logging.getLogger(__name__)

TYPES: dict[str, DataType] = {
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "decimal": T.DecimalType(32, 3),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "string": T.StringType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
}
#: Written with every row; ids follow the business columns'.
AUDIT = (("source_data", "string"), ("status", "string"), ("ingestion_time", "timestamptz"), ("ingestion_date", "date"), ("execution_id", "string"))
AUDIT_ID = 9001
#: Of a partition's name by transform.
FORMATS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}
WHOLE = "all"
HEADER = ["field_id", "name", "type", "is_identifier", "required", "doc", "partition_transform", "source_name", "comment"]


def data_type(name: str) -> DataType:
    if name not in TYPES:
        raise ValueError(f"unknown type {name!r}")
    return TYPES[name]


@dataclass(frozen=True)
class TableSpec:
    """A table's name (with its namespace), schema, keys, and partitioning as (date or timestamp column, transform)."""

    name: str
    schema: StructType
    keys: tuple[str, ...] = ()
    partition: tuple[str, str] | None = None
    sources: dict[str, str] = field(default_factory=dict)  # column by the header of a raw file

    def __post_init__(self):
        if self.partition:
            column, transform = self.partition
            if transform not in FORMATS:
                raise ValueError(f"unknown partition transform {transform!r}")
            if self.schema[column].dataType.simpleString() not in ("date", "timestamp", "timestamp_ntz"):
                raise ValueError(f"{transform} of {column}: it is no date or time")

    @staticmethod
    def of(name: str, columns: str, partition: tuple[str, str] | None = None, audit: bool = False) -> TableSpec:
        """columns: ``name type [required] [key], ...`` with the types of TYPES."""
        fields, keys = [], []
        for i, (column, kind, *marks) in enumerate(map(str.split, columns.split(",")), 1):
            fields.append(StructField(column, data_type(kind), "required" not in marks, {"field_id": i}))
            keys += [column] if "key" in marks else []
        return TableSpec(name, StructType(fields + (audit_fields() if audit else [])), tuple(keys), partition)

    @staticmethod
    def from_csv(name: str, text: str) -> TableSpec:
        """From a declaration of HEADER's columns; the audit columns are added. Empty lines are skipped; ``required`` and
        ``is_identifier`` are true only where they say so."""
        fields, keys, sources, partition = [], [], {}, None
        for r in csv.DictReader(io.StringIO(text)):
            if not any((v or "").strip() for v in r.values() if isinstance(v, str)):
                continue
            missing = [c for c in ("field_id", "name", "type") if not (r.get(c) or "").strip()]
            if missing:
                raise ValueError(f"{name}: a column lacks {', '.join(missing)}")
            column, true = r["name"].strip(), lambda c, r=r: (r.get(c) or "").strip().lower() == "true"
            fields.append(StructField(column, data_type(r["type"].strip()), not true("required"), {"field_id": int(r["field_id"]), "doc": (r.get("doc") or "").strip()}))
            keys += [column] if true("is_identifier") else []
            if (r.get("source_name") or "").strip():
                sources[r["source_name"].strip()] = column
            if (r.get("partition_transform") or "").strip():
                partition = (column, r["partition_transform"].strip())
        return TableSpec(name, StructType(fields + audit_fields()), tuple(keys), partition, sources)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema if not f.nullable]

    def part(self) -> Column:
        return F.date_format(self.partition[0], FORMATS[self.partition[1]]) if self.partition else F.lit(WHOLE)

    def overlaps(self, part: str, window: Window) -> bool:
        """Whether a partition can have rows of the window."""
        if part == WHOLE or not self.partition:
            return True
        n = len(part)
        return window.lo.isoformat()[:n] <= part <= window.last.isoformat()[:n]


def audit_fields() -> list[StructField]:
    return [StructField(c, data_type(t), True, {"field_id": AUDIT_ID + i}) for i, (c, t) in enumerate(AUDIT)]


def stamp(df: DataFrame, status: str = "loaded", execution_id: str | None = None, source: str | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Audit columns: one time for all rows, of the driver's clock."""
    now = now or dt.datetime.now(dt.UTC)
    extra = {"status": F.lit(status), "ingestion_time": F.lit(now), "ingestion_date": F.lit(now.date()), "execution_id": F.lit(execution_id or str(uuid.uuid4()))}
    return df.withColumns(extra | ({"source_data": F.lit(source)} if source is not None else {}))


#: Uncommitted files younger than this are left alone.
ORPHAN_AGE = dt.timedelta(days=1)


class Files:
    """Any file system that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.Path, self.conf = spark, spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str, before: float | None = None) -> list[str]:
        """Files below path, with their full names; only those last changed before that many milliseconds, if given."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        out, it = [], fs.listFiles(p, True)
        while it.hasNext():
            f = it.next()
            if before is None or f.getModificationTime() <= before:
                out.append(f.getPath().toString())
        return sorted(out)

    def folders(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, path: str, data: bytes, overwrite: bool = True) -> None:
        """Without overwrite it fails if the file is there: of two writers one wins."""
        fs, p = self._at(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(data)
        finally:
            stream.close()

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)


@dataclass(frozen=True)
class Version:
    number: int
    at: str
    schema: str  # as JSON
    partition: tuple[str, str] | None
    files: tuple[tuple[str, str], ...]  # path below the table, partition
    rows: int | None = None


@dataclass(frozen=True)
class Staged:
    """Written rows that no version names yet: their files, their number, the first and last day."""

    spec: TableSpec
    files: tuple[tuple[str, str], ...]
    rows: int = 0
    lo: dt.date | None = None
    hi: dt.date | None = None


class Lake:
    """Tables below a folder, ``root/namespace/table``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    # -- versions --

    def home(self, name: str) -> str:
        return f"{self.root}/{name.replace('.', '/')}"

    def numbers(self, name: str) -> list[int]:
        return sorted(int(p.rsplit("/v", 1)[1].removesuffix(".json")) for p in self.files.list(f"{self.home(name)}/versions") if p.endswith(".json"))

    def version(self, name: str, number: int | None = None) -> Version:
        number = number if number is not None else max(self.numbers(name), default=None)
        if number is None:
            raise LookupError(f"there is no table {name}")
        x = json.loads(self.files.read(f"{self.home(name)}/versions/v{number:08d}.json"))
        return Version(number, x["at"], x["schema"], tuple(x["partition"]) if x["partition"] else None, tuple(map(tuple, x["files"])), x.get("rows"))

    def commit(self, name: str, before: Version | None, schema: StructType, partition: tuple[str, str] | None, files: Iterable[tuple[str, str]], rows_: int | None = None) -> Version:
        v = Version((before.number if before else 0) + 1, dt.datetime.now(dt.UTC).isoformat(), schema.json(), partition, tuple(sorted(files)), rows_)
        body = {"at": v.at, "schema": v.schema, "partition": partition, "files": v.files, "rows": rows_}
        self.files.write(f"{self.home(name)}/versions/v{v.number:08d}.json", json.dumps(body).encode(), overwrite=False)
        return v

    def exists(self, name: str) -> bool:
        return bool(self.numbers(name))

    # -- reading --

    def read(self, spec: TableSpec | str, window: Window | None = None, number: int | None = None) -> DataFrame:
        """The table, or a version of it; with a window its days only, from the files that can have them."""
        name = spec if isinstance(spec, str) else spec.name
        v = self.version(name, number)
        schema = StructType.fromJson(json.loads(v.schema))
        shape = TableSpec(name, schema, partition=v.partition)
        paths = [f"{self.home(name)}/{p}" for p, part in v.files if window is None or shape.overlaps(part, window)]
        df = self.spark.read.schema(StructType([replace_nullable(f) for f in schema])).parquet(*paths) if paths else self.spark.createDataFrame([], StructType([replace_nullable(f) for f in schema]))
        return df.filter(window.holds(F.col(v.partition[0]))) if window and v.partition else df

    def has_rows(self, spec: TableSpec, **equal) -> bool:
        """Whether rows with these values are there; stops at the first."""
        if not self.exists(spec.name):
            return False
        df = self.read(spec)
        for c, v in equal.items():
            df = df.filter(F.col(c) == F.lit(v))
        return not df.select(F.lit(1)).limit(1).isEmpty()

    # -- writing --

    def _put(self, spec: TableSpec, df: DataFrame) -> list[tuple[str, str]]:
        """df as new files; a large partition is dealt over several tasks, small ones share one."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = df.withColumn("_part", F.coalesce(spec.part(), F.lit("null"))).hint("rebalance", "_part")
        order = [spec.partition[0]] if spec.partition else list(spec.keys)
        dealt = dealt.sortWithinPartitions("_part", *order)
        dealt.write.partitionBy("_part").parquet(f"{self.home(spec.name)}/{folder}")
        found = []
        for p in self.files.list(f"{self.home(spec.name)}/{folder}"):
            if p.endswith(".parquet"):
                tail = p[p.index(folder) :]
                found.append((tail, tail.split("_part=", 1)[1].split("/", 1)[0]))
        return found

    def provision(self, spec: TableSpec) -> Version:
        """Creates the table; adds new columns; only warns of columns or partitions that differ otherwise."""
        if not self.exists(spec.name):
            return self.commit(spec.name, None, spec.schema, spec.partition, [], 0)
        v = self.version(spec.name)
        old = StructType.fromJson(json.loads(v.schema))
        new = [f for f in spec.schema if f.name not in old.names]
        gone = [c for c in old.names if c not in spec.schema.names]
        if gone:
            log.warning("%s: columns %s are no longer declared; they stay", spec.name, gone)
        if v.partition != spec.partition:
            log.warning("%s: it is partitioned by %s, not by %s", spec.name, v.partition, spec.partition)
        if not new:
            return v
        return self.commit(spec.name, v, StructType(list(old) + [replace_nullable(f) for f in new]), v.partition, v.files, v.rows)

    def _current(self, spec: TableSpec) -> tuple[Version, TableSpec]:
        v = self.provision(spec)
        return v, TableSpec(spec.name, StructType.fromJson(json.loads(v.schema)), spec.keys, v.partition, spec.sources)

    def _frame(self, name: str, schema: StructType, files: Sequence[tuple[str, str]]) -> DataFrame:
        return self.spark.read.schema(StructType([replace_nullable(f) for f in schema])).parquet(*[f"{self.home(name)}/{p}" for p, _ in files])

    def stage(self, spec: TableSpec, df: DataFrame, column: str | None = None, unique: bool = True) -> Staged:
        """df, read once, as new files that no version names yet. Checks look at these files: required columns and, if unique,
        keys. What fails is removed again. column: whose first and last value are asked for."""
        now = self._current(spec)[1] if self.exists(spec.name) else spec
        out = Staged(now, tuple(self._put(now, rows.align(df, now.schema))))
        if not out.files:
            return out
        try:
            back = self._frame(spec.name, now.schema, out.files)
            bounds = [F.min(column), F.max(column)] if column else [F.lit(None), F.lit(None)]
            n, lo, hi, *nulls = back.agg(F.count(F.lit(1)), *bounds, *[F.count_if(F.col(c).isNull()) for c in now.required]).first()
            if wrong := {c: n for c, n in zip(now.required, nulls, strict=True) if n}:
                raise ValueError(f"{spec.name}: required columns have NULLs: {wrong}")
            if unique and spec.keys:
                rows.require_unique(back, spec.keys, spec.name)
        except Exception:
            self.discard(out)
            raise
        return Staged(now, out.files, n, lo, hi)

    def discard(self, staged: Staged) -> None:
        for p, _ in staged.files:
            self.files.delete(f"{self.home(staged.spec.name)}/{p}")

    def append(self, spec: TableSpec, df: DataFrame) -> Version:
        staged = self.stage(spec, df, unique=False)
        v, now = self._current(spec)
        return self.commit(spec.name, v, now.schema, now.partition, [*v.files, *staged.files], staged.rows)

    @staticmethod
    def date_column(spec: TableSpec) -> str:
        return spec.partition[0] if spec.partition else next(f.name for f in spec.schema if f.dataType.simpleString() == "date")

    def replace_window(self, spec: TableSpec, df: DataFrame, window: Window | None, column: str | None = None) -> Version | None:
        """The rows of df take the place of the table's rows in the window (None: from the first to the last day of df).
        No rows replace nothing. Keys must be unique and required columns filled, or nothing is written. Only partitions that
        the window or the new rows touch are rewritten. The version's ``rows`` are those of df, counted in the files."""
        column = column or self.date_column(spec)
        return self.put_in_place(spec, self.stage(spec, df, column), window, column)

    def put_in_place(self, spec: TableSpec, staged: Staged, window: Window | None, column: str) -> Version | None:
        """Commits staged rows in place of the window's."""
        if not staged.rows:
            return None
        if window is None:
            if staged.lo is None:
                self.discard(staged)
                raise ValueError(f"{spec.name}: no row has a {column}, so there is no window")
            window = Window.days(staged.lo, staged.hi)
        v, now = self._current(spec)
        inside = window if staged.lo is None else Window.days(min(staged.lo, window.lo), max(staged.hi, window.last))
        touched = [f for f in v.files if now.overlaps(f[1], inside)]
        gone = set(touched)
        kept = [f for f in v.files if f not in gone]
        if touched:
            kept += self._put(now, self._frame(spec.name, now.schema, touched).filter(~F.coalesce(window.holds(F.col(column)), F.lit(False))))
        return self.commit(spec.name, v, now.schema, now.partition, [*kept, *staged.files], staged.rows)

    # -- upkeep --

    def evolve_partition(self, spec: TableSpec) -> list[str]:
        """Lays the table out anew by the declared partitioning; what was added."""
        v = self.version(spec.name)
        if v.partition == spec.partition or spec.partition is None:
            return []
        now = TableSpec(spec.name, StructType.fromJson(json.loads(v.schema)), spec.keys, spec.partition)
        files = self._put(now, self.read(spec.name)) if v.files else []
        self.commit(spec.name, v, now.schema, spec.partition, files, v.rows)
        return [f"{spec.partition[1]}({spec.partition[0]})"]

    def pin(self, name: str, ref: str, number: int) -> None:
        self.files.write(f"{self.home(name)}/refs/{ref}", str(number).encode())

    def pinned(self, name: str) -> set[int]:
        return {int(self.files.read(p)) for p in self.files.list(f"{self.home(name)}/refs") if not p.rsplit("/", 1)[1].startswith(".")}

    def expire(self, name: str, older_than: dt.timedelta, delete: bool = False, now: dt.datetime | None = None) -> list[int]:
        """Versions older than the bound, save the last and pinned ones; deleted only if asked for."""
        cutoff, keep = (now or dt.datetime.now(dt.UTC)) - older_than, self.pinned(name)
        numbers = self.numbers(name)
        old = [n for n in numbers[:-1] if n not in keep and dt.datetime.fromisoformat(self.version(name, n).at) < cutoff]
        if delete:
            for n in old:
                self.files.delete(f"{self.home(name)}/versions/v{n:08d}.json")
        return old

    def orphans(self, name: str, older_than: dt.timedelta = ORPHAN_AGE) -> list[str]:
        """Data files of that age that no surviving version names. Younger ones may be a running writer's, not yet committed."""
        before = (dt.datetime.now(dt.UTC) - older_than).timestamp() * 1000
        listed = [p[p.index("/data/") + 1 :] for p in self.files.list(f"{self.home(name)}/data", before) if p.endswith(".parquet")]
        used = {p for n in self.numbers(name) for p, _ in self.version(name, n).files}
        return [p for p in listed if p not in used]

    def delete_orphans(self, name: str, batch: int = 1000, older_than: dt.timedelta = ORPHAN_AGE) -> int:
        found = self.orphans(name, older_than)
        for at in range(0, len(found), batch):
            for p in found[at : at + batch]:
                self.files.delete(f"{self.home(name)}/{p}")
        return len(found)

    def drop(self, name: str) -> bool:
        """False, with a warning, if it is not there."""
        if not self.exists(name):
            log.warning("there is no table %s", name)
            return False
        return self.files.delete(self.home(name))

    def create_namespace(self, name: str) -> None:
        self.files.make_folder(f"{self.root}/{name}")

    def namespaces(self) -> list[str]:
        return self.files.folders(self.root)

    def tables(self, namespace: str) -> list[str]:
        return [f"{namespace}.{t}" for t in self.files.folders(f"{self.root}/{namespace}")]

    def drop_namespace(self, name: str) -> bool:
        if self.tables(name):
            log.warning("namespace %s is not empty", name)
            return False
        return self.files.delete(f"{self.root}/{name}")


def replace_nullable(f: StructField) -> StructField:
    """Files may lack what was required later; requirements are checked when rows are written."""
    return StructField(f.name, f.dataType, True, f.metadata)


def validate_then_write(lake: Lake, jobs: Sequence[tuple[TableSpec, DataFrame, Window | None]]) -> list[Version | None]:
    """All are written aside and checked before any is committed; each is read once."""
    staged: list[Staged] = []
    try:
        for spec, df, _ in jobs:
            staged.append(lake.stage(spec, df, lake.date_column(spec)))
    except Exception:
        for x in staged:
            lake.discard(x)
        raise
    return [lake.put_in_place(spec, x, window, lake.date_column(spec)) for (spec, _, window), x in zip(jobs, staged, strict=True)]
