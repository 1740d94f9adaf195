"""Raw objects: immutable bytes, a manifest of the newest of each scope, and a log of all.

``raw/<dataset>/<scope>/ingested_at=<time>/`` holds an object and its metadata. An object whose SHA-256 is the manifest's is not
written again.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.operators.tables import Files
from amberline.sources import rawlog

LOG_COLUMNS = "dataset string, fiscal_year bigint, snapshot_date string, ingested_at string, file_hash string, file_path string, content_length bigint, etag string, last_modified string, is_latest boolean, bronze_status string, bronze_processed_at string, execution_id string"


@dataclass(frozen=True)
class Snapshot:
    changed: bool
    path: str | None
    digest: str


class RawStore:
    """Raw objects below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def log(self) -> DataFrame:
        """Empty, with its columns, where there is none yet."""
        newest = max((p for p in self.files.list(f"{self.root}/log") if p.endswith("/_SUCCESS")), default=None)
        return self.spark.createDataFrame([], LOG_COLUMNS) if newest is None else self.spark.read.schema(LOG_COLUMNS).parquet(newest.rsplit("/", 1)[0])

    def _save_log(self, log: DataFrame) -> None:
        """Beside the last one, under a later name; the last is removed afterwards."""
        old = self.files.folders(f"{self.root}/log")
        log.coalesce(1).write.parquet(f"{self.root}/log/{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}")
        for x in old:
            self.files.delete(f"{self.root}/log/{x}")

    def put(self, dataset: str, name: str, data: bytes, fiscal_year: int | None = None, day: dt.date | None = None, compress: bool = False, execution_id: str | None = None, now: dt.datetime | None = None, **headers: str) -> Snapshot:
        """Writes an object of a scope (a fiscal year, or a day) if it differs from the newest."""
        now = now or dt.datetime.now(dt.UTC)
        scope = f"fiscal_year={fiscal_year}" if fiscal_year is not None else f"snapshot_date={day.isoformat()}"
        digest, manifest = hashlib.sha256(data).hexdigest(), f"{self.root}/manifests/{dataset}/{scope}/latest.json"
        if self.files.exists(manifest) and json.loads(self.files.read(manifest)).get("sha256") == digest:
            return Snapshot(False, None, digest)
        folder = f"{self.root}/raw/{dataset}/{scope}/ingested_at={now:%Y%m%dT%H%M%S%f}Z"
        path = f"{folder}/{name}" + ".gz" * compress
        self.files.write(path, gzip.compress(data, mtime=0) if compress else data, overwrite=False)
        facts = {"sha256": digest, "path": path, "ingested_at": now.isoformat(), "content_length": len(data), **headers}
        self.files.write(f"{folder}/metadata.json", json.dumps(facts).encode())
        self.files.write(manifest, json.dumps(facts).encode())
        row = {"dataset": dataset, "fiscal_year": fiscal_year, "snapshot_date": day.isoformat() if day else None, "ingested_at": now.isoformat(), "file_hash": digest, "file_path": path, "content_length": len(data), "etag": headers.get("etag"), "last_modified": headers.get("last_modified"), "is_latest": True, "bronze_status": "pending", "bronze_processed_at": None, "execution_id": execution_id or str(uuid.uuid4())}
        new = self.spark.createDataFrame([row], LOG_COLUMNS)
        self._save_log(rawlog.supersede(self.log(), new, self._scope(dataset, fiscal_year, day)))
        return Snapshot(True, path, digest)

    @staticmethod
    def _scope(dataset: str, fiscal_year: int | None, day: dt.date | None):
        where = F.col("dataset") == dataset
        return where & (F.col("fiscal_year") == fiscal_year if fiscal_year is not None else F.col("snapshot_date") == day.isoformat())

    def latest(self, dataset: str, fiscal_year: int | None = None, day: dt.date | None = None, unprocessed: bool = False) -> str:
        """The path of the newest object of a scope."""
        where = self._scope(dataset, fiscal_year, day)
        if unprocessed:
            where = where & ~F.col("bronze_status").eqNullSafe(F.lit("processed"))
        row = rawlog.newest(self.log(), where, "ingested_at").first()
        if row is None:
            raise ValueError(f"no raw object of {dataset} for {fiscal_year if fiscal_year is not None else day}")
        return row["file_path"]

    def mark_processed(self, path: str, now: dt.datetime | None = None) -> bool:
        """False if the log does not have the path."""
        log = self.log()
        if log.filter(F.col("file_path") == path).isEmpty():
            return False
        at = (now or dt.datetime.now(dt.UTC)).isoformat()
        self._save_log(rawlog.marked(log, F.col("file_path") == path, bronze_status=F.lit("processed"), bronze_processed_at=F.lit(at)))
        return True

    def text(self, path: str, charset: str) -> str:
        """One object's text, unpacked if its name says so."""
        data = self.files.read(path)
        return (gzip.decompress(data) if path.endswith(".gz") else data).decode(charset)


def read_csv(spark: SparkSession, path: str, charset: str = "cp932") -> DataFrame:
    """All columns as text. ``.gz`` is unpacked by Spark; cp932 needs the session setting that ``build_session`` makes."""
    if charset == "utf-8-sig":  # the mark at the start would be part of the first name
        df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
        return df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return spark.read.csv(path, header=True, inferSchema=False, encoding=charset)
