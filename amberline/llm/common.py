"""What the text operators share: reading, stage tables in the cluster's shared folder, per-document maps."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Narrow rows may be broadcast if they are at most so many and their values take at most so many bytes; else a shuffle joins.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Only a local session without one, as in tests, gets one made;
    on a cluster a folder of this machine would be another folder on each executor."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="amberline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Stage:
    """Written tables of one run, under one folder of the shared storage. They cut lineage: a lost executor takes
    nothing with it, since later jobs read the files. ``drop`` removes a table that nothing reads any more."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, codec: str | None = None) -> DataFrame:
        """codec: of the files, if not the session's."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(t._stage_path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows, of at most BROADCAST_BYTES; looks no further than that many rows."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in df.schema]
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(sum(sizes, F.lit(0)).cast("bigint"))).first()
    return n <= rows and (size or 0) <= BROADCAST_BYTES


def join_by_size(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """left joined with right, whose narrow rows are broadcast only after they have been counted."""
    return left.join(F.broadcast(right) if is_small(right, rows) else right, on, how)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_fold(name: str = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id as text, modulo folds: the fixed split into held-out and learning rows."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(folds).cast("bigint"))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, rows: int = 256) -> DataFrame:
    """Per-row Python work over Arrow batches, at most ``rows`` at a time so that memory follows the longest texts, not
    the batch size. ``make`` runs once in each task and gives the function from columns to columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(1_000_000, 20, 20)  # large dictionaries without cycles: looking through them often costs more than the work
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = f(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(work, schema)


def filter_rows(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[bool]]], rows: int = 256) -> DataFrame:
    """The rows of df, with all columns, whose text (null: empty) the made function keeps. Other columns are not converted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(1_000_000, 20, 20)
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                yield some.filter(pa.array(f([t or "" for t in some.column(text).to_pylist()]), pa.bool_()))

    return df.mapInArrow(work, df.schema)
