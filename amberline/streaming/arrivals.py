"""Bronze rows as they arrive, each micro-batch replacing the days it has in a silver table.

Late revisions are the same as in batch: a day's bronze rows are read again in full, so the newest revision wins whatever the
order of arrival, and a batch that runs twice leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from amberline.functions.slots import Window
from amberline.operators.tables import Lake, TableSpec, stamp


def replace_as_it_comes(spark: SparkSession, folder: str, schema: StructType, day: Callable[[DataFrame], DataFrame], stage: Callable[[DataFrame, Window], DataFrame], lake: Lake, spec: TableSpec, checkpoint: str) -> StreamingQuery:
    """folder: Parquet files of bronze rows. day: a frame of their business dates, column ``day``. stage: a window's silver rows of
    bronze. Runs over what is there, then ends."""

    def batch(new: DataFrame, _: int) -> None:
        lo, hi = day(new).agg(F.min("day"), F.max("day")).first()
        if lo is not None:
            window = Window.days(lo, hi)
            bronze = spark.read.schema(schema).parquet(folder)
            lake.replace_window(spec, stamp(stage(bronze, window)), window)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
