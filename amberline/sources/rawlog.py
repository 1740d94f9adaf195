"""Operators on the log of raw objects; the log itself is in ``amberline.sources.raw``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def supersede(log: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """What was latest in the scope is so no more; the new rows follow, by name, with NULL for what they lack."""
    before = log.withColumn("is_latest", F.when(F.coalesce(scope, F.lit(False)), F.lit(False)).otherwise(F.col("is_latest")))
    return before.unionByName(new, allowMissingColumns=True)


def newest(log: DataFrame, where: Column, by: str) -> DataFrame:
    return log.filter(F.col("is_latest") & where).orderBy(F.desc(by)).limit(1)


def marked(log: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return log.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})
