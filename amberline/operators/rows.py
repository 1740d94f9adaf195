"""Operators from DataFrame to DataFrame: latest revisions, violations, reshaping, schema alignment, key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def latest(df: DataFrame, keys: Sequence[str | Column], newest: Sequence[str]) -> DataFrame:
    """One row for each key, the newest by the columns in order; NULLs are oldest, NULL keys are equal."""
    order = [F.col(c).desc_nulls_last() for c in newest]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


#: Of so many keys the newest values may be broadcast.
FEW = 100_000


def latest_wide(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """``latest`` for rows of many columns. Where keys are few, the newest values of each are found from the narrow columns alone,
    and only the rows that have them are made whole and sorted. Counts the keys when it is called."""
    best = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.max(F.struct(*newest)).alias("_best"))
    if best.limit(FEW + 1).count() > FEW:
        return latest(df, keys, newest)
    best = best.select(*[f"_key_{k}" for k in keys], *[F.col(f"_best.{c}").alias(f"_key_{c}") for c in newest])
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in (*keys, *newest)]
    return latest(df.join(F.broadcast(best), same, "left_semi"), keys, newest)


def violation_list(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that are true; an unknown answer is no violation."""
    return F.filter(F.array(*[F.when(p, F.lit(name)) for name, p in rules.items()]), lambda x: x.isNotNull())


def valid(df: DataFrame, column: str = "violations") -> DataFrame:
    return df.filter(F.size(column) == 0)


def violation_summary(df: DataFrame, column: str = "violations") -> DataFrame:
    return df.select(F.explode(column).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "violation")


def dropped(column: str = "violations") -> Column:
    return F.count_if(F.size(column) > 0)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str, keep_nulls: bool) -> DataFrame:
    """Columns to rows, narrow before it widens; rows whose value is NULL stay only if asked for."""
    out = df.select(*ids, *values).unpivot(list(ids), list(values), name, value)
    return out if keep_nulls else out.filter(F.col(value).isNotNull())


def unpivot_metrics(df: DataFrame, ids: Sequence[str], slots: Mapping[int, Mapping[str, Column]], name: str) -> DataFrame:
    """Several metrics a slot in one pass: a row for each slot, no joins, no shuffle."""
    rows = [F.struct(F.lit(slot).alias(name), *[c.alias(m) for m, c in metrics.items()]) for slot, metrics in slots.items()]
    return df.select(*ids, F.inline(F.array(*rows)))


def position_of(column: str, values: Sequence[str]) -> Column:
    """1 for the first of the names."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)).cast("int")


def list_sum(values: Sequence[Column]) -> Column:
    """Of what is there; NULL if nothing is."""
    known = F.filter(F.array(*values), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("bigint"), lambda a, x: a + x))


def list_min(values: Sequence[Column]) -> Column:
    return F.array_min(F.array(*values))


def surplus_rows(df: DataFrame, keys: Sequence[str]) -> int:
    """How many rows exceed one for each key; NULLs are equal to each other."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.sum(F.col("n") - 1)).first()[0]
    return int(found or 0)


class DuplicateKeys(ValueError):
    """A key has several rows."""


def require_unique(df: DataFrame, keys: Sequence[str], table: str) -> None:
    n = surplus_rows(df, keys)
    if n:
        raise DuplicateKeys(f"{table}: {n} rows repeat a key ({', '.join(keys)})")


def align(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns and order of the schema: missing ones NULL, others dropped, all cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def pivot_wide(df: DataFrame, index: str, column: str, values: Sequence, value: str) -> DataFrame:
    """Explicit values: no pass to find them."""
    return df.groupBy(index).pivot(column, list(values)).agg(F.first(value))


def sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows (all, if there are fewer), the same for a seed however the table is partitioned: those whose keys hash lowest.
    Each task keeps n rows at most. NULL keys are empty texts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.orderBy(F.md5(text), *keys).limit(n)
