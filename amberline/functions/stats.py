"""Statistics of prices, exact in the third decimal."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.functions.casts import PRICE

#: Into so many intervals a pass of ``quantiles`` divides a range of values.
BINS = 4096
SPLIT, SPIKE, FLOOR = "0.01", "50.0", "0.01"  # Fixed values: thresholds of the market events


def thousandths(c: Column) -> Column:
    """A double as a price: its thousandfold to the nearest whole number, ties away from zero."""
    return (F.round(c * F.lit(1000.0), 0).cast("decimal(32,0)") / 1000).cast(PRICE)


def mean(c: Column) -> Column:
    """Of prices: the exact sum of thousandths, divided as a double."""
    return thousandths((F.sum(c) * 1000).cast("double") / (F.count(c) * F.lit(1000.0)))


def quantile(c: Column, q: float) -> Column:
    """Linear interpolation among whole thousandths, truncated towards the lower neighbour. For groups of some dozen values."""
    s = F.sort_array(F.collect_list((c * 1000).cast("bigint")))
    r = (F.count(c) - 1) * F.lit(q)
    lo, hi = F.floor(r), F.ceil(r)
    a, b = F.try_element_at(s, (lo + 1).cast("int")), F.try_element_at(s, (hi + 1).cast("int"))
    step = ((b - a) * (r - lo)).cast("bigint")
    return F.when(F.count(c) > 0, ((a + step).cast("decimal(32,0)") / 1000).cast(PRICE))


def quantiles(df: DataFrame, column: str, qs: Sequence[float]) -> list[float | None]:
    """Of all values of a column of doubles, as ``percentile`` has them, which would hold every different value in one task. Each pass
    counts the values by interval and divides those that have a wanted rank, until these have one value: a task holds at most
    BINS counts for each rank. NULLs do not count, NaN is the largest."""
    v, inf = F.col("v"), F.lit(math.inf)
    values = df.select((F.col(column).cast("double") + F.lit(0.0)).alias("v")).filter("v is not null")
    finite = ~F.isnan(v) & (F.abs(v) < inf)
    some = F.when(finite, v)
    n, below, above, nans, lo, hi = values.agg(F.count(v), F.count_if(v == -inf), F.count_if(v == inf), F.count_if(F.isnan(v)), F.min(some), F.max(some)).first()
    if not n:
        return [None] * len(qs)
    places = [(n - 1) * q for q in qs]
    ranks = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    found = {k: -math.inf if k < below else math.nan if k >= n - nans else math.inf for k in ranks if not below <= k < n - nans - above}
    todo = {(lo, hi, below): [k for k in ranks if k not in found]}
    while todo := {at: ks for at, ks in todo.items() if ks}:
        found |= {k: lo for (lo, hi, _), ks in todo.items() if lo == hi for k in ks}
        if not (todo := {at: ks for at, ks in todo.items() if at[0] < at[1]}):
            break
        which = F.coalesce(*[F.when(v.between(lo, hi), F.lit(i)) for i, (lo, hi, _) in enumerate(todo)])
        bins = F.coalesce(*[F.when(F.col("i") == i, (v * half - F.lit(lo * half)) / F.lit(hi * half - lo * half)) for i, (lo, hi, _) in enumerate(todo) for half in [0.5 if math.isinf(hi - lo) else 1.0]])
        counted = values.filter(finite).withColumn("i", which).filter("i is not null").groupBy("i", F.floor(bins * BINS).alias("bin")).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        rows, after = sorted(counted.collect()), {}
        for i, ((_, _, start), ks) in enumerate(todo.items()):
            for r in rows:
                if r.i == i:
                    after[r.lo, r.hi, start] = [k for k in ks if start <= k < start + r.n]
                    start += r.n
        todo = after
    between = lambda p, a, b: found[a] if a == b or found[a] == found[b] else (b - p) * found[a] + (p - a) * found[b]
    return [between(p, math.floor(p), math.ceil(p)) for p in places]


def ratio_of_sums(a: Column, b: Column, factor: float = 100.0) -> Column:
    return F.lit(factor) * F.sum(a).cast("double") / F.sum(b).cast("double")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value.cast("double") * weight.cast("double")) / F.sum(weight.cast("double"))


def count_where(p: Column) -> Column:
    return F.count_if(p).cast("int")


def is_split(spread: Column) -> Column:
    return F.abs(spread) >= F.lit(SPLIT).cast("decimal(10,3)")


def is_spike(price: Column) -> Column:
    return price >= F.lit(SPIKE).cast("decimal(10,3)")


def is_floor(price: Column) -> Column:
    return price <= F.lit(FLOOR).cast("decimal(10,3)")


def nearest_quantile(c: Column, q: float) -> Column:
    """The value at the nearest rank."""
    s = F.sort_array(F.collect_list(c))
    return F.try_element_at(s, (F.round((F.count(c) - 1) * F.lit(q)) + 1).cast("int"))
