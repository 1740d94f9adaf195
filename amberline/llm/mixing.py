"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Rows of a source, in the order of a hash of their key, form blocks. A cycle is as many slots as all weights together, one
block to a slot; in it a source of weight d gets d blocks. Of a source's d blocks in a cycle of S slots, block m (from 1) is
released at slot floor((m - 1) * S / d) and due by slot ceil(m * S / d). Slots are filled earliest deadline first among what
is released, so that after any number of slots t of a cycle a source has had t * d / S blocks, to less than one block.

A source that ends drops out: its last cycle has what is left of it, and later cycles are shared by the others. Cycles of one
composition form a phase, of which there are at most two for each source; the schedule is worked out once for each phase, by
a fold over its slots, and every cycle of the phase repeats it. Nothing is dropped or repeated.

What grows with the sources alone (weights, phases, schedules) meets in one row; what grows with the rows does not. Rows are
numbered within (source, bucket of the hash), so a source with a third of all rows is dealt over all buckets; the numbers
do not depend on how many buckets there are.

A null source is the source "", unless the table has that too: they are one. A null key is ordered as the empty text; rows with equal
keys are numbered in any order. Sources without a weight have the default. An empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amberline.llm.common import table

#: Rows that one bucket of a source should hold at most, if the source had all rows.
BUCKET_ROWS = 20_000

# The fold: state is how many blocks each source has had and at which slots; each step gives slot t to the released
# block of the earliest deadline, then of the earliest source. demand: blocks of each source in the cycle, total: its slots.
FOLD = """
aggregate(
  sequence(0L, total - 1),
  named_struct('had', transform(demand, d -> 0L), 'slots', transform(demand, d -> cast(array() as array<bigint>))),
  (state, t) -> element_at(transform(
    array(array_min(transform(
      filter(sequence(0, size(demand) - 1), i -> state.had[i] < demand[i] and state.had[i] * total div demand[i] <= t),
      i -> named_struct('due', ((state.had[i] + 1) * total + demand[i] - 1) div demand[i], 'i', i)
    )).i),
    pick -> named_struct(
      'had', transform(state.had, (n, i) -> if(i = pick, n + 1, n)),
      'slots', transform(state.slots, (s, i) -> if(i = pick, concat(s, array(t)), s)))
  ), 1),
  state -> state.slots
)
"""


def schedule(sources: DataFrame) -> DataFrame:
    """sources: s, weight, blocks. For each source its phases: array of (first cycle, first slot, slots of a cycle, blocks of
    this source in it, their slots)."""
    full = sources.select("s", "weight", "blocks", F.expr("blocks div weight").alias("full"))
    packed = full.agg(F.array_sort(F.collect_list(F.struct("s", "weight", "blocks", "full"))).alias("all"))
    border = F.expr("array_sort(array_distinct(flatten(transform(all, x -> array(0L, x.full, x.full + 1)))))")
    phases = packed.select("all", F.posexplode(border).alias("p", "cycle"), border.alias("border"))
    phases = phases.withColumn("cycles", F.expr("case when p + 1 < size(border) then border[p + 1] - cycle else 0L end"))
    demand = F.expr("transform(all, x -> case when cycle < x.full then x.weight when cycle = x.full then x.blocks - x.full * x.weight else 0L end)")
    phases = phases.withColumn("demand", demand).withColumn("total", F.expr("aggregate(demand, 0L, (a, d) -> a + d)")).filter("total > 0 and cycles > 0")
    phases = phases.withColumn("slots", F.expr(FOLD))
    before = Window.orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1)
    phases = phases.withColumn("start", F.coalesce(F.sum(F.col("total") * F.col("cycles")).over(before), F.lit(0).cast("bigint")))
    each = phases.select("cycle", "start", "total", F.inline(F.expr("transform(all, (x, i) -> named_struct('s', x.s, 'blocks', demand[i], 'slots', slots[i]))"))).filter("blocks > 0")
    return each.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("cycle", "start", "total", "blocks", "slots"))).alias("phases"))


def digits(rows: int) -> int:
    """Hex digits of the hash that name a bucket."""
    n = 1
    while n < 6 and rows > BUCKET_ROWS * 16**n:
        n += 1
    return n


def mix(df: DataFrame, weights: dict[str, int], default: int = 1, block: int = 8, key: str = "doc_id", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """k, s, the columns carried (under names of their own, c_0 and so on), block_no, slot, release, deadline, place (in the
    block). Ordered by slot and place, the rows are mixed."""
    if default < 1 or min(weights.values(), default=1) < 1 or block < 1:
        raise ValueError("weights and blocks are positive")
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(source), F.lit("")).alias("s"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("h"), *[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry or [])])
    rows = rows.withColumn("b", F.substring("h", 1, digits(df.count())))
    counts = rows.groupBy("s", "b").agg(F.count(F.lit(1)).alias("rows"))
    weight = F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(weights)), "map<string, bigint>"), F.col("s")), F.lit(default).cast("bigint"))
    sources = counts.groupBy("s").agg(F.expr(f"(sum(rows) + {block - 1}) div {block}").alias("blocks")).withColumn("weight", weight)
    offsets = counts.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))
    offsets = offsets.join(schedule(sources).join(sources.select("s", "weight"), "s"), "s")
    # only the phases that blocks of this bucket can be in
    cycle_of = f"((before + {{}}) div {block}) div weight"
    offsets = offsets.withColumn("lo", F.expr(cycle_of.format("0"))).withColumn("hi", F.expr(cycle_of.format("rows - 1")))
    offsets = offsets.withColumn("phases", F.expr("filter(phases, (p, i) -> p.cycle <= hi and (i + 1 >= size(phases) or phases[i + 1].cycle > lo))")).select("s", "b", "before", "weight", "phases")
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "k"))).join(offsets, ["s", "b"])
    numbered = numbered.withColumn("nth", F.col("before") + F.col("i") - 1).withColumn("block_no", F.expr(f"nth div {block}"))
    numbered = numbered.withColumn("cycle", F.expr("block_no div weight")).withColumn("p", F.expr("element_at(filter(phases, p -> p.cycle <= cycle), -1)")).withColumn("m", F.expr("block_no % weight"))
    base = "p.start + (cycle - p.cycle) * p.total + "
    return numbered.select(
        "k",
        "s",
        *[f"c_{i}" for i in range(len(carry or []))],
        "block_no",
        F.expr(base + "p.slots[int(m)]").alias("slot"),
        F.expr(base + "m * p.total div p.blocks").alias("release"),
        F.expr(base + "((m + 1) * p.total + p.blocks - 1) div p.blocks").alias("deadline"),
        F.expr(f"nth % {block}").alias("place"),
    )


#: Target weights of the registered query and of the pipeline; sources not named have weight 1.
WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2}
BLOCK = 8


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block_no, slot, release, deadline, place."""
    return mix(table(spark, sf_dir, "documents"), WEIGHTS, block=BLOCK).withColumnRenamed("k", "doc_id").withColumnRenamed("s", "source")


def mixed_rows(df: DataFrame, weights: dict[str, int], default: int = 1, block: int = 8, key: str = "doc_id", source: str = "source") -> DataFrame:
    """All rows of df with its columns, in the order of the mix: written files, read by name, have it too."""
    found = mix(df, weights, default, block, key, source, carry=df.columns)
    return found.orderBy("slot", "place").select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(df.columns)])


OP2_SQL = f"""
WITH RECURSIVE weights(s, w) AS (VALUES {", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())}),
nth AS (
  SELECT doc_id, coalesce(source, '') AS s,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS n
  FROM documents),
src AS (
  SELECT s, coalesce(any_value(w), 1) AS w, (count(*) + {BLOCK - 1}) // {BLOCK} AS blocks
  FROM nth LEFT JOIN weights USING (s) GROUP BY s),
listed AS (SELECT *, blocks // w AS full_cycles, row_number() OVER (ORDER BY s) AS i FROM src),
borders AS (
  SELECT DISTINCT unnest([0, full_cycles, full_cycles + 1]) AS cycle FROM listed),
phase AS (SELECT cycle, lead(cycle) OVER (ORDER BY cycle) - cycle AS cycles FROM borders),
demand AS (
  SELECT cycle, any_value(cycles) AS cycles,
         list(CASE WHEN cycle < full_cycles THEN w WHEN cycle = full_cycles THEN blocks - full_cycles * w ELSE 0 END ORDER BY i)::BIGINT[] AS d
  FROM phase, listed WHERE cycles IS NOT NULL GROUP BY cycle),
total AS (SELECT *, list_sum(d)::BIGINT AS slots FROM demand WHERE list_sum(d) > 0),
run AS (
  SELECT cycle, 0::BIGINT AS t, list_transform(d, lambda x: 0::BIGINT) AS had, 0::BIGINT AS pick FROM total
  UNION ALL
  SELECT cycle, t + 1, list_transform(had, lambda n, k: CASE WHEN k = best THEN n + 1 ELSE n END), best
  FROM (
    SELECT run.cycle, t, had, slots,
           list_min(list_transform(
             list_filter(range(1, len(d) + 1), lambda k: had[k] < d[k] AND had[k] * slots // greatest(d[k], 1) <= t),
             lambda k: (((had[k] + 1) * slots + d[k] - 1) // d[k]) * 1000000 + k)) % 1000000 AS best
    FROM run JOIN total ON total.cycle = run.cycle WHERE t < slots) AS step),
placed AS (SELECT cycle, pick AS i, t - 1 AS slot, had[pick] AS m FROM run WHERE pick > 0),
start AS (
  SELECT *, coalesce(sum(slots * cycles) OVER (ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM total)
SELECT doc_id, nth.s AS source, n // {BLOCK} AS block_no,
       (first + (n // {BLOCK} // w - start.cycle) * slots + placed.slot)::BIGINT AS slot,
       (first + (n // {BLOCK} // w - start.cycle) * slots + (n // {BLOCK} % w) * slots // d[listed.i])::BIGINT AS release,
       (first + (n // {BLOCK} // w - start.cycle) * slots + ((n // {BLOCK} % w + 1) * slots + d[listed.i] - 1) // d[listed.i])::BIGINT AS deadline,
       n % {BLOCK} AS place
FROM nth JOIN listed USING (s)
JOIN start ON n // {BLOCK} // w >= start.cycle AND n // {BLOCK} // w < start.cycle + cycles
JOIN placed ON placed.cycle = start.cycle AND placed.i = listed.i AND placed.m = n // {BLOCK} % w + 1
"""
