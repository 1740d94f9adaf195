"""Exact deduplication by content sort.

Rows are range-partitioned by content and sorted, which is external in Spark: equal texts then stand side by side, and each
row is compared in full with the one before it. The key of the order is the content's first bytes, then the SHA-256 of the
whole, then the whole, then the id. Splitters are sampled from the first, second and last of these, so the driver holds some
tens of bytes for each sampled row, never texts. As the id is part of the order, a text that a third of all rows share is
dealt over many partitions; runs of equal texts that cross a border are joined by comparing the last text of one partition
with the first of the next.

Only what a partition found about its two outer runs meets in one place, a few numbers for each partition, no texts.

Nulls count as empty texts. Rows that share text and id are as good as each other: exactly one of a group stays. Ids may
repeat; a null id is never the id that is kept if another is there. An empty table gives an empty result. Other columns
are carried only if asked for, by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from amberline.llm.common import Stage, join_by_size, table, text_or_empty

LEAD = 16  # bytes of the content that lead the order
FLUSH_ROWS, FLUSH_BYTES = 2048, 8 << 20


def unchanged(text: Column) -> Column:
    return text


def runs(rows: DataFrame, carry: list[str], keep: str, only_kept: bool) -> DataFrame:
    """rows, sorted within partitions: of each its run (part, run), the run's rows and kept id in this partition, whether it
    is the run's row to keep; and one row for each partition (edge) with its outer texts and runs. Of a run no more is held
    than one row with its text and, unless only_kept, the ids of the others."""
    last = keep == "max"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        weight, run, size = 0, -1, 0
        best: dict = {}  # the current run's row to keep
        ids: list = []  # of the current run
        before = first = first_run = last_run = None

        def flush() -> pa.RecordBatch:
            nonlocal weight
            got = pa.RecordBatch.from_pylist([{c: x.get(c) for c in names} for x in out], schema=arrow)
            out.clear()
            weight = 0
            return got

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal weight, first_run, last_run
            last_run = (size, best["k"])
            first_run = first_run or last_run
            of_run = {"edge": False, "part": part, "run": run, "h": best["h"], "size": size, "keep_id": best["k"]}
            if only_kept:
                out.append(best | of_run | {"kept": True})
                weight += len(best["t"])
            at = len(ids) - 1 if last else 0
            for i, k in enumerate(ids):
                out.append(of_run | {"k": k, "kept": i == at})
                if len(out) >= FLUSH_ROWS:
                    yield flush()
            ids.clear()
            if len(out) >= FLUSH_ROWS or weight >= FLUSH_BYTES:
                yield flush()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    text = row["t"]
                    if before is None or text != before:
                        if size:
                            yield from close()
                        run, size, best = run + 1, 0, {}
                        first = text if first is None else first
                        before = text
                    size += 1
                    if last or size == 1:
                        best = row if only_kept else {"k": row["k"], "h": row["h"]}
                    if not only_kept:
                        ids.append(row["k"])
        if size:
            yield from close()
            out.append({"edge": True, "part": part, "run": run, "first": first, "last": before, "first_size": first_run[0], "first_keep": first_run[1], "last_size": last_run[0], "last_keep": last_run[1]})
            yield flush()

    kind = rows.schema["k"].dataType
    fields = [("edge", BooleanType()), ("part", IntegerType()), ("run", LongType()), ("k", kind), ("h", StringType()), ("size", LongType()), ("keep_id", kind), ("kept", BooleanType())]
    fields += [("t", BinaryType())] if only_kept else []
    fields += [("first", BinaryType()), ("last", BinaryType()), ("first_size", LongType()), ("first_keep", kind), ("last_size", LongType()), ("last_keep", kind)]
    schema = StructType([StructField(a, b) for a, b in fields] + [StructField(c, rows.schema[c].dataType) for c in carry])
    arrow, names = to_arrow_schema(schema), schema.names
    return rows.mapInArrow(work, schema)


def chains(edges: DataFrame) -> DataFrame:
    """For the outer runs of all partitions: rows of the whole run, over all partitions it crosses, its kept id, and whether
    this partition has the row to keep. Only the partitions' numbers, and then a few numbers for each, are ordered in one
    task; the texts at a border are compared in full where a shuffle brings the two together."""
    numbered = edges.join(edges.select("part").withColumn("i", F.row_number().over(Window.orderBy("part"))), "part")
    ahead = numbered.select((F.col("i") + 1).alias("i"), F.col("last").alias("before"))
    linked = numbered.join(ahead, "i", "left").withColumn("goes_on", F.coalesce(F.col("first") == F.col("before"), F.lit(False))).drop("first", "last", "before")
    outer = [F.struct(F.lit(0).cast("bigint").alias("run"), F.col("first_size").alias("size"), F.col("first_keep").alias("keep_id"), F.col("goes_on").alias("goes_on"))]
    outer += [F.struct(F.col("run"), F.col("last_size").alias("size"), F.col("last_keep").alias("keep_id"), F.lit(False).alias("goes_on"))]
    two = linked.select("part", F.inline(F.when(F.col("run") > 0, F.array(*outer)).otherwise(F.array(outer[0]))))
    return two.withColumn("chain", F.sum((~F.col("goes_on")).cast("bigint")).over(Window.orderBy("part", "run").rowsBetween(Window.unboundedPreceding, 0)))


def content_sort(df: DataFrame, keep: str = "min", key: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = unchanged, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of df: key, keep_id, group_size, kept, text_sha256. With carry, only the kept rows, and of these
    the columns named. keep: "min" keeps the smallest id of equal texts, "max" the largest."""
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    stage = Stage(df.sparkSession, "content-sort")
    plain = normalise is unchanged  # then the text need not be carried beside its content
    others = [c for c in carry or [] if c != key and not (c == text and plain)]
    carried = [F.col(c).alias(f"c_{i}") for i, c in enumerate(others)] + [F.col(text).isNull().alias("no_text")]
    names = [f"c_{i}" for i in range(len(others))] + ["no_text"]
    content = normalise(text_or_empty(text)).cast("binary")
    rows = df.select(F.col(key).alias("k"), content.alias("t"), *carried).withColumn("h", F.sha2("t", 256)).withColumn("lead", F.substring("t", 1, LEAD))
    id_order = F.col("k").asc_nulls_first() if keep == "max" else F.col("k").asc_nulls_last()
    dealt = rows.repartitionByRange("lead", "h", id_order).sortWithinPartitions("lead", "h", "t", id_order).drop("lead")
    marked = stage.write(runs(dealt, names, keep, carry is not None))
    two = chains(marked.filter("edge").select("part", "run", "first", "last", "first_size", "first_keep", "last_size", "last_keep"))
    place = F.struct("part", "run")
    held = (F.max_by if keep == "max" else F.min_by)(F.struct("part", "run", "keep_id"), place)
    whole = two.groupBy("chain").agg(F.sum("size").alias("all_size"), held.alias("holder"))
    # keeps of pieces are in order, nulls aside: the outermost piece with an id has the chain's
    best = two.groupBy("chain").agg((F.max if keep == "max" else F.min)("keep_id").alias("all_keep"))
    outer = two.select("part", "run", "chain").join(whole, "chain").join(best, "chain").select("part", "run", "all_size", "all_keep", (place == F.struct("holder.part", "holder.run")).alias("here"))
    found = join_by_size(marked.filter("not edge").drop("first", "last", "first_size", "first_keep", "last_size", "last_keep"), outer, ["part", "run"], "left")
    kept = F.col("kept") & F.coalesce("here", F.lit(True))
    if carry is not None:
        back = {c: F.col(f"c_{i}") for i, c in enumerate(others)} | {key: F.col("k")}
        if plain:
            back[text] = F.when(~F.col("no_text"), F.col("t").cast("string"))
        return found.filter(kept).select(*[back[c].alias(c) for c in carry])
    return found.select(
        F.col("k").alias(key),
        F.coalesce("all_keep", "keep_id").alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        kept.alias("kept"),
        F.col("h").alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"), keep="max")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
