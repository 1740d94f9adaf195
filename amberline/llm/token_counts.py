"""Token counts without token ids.

Documents are taken in blocks. A block's distinct pre-tokens are rows of one table, its documents' frequencies of them one
more row. The pre-tokens of all blocks are sorted, so that equal ones are neighbours: the library counts the pieces of every
distinct one once, and its rows take the count in the same pass, a merge join. The counts meet the frequencies block by block,
where they are multiplied and summed. No list of ids is ever made. A pre-token moves once for each block that has it and a pair of document and pre-token about two bytes, packed,
where a row for each pair would be more bytes than the texts. The hottest pre-token has one row a block.

A special token's string inside a text is one token, as the library does it by default. Nulls count as empty texts and
have 0 tokens. Only the key and the text are read, so other columns do not matter; repeated rows give repeated results.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from amberline.llm.common import Stage, map_rows, table, text_or_empty

#: A block ends with the document that brings it to so many characters, or to so many documents.
BLOCK_CHARS, BLOCK_ROWS = 32 << 20, 1 << 16
#: Pre-tokens are written in batches of so many and go to the library in lists of so many characters.
AT_ONCE, AT_ONCE_CHARS = 20_000, 4 << 20
#: Counted rows are packed by block when there are so many.
HELD = 1 << 20


class PreTokens:
    """definition: the text of a tokenizers .json with a byte-level pre-tokenizer and no normalizer."""

    def __init__(self, definition: str, pattern: str):
        parsed = json.loads(definition)
        pre = parsed["pre_tokenizer"]
        if parsed["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only a plain byte-level pre-tokenizer splits texts as the pattern does")
        special = sorted((x["content"] for x in parsed["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = regex.compile(pattern).findall

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Of pre-tokens; and how many special tokens stand between them."""
        if self.special is None or not self.special.search(text):
            return Counter(self.split(text)), 0
        parts, found = self.special.split(text), Counter()
        for part in parts:
            found.update(self.split(part))
        return found, len(parts) - 1


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes: the high ones are nearly all zero."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Block:
    """Documents' ids, sizes and frequencies of pre-tokens, which have the places of their first appearance."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.specials, self.lengths, self.at, self.times, self.chars = [], [], [], [], [], [], 0
        self.place: defaultdict[str, int] = defaultdict()
        self.place.default_factory = self.place.__len__

    def add(self, key, text: str, found: Counter, specials: int) -> None:
        self.ids.append(key)
        self.sizes.append(len(text.encode("utf-8")))
        self.specials.append(specials)
        self.lengths.append(len(found))
        at = np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))
        order = np.argsort(at)
        self.at.append(np.diff(at[order], prepend=0).astype(np.uint32))  # steps from place to place: smaller, so they pack better
        self.times.append(np.fromiter(found.values(), np.uint32, len(found))[order])
        self.chars += len(text)

    def full(self, rows: int) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.ids) >= rows

    def rows(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Its pre-tokens, then itself. Pre-tokens of 32 bytes and more go by their digest, which shorter ones cannot be."""
        names, n = list(self.place), len(schema)
        for begin in range(0, len(names), AT_ONCE):
            some = names[begin : begin + AT_ONCE]
            raw = [p.encode("utf-8") for p in some]
            keys = [b if len(b) < 32 else hashlib.sha256(b).digest() for b in raw]
            long = [p if len(b) >= 32 else None for p, b in zip(some, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[number] * len(some), range(begin, begin + len(some)), keys, long, *[[None] * len(some)] * (n - 4)], schema, strict=True)], schema=schema)
        empty = [np.zeros(0, np.uint32)]
        packed = [pack(np.concatenate(x or empty)) for x in (self.at, self.times)]
        whole = [number, None, None, None, self.ids, self.sizes, self.specials, self.lengths, *packed]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(whole, schema, strict=True)], schema=schema)


def blocks(df: DataFrame, definition: Broadcast, pattern: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """df: k and t. Rows of (block, at, key, long) for pre-tokens, and of block and the rest for blocks."""
    kind = df.schema["k"].dataType.simpleString()
    ddl = f"block bigint, at int, key binary, long string, ids array<{kind}>, sizes array<bigint>, specials array<int>, lengths array<int>, places binary, times binary"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(1_000_000, 20, 20)
        split, number, block = PreTokens(definition.value, pattern), TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512).to_pydict()
                for k, t in zip(some["k"], some["t"], strict=True):
                    block.add(k, t, *split.frequencies(t))
                    if block.full(rows):
                        yield from block.rows(number, arrow)
                        number, block = number + 1, Block()
        if block.ids:
            yield from block.rows(number, arrow)

    return df.mapInArrow(work, ddl)


def count_pieces(pieces: DataFrame, definition: Broadcast, at_most: int = HELD) -> DataFrame:
    """pieces: block, at, key and, of long ones, the pre-token, with equal keys side by side in one partition. Every key is
    counted once. Rows of of_block with packed places and numbers of pieces, several for a block."""
    ddl = "of_block bigint, ats binary, ns binary"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def by_block(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        block, at, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, block))
        names, begins = np.unique(block[order], return_index=True)
        parts = [[pack(x) for x in np.split(c[order], begins[1:])] for c in (at, n)]
        return pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(x, pa.binary()) for x in parts]], schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is its share
        library, last, n, held, rows = Tokenizer.from_str(definition.value), None, 0, [], 0
        for batch in batches:
            keys, long = batch.column("key").to_pylist(), batch.column("long")
            first = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else last)]
            counts, some, size = [n], [], 0
            for i in first:
                some.append(long[i].as_py() if long[i].is_valid else keys[i].decode("utf-8"))
                size += len(some[-1])
                if size >= AT_ONCE_CHARS:
                    counts += map(len, library.encode_batch_fast(some, add_special_tokens=False))
                    some, size = [], 0
            counts += map(len, library.encode_batch_fast(some, add_special_tokens=False))
            of_row = np.repeat(counts, np.diff([0, *first, len(keys)]))
            held.append((batch.column("block").to_numpy(), batch.column("at").to_numpy(), of_row))
            last, n, rows = keys[-1] if keys else last, counts[-1], rows + len(keys)
            if rows >= at_most:
                yield by_block(held)
                held, rows = [], 0
        if rows:
            yield by_block(held)

    return pieces.mapInArrow(work, ddl)


def count_tokens(df: DataFrame, tokenizer_file: str, pattern: str, limit: int, key: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS, held: int = HELD) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (more than ``limit`` tokens). The definition, a fixed file of some MB, is broadcast.
    The blocks are a table in the shared folder, so that a lost executor does not take them with it."""
    spark = df.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    stage = Stage(spark, "token-counts")
    made = stage.write(blocks(df.select(F.col(key).alias("k"), text_or_empty(text).alias("t")), shared, pattern, block_rows), "zstd")
    pieces = made.filter("key IS NOT NULL").select("block", "at", "key", "long")
    counted = count_pieces(pieces.repartition("key").sortWithinPartitions("key"), shared, held)
    whole = made.filter("key IS NULL").select("block", "ids", "sizes", "specials", "lengths", "places", "times")
    ddl = f"k {df.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def total(block: pa.Table, found: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0] for c in block.column_names}
        ats, ns = ([unpack(x.as_py()) for x in found.column(c)] or [np.zeros(0, np.int64)] for c in ("ats", "ns"))
        of_place = np.zeros(sum(map(len, ats)), np.int64)
        of_place[np.concatenate(ats)] = np.concatenate(ns)
        lengths = row["lengths"].values.to_numpy(zero_copy_only=False)
        ends, steps = np.cumsum(lengths), np.concatenate([[0], np.cumsum(unpack(row["places"].as_py()))])
        products = of_place[steps[1:] - np.repeat(steps[ends - lengths], lengths)] * unpack(row["times"].as_py())
        sums = np.concatenate([[0], np.cumsum(products)])
        n = sums[ends] - sums[ends - lengths] + row["specials"].values.to_numpy(zero_copy_only=False)
        return pa.Table.from_arrays([row["ids"].values, row["sizes"].values, pa.array(n, pa.int64()), pa.array(n > limit)], schema=arrow)

    return whole.groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(total, ddl).withColumnRenamed("k", key)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=512)
