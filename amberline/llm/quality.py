"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader (proximal).

Tokens are runs of word characters and runs of other signs; a token's shape (kinds of characters, runs shortened; or that it
repeats the one before) counts beside it. Uni- and bigrams of both are hashed into 2 ** BITS places; a text's vector holds log(1 + count) at each place and
has length 1. A score is the logistic function of a sparse dot product. The weights, 2 ** BITS numbers, are broadcast.

Training takes at most SAMPLE labelled rows, the first in order of a hash of the key, and of these only so many that their
vectors have at most PLACES places together (one row at least, whole texts always). Those keys alone are broadcast to find
their texts; hashed vectors are written to the shared folder, the driver reads their sizes and then the vectors it takes. A
key with several labels counts with its smallest, one with several texts with the smallest digest. Null labels do not teach. A null text counts as empty, and an empty one is scored by the bias alone. With no label at all the score is 0.5.
Only the key and the text are read to score; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm.byte_pairs import Pieces
from amberline.llm.common import Stage, crc_fold, map_rows, table, text_or_empty

BITS = 18
SAMPLE = 6_000
#: 12 bytes each as they come to the driver: 96 MB.
PLACES = 8_000_000
#: Steps of training: the examples are gone through as often as this needs, between 3 and 20 times.
STEPS = 18_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
KEEP = 200_000

TOKENS = re.compile(r"\w+|[^\w\s]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
REPEAT = np.uint64(0xD1B54A32D192ED03)


def shape(token: str) -> str:
    """Kinds of characters, runs shortened to one: ``Xx`` for a capitalised word, the sign itself for signs."""
    out = []
    for c in token:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)[:16] + (str(min(len(token), 8)) if len(out) == 1 and out[0] not in "Xx9" else "")


def token_hashes(token: str) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(token.lower(), 1), xxhash.xxh3_64_intdigest(shape(token), 2)


@lru_cache(maxsize=1)
def known_tokens() -> Pieces:
    return Pieces(token_hashes, KEEP)


def vector(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the text's sparse vector."""
    tokens = TOKENS.findall(text)
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    pairs = np.array(list(map(known_tokens().__getitem__, tokens)), np.uint64)
    pairs[1:, 1][pairs[1:, 0] == pairs[:-1, 0]] = REPEAT  # a word said again has a shape of its own
    grams = [pairs.ravel()]
    for c in (0, 1):
        h = pairs[:, c]
        grams.append((h[:-1] * MIX + h[1:]) * np.uint64(0xD6E8FEB86659FD93))
    place, count = np.unique((np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    value = np.log1p(count)
    return place, value / math.sqrt(float(value @ value))


class FollowTheLeader:
    """FTRL-proximal for logistic loss. The bias is a place of its own, not regularised by L1."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    @staticmethod
    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def weights(self) -> np.ndarray:
        return self.weight(self.z, self.n, L1)

    def bias(self) -> float:
        return float(self.weight(self.bias_z, self.bias_n, 0.0))

    def learn(self, place: np.ndarray, value: np.ndarray, label: int) -> None:
        z, n = self.z[place], self.n[place]
        w, b = self.weight(z, n, L1), self.bias()
        loss = logistic(float(w @ value) + b) - label
        g = loss * value
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[place] += g - step * w
        self.n[place] += g * g
        step = (math.sqrt(self.bias_n + loss * loss) - math.sqrt(self.bias_n)) / ALPHA
        self.bias_z += loss - step * b
        self.bias_n += loss * loss


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias. Every epoch goes through the examples in an order of its own."""
    model = FollowTheLeader()
    for epoch in range(min(20, max(3, -(-steps // max(1, len(examples)))))):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            model.learn(*examples[i])
    return model.weights().astype(np.float32), model.bias()


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE, places: int = PLACES) -> tuple[np.ndarray, float]:
    """Learns from at most ``sample`` labelled rows of docs, whose vectors have at most ``places`` places together."""
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"))
    some = marks.withColumn("h", F.xxhash64(F.col("k").cast("string"))).orderBy("h", "k").limit(sample).drop("h")
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).join(F.broadcast(some), "k")

    def make():
        def work(r: dict[str, list]) -> dict[str, list]:
            found = [vector(t) for t in r["t"]]
            out = {"k": r["k"], "y": r["y"], "size": [len(p) for p, _ in found], "digest": [xxhash.xxh3_64_hexdigest(t) for t in r["t"]]}
            return out | {"place": [p.astype(np.int32).tobytes() for p, _ in found], "value": [v.tobytes() for _, v in found]}

        return work

    kind = docs.schema[key].dataType.simpleString()
    stage = Stage(docs.sparkSession, "quality")
    made = stage.write(map_rows(rows, make, f"k {kind}, y int, size int, digest string, place binary, value binary"))
    sizes = made.groupBy("k").agg(F.min(F.struct("digest", "size")).alias("first")).select("k", "first.*").toArrow().to_pylist()
    taken, total = {}, 0
    for r in sorted(sizes, key=lambda r: (xxhash.xxh64_intdigest(str(r["k"])), str(r["k"]))):
        total += r["size"]
        if taken and total > places:
            break
        taken[r["k"]] = r["digest"]
    wanted = made.filter(F.col("k").isin(list(taken))) if len(taken) < len(sizes) else made
    got = {r["k"]: r for r in wanted.toArrow().to_pylist() if taken.get(r["k"]) == r["digest"]}
    stage.drop(made)
    return train([(np.frombuffer(r["place"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float64), r["y"]) for r in map(got.__getitem__, taken)])


def score(df: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text", threshold: float = 0.7, extra: dict[str, Column] | None = None) -> DataFrame:
    """key, the extra columns, score, predicted."""
    weights, bias = model
    shared = df.sparkSession.sparkContext.broadcast(weights)
    names = list(extra or {})

    def make():
        w = shared.value

        def work(rows: dict[str, list]) -> dict[str, list]:
            out = []
            for t in rows["t"]:
                place, value = vector(t)
                out.append(logistic(float(w[place] @ value) + bias))
            return {"k": rows["k"]} | {c: rows[c] for c in names} | {"score": out, "predicted": [int(s >= threshold) for s in out]}

        return work

    rows = df.select(F.col(key).alias("k"), text_or_empty(text).alias("t"), *[c.alias(n) for n, c in (extra or {}).items()])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "t") + ", score double, predicted int"
    return map_rows(rows, make, schema).withColumnRenamed("k", key)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(crc_fold() != 2), "doc_id", "text", "quality")
    return score(docs, model, extra={"held_out": F.coalesce(crc_fold() == 2, F.lit(False))})
