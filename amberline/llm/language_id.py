"""Language identification by character language models.

One interpolated Kneser-Ney model for each language, over the characters of words between two marks, up to ORDER
characters at a time. All n-grams and contexts stand as sorted arrays of 64-bit hashes; beside each hash stands, for each
language, the log probability (or the weight that a context leaves to shorter ones). A text's cross-entropy under a
language is the mean over its characters and word ends; the lowest wins. Words repeat, so each worker keeps what it found
for a word.

Rejection is calibrated on learning rows that the models did not see: a text is rejected if its cross-entropy lies
SPREAD standard errors and SLACK nats above the mean of its language, where the standard error is that of a text of so
many words. A text without a letter is rejected as ``und``.

Models are fitted on at most SAMPLE texts for each language, the first in order of a hash of the key, whole, of which every
fifth only calibrates. Rows with a null language or text do not teach. A null text, or one without a letter, is ``und`` with
score 0, as is every text if nothing can be learned. Only the key, the text and, to learn, the language are read.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amberline.llm.common import crc_fold, filter_rows, map_rows, table, text_or_empty

ORDER = 5
SAMPLE = 200
SPREAD, SLACK = 6.0, 0.75
#: The score is the share of the best language when each is weighted by exp(-SHARPNESS * cross-entropy).
SHARPNESS = 10.0
UNDETERMINED = "und"
#: Base of the unigram model: as many characters as Unicode could have in use.
CHARACTERS = 150_000
KEEP_BYTES = 48 << 20

WORDS = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
MULTIPLIER = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def words_of(text: str) -> list[str]:
    """Runs of letters; a text without one that Python's ``isalpha`` knows has none."""
    return WORDS.findall(text.lower())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_hashes(chars: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """chars: code points of marked words, one after another; starts: of each character, where its word starts. Hash of the
    n characters that end at each place, and where these lie within one word."""
    h = np.full(len(chars), n, np.uint64)
    for back in range(n):
        h[back:] += (chars[: max(0, len(chars) - back)] + np.uint64(1)) * MULTIPLIER[back]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h, np.arange(len(chars)) - n + 1 >= starts


def marked(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words between marks, start of the word of each, place in the list of each."""
    text = "".join(START + w + END for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(sizes) - sizes
    return chars, np.repeat(begin, sizes), np.repeat(np.arange(len(words)), sizes)


class KneserNey:
    """One language's model as dictionaries; only for fitting."""

    def __init__(self, words: Counter, order: int):
        raw: list[Counter] = [Counter() for _ in range(order + 1)]
        for w, c in words.items():
            s = START + w + END
            for n in range(1, order + 1):
                for i in range(max(n, 2), len(s) + 1):  # the start mark is never predicted
                    raw[n][s[i - n : i]] += c
        self.order, self.value, self.left = order, [{} for _ in range(order + 1)], [{} for _ in range(order + 1)]
        counts = [Counter() for _ in range(order + 1)]
        counts[order] = raw[order]
        for n in range(order - 1, 0, -1):
            # how many characters go before a gram; what starts a word has nothing before it and keeps its own count
            counts[n] = Counter(g[1:] for g in raw[n + 1])
            counts[n].update({g: c for g, c in raw[n].items() if g[0] == START})
        for n in range(1, order + 1):
            of = Counter(counts[n].values())
            discount = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
            total, kinds = defaultdict(float), defaultdict(int)
            for g, c in counts[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            for context, t in total.items():
                self.left[n][context] = discount * kinds[context] / t
            for g, c in counts[n].items():
                context = g[:-1]
                lower = self.probability(g[1:]) if n > 1 else 1 / CHARACTERS
                self.value[n][g] = max(c - discount, 0) / total[context] + self.left[n][context] * lower

    def probability(self, gram: str) -> float:
        """Of the last character after those before it."""
        n = len(gram)
        if not n:
            return 1 / CHARACTERS
        found = self.value[n].get(gram)
        return self.left[n].get(gram[:-1], 1.0) * self.probability(gram[1:]) if found is None else found


def sorted_arrays(grams: list[str], n: int, value) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of strings of n characters, sorted; log of value(string, model's place) for each."""
    if not grams:
        return np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)
    chars = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = gram_hashes(chars, np.zeros(len(chars), np.int64), n)[0][n - 1 :: n] if n else np.zeros(1, np.uint64)
    order = np.argsort(h)
    return h[order], np.log(np.array([value(grams[i]) for i in order], np.float64)).astype(np.float32)


class LanguageModels:
    """Models of all languages in shared sorted hash arrays; ``mean`` and ``spread`` by language after calibration."""

    def __init__(self, words: dict[str, Counter], order: int = ORDER):
        self.languages, self.order = sorted(words), order
        models = [KneserNey(words[x], order) for x in self.languages]
        self.grams, self.contexts = [None], [None]
        for n in range(1, order + 1):
            seen = sorted({g for m in models for g in m.value[n]})
            self.grams.append(sorted_arrays(seen, n, lambda g: [m.probability(g) for m in models]))
            before = sorted({c for m in models for c in m.left[n]})
            self.contexts.append(sorted_arrays(before, n - 1, lambda c, n=n: [m.left[n].get(c, 1.0) for m in models]))
        self.mean = self.spread = np.zeros(len(models))

    @staticmethod
    def find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes the table has, and their places in it."""
        keys = table[0]
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, at

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, its end included, under each language."""
        chars, starts, word = marked(words)
        out = np.zeros((len(chars), len(self.languages)), np.float32)
        place = np.arange(len(chars))
        open_ = place > starts  # all but the start marks
        for n in range(self.order, 0, -1):
            h, inside = gram_hashes(chars, starts, n)
            at = np.flatnonzero(open_ & inside)
            hit, row = self.find(self.grams[n], h[at])
            out[at[hit]] += self.grams[n][1][row[hit]]
            open_[at[hit]] = False
            missed = at[~hit]
            if n > 1:
                before = gram_hashes(chars, starts, n - 1)[0][missed - 1]
            else:
                before = np.zeros(len(missed), np.uint64)
            known, row = self.find(self.contexts[n], before)
            out[missed[known]] += self.contexts[n][1][row[known]]
        out[open_] -= math.log(CHARACTERS)
        total = np.zeros((len(words), len(self.languages)))
        np.add.at(total, word, out)
        return total

    def calibrate(self, counts: dict[str, Counter]) -> None:
        """Mean cross-entropy of the words of each language's own texts, and the deviation of one word's about it."""
        self.mean, self.spread = np.zeros(len(self.languages)), np.ones(len(self.languages))
        for i, x in enumerate(self.languages):
            every = counts.get(x)
            if not every:
                continue
            words = list(every)
            sizes = np.array([len(w) + 1 for w in words])
            count = np.array([every[w] for w in words])
            entropy = -self.score_words(words)[:, i] / sizes
            self.mean[i] = (entropy * sizes * count).sum() / (sizes * count).sum()
            self.spread[i] = math.sqrt(((entropy - self.mean[i]) ** 2 * count).sum() / count.sum())


class Memory:
    """Scores of words, found in bulk."""

    def __init__(self, models: LanguageModels):
        self.models, width = models, max(1, len(models.languages))
        self.most = max(10_000, min(300_000, KEEP_BYTES // (4 * width)))
        self.index: dict[str, int] = {}
        self.rows = np.zeros((self.most, width), np.float32)

    def cross_entropy(self, texts: list[Counter]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            new: dict[str, None] = {}
            end = at
            while end < len(texts) and (end == at or len(self.index) + len(new) + len(texts[end]) <= self.most):
                new.update(dict.fromkeys(w for w in texts[end] if w not in self.index))
                end += 1
            if len(self.index) + len(new) > self.most:
                self.index.clear()
                new = dict.fromkeys(texts[at])
                if len(new) > self.most:  # one text with more words than are kept
                    out.append(self.long_text(texts[at]))
                    at += 1
                    continue
                end = at + 1
            if new:
                words, first = list(new), len(self.index)
                self.rows[first : first + len(words)] = self.models.score_words(words)
                self.index.update(zip(words, range(first, first + len(words)), strict=True))
            for t in texts[at:end]:
                count = np.fromiter(t.values(), np.float64, len(t))
                found = np.fromiter(map(self.index.__getitem__, t), np.int64, len(t))
                out.append(-(count @ self.rows[found]) / sum(c * (len(w) + 1) for w, c in t.items()))
            at = end
        return out

    def long_text(self, text: Counter) -> np.ndarray:
        words, total = list(text), 0.0
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            total = total + np.array([text[w] for w in some], np.float64) @ self.models.score_words(some)
        return -total / sum(c * (len(w) + 1) for w, c in text.items())


def fit(df: DataFrame, key: str, text: str, language: str, sample: int = SAMPLE) -> LanguageModels:
    """Models from at most ``sample`` texts of each language in df, whole, the first in order of a hash of the key."""
    first = Window.partitionBy("l").orderBy("h", "k")
    rows = df.filter(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(language).alias("l"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).alias("t"))
    some = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample).select("l", (F.col("n") % 5 == 0).alias("aside"), "t")

    def make():
        def work(r: dict[str, list]) -> dict[str, list]:
            found = [Counter(words_of(t)) for t in r["t"]]
            return {c: [x for x, f in zip(r[c], found, strict=True) for _ in f] for c in ("l", "aside")} | {"word": [w for f in found for w in f], "n": [n for f in found for n in f.values()]}

        return work

    kind = df.schema[language].dataType.simpleString()
    # what comes to the driver are the distinct words of the sampled texts, with their numbers
    counted = map_rows(some, make, f"l {kind}, aside boolean, word string, n bigint").groupBy("l", "aside", "word").agg(F.sum("n").alias("n"))
    words: dict[str, Counter] = defaultdict(Counter)
    unseen: dict[str, Counter] = defaultdict(Counter)
    for r in counted.sort("l", "aside", "word").toArrow().to_pylist():
        (unseen if r["aside"] else words)[r["l"]][r["word"]] = r["n"]
    for x in list(unseen):
        if x not in words:
            words[x].update(unseen[x])
    models = LanguageModels(dict(words))
    models.calibrate({x: unseen.get(x) or words[x] for x in words})
    return models


@lru_cache(maxsize=2)
def memory(data: bytes) -> Memory:
    return Memory(pickle.loads(data))


def judge(kept: Memory, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
    """(language, score, cross-entropy, whether it is rejected) of each text."""
    m = kept.models
    found = [Counter(words_of(t)) if has_letter(t) and m.languages else Counter() for t in texts]
    entropies = iter(kept.cross_entropy([f for f in found if f]))
    out = []
    for words in found:
        if not words:
            out.append((UNDETERMINED, 0.0, None, True))
            continue
        entropy = next(entropies)
        i = int(entropy.argmin())
        share = 1 / float(np.exp(SHARPNESS * (entropy[i] - entropy)).sum())
        limit = m.mean[i] + SPREAD * m.spread[i] / math.sqrt(sum(words.values())) + SLACK
        out.append((m.languages[i], share, float(entropy[i]), bool(entropy[i] > limit)))
    return out


def accepted(df: DataFrame, models: LanguageModels, text: str = "text") -> DataFrame:
    """The rows of df, with all columns, that are not rejected."""
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(models))

    def make():
        kept = memory(shared.value)
        return lambda texts: [not x[3] for x in judge(kept, texts)]

    return filter_rows(df, text, make)


def predict(df: DataFrame, models: LanguageModels, key: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """key, the extra columns, lang_pred, score, cross_entropy, rejected. The models, whose size SAMPLE bounds, are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(models))
    names = list(extra or {})

    def make():
        kept = memory(shared.value)

        def work(rows: dict[str, list]) -> dict[str, list]:
            columns = zip(*judge(kept, rows["t"]), strict=True)
            return {"k": rows["k"]} | {c: rows[c] for c in names} | dict(zip(("lang_pred", "score", "cross_entropy", "rejected"), map(list, columns), strict=True))

        return work

    rows = df.select(F.col(key).alias("k"), text_or_empty(text).alias("t"), *[c.alias(n) for n, c in (extra or {}).items()])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "t") + ", lang_pred string, score double, cross_entropy double, rejected boolean"
    return map_rows(rows, make, schema).withColumnRenamed("k", key)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = fit(docs.filter(crc_fold() != 2), "doc_id", "text", "lang")
    return predict(docs, models, extra={"held_out": F.coalesce(crc_fold() == 2, F.lit(False))})
