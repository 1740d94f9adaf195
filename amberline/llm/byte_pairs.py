"""Byte-level BPE encoding and decoding.

Token bytes are mapped to Latin-1 characters, one for each byte, and put into an Aho-Corasick automaton. One pass over a
piece gives, for each start, every token that begins there. The encoder takes the longest, goes to shorter ones or back
one token where the next token does not fit its neighbour, and never tries a position again that has been found dead:
its work is linear in the piece. Two tokens fit if merging their joined bytes gives these two tokens again; by that
property of adjacent pairs a sequence is what the merges give. Answers for pairs are kept, as are whole pieces.

Nulls and empty texts have no tokens; ids of other columns and clashing names are left alone, since only the key and the
text are read. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm.common import map_rows, table, text_or_empty

#: Most pieces, and pairs, kept by one worker.
KEEP = 400_000
#: Keys longer than this are not kept.
LONG = 64


class Pieces(dict):
    """What ``find`` gives, by key, found on first use. Half of what is kept is older: what is asked for again is taken over
    before the older half goes. Text or bytes of more than LONG characters are found anew each time, so that what is kept is
    bounded by bytes as well as by number."""

    def __init__(self, find, keep: int = KEEP):
        super().__init__()
        self.find, self.half, self.old = find, keep // 2, {}

    def __missing__(self, key):
        if isinstance(key, (str, bytes)) and len(key) > LONG:
            return self.find(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.find(key)
        self[key] = out
        return out


class BytePairCodec:
    """ranks: token bytes to rank. pattern: the pre-tokenizer's expression."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.rank_of = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.latin_of = {rank: token for token, rank in self.rank_of.items()}
        self.split = regex.compile(pattern).findall
        self.size_of = {rank: len(token) for token, rank in self.rank_of.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank_of.items():
            if len(token) > 1:  # single bytes always match, so they need no search
                self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.pieces = Pieces(lambda piece: tuple(self.encode_piece(piece.encode("utf-8").decode("latin-1"))))
        self.fits = Pieces(lambda pair: self.merge(self.latin_of[pair[0]] + self.latin_of[pair[1]]) == list(pair))

    def merge(self, data: str) -> list[int]:
        """The definition: join the adjacent pair of lowest rank until none is left."""
        parts = list(data)
        rank_of = self.rank_of
        ranks = [rank_of.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            at, best = -1, None
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    at, best = i, r
            if best is None:
                return [rank_of[x] for x in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of.get(parts[at] + parts[at + 1])
            if at:
                ranks[at - 1] = rank_of.get(parts[at - 1] + parts[at])

    def encode_piece(self, data: str) -> list[int]:
        """data: a piece's bytes as Latin-1 characters."""
        whole = self.rank_of.get(data)
        if whole is not None:
            return [whole]
        sizes, fits, end = self.size_of, self.fits, len(data)
        starts = [[self.rank_of[x]] for x in data]  # by start, from short to long
        for last, token in self.automaton.iter(data):
            starts[last - sizes[token] + 1].append(token)
        alive = bytearray(b"\1") * (end + 1)
        path: list[tuple[int, int, int]] = []  # start, place among the tokens of that start, token
        at, k = 0, len(starts[0]) - 1
        while at < end:
            options = starts[at]
            while k >= 0:
                token = options[k]
                if alive[at + sizes[token]] and (not path or fits[path[-1][2], token]):
                    break
                k -= 1
            if k >= 0:
                path.append((at, k, token))
                at += sizes[token]
                k = len(starts[at]) - 1 if at < end else -1
            else:
                alive[at] = 0
                at, k, _ = path.pop()
                k -= 1
        return [token for _, _, token in path]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a .tiktoken file: base64 of a token, a space, its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


@lru_cache(maxsize=2)
def codec(data: bytes, pattern: str) -> BytePairCodec:
    return BytePairCodec(read_ranks(data), pattern)


def encode_decode(df: DataFrame, ranks_file: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (array<int>) and decoded (binary).

    The vocabulary (some 50,000 entries, half a MB, fixed by its file) is broadcast as the file's bytes."""
    spark = df.sparkSession
    with open(ranks_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def make():
        c = codec(shared.value, pattern)
        names = Pieces(str, 1 << 20)

        def work(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"k": rows["k"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            if with_ids:
                out |= {"ids": [], "decoded": []}
            for t in rows["t"]:
                ids = c.encode(t)
                data = c.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
                    out["decoded"].append(data)
            return out

        return work

    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")
    return map_rows(df.select(F.col(key).alias("k"), text_or_empty(text).alias("t")), make, schema).withColumnRenamed("k", key)


def op10_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
