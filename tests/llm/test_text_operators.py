"""Edge cases of all operators, and each against a plain version of what it does."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from amberline.llm import byte_pairs, chat, exact_dedup, jpeg, language_id, mixing, ngram_join, quality, secrets, token_counts

RANKS, DEFINITION = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "a", "Ünï😀 \n\t<|endoftext|> x", "\x00﻿", "word " * 5000, "日本語" * 400, "1234567890" * 3, "ſK token = \"abcdefgh12345678\""]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, t int, x string, h string, edge boolean, ids int"


def frame(spark, texts, langs=None, sources=None):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, (langs or [None] * len(texts))[i], (sources or [None] * len(texts))[i], None, "k", 1, "x", "h", None, 0) for i, t in enumerate(texts)], SCHEMA)


def prose(seed, words=120, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) if r.random() < 0.5 else f"w{r.randrange(vocabulary)}" for _ in range(words))


RUN = {
    "jpeg": lambda df: jpeg.text_media(df),
    "store": lambda df: jpeg.media_features(jpeg.store_texts(df), "doc_id", "media"),
    "mix": lambda df: mixing.mix(df, {"a": 2}, block=2),
    "mixed_rows": lambda df: mixing.mixed_rows(df, {"a": 2}),
    "join": lambda df: ngram_join.jaccard_components(df),
    "tokens": lambda df: token_counts.count_tokens(df, DEFINITION, P.PATTERN, 512),
    "quality": lambda df: quality.score(df, quality.fit(df, df.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality"), "doc_id", "text", "quality")),
    "quality without labels": lambda df: quality.score(df, quality.fit(df, df.selectExpr("doc_id", "cast(null as int) AS quality"), "doc_id", "text", "quality")),
    "dedup": lambda df: exact_dedup.content_sort(df, keep="max"),
    "language": lambda df: language_id.predict(df, language_id.fit(df, "doc_id", "text", "lang")),
    "secrets": lambda df: secrets.scan_secrets(df, with_spans=True),
    "pairs": lambda df: byte_pairs.encode_decode(df, RANKS, P.PATTERN, with_ids=True),
}


@pytest.mark.parametrize("name", RUN)
def test_odd_and_empty_tables(spark, name):
    texts = ODD + ODD
    full = RUN[name](frame(spark, texts, langs=["en", None] * len(ODD), sources=["a", None, "b"] * 8))
    assert full.count() == len(texts)
    assert RUN[name](frame(spark, texts).filter("doc_id < 0")).count() == 0


# ---- 1 ----------------------------------------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=3000))
def test_jpeg_round_trip(data):
    payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
    stored = jpeg.store(payload)
    ((scan, picture),) = jpeg.thumbnails([stored])[0]
    assert picture.tobytes() == payload and (scan.width, scan.height) == (192, len(payload) // 3)


def test_long_payloads_take_wider_images(monkeypatch):
    monkeypatch.setattr(jpeg, "AT_ONCE", 576 * 8)
    r = random.Random(1)
    for size in (576 * 341, 576 * 342, 576 * 1000, 576 * 1009):
        payload = r.randbytes(size)
        ((scan, picture),) = jpeg.thumbnails([jpeg.store(payload)])[0]
        assert picture.tobytes() == payload and scan.height <= 65535 and scan.width % 192 == 0
    monkeypatch.setattr(jpeg, "MOST_ROWS", 24)
    monkeypatch.setattr(jpeg, "MOST_WIDE", 24)
    payload = r.randbytes(576 * 31)
    (images,) = jpeg.thumbnails([jpeg.store(payload)])
    assert len(images) == 2 and b"".join(p.tobytes() for _, p in images) == payload


def test_text_media_against_a_plain_version(spark):
    """Digests by hand, and the stored form read by a decoder of its own: bit by bit, a dictionary of the codes."""
    texts = ["", "abc", "Grüße " * 300, "x" * 576, "日本" * 200, None, "abc"]
    rows = {r.doc_id: r for r in jpeg.text_media(frame(spark, texts)).collect()}
    media = {r.doc_id: bytes(r.media) for r in jpeg.store_texts(frame(spark, texts)).collect()}
    codes = {(length, code): size for size, (code, length) in enumerate(jpeg.codes(jpeg.DC_COUNTS))}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        assert rows[i].n_bytes == len(data) and rows[i].payload_bytes == len(payload) and rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert rows[i].tail_crc32 == zlib.crc32(payload[-32:]) and rows[i].media_sha256 == hashlib.sha256(media[i]).hexdigest() and rows[i].media_bytes == len(media[i])
        scan = media[i][media[i].index(b"\xff\xda") + 10 : -2]
        back = []
        for interval in re.split(rb"\xff[\xd0-\xd7]", scan):
            bits = "".join(f"{b:08b}" for b in interval.replace(b"\xff\x00", b"\xff"))
            at, level = 0, 0
            for _ in range(24):
                n = next(n for n in range(1, 17) if (n, int(bits[at : at + n], 2)) in codes)
                size = codes[n, int(bits[at : at + n], 2)]
                at += n
                value = int(bits[at : at + size] or "0", 2)
                level += value if not size or value >> (size - 1) else value - (1 << size) + 1
                at += size + 1  # and the end of block
                back.append(level + 128)
        assert bytes(back) == payload
    assert rows[1].feature == rows[6].feature and rows[1].media_sha256 == rows[6].media_sha256


def encoder(width, height, parts, dc, ac, every=0):
    """A small baseline encoder: parts are (across, down); dc and ac give terms by component and block."""
    dcs, acs = jpeg.codes(jpeg.DC_COUNTS), {0: "00", 0x21: "01", 0xF0: "100"}  # AC: end, two zeros and one bit, sixteen zeros
    bits, out, last, n = "", b"", [0] * len(parts), 0
    most = max(a for a, _ in parts), max(d for _, d in parts)
    mcus = -(-width // (8 * most[0])) * -(-height // (8 * most[1]))

    def flush():
        nonlocal bits, out
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""

    for m in range(mcus):
        if every and m and m % every == 0:
            flush()
            out += bytes([255, 0xD0 + (m // every - 1) % 8])
            last = [0] * len(parts)
        for c, (across, down) in enumerate(parts):
            for _ in range(across * down):
                v = dc(c, n)
                d, last[c] = v - last[c], v
                size = abs(d).bit_length()
                code, length = dcs[size]
                bits += f"{code:0{length}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
                bits += acs[0xF0] + acs[0x21] + "1" if ac(c, n) else ""
                bits += acs[0]
                n += 1
    flush()
    frame = jpeg.struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, a * 16 + d, 0]) for i, (a, d) in enumerate(parts))
    scan = bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + bytes([0, 63, 0])
    ac_table = b"\x10" + bytes([0, 2, 1] + [0] * 13) + bytes([0, 0x21, 0xF0])
    return b"\xff\xd8" + jpeg.segment(0xFE, b"note") + jpeg.segment(0xDB, b"\0" + bytes([8] * 64)) + jpeg.segment(0xC0, frame) + jpeg.segment(0xC4, b"\0" + jpeg.DC_COUNTS + jpeg.DC_SYMBOLS) + jpeg.segment(0xC4, ac_table) + (jpeg.segment(0xDD, jpeg.struct.pack(">H", every)) if every else b"") + jpeg.segment(0xDA, scan) + out + b"\xff\xd9"


@pytest.mark.parametrize("every", [0, 2])
def test_jpeg_with_colour_subsampling_and_ac_terms(every):
    data = encoder(40, 24, [(2, 2), (1, 1), (1, 1)], lambda c, n: (n * 37) % 200 - 100 if c == 0 else 5, lambda c, n: n % 2 == 0, every)
    ((scan, picture),) = jpeg.thumbnails([data])[0]
    assert picture.shape == (3, 5)
    want = {}
    for m in range(3 * 2):
        for b in range(4):
            row, col = m // 3 * 2 + b // 2, m % 3 * 2 + b % 2
            want[row, col] = ((m * 6 + b) * 37) % 200 - 100 + 128
    assert all(picture[r, c] == want[r, c] for r in range(3) for c in range(5))


def test_what_is_no_jpeg(spark):
    good = jpeg.store(b"\xff" * 576)
    df = spark.createDataFrame([(1, good), (2, None), (3, b"GIF89a"), (4, good[:-200]), (5, good.replace(b"\xff\xc0", b"\xff\xc2")), (6, b"")], "i int, m binary")
    rows = {r.i: r for r in jpeg.media_features(df, "i", "m").collect()}
    assert rows[1].width == 192 and rows[1].error is None and rows[1].thumbnail == b"\xff" * 576
    assert rows[2].width is None and rows[2].error is None and all(rows[i].error and rows[i].width is None for i in (3, 4, 5, 6))


# ---- 2 ----------------------------------------------------------------------------------------------------------


def test_mix_follows_the_weights(spark):
    r = random.Random(3)
    sources = r.choices(["a", "b", "c", None], [10, 4, 3, 1], k=700)
    weights = {"a": 3, "b": 2}
    rows = sorted(mixing.mix(frame(spark, ["t"] * 700, sources=sources), weights, block=4).collect(), key=lambda x: (x.slot, x.place))
    assert sorted(x.k for x in rows) == list(range(700))
    assert all(x.release <= x.slot < x.deadline for x in rows)
    slots = sorted({(x.slot, x.s) for x in rows})
    assert [s for s, _ in slots] == list(range(len(slots)))  # one block to a slot, none empty
    order = [s for _, s in slots]
    blocks, full = Counter(order), {"a": 3, "b": 2, "c": 1, "": 1}
    for t in range(1, 7 * min(blocks[s] // w for s, w in full.items()) + 1):  # while all sources last
        had = Counter(order[:t])
        assert all(abs(had[s] - t * w / 7) < 1 for s, w in full.items())


def test_numbers_do_not_depend_on_buckets(spark, monkeypatch):
    df = frame(spark, ["t"] * 200, sources=["a", "b"] * 100)
    one = sorted(map(tuple, mixing.mix(df, {"a": 3}).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert sorted(map(tuple, mixing.mix(df, {"a": 3}).collect())) == one


def test_mixing_is_native(spark):
    plan = mixing.mixed_rows(frame(spark, ["t"]), {"a": 3})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 3 ----------------------------------------------------------------------------------------------------------


def brute_components(texts, words, num, den):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [grams(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def near_copies(seed, groups=6, members=12):
    r, out = random.Random(seed), []
    passage = prose(seed * 7, 60)
    for g in range(groups):
        base = prose(seed * 100 + g, r.choice([6, 8, 12, 30, 120, 300])).split()
        for _ in range(members):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(["the", "and", f"n{r.random()}"])
            out.append(" ".join(w) + (" " + passage if r.random() < 0.3 else ""))
    out += [out[0], out[0].upper(), None, "", "   ", "one two", "One  two", "x"]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(
    ("seed", "words", "num", "den", "rare", "small", "factor", "members"),
    [(1, 4, 85, 100, 32, 32, 8, 12), (2, 5, 80, 100, 2, 1, 0, 25), (3, 4, 85, 100, 1, 3, 0, 40), (4, 2, 60, 100, 3, 2, 0.1, 25)],
)
def test_jaccard_join_is_brute_force(spark, monkeypatch, seed, words, num, den, rare, small, factor, members):
    """With a factor of 0 every round goes by pivots and relative tokens."""
    for name, value in (("RARE", rare), ("SMALL", small), ("PAIRS_A_ROW", factor)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = near_copies(seed, members=members)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, texts), words, num, den).collect()}
    assert got == brute_components(texts, words, num, den)


def test_jaccard_join_moves_no_tokens_of_pairs_that_are_far_apart(spark):
    r, rule = random.Random(5), ngram_join.Rule(85, 100)
    base = [r.getrandbits(63) for _ in range(300)]
    found = [sorted({*r.sample(base, 300 - k), *(r.getrandbits(63) for _ in range(k))}) for k in (0, 3, 9, 12, 20, 24, 25, 30, 45, 60) for _ in range(3)]
    full = ngram_join.mapped(spark.createDataFrame([(i, len(t) + i % 2, t) for i, t in enumerate(found)], "x bigint, n bigint, tokens array<bigint>"))
    every = [(a, b, a == 0) for b in range(len(found)) for a in range(b)]
    kept = {(x.a, x.b) for x in ngram_join.likely(spark.createDataFrame(every, "a bigint, b bigint, pivot boolean"), full, rule).collect()}
    size = lambda i: len(found[i]) + i % 2
    both = {(a, b): len({*found[a]} & {*found[b]}) for a, b, _ in every}
    links = {(a, b) for (a, b), n in both.items() if 100 * n >= 85 * (size(a) + size(b) - n)}
    far = {(a, b) for (a, b), n in both.items() if a and 100 * n < 70 * (size(a) + size(b) - n)}
    assert len(links) > 50 and links <= kept and {(0, b) for b in range(1, len(found))} <= kept
    assert len(far) > 50 and not far & kept


def test_jaccard_join_with_repeated_ids(spark):
    """Every row is a document of its own: each of two texts of one id links with its own near copy."""
    a, b = prose(1, 80).split(), prose(2, 80).split()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "end"])), (3, " ".join([*b, "end"])), (None, " ".join([*b, "fin"])), (7, "alone it is")]
    for some in (rows, rows[::-1]):
        found = ngram_join.jaccard_components(spark.createDataFrame(some, "doc_id bigint, text string"), 5, 80, 100).collect()
        assert sorted(((r.doc_id or 0), r.component_id) for r in found) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (7, 7)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([(85, 100), (80, 100), (1, 2)]), st.sampled_from([1, 3, 1000]))
def test_prefixes_lose_no_pair(seed, threshold, rare):
    """Two sets that link share a signature, whatever the counts of their tokens are."""
    r, rule = random.Random(seed), ngram_join.Rule(*threshold)
    n = r.randint(1, 120)
    a = {r.getrandbits(64) for _ in range(n)}
    b = set(a)
    for _ in range(r.randint(0, rule.missing(n) + 1)):
        if b:
            b.remove(r.choice(sorted(b)))
        if r.random() < 0.5:
            b.add(r.getrandbits(64))
    if not b or a == b or rule.den * len(a & b) < rule.num * len(a | b):
        return
    found = [np.array(sorted(x), np.uint64) for x in (a, b)]
    shown = [ngram_join.posted(x, rule) for x in found]
    count = {t: 1 + (t in set(shown[1][0].tolist())) + r.choice([0, 0, 2, 50]) * (t in a & b) for t in shown[0][0].tolist()}
    count |= {t: count.get(t, 1) for t in shown[1][0].tolist()}
    sigs = []
    for x, (p, sampled) in zip(found, shown, strict=True):
        old, ngram_join.RARE = ngram_join.RARE, rare
        try:
            sigs.append(ngram_join.signatures(len(x), len(p), sampled, [(count[t], t) for t in p.tolist() if count[t] > 1], rule))
        finally:
            ngram_join.RARE = old
    assert any(s == t and (o or q) for s, o in sigs[0] for t, q in sigs[1])


def test_components_of_a_chain(spark):
    from amberline.llm.common import Stage

    r = random.Random(5)
    names = r.sample(range(1000), 60)
    links = [(min(a, b), max(a, b)) for a, b in zip(names[:40], names[1:40], strict=False)] + [(min(names[40], x), max(names[40], x)) for x in names[41:]]
    got = {x.x: x.c for x in ngram_join.components(spark.createDataFrame(links, "a bigint, b bigint"), Stage(spark, "t")).collect()}
    assert got == {x: min(names[:40]) for x in names[:40] if x != min(names[:40])} | {x: min(names[40:]) for x in names[40:] if x != min(names[40:])}


# ---- 4 and 10 ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = byte_pairs.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_pairs.BytePairCodec(ranks, P.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdeés '\n.1", max_size=80))
def test_byte_pairs_are_the_librarys(library, text):
    theirs, mine = library
    ids = mine.encode(text)
    assert ids == theirs.encode_ordinary(text) and mine.decode(ids) == text.encode()


def test_byte_pair_digests(spark, library):
    rows = byte_pairs.encode_decode(frame(spark, ODD), RANKS, P.PATTERN, with_ids=True).collect()
    for r in rows:
        text = ODD[r.doc_id] or ""
        ids = library[0].encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.decoded == text.encode()


def test_token_counts_are_the_librarys(spark):
    t = Tokenizer.from_file(DEFINITION)
    for r in token_counts.count_tokens(frame(spark, ODD), DEFINITION, P.PATTERN, 512).collect():
        text = ODD[r.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False))
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 512, len(text.encode()))


def test_token_counts_do_not_depend_on_blocks(spark):
    texts = ODD + [prose(i) for i in range(40)] + ["x" * 40 + " " + "x" * 40, "x" * 31, "é" * 16]
    t = Tokenizer.from_file(DEFINITION)
    due = [len(t.encode(x or "", add_special_tokens=False)) for x in texts]
    split, made = token_counts.PreTokens(open(DEFINITION).read(), P.PATTERN), token_counts.Block()
    for i, x in enumerate(texts):
        made.add(i, x or "", *split.frequencies(x or ""))
    assert [int(n) for n in token_counts.unpack(token_counts.pack(np.array([0, 255, 256, 1 << 31, 7])))] == [0, 255, 256, 1 << 31, 7]
    assert len(token_counts.unpack(token_counts.pack(np.zeros(0)))) == 0 and list(made.place.values()) == list(range(len(made.place)))
    for parts, block, held in ((1, 1 << 16, 1 << 20), (7, 5, 50)):
        got = token_counts.count_tokens(frame(spark, texts + texts).repartition(parts), DEFINITION, P.PATTERN, 512, block_rows=block, held=held).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, due[i % len(due)]) for i in range(2 * len(due))]


def test_memory_keeps_to_its_size(library):
    kept = byte_pairs.Pieces(lambda x: x * 2, 10)
    assert [kept[i % 30] for i in range(100)] == [i % 30 * 2 for i in range(100)] and len(kept) + len(kept.old) <= 10


# ---- 5 ----------------------------------------------------------------------------------------------------------


def test_quality_on_rows_it_has_not_seen(spark):
    texts = [prose(i) if i % 3 else re.sub(r"(\w+)", r"\1!!", prose(i).upper()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id bigint, quality int")
    df = frame(spark, texts)
    rows = quality.score(df, quality.fit(df, labels, "doc_id", "text", "quality")).filter("doc_id >= 200").collect()
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in rows) >= 98 and all(0 <= r.score <= 1 for r in rows)


def plain_vector(text):
    """As the text's description says: hashes of words and of shapes, uni- and bigrams, log counts, length 1."""
    tokens = re.findall(r"\w+|[^\w\s]+", text)
    pairs = [quality.token_hashes(t) for t in tokens]
    shapes = [int(quality.REPEAT) if i and pairs[i][0] == pairs[i - 1][0] else s for i, (_, s) in enumerate(pairs)]
    grams = [h for h, _ in pairs] + shapes
    for column in ([h for h, _ in pairs], shapes):
        grams += [(a * int(quality.MIX) + b) * 0xD6E8FEB86659FD93 % 2**64 for a, b in zip(column, column[1:])]
    logs = {place: math.log1p(n) for place, n in Counter(g >> 64 - quality.BITS for g in grams).items()}
    norm = math.sqrt(sum(v * v for v in logs.values()))
    return {place: v / norm for place, v in logs.items()}


def plain_leader(examples, epochs):
    """FTRL-proximal over dictionaries; the bias is place -1, without L1."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == -1 else quality.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for epoch in range(epochs):
        for at in np.random.default_rng(epoch).permutation(len(examples)):
            x, y = examples[at]
            x = x | {-1: 1.0}
            w = {i: weight(i) for i in x}
            loss = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items()))) - y
            for i, v in x.items():
                g = loss * v
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - step * w[i]
                n[i] += g * g
    return weight


def test_quality_scores_are_the_plain_versions(spark):
    texts = [*ODD, *[prose(i, 30) if i % 2 else prose(i, 30).upper() + " !! !!" for i in range(30)]]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, labels, "doc_id", "text", "quality")).collect()}
    order = sorted(range(30), key=lambda i: (quality.xxhash.xxh64_intdigest(str(i)), str(i)))
    weight = plain_leader([(plain_vector(texts[i] or ""), i % 2) for i in order], 20)
    for i, t in enumerate(texts):
        total = weight(-1) + sum(weight(p) * v for p, v in plain_vector(t or "").items())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)


def test_quality_fit_is_bounded_and_does_not_depend_on_order(spark):
    texts = [prose(i, 40) for i in range(40)]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    sizes = {i: len(plain_vector(t)) for i, t in enumerate(texts)}
    order = sorted(sizes, key=lambda i: (quality.xxhash.xxh64_intdigest(str(i)), str(i)))
    most = sum(sizes[i] for i in order[:12])
    few = labels.filter(F.col("doc_id").isin(order[:12]))
    want, bias = quality.fit(df, few, "doc_id", "text", "quality")
    got, same = quality.fit(df, labels, "doc_id", "text", "quality", places=most)
    assert np.array_equal(got, want) and same == bias
    assert quality.fit(df, labels, "doc_id", "text", "quality", places=1)[0].any()  # one row at least
    twice = df.union(df.withColumn("text", F.lit("another text"))).union(df)
    a, b = (quality.fit(x, labels, "doc_id", "text", "quality") for x in (twice, twice.orderBy(F.desc("text")).repartition(3)))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_ftrl_is_sparse_and_separates():
    r = np.random.default_rng(0)
    examples = [(np.array([y, 2 + r.integers(50)]), np.array([0.8, 0.6]), y) for y in r.integers(0, 2, 400)]
    weights, bias = quality.train(examples)
    assert weights[1] > 0.5 > -0.5 > weights[0] and np.count_nonzero(weights) < 60


# ---- 6 ----------------------------------------------------------------------------------------------------------


def chats(spark, n=40, hide=0.0, seed=0):
    r, rows = random.Random(seed), []
    for c in range(n):
        for t in range(r.randint(2, 8)):
            role = "user" if t % 2 == 0 else "assistant"
            text = ("what is this?" if role == "user" else "\n".join(["- " + "word " * 30] * 6))
            rows.append((c, t, None if r.random() < hide else role, text, role))
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, truth string")


def test_roles_are_recovered(spark):
    df = chats(spark, hide=0.3)
    truth = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.turn)):
        truth[r.conv_id].append(r.truth)
    rows = chat.format_chats(df).collect()
    assert sum(r.roles.split(",") == truth[r.conv_id] for r in rows) >= 39
    first = min(rows, key=lambda r: r.conv_id)
    assert first.rendered.startswith("<|user|>\nwhat is this?\n<|end|>\n<|assistant|>\n- word") and first.rendered_sha256 == hashlib.sha256(first.rendered.encode()).hexdigest()


def test_parts_decode_as_a_whole(spark, monkeypatch):
    df = chats(spark, n=3, hide=0.5, seed=4)
    whole = {r.conv_id: r.roles for r in chat.format_chats(df).collect()}
    monkeypatch.setattr(chat, "PART", 2)
    parts = defaultdict(list)
    for r in sorted(chat.format_chats(df).collect(), key=lambda r: (r.conv_id, r.part)):
        parts[r.conv_id].append(r.roles)
    assert {c: ",".join(p) for c, p in parts.items()} == whole and max(map(len, parts.values())) > 1


def test_viterbi_is_the_best_of_all_paths(spark):
    import itertools

    model = chat.fit(chats(spark))
    given_rows = [(None, "a?"), ("bot", "x\ny"), ("bot", "User: z")]
    path, lines = chat.decode(model, given_rows)

    def weight(p):
        w = model.start[p[0]] + model.emission(*lines[0])[p[0]]
        for a, b, line in zip(p, p[1:], lines[1:], strict=False):
            w += model.step[a, b] + model.emission(*line)[b]
        return w

    assert weight(path) == pytest.approx(max(weight(p) for p in itertools.product(range(6), repeat=len(lines))))


def test_labelled_rows_stay_whole(spark):
    """Strictly alternating rows teach that no role follows itself; a conversation where one does keeps its speakers."""
    rows = [(c, t, ("user", "assistant")[t % 2], "one\ntwo\n- more") for c in range(200) for t in range(4)]
    rows += [(999, 0, "user", "hello\n- more"), (999, 1, "assistant", "a\n- more"), (999, 2, "assistant", "b\n- more?"), (999, 3, "user", "c")]
    found = chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).filter("conv_id = 999").first()
    turns = re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>", found.rendered, re.S)
    said = defaultdict(str)
    for role, text in turns:
        said[role] += text + "\n"
    assert said["user"] == "hello\n- more\nc\n" and said["assistant"] == "a\n- more\nb\n- more?\n" and found.n_changed == 0 and found.n_rows == 4


def test_a_marker_inside_a_labelled_row_splits_it(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "what is it?" if t % 2 == 0 else "- it is this") for c in range(50) for t in range(4)] + [(99, 0, "user", "what is it?"), (99, 1, "assistant", "- it is this\nUser: what is that?")]
    found = chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).filter("conv_id = 99").first()
    assert found.roles == "user,assistant,user" and found.n_changed == 1


def test_markers_in_transcripts(spark):
    rows = chat.format_chats(spark.createDataFrame([(1, 0, None, "Human: hi\nthere\n\n### Assistant\nhello\nUser: bye", 1)], "conv_id int, turn int, role string, text string, part int")).collect()
    assert rows[0].roles == "user,assistant,user" and rows[0].rendered == "<|user|>\nhi\nthere\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\nbye\n<|end|>\n"


def test_odd_chats(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, part string, lo int"
    df = spark.createDataFrame([(None, None, None, None, "p", 1), (None, 0, "alien", "", "p", 1), (2, 0, "user", "a", "p", 1), (2, 0, "user", "a", "p", 1), (3, -4, "USER ", "x" * 100_000, "p", 1)], schema)
    rows = chat.format_chats(df).collect()
    assert {r.conv_id: r.n_rows for r in rows} == {None: 2, 2: 2, 3: 1} and chat.format_chats(df.filter("conv_id > 9")).count() == 0


# ---- 7 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_exact_dedup(spark, keep, partitions):
    r = random.Random(8)
    texts = [r.choice(["same", None, "", "same ", prose(r.randrange(9)), "x" * 40 + "a", "x" * 40 + "b"]) for _ in range(120)] + ["hot"] * 150
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = exact_dedup.content_sort(frame(spark, texts), keep=keep).collect()
        kept = exact_dedup.content_sort(frame(spark, texts), keep=keep, carry=["text", "doc_id", "x", "edge"])
        kept_rows = kept.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    pick = min if keep == "min" else max
    for x in rows:
        g = groups[texts[x.doc_id] or ""]
        assert (x.keep_id, x.group_size, x.kept) == (pick(g), len(g), x.doc_id == pick(g)) and x.text_sha256 == hashlib.sha256((texts[x.doc_id] or "").encode()).hexdigest()
    assert len(rows) == len(texts) and kept.columns == ["text", "doc_id", "x", "edge"]
    assert sorted((x.doc_id, x.text) for x in kept_rows) == sorted((pick(g), texts[pick(g)]) for g in groups.values())


def test_of_repeated_rows_one_stays(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, "A")], "doc_id int, text string")
    assert sorted((r.keep_id, r.kept) for r in exact_dedup.content_sort(df, keep="min").collect()) == [(1, False), (1, False), (1, True), (2, True)]

    assert exact_dedup.content_sort(df, normalise=F.lower).filter("kept").count() == 1


# ---- 8 ----------------------------------------------------------------------------------------------------------

SYLLABLES = {"one": ["ka", "ro", "mi"], "two": ["sch", "ung", "ei"]}


def spoken(language, seed):
    r = random.Random(f"{language}{seed}")
    return " ".join("".join(r.choices(SYLLABLES[language], k=r.randint(1, 4))) for _ in range(40))


def test_languages_on_rows_it_has_not_seen(spark):
    names = sorted(SYLLABLES) * 60
    df = frame(spark, [spoken(x, i) for i, x in enumerate(names)] + ["12 34 !", "zxqj wvzq qqxz"], langs=[*names, None, None])
    rows = {r.doc_id: r for r in language_id.predict(df, language_id.fit(df.filter("doc_id < 80"), "doc_id", "text", "lang")).collect()}
    assert all(rows[i].lang_pred == names[i] and rows[i].score > 0.9 and not rows[i].rejected for i in range(80, 120))
    assert (rows[120].lang_pred, rows[120].score, rows[120].rejected) == ("und", 0.0, True)
    assert rows[121].lang_pred in SYLLABLES and rows[121].rejected
    kept = language_id.accepted(df, language_id.fit(df, "doc_id", "text", "lang"))
    assert kept.columns == df.columns and {120, 121} == {r.doc_id for r in df.select("doc_id").subtract(kept.select("doc_id")).collect()}


def test_predictions_are_the_plain_models(spark):
    names = sorted(SYLLABLES) * 15
    df = frame(spark, [spoken(x, i) for i, x in enumerate(names)] + ["ka ung", "Karo schmi", "1 2"], langs=[*names, None, None, None])
    seen = defaultdict(list)
    for r in df.filter("lang IS NOT NULL").select("lang", "text", "doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect():
        seen[r.lang].append((r.h, r.doc_id, r.text))
    plain = {}
    for x, rows in seen.items():
        learned = [t for n, (_, _, t) in enumerate(sorted(rows), 1) if n % 5]
        plain[x] = language_id.KneserNey(Counter(w for t in learned for w in language_id.words_of(t)), language_id.ORDER)

    def entropy(model, text):
        total = size = 0
        for w in language_id.words_of(text):
            s = language_id.START + w + language_id.END
            for i in range(2, len(s) + 1):
                total -= math.log(model.probability(s[max(0, i - language_id.ORDER) : i]))
                size += 1
        return total / size

    for r in language_id.predict(df, language_id.fit(df, "doc_id", "text", "lang")).join(df.select("doc_id", "text"), "doc_id").collect():
        if r.text == "1 2":
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        found = {x: entropy(m, r.text) for x, m in plain.items()}
        best = min(found, key=found.get)
        assert r.lang_pred == best and r.cross_entropy == pytest.approx(found[best], rel=1e-3)
        assert r.score == pytest.approx(1 / sum(math.exp(language_id.SHARPNESS * (found[best] - e)) for e in found.values()), abs=1e-2)


def test_probabilities_add_up():
    words = Counter(w for i in range(30) for w in spoken("one", i).split())
    model = language_id.KneserNey(words, 4)
    for context in ("", "k", "\x02k", "kar", "zz", "\x02"):
        seen = sum(model.probability((context + c)[-4:]) for c in {g for g in model.value[1]})
        unseen = model.probability((context + "ψ")[-4:]) * (language_id.CHARACTERS - len(model.value[1]))
        assert seen + unseen == pytest.approx(1)
    arrays = language_id.LanguageModels({"one": words}, 4)
    for w in ("karo", "zzz", "mikaψ", "a"):
        s = language_id.START + w + language_id.END
        assert arrays.score_words([w])[0, 0] == pytest.approx(sum(math.log(model.probability(s[max(0, i - 3) : i + 1])) for i in range(1, len(s))), rel=1e-4)


def test_texts_with_more_words_than_are_kept(monkeypatch):
    models = language_id.LanguageModels({x: Counter(w for i in range(9) for w in spoken(x, i).split()) for x in SYLLABLES})
    kept = language_id.Memory(models)
    texts = [Counter(f"{a}{b}" for a in spoken("one", i).split() for b in "ab") for i in range(5)]
    want = kept.cross_entropy(texts)
    small = language_id.Memory(models)
    small.most, small.rows = 30, small.rows[:30]
    assert np.allclose(np.array(small.cross_entropy(texts)), np.array(want), atol=1e-4)


# ---- 9 ----------------------------------------------------------------------------------------------------------


def brute_spans(text):
    out = []
    rules = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8), (re.compile("AKIA[A-Z0-9]+"), 0, 16), (re.compile("[0-9a-f]+"), 0, 32)]
    for k, (rule, group, least) in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in rule.finditer(text) if len(m[group]) >= least]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "API_KEY", "apikey", "=", ":", " ", '"', "AKIA", "AKIA1234567890ABCD", "abcdef12", "0123456789abcdef", "é", "ſecret", "\n", "x"]), max_size=25).map("".join))
def test_patterns_are_brute_force(text):
    assert secrets.pattern_spans(text) == brute_spans(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc123XYZ-_", min_size=20, max_size=60))
def test_window_entropy_by_definition(text):
    best = 0.0
    for i in range(len(text) - secrets.WINDOW + 1):
        c = Counter(text[i : i + secrets.WINDOW])
        best = max(best, -sum(n / secrets.WINDOW * math.log2(n / secrets.WINDOW) for n in c.values()))
    assert secrets.window_entropy(text, "base64") == pytest.approx(best, abs=1e-9)


def test_rulers_and_secrets_in_long_lines_scan_in_linear_time():
    import time

    for text in ("-" * 40 + "v2Ab", "-/" * 1_000_000 + "Ab1" + "-/" * 1_000_000, "a_B-" * 500_000 + "Ab1", "token=abcdefgh12345678 " * 40_000):
        began = time.perf_counter()
        base = secrets.pattern_spans(text)
        secrets.entropy_spans(text, base)
        assert time.perf_counter() - began < 30


@settings(max_examples=200, deadline=None)
@given(st.text("aB1-/_", max_size=14))
def test_slugs_are_what_the_expression_says(text):
    assert secrets.is_slug(text) == bool(re.fullmatch(r"(?:[A-Za-z]?[a-z]*|[A-Z]*)(?:[/_+-](?:[A-Za-z]?[a-z]*|[A-Z]*|[0-9]{1,4}))*", text))


def test_base_digests_of_plain_patterns(spark):
    texts = ['password: "abcdefgh1" and TOKEN=ABCDEFG', "AKIA" + "Z" * 12 + " " + "0f" * 16 + " " + "0f" * 15, "api_key = a" * 3, "secret:" + "x" * 9 + " token=" + "f" * 40, None]
    rows = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = sorted(brute_spans(t or ""))
        spans = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert rows[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(b[1] == k for b in base) for k in range(3)]


def test_entropy_spans(spark):
    key = "zQ3vR8pLw1Xk9Tn4Yb7Mc2Hd"
    texts = [f"a {key} b", "internationalization of counterrevolutionaries", "123e4567-e89b-12d3-a456-426614174000", "/usr/local/share/some/long/path/names", f'token = "{key}"', None]
    rows = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, texts), with_spans=True).collect()}
    assert rows[0].spans == f"entropy:2:{2 + len(key)}" and [rows[i].spans for i in (1, 2, 3, 5)] == [""] * 4
    assert rows[4].n_entropy == 0 and rows[4].n_assign == 1 and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[0].found[0]["kind"] == "entropy"


# ---- the pipeline -----------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    names = sorted(SYLLABLES) * 40
    texts = [spoken(x, i) for i, x in enumerate(names)]
    texts += [texts[0], texts[0] + " kami", "?!", None, texts[5]]
    df = frame(spark, texts, langs=[*names, "one", "one", None, None, "two"], sources=["src0", "src1", "src9"] * 28 + ["src0"])
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs, n = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, str(tmp_path))
        assert i == 4 or out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        n.append({r.doc_id for r in docs.select("doc_id").collect()})
    every = set(range(85))
    assert n[0] == every - {82, 83}  # no letters
    assert n[1] == n[0] - {0, 5}  # of equal texts the largest id stays
    assert n[2] == n[1] - {81}  # of near copies the smallest
    assert n[3] == n[4] == n[2]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == n[4]


def test_folds():
    assert zlib.crc32(b"12") % 4 == zlib.crc32(str(12).encode()) % 4
