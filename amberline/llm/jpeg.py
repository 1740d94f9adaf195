"""Media columns as baseline JPEG.

Reading: markers are parsed, the scan's Huffman codes decoded, and only the DC term of each luminance block kept: one
sample for each 8 x 8 pixels, a thumbnail. AC codes are decoded to be skipped. A scan is decoded in lanes: each restart
interval of each image of a batch is a lane, and all lanes take a step together in numpy.

Storing bytes: each byte is the DC term of a flat block (quantiser 8, so a step is one grey level), 24 blocks to a row, or the
next multiple of 24 with which the rows fit into one image's height; a restart marker after each row. The thumbnail of such
an image is the stored bytes, without loss. What no width of up to MOST_WIDE blocks can hold (4.7 MB and more) goes to
several images, one after another in the same stream.

Rows: a null text is an empty one, whose payload is one unit of filling bytes. A null medium gives null features; bytes
that are no baseline JPEG give null features and say why in ``error``. Other columns are not read. Repeated rows give
repeated results, equal texts equal media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm.common import map_rows, table, text_or_empty

WIDE = 24  # blocks in a row
UNIT = WIDE * 24  # payloads are filled up to a multiple of this
FILL = b"\xff"
MOST_WIDE = 8184  # blocks in a row, for longer payloads
AT_ONCE = 1 << 18  # blocks that are packed together
MOST_ROWS = 8184  # a multiple of 24; 65,535 pixels are the format's limit

# Fixed values of the format: the customary DC luminance code (ITU T.81, table K.3), as counts by length and symbols.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
# Our AC code has one symbol, end of block, as the single bit 0.
AC_COUNTS = bytes([1] + [0] * 15)
AC_SYMBOLS = bytes([0])


class NotBaseline(ValueError):
    """The bytes are no baseline JPEG that can be read."""


def codes(counts: bytes) -> list[tuple[int, int]]:
    """(code, length) of each symbol, in the order of the table."""
    out, code = [], 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, size))
            code += 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: length of the code (0: none) and symbol."""
    size, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for (code, n), s in zip(codes(counts), symbols, strict=True):
        at = code << (16 - n)
        size[at : at + (1 << (16 - n))] = n
        symbol[at : at + (1 << (16 - n))] = s
    return size, symbol


# ---- storing ----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def block_codes() -> tuple[np.ndarray, np.ndarray]:
    """By DC difference + 255: the bits of a flat block (DC code, extra bits, end of block) and how many."""
    dc = codes(DC_COUNTS)
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << n) - 1
        bits[d + 255] = ((dc[n][0] << n) | extra) << 1
        size[d + 255] = dc[n][1] + n + 1
    return bits, size


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int, wide: int) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            segment(0xDB, b"\0" + bytes([8] * 64)),
            segment(0xC0, struct.pack(">BHHB", 8, rows * 8, wide * 8, 1) + bytes([1, 0x11, 0])),
            segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS),
            segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
            segment(0xDD, struct.pack(">H", wide)),
            segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def pack_rows(samples: np.ndarray) -> np.ndarray:
    """The entropy-coded bytes of rows of samples, with stuffing and restart markers."""
    bits, size = block_codes()
    value = samples.astype(np.int64) - 128
    step = np.diff(value, axis=1, prepend=0) + 255
    code, length = bits[step], size[step]
    ends = np.cumsum(length, axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    first = np.concatenate([[0], np.cumsum(row_bytes)])
    at = (first[:-1, None] << 3) + ends - length
    window = code << (24 - (at & 7) - length)
    where, total = (at >> 3).ravel(), int(first[-1])
    out = sum(np.bincount(where + k, ((window >> (16 - 8 * k)) & 255).ravel(), total + 2) for k in range(3)).astype(np.int64)[:total]
    out[first[1:] - 1] += (1 << ((-ends[:, -1]) & 7)) - 1  # filled up with ones
    full = np.flatnonzero(out == 255) + 1
    border = first[1:-1]
    restart = 0xD0 + (np.arange(len(border)) & 7)
    return np.insert(out.astype(np.uint8), np.concatenate([full, border, border]), np.concatenate([np.zeros(len(full), int), np.full(len(border), 255), restart]))


def store(payload: bytes) -> bytes:
    """payload, of a multiple of UNIT bytes, as one or more images."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload has a positive multiple of {UNIT} bytes")
    wide = width(len(payload))
    samples = np.frombuffer(payload, np.uint8).reshape(-1, wide)
    parts = [samples[at : at + MOST_ROWS] for at in range(0, len(samples), MOST_ROWS)]
    return b"".join(header(len(x), wide) + pack(x) + b"\xff\xd9" for x in parts)


def width(blocks: int) -> int:
    """The least multiple of 24 blocks that divides them into rows of one image; or 576, which always divides them."""
    for wide in range(WIDE, MOST_WIDE + 1, WIDE):
        if blocks % wide == 0 and blocks // wide <= MOST_ROWS:
            return wide
    return UNIT


def pack(samples: np.ndarray) -> bytes:
    """The entropy-coded bytes of an image, some rows at a time; restart markers count on."""
    rows = max(8, AT_ONCE // samples.shape[1] // 8 * 8)
    parts = [pack_rows(samples[at : at + rows]).tobytes() for at in range(0, len(samples), rows)]
    return b"\xff\xd7".join(parts)  # each part but the last has a multiple of 8 rows


# ---- reading ----------------------------------------------------------------------------------------------------


@dataclass
class Scan:
    """What is needed to decode one image's scan."""

    width: int
    height: int
    parts: tuple  # of each component in the scan: across, down, DC table, AC table
    quantiser: int  # of the luminance DC term
    every: int  # MCUs in a restart interval
    wide: int  # MCUs in a row
    high: int
    coded: np.ndarray  # entropy-coded bytes without stuffing and markers
    starts: np.ndarray  # of the intervals in it
    index: int = 0

    @property
    def shape(self) -> tuple:
        return self.parts, self.every


def scan_data(data: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """From the scan's first byte: its bytes without stuffing and markers, where intervals start, where it ends."""
    rest = data[at:]
    full = np.flatnonzero(rest[:-1] == 255)
    after = rest[full + 1]
    stop = full[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    if not len(stop):
        raise NotBaseline("the scan has no end")
    end = int(stop[0])
    full, after = full[full < end], after[full < end]
    keep = np.ones(end, bool)
    keep[full[after == 0] + 1] = False
    restart = full[after != 0]
    keep[restart] = keep[restart + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    return rest[:end][keep], np.concatenate([[0], place[restart]]), at + end


def parse(data: bytes) -> list[Scan]:
    """The images of a stream."""
    out, at, bytes_of = [], 0, np.frombuffer(data, np.uint8)
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise NotBaseline("no start of image")
        at += 2
        quant: dict[int, int] = {}
        huff: dict[int, tuple[bytes, bytes]] = {}
        frame, every, scan = None, 0, None
        while True:
            if at + 2 > len(data) or data[at] != 255:
                raise NotBaseline("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                at += 2
                break
            if at + 4 > len(data):
                raise NotBaseline("it breaks off")
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            if len(body) != size - 2:
                raise NotBaseline("it breaks off")
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                (every,) = struct.unpack(">H", body)
            elif marker == 0xC0:
                if body[0] != 8:
                    raise NotBaseline("samples have other than 8 bits")
                height, width = struct.unpack_from(">HH", body, 1)
                frame = (width, height, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])])
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise NotBaseline("the frame is not baseline")
            elif marker == 0xDA:
                if frame is None or not frame[0] or not frame[1]:
                    raise NotBaseline("the scan has no frame")
                try:
                    tables = {body[1 + 2 * i]: (huff[body[2 + 2 * i] >> 4], huff[16 | body[2 + 2 * i] & 15]) for i in range(body[0])}
                    first = frame[2][0]
                    coded, starts, at = scan_data(bytes_of, at)
                    if first[0] in tables and scan is None:
                        one = len(tables) == 1
                        parts = tuple((1, 1, *tables[i]) if one else (h, v, *tables[i]) for i, h, v, _ in frame[2] if i in tables)
                        most_h, most_v = max(h for _, h, _, _ in frame[2]), max(v for _, _, v, _ in frame[2])
                        across, down = (-(-frame[0] * first[1] // most_h), -(-frame[1] * first[2] // most_v)) if one else (frame[0], frame[1])
                        wide, high = -(-across // (8 if one else 8 * most_h)), -(-down // (8 if one else 8 * most_v))
                        scan = Scan(frame[0], frame[1], parts, quant[first[3]], every or wide * high, wide, high, coded, starts)
                except KeyError as e:
                    raise NotBaseline(f"a table is missing: {e}") from None
        if scan is None:
            raise NotBaseline("no luminance scan")
        if len(scan.starts) != -(-scan.wide * scan.high // scan.every):
            raise NotBaseline("restart markers don't fit the size")
        out.append(scan)
    if not out:
        raise NotBaseline("no bytes")
    return out


def decode_lanes(scans: list[Scan]) -> list[np.ndarray]:
    """The luminance DC terms, MCU after MCU, of scans of one shape."""
    parts, every = scans[0].shape
    pad = np.zeros(8, np.uint8)
    coded = np.concatenate([x for s in scans for x in (s.coded, pad)]).astype(np.int64)
    offset = np.cumsum([0] + [len(s.coded) + 8 for s in scans])[:-1]
    pos = np.concatenate([s.starts + o for s, o in zip(scans, offset, strict=True)]) << 3
    limit = np.concatenate([np.full(len(s.starts), (o + len(s.coded)) * 8) for s, o in zip(scans, offset, strict=True)])
    mcus = np.concatenate([np.minimum(every, s.wide * s.high - every * np.arange(len(s.starts))) for s in scans])
    word = (coded[:-3] << 24) | (coded[1:-2] << 16) | (coded[2:-1] << 8) | coded[3:]  # 32 bits from each byte on
    blocks = parts[0][0] * parts[0][1]
    kept = np.zeros((len(pos), every, blocks), np.int64)
    last = np.zeros((len(parts), len(pos)), np.int64)

    def peek(p: np.ndarray) -> np.ndarray:
        return (word[p >> 3] >> (16 - (p & 7))) & 0xFFFF

    def symbol(p: np.ndarray, code: tuple) -> tuple[np.ndarray, np.ndarray]:
        size, value = lookup(*code)
        bits = peek(p)
        n = size[bits]
        if not n.all():
            raise NotBaseline("a code is unknown")
        return value[bits], p + n

    live = np.arange(len(pos))
    for step in range(every):
        if step >= mcus.min():
            live = np.flatnonzero(mcus > step)
        for c, (across, down, dc, ac) in enumerate(parts):
            for b in range(across * down):
                n, p = symbol(pos[live], dc)
                extra = peek(p) >> (16 - n)
                last[c, live] += np.where((n > 0) & (extra < (1 << np.maximum(n, 1) >> 1)), extra - (1 << n) + 1, extra)
                p = p + n
                if c == 0:
                    kept[live, step, b] = last[0, live]
                lanes, k = np.arange(len(live)), np.ones(len(live), np.int64)
                while len(lanes):
                    s, q = symbol(p[lanes], ac)
                    p[lanes] = q + (s & 15)
                    k[lanes] = np.where(s == 0, 64, k[lanes] + (s >> 4) + 1)
                    lanes = lanes[k[lanes] < 64]
                if (p > limit[live]).any():
                    raise NotBaseline("a scan breaks off")
                pos[live] = p
    out, at = [], 0
    for s in scans:
        n = len(s.starts)
        out.append(kept[at : at + n].reshape(n * every, blocks)[: s.wide * s.high])
        at += n
    return out


def arrange(scan: Scan, dc: np.ndarray) -> np.ndarray:
    """DC terms as a picture of one sample a block."""
    across, down = scan.parts[0][:2]
    grid = dc.reshape(scan.high, scan.wide, down, across).transpose(0, 2, 1, 3).reshape(scan.high * down, scan.wide * across)
    most = max(p[0] for p in scan.parts), max(p[1] for p in scan.parts)
    w, h = -(-scan.width * across // (8 * most[0])), -(-scan.height * down // (8 * most[1]))
    return np.clip((grid[:h, :w] * scan.quantiser + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def thumbnails(streams: list[bytes | None]) -> list[list[tuple[Scan, np.ndarray]] | str | None]:
    """For each stream its images and their DC-only luminance pictures; or why it can't be read; None for None."""
    out: list = []
    groups: dict[tuple, list[Scan]] = {}
    for i, data in enumerate(streams):
        if data is None:
            out.append(None)
            continue
        try:
            scans = parse(data)
        except (NotBaseline, struct.error, IndexError) as e:
            out.append(str(e))
            continue
        out.append([])
        for s in scans:
            s.index = i
            groups.setdefault(s.shape, []).append(s)
            out[i].append(s)
    done: dict[int, np.ndarray] = {}
    for group in groups.values():
        try:
            done.update((id(s), arrange(s, dc)) for s, dc in zip(group, decode_lanes(group), strict=True))
        except (NotBaseline, IndexError):
            for s in group:  # one by one, to find which of them it is
                try:
                    done[id(s)] = arrange(s, decode_lanes([s])[0])
                except (NotBaseline, IndexError) as e:
                    out[s.index] = str(e)
    return [[(s, done[id(s)]) for s in x] if isinstance(x, list) else x for x in out]


def picture_hash(picture: np.ndarray) -> str:
    """64 bits, by rows of an 8 x 8 grid: whether a cell is brighter than the whole."""
    rows, cols = (np.arange(9) * n // 8 for n in picture.shape)
    total = np.zeros((picture.shape[0] + 1, picture.shape[1] + 1), np.int64)
    total[1:, 1:] = picture.astype(np.int64).cumsum(0).cumsum(1)
    top, left = np.minimum(rows[:-1], picture.shape[0] - 1), np.minimum(cols[:-1], picture.shape[1] - 1)
    low, right = np.maximum(rows[1:], top + 1), np.maximum(cols[1:], left + 1)
    cell = total[np.ix_(low, right)] - total[np.ix_(top, right)] - total[np.ix_(low, left)] + total[np.ix_(top, left)]
    size = np.outer(low - top, right - left)
    return np.packbits(cell * picture.size > total[-1, -1] * size).tobytes().hex()


def describe(images: list[tuple[Scan, np.ndarray]]) -> str:
    return "+".join(f"{s.width}x{s.height}:{picture_hash(p)}" for s, p in images)


def media_features(df: DataFrame, key: str, media: str) -> DataFrame:
    """Of a binary column: key, images, width, height (of the first image), thumbnail (binary, one byte a block), feature
    (size and thumbnail hash of each image), error."""

    def make():
        def work(rows: dict[str, list]) -> dict[str, list]:
            found = thumbnails(rows["m"])
            ok = [x if isinstance(x, list) else None for x in found]
            return {
                "k": rows["k"],
                "images": [x and len(x) for x in ok],
                "width": [x and x[0][0].width for x in ok],
                "height": [x and x[0][0].height for x in ok],
                "thumbnail": [x and b"".join(p.tobytes() for _, p in x) for x in ok],
                "feature": [x and describe(x) for x in ok],
                "error": [x if isinstance(x, str) else None for x in found],
            }

        return work

    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, images int, width int, height int, thumbnail binary, feature string, error string"
    return map_rows(df.select(F.col(key).alias("k"), F.col(media).alias("m")), make, schema, rows=64).withColumnRenamed("k", key)


def fill(text: str) -> bytes:
    data = text.encode("utf-8")
    return data + FILL * (UNIT - len(data) if not data else -len(data) % UNIT)


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and media: each whole text, filled up, as a stored stream."""

    def make():
        return lambda rows: {"k": rows["k"], "media": [store(fill(t)) for t in rows["t"]]}

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(F.col(key).alias("k"), text_or_empty(text).alias("t")), make, f"k {kind}, media binary", rows=64).withColumnRenamed("k", key)


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text stored as a stream and read back; digests of what was read."""

    def make():
        def work(rows: dict[str, list]) -> dict[str, list]:
            media = [store(fill(t)) for t in rows["t"]]
            images = thumbnails(media)
            back = [b"".join(p.tobytes() for _, p in x) for x in images]
            return {
                "k": rows["k"],
                "n_bytes": [len(t.encode("utf-8")) for t in rows["t"]],
                "payload_bytes": [len(x) for x in back],
                "payload_sha256": [hashlib.sha256(x).hexdigest() for x in back],
                "tail_crc32": [zlib.crc32(x[-32:]) for x in back],
                "media_bytes": [len(x) for x in media],
                "media_sha256": [hashlib.sha256(x).hexdigest() for x in media],
                "feature": [describe(x) for x in images],
            }

        return work

    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_rows(df.select(F.col(key).alias("k"), text_or_empty(text).alias("t")), make, schema, rows=64).withColumnRenamed("k", key)


def op1_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
