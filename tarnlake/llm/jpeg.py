"""Media columns in baseline JPEG, read as DC-only luminance thumbnails.

The decoder walks the markers (DQT, SOF0, DHT, DRI, SOS, restarts), Huffman-decodes the scan and keeps only the DC
coefficient of each luminance block: one sample per 8 x 8 block, a thumbnail at an eighth of the size. Scans whose
blocks all have the same number of bits (a DC code of length ``c - size`` for each size and an end-of-block code
alone for AC) are decoded at once in numpy by gathering a window of bits per block; all others block by block.

The encoder writes such scans: a byte is one flat block, with quantiser 8 its DC level is exactly ``byte - 128``, so
the thumbnail gives the bytes back without loss. Codes take 15 bits less the magnitude size, end of block one bit,
which makes two bytes per block that never hold 0xFF. A payload is cut into frames of at most 64 x 8191 blocks,
one JPEG after the other.

The media column is written to a table in the shared folder and read back before it is decoded. Columns of codes are
regular, so they take about as much there, under Zstandard, as the texts did.

Defined cases: a null text is empty; an empty one is stored as 64 zero bytes; length is not bounded; equal texts give
equal values; repeated rows and empty tables pass through; other columns stay, those named ``n_bytes, media`` are
replaced; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder

WIDTH = 64
MOST_ROWS = 8191
#: Zigzag place 0 is DC; the encoder's quantiser makes one level one grey value.
DC_QUANT = 8
#: Huffman tables as (counts per length 1 to 16, symbols in order of code).
DC_TABLE = (bytes(6) + bytes([1] * 9) + bytes(1), bytes(range(8, -1, -1)))
AC_TABLE = (bytes([1]) + bytes(15), bytes([0]))


def huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """Symbol and length for every 16-bit window (length 0: no code), and (code, length) per symbol."""
    symbol, length, codes = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8), {}
    code = k = 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            a, b = code << (16 - n), (code + 1) << (16 - n)
            symbol[a:b], length[a:b] = symbols[k], n
            codes[symbols[k]] = (code, n)
            code += 1
            k += 1
        code <<= 1
    return symbol, length, codes


def _encoder() -> np.ndarray:
    """Two bytes for each difference from -255 to 255: DC code, magnitude bits, end of block."""
    dc = huffman(*DC_TABLE)[2]
    (eob, eob_bits) = huffman(*AC_TABLE)[2][0]
    out = []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, _ = dc[size]
        bits = d if d >= 0 else d + (1 << size) - 1
        out.append((((code << size) | bits) << eob_bits) | eob)
    return np.array(out, ">u2")


_WORDS = _encoder()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_frame(data: bytes) -> bytes:
    """A grey image, 64 blocks wide, whose block means are the bytes; their number must be a multiple of 64."""
    rows = len(data) // WIDTH
    levels = np.frombuffer(data, np.uint8).astype(np.int16) - 128
    steps = levels.copy()
    steps[1:] -= levels[:-1]
    words = _WORDS[steps + 255]
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, bytes([0, DC_QUANT]) + bytes([1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00]) + DC_TABLE[0] + DC_TABLE[1]),
        _segment(0xC4, bytes([0x10]) + AC_TABLE[0] + AC_TABLE[1]),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        words.tobytes(),
        b"\xff\xd9",
    ))


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes followed by zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def encode(payload: bytes) -> bytes:
    step = WIDTH * MOST_ROWS
    return b"".join(encode_frame(payload[i : i + step]) for i in range(0, len(payload), step))


class _Tables(dict):
    """Decoding tables by their definition, each built once a worker."""

    def __init__(self):
        super().__init__()
        #: Difference by 16-bit block, for tables whose blocks take 16 bits.
        self.whole: dict[tuple[int, int], np.ndarray] = {}

    def __missing__(self, key: bytes):
        if len(self) >= 64:
            self.clear()
            self.whole.clear()
        symbol, length, codes = huffman(key[:16], key[16:])
        self[key] = found = (symbol.tolist(), length.tolist(), symbol, length, codes)
        return found


def _uniform(dc, ac) -> tuple[int, int] | None:
    """(bits of DC code and magnitude, bits of end of block) if every block of the scan takes the same."""
    widths = {n + size for size, (_, n) in dc[4].items()}
    if len(widths) == 1 and set(ac[4]) == {0} and max(widths) + ac[4][0][1] <= 25 and min(dc[4]) >= 0:
        return widths.pop(), ac[4][0][1]
    return None


#: Marks windows that begin with no code.
_NO_CODE = np.int16(-32768)


def _differences(dc, top: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Differences whose code begins the 16-bit window ``top`` and whose magnitude bits end ``held``."""
    size = dc[2][top].astype(np.int32)
    bits = held & ((1 << size) - 1)
    d = np.where((size > 0) & (bits < (1 << size >> 1)), bits - (1 << size) + 1, bits)
    return np.where(dc[3][top] > 0, d, _NO_CODE).astype(np.int16)


def _strided(scan: bytes, n: int, dc, wide: int, eob: int, tables: _Tables) -> np.ndarray:
    """Differences of ``n`` blocks of ``wide + eob`` bits each."""
    step = wide + eob
    if len(scan) * 8 < n * step:
        raise ValueError("scan ends early")
    if step == 16:
        every = tables.whole.get((id(dc), eob))
        if every is None:
            window = np.arange(65536, dtype=np.int32)
            every = tables.whole[(id(dc), eob)] = _differences(dc, window, window >> eob)
        found = every[np.frombuffer(scan, ">u2", n)]
    else:
        data = np.frombuffer(scan + bytes(4), np.uint8).astype(np.uint32)
        bit = np.arange(n, dtype=np.int64) * step
        at = bit >> 3
        w = (data[at] << 24) | (data[at + 1] << 16) | (data[at + 2] << 8) | data[at + 3]
        w = (w << (bit & 7).astype(np.uint32)) & np.uint32(0xFFFFFFFF)
        found = _differences(dc, (w >> 16).astype(np.int32), (w >> np.uint32(32 - wide)).astype(np.int32))
    if (found == _NO_CODE).any():
        raise ValueError("no such code")
    return found


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data + b"\xff\xff\xff\xff", "big"), len(data) * 8 + 32

    def peek16(self) -> int:
        if self.left < 32:
            raise ValueError("scan ends early")
        return (self.value >> (self.left - 16)) & 0xFFFF

    def take(self, n: int) -> int:
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, table) -> int:
        w = self.peek16()
        n = table[1][w]
        if not n:
            raise ValueError("no such code")
        self.left -= n
        return table[0][w]


def _split_restarts(scan: bytes) -> list[bytes]:
    parts, at, begin = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0:
        if at + 1 < len(scan) and 0xD0 <= scan[at + 1] <= 0xD7:
            parts.append(scan[begin:at])
            begin = at + 2
        at += 2
    return [p.replace(b"\xff\x00", b"\xff") for p in (*parts, scan[begin:])]


def _scan_end(data: bytes, at: int) -> int:
    while (at := data.find(b"\xff", at)) >= 0:
        if at + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
            at += 2
            continue
        return at
    return len(data)


def decode_frame(data: bytes, at: int, tables: _Tables) -> tuple[np.ndarray, tuple[int, int], int]:
    """Luminance thumbnail, (width, height) in pixels, and where the image ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    quant: dict[int, int] = {}
    coded: dict[int, tuple] = {}
    parts: list[tuple[int, int, int, int]] = []
    width = height = interval = 0
    thumb = None
    while True:
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            if thumb is None:
                raise ValueError("no scan")
            return thumb, (width, height), at
        (n,) = struct.unpack_from(">H", data, at)
        body, at = data[at + 2 : at + n], at + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                k = 17 + sum(body[1:17])
                coded[body[0]] = tables[bytes(body[1:k])]
                body = body[k:]
        elif marker == 0xC0:
            _, height, width, count = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            if body[0] != len(parts):
                raise ValueError("scans of single components are not baseline thumbnails here")
            using = {body[1 + 2 * i]: (coded[body[2 + 2 * i] >> 4], coded[16 + (body[2 + 2 * i] & 15)]) for i in range(body[0])}
            end = _scan_end(data, at)
            thumb = _scan(data[at:end], parts, using, quant, width, height, interval, tables)
            at = end


def _scan(scan: bytes, parts, using, quant, width: int, height: int, interval: int, tables: _Tables) -> np.ndarray:
    single = len(parts) == 1
    hs, vs = (1, 1) if single else (max(p[1] for p in parts), max(p[2] for p in parts))
    across, down = -(-width // (8 * hs)), -(-height // (8 * vs))
    h, v = (1, 1) if single else parts[0][1:3]
    scale = quant[parts[0][3]] / 8
    if single and not interval and (same := _uniform(*using[parts[0][0]])):
        dc = using[parts[0][0]][0]
        levels = np.cumsum(_strided(scan.replace(b"\xff\x00", b"\xff"), across * down, dc, *same, tables), dtype=np.int32).reshape(down, across)
    else:
        levels = np.zeros((down * v, across * h), np.int64)
        pieces = _split_restarts(scan)
        each = interval or across * down
        for k in range(across * down):
            if k % each == 0:
                bits, last = _Bits(pieces[k // each]), dict.fromkeys((p[0] for p in parts), 0)
            y, x = divmod(k, across)
            for p in parts:
                dc, ac = using[p[0]]
                for j in range(1 if single else p[1] * p[2]):
                    size = bits.symbol(dc)
                    d = bits.take(size)
                    last[p[0]] += d - (1 << size) + 1 if size and d < 1 << (size - 1) else d
                    place = 1
                    while place < 64:
                        s = bits.symbol(ac)
                        if s == 0:
                            break
                        bits.take(s & 15)
                        place += (s >> 4) + 1
                    if p is parts[0]:
                        levels[y * v + j // h, x * h + j % h] = last[p[0]]
    shown = levels[: -(-height * v // (8 * vs)), : -(-width * h // (8 * hs))]
    if scale == int(scale):
        return np.clip(shown * np.int32(scale) + 128, 0, 255).astype(np.uint8)
    return np.clip(np.rint(shown * scale + 128), 0, 255).astype(np.uint8)


_EIGHTHS = np.arange(9)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid are lighter than the mean."""
    rows, cols = thumb.shape
    y, x = _EIGHTHS * rows // 8, _EIGHTHS * cols // 8
    total = np.add.reduceat(np.add.reduceat(thumb, y[:8], 0, np.int64), x[:8], 1)  # an empty band is its first line
    cells = np.maximum(y[1:] - y[:8], 1)[:, None] * np.maximum(x[1:] - x[:8], 1)
    light = total * thumb.size > int(thumb.sum(dtype=np.int64)) * cells
    return np.packbits(light).tobytes().hex()


def decode(media: bytes, tables: _Tables) -> tuple[bytes, str]:
    """Samples of all frames' thumbnails in order, and ``<width>x<height>:<hash>`` per frame joined by commas."""
    at, samples, features = 0, [], []
    while at < len(media):
        thumb, (width, height), at = decode_frame(media, at, tables)
        samples.append(thumb.tobytes())
        features.append(f"{width}x{height}:{thumbnail_hash(thumb)}")
    return b"".join(samples), ",".join(features)


def media_column(docs: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, <keep>, n_bytes, media``: each text's payload as JPEG."""
    held = docs.select("text", "doc_id", *[F.col(f"`{c}`") for c in keep if c not in ("doc_id", "n_bytes", "media")])
    names = held.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                payloads = [payload_of(t) for t in part.column(0).to_pylist()]
                size = pa.array([len((t or "").encode("utf-8")) for t in part.column(0).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], size, pa.array([encode(p) for p in payloads], pa.binary())], [*names, "n_bytes", "media"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[1:])
    return held.mapInArrow(run, f"{kinds}, n_bytes long, media binary")


def stored(spark: SparkSession, media: DataFrame) -> DataFrame:
    """The media table written to the shared folder and read back."""
    path = new_folder(spark, "media")
    media.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(media.schema).parquet(path)


def media_features(media: DataFrame) -> DataFrame:
    """Features of ``doc_id, n_bytes, media`` rows, computed from the stored bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables()
        for batch in batches:
            size, sha, tail, stored, stored_sha, feature = [], [], [], [], [], []
            for k in range(batch.num_rows):
                data = batch.column(2)[k].as_py()
                payload, what = decode(data, tables)
                size.append(len(payload))
                sha.append(hashlib.sha256(payload).hexdigest())
                tail.append(zlib.crc32(payload[-64:]))
                stored.append(len(data))
                stored_sha.append(hashlib.sha256(data).hexdigest())
                feature.append(what)
            cols = [batch.column(0), batch.column(1), *[pa.array(x, pa.int64() if isinstance((x or [""])[0], int) else pa.string()) for x in (size, sha, tail, stored, stored_sha, feature)]]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(cols, names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {dict(media.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
