"""Media columns: motion JPEG in AVI.

A payload becomes frames of WIDTH x HEIGHT pixels.  Each payload byte is the DC coefficient of one 8 x 8
block, the format's own unit: the frame's tables have one DC code of 7 bits, for differences of 8 bits, and
one AC code, for the end of a block, and prediction restarts at every MCU of three blocks; so a byte is the
8 extra bits of a difference and a block takes two bytes.  The stream is baseline JPEG that any decoder
reads.  Frames are indexed by idx1; the payload's length stands in LIST INFO.

The reader follows the index, decodes the intra frames (any baseline tables; frames of the writer's own
header all at once), takes a histogram of each and starts a new shot where the distance to the frame before
exceeds what the last frames suggest.

Null texts are empty; a payload is filled with spaces to a positive multiple of 192.  Equal texts give equal
rows.  A text is encoded by itself; memory follows the longest one.  RIFF ends at 4 GB, about 1.3 GB of text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

UNIT = 192
ROWS = 4  # rows of blocks in a frame
FPS = 25
WIDTH, HEIGHT = 8 * UNIT // 3, 8 * ROWS
_MCUS = UNIT // 3 * ROWS
_BYTES = UNIT * ROWS


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_header() -> bytes:
    quant = _segment(0xDB, bytes([0]) + bytes([4] * 64))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    dc = _segment(0xC4, bytes([0x00]) + bytes([0] * 6 + [1] + [0] * 9) + bytes([8]))
    ac = _segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0]))
    restart = _segment(0xDD, struct.pack(">H", 1))
    scan = _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return b"\xff\xd8" + quant + frame + dc + ac + restart + scan


_HEADER = _frame_header()
_SIZE = len(_HEADER) + 8 * _MCUS  # each MCU: 6 bytes and a marker, the last one's being the end of the image
_PAD = _SIZE % 2


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def encode(payload: bytes) -> bytes:
    """The AVI file of a payload."""
    n = -(-len(payload) // _BYTES)
    raw = np.zeros(n * _BYTES, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    raw = raw.reshape(n, _MCUS, 3)
    chunk = np.zeros((n, 8 + _SIZE + _PAD), np.uint8)
    chunk[:, : 8 + len(_HEADER)] = np.frombuffer(b"00dc" + struct.pack("<I", _SIZE) + _HEADER, np.uint8)
    scan = chunk[:, 8 + len(_HEADER) : 8 + _SIZE].reshape(n, _MCUS, 8)
    scan[:, :, 0:6:2] = raw >> 7
    scan[:, :, 1:6:2] = raw << 1
    scan[:, :, 6] = 0xFF
    scan[:, :, 7] = 0xD0 + np.arange(_MCUS) % 8
    scan[:, -1, 7] = 0xD9
    chunk[:, 8 + len(_HEADER) : 8 + _SIZE] = scan.reshape(n, -1)
    movi = b"movi" + chunk.tobytes()
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
    index[:, 2], index[:, 3] = 4 + np.arange(n) * chunk.shape[1], _SIZE
    part = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    main = struct.pack("<14I", 1_000_000 // FPS, _SIZE * FPS, 0, 0x10, n, 0, 1, _SIZE, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, n, _SIZE, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 24, b"MJPG", WIDTH * HEIGHT * 3, 0, 0, 0, 0)
    head = part(b"LIST", b"hdrl" + part(b"avih", main) + part(b"LIST", b"strl" + part(b"strh", stream) + part(b"strf", bitmap)))
    info = part(b"LIST", b"INFO" + part(b"ICMT", b"payload=%d\0" % len(payload)))
    return part(b"RIFF", b"AVI " + head + info + part(b"LIST", movi) + part(b"idx1", index.tobytes()))


class Avi:
    """The parts of an AVI file: frames (offset, size) from its index, fps, and the comment."""

    def __init__(self, data: bytes):
        self.data, self.frames, self.fps, self.comment = memoryview(data), [], FPS, b""
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        index, self._movi = b"", None
        stack = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
        while stack:
            at, end = stack.pop()
            while at + 8 <= min(end, len(data)):
                tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
                if tag == b"LIST" and data[at + 8 : at + 12] == b"movi":
                    self._movi = at + 8
                elif tag == b"LIST":
                    stack.append((at + 12, at + 8 + size))
                elif tag == b"idx1":
                    index = data[at + 8 : at + 8 + size]
                elif tag == b"strh" and data[at + 8 : at + 12] == b"vids":
                    scale, rate = struct.unpack_from("<II", data, at + 28)
                    self.fps = rate / (scale or 1)
                elif tag == b"ICMT":
                    self.comment = data[at + 8 : at + 8 + size].rstrip(b"\0")
                at += 8 + size + size % 2
        entries = np.frombuffer(index[: len(index) // 16 * 16], "<u4").reshape(-1, 4)
        video = entries[(entries[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
        # offsets count from 'movi', or in some files from the start
        base = self._movi if len(video) and data[self._movi + video[0, 2] : self._movi + video[0, 2] + 2] == b"00" else 0
        self.frames = [(base + int(o) + 8, int(n)) for o, n in video[:, 2:4]]

    def units(self) -> np.ndarray:
        """DC differences' payload units: one byte of each block, all frames in order."""
        if self.frames and all(n == _SIZE for _, n in self.frames):
            step = self.frames[1][0] - self.frames[0][0] if len(self.frames) > 1 else _SIZE
            first = self.frames[0][0]
            if all(o == first + k * step for k, (o, _) in enumerate(self.frames)):
                flat = np.frombuffer(self.data, np.uint8, (len(self.frames) - 1) * step + _SIZE, first)
                view = np.lib.stride_tricks.as_strided(flat, (len(self.frames), _SIZE), (step, 1))
                if (view[:, : len(_HEADER)] == np.frombuffer(_HEADER, np.uint8)).all():
                    scan = view[:, len(_HEADER) :].reshape(len(self.frames), _MCUS, 8)
                    return ((scan[:, :, 0:6:2] << 7) | (scan[:, :, 1:6:2] >> 1)).reshape(-1)
        out = [np.concatenate([np.where(d >= 0, d, d + 255) for d in [dc.reshape(-1)]]) for dc in (decode_dc(bytes(self.data[o : o + n])) for o, n in self.frames)]
        return np.concatenate(out).astype(np.uint8) if out else np.zeros(0, np.uint8)


def decode_dc(jpeg: bytes) -> np.ndarray:
    """DC coefficients before dequantisation of a baseline JPEG without subsampling: (MCU, component)."""
    tables: dict[int, dict[tuple[int, int], int]] = {}
    at, every, comps, n_mcu = 2, 0, [], 0
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                code, k, table = 0, 17, {}
                for length in range(1, 17):
                    for _ in range(body[length]):
                        table[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = table
                body = body[k:]
        elif marker in (0xC0, 0xC1):
            h, w = struct.unpack_from(">HH", body, 1)
            if any(body[7 + 3 * c] != 0x11 for c in range(body[5])):
                raise ValueError("subsampled frames aren't read")
            n_mcu = -(-h // 8) * -(-w // 8)
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            comps = [(body[2 + 2 * c] >> 4, body[2 + 2 * c] & 15) for c in range(body[0])]
            break
    out, pred = np.zeros((n_mcu, len(comps)), np.int64), [0] * len(comps)
    bits, have = 0, 0

    def take(n: int) -> int:
        nonlocal bits, have, at
        while have < n:
            b = jpeg[at] if at < len(jpeg) else 0
            if b == 0xFF and at + 1 < len(jpeg) and jpeg[at + 1] != 0:
                b = 0  # a marker: the stream before it is over
            else:
                at += 2 if b == 0xFF else 1
            bits, have = bits << 8 | b, have + 8
        have -= n
        v = bits >> have
        bits &= (1 << have) - 1
        return v

    def symbol(table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("damaged frame")

    for m in range(n_mcu):
        if every and m and m % every == 0:
            bits = have = 0
            while not (jpeg[at] == 0xFF and 0xD0 <= jpeg[at + 1] <= 0xD7):
                at += 1
            at, pred = at + 2, [0] * len(comps)
        for c, (dc, ac) in enumerate(comps):
            n = symbol(tables[dc])
            v = take(n) if n else 0
            pred[c] += v if not n or v >> (n - 1) else v - (1 << n) + 1
            out[m, c] = pred[c]
            k = 1
            while k < 64:
                s = symbol(tables[16 + ac])
                if not s:
                    break
                k += 1 + (s >> 4)
                take(s & 15)
    return out


def shots(units: np.ndarray, per_frame: int = _BYTES, window: int = 8) -> list[tuple[int, int]]:
    """Frame ranges [a, b): a shot starts where the histogram's distance to the frame before exceeds both a
    fixed least and mean + 2 deviations of the `window` distances before it."""
    n = -(-len(units) // per_frame)
    if n < 2:
        return [(0, n)]
    hist = np.bincount((np.arange(len(units)) // per_frame) * 32 + (units >> 3), minlength=32 * n).reshape(n, 32)
    p = hist / hist.sum(1, keepdims=True)
    d = np.abs(np.diff(p, axis=0)).sum(1) / 2
    s1, s2 = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    i = np.arange(len(d))
    a = np.maximum(0, i - window)
    k = np.maximum(1, i - a)
    mean = (s1[i] - s1[a]) / k
    dev = np.sqrt(np.maximum(0, (s2[i] - s2[a]) / k - mean**2))
    cut = np.flatnonzero((d > np.where(i > 0, mean + 2 * dev, 0)) & (d > 0.12)) + 1
    edge = [0, *cut.tolist(), n]
    return list(zip(edge[:-1], edge[1:], strict=True))


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shots array<struct<start: long, end: long>>"


def features(docs: DataFrame, media: bool = False) -> DataFrame:
    """Every text stored as AVI, read back, and described; media: with the file itself as column `media`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = C.text_column(batch, "text")
            offsets, _ = C.buffers(col)
            ids = batch.column(0)
            for a, b in C.slices(offsets):
                rows = []
                for text in col.slice(a, b - a).to_pylist():
                    n, payload = padded(text)
                    stored = encode(payload)
                    avi = Avi(stored)
                    units = avi.units()[: int(avi.comment.rpartition(b"=")[2])]
                    back = units.tobytes()
                    cuts = shots(units)
                    said = f"{len(avi.frames)}f;" + ",".join(f"{x}-{y}" for x, y in cuts)
                    row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), said, [{"start": x, "end": y} for x, y in cuts])
                    rows.append(row + (stored,) if media else row)
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shots", "media"]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]], names=["doc_id", *names[: len(cols)]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FEATURES + ", media binary" * media)


def clips(docs: DataFrame) -> DataFrame:
    """One row per shot: doc_id, clip, start_s, end_s."""
    x = features(docs).select("doc_id", F.posexplode("shots").alias("clip", "s"))
    return x.select("doc_id", "clip", (F.col("s.start") / FPS).alias("start_s"), (F.col("s.end") / FPS).alias("end_s"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("shots")
