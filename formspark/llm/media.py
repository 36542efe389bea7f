"""Motion-JPEG in AVI: write, parse by the RIFF index, decode intra frames, and find shots.

Frames are lossless JPEG (predictor 1), 64 samples wide and grey, with a restart after each line, so that the lines of
all files of a batch decode side by side.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta

WIDTH, LINES = 64, 64
FPS = 25

# A difference of category s has s more bits. Code lengths of 9 - s make every sample 9 bits long, so that a line of
# 64 samples is 72 whole bytes.
_LENGTHS = [9 - s for s in range(9)]
_ORDER = sorted(range(9), key=lambda s: _LENGTHS[s])


def huffman(lengths: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of the canonical code; lengths are ascending."""
    out, code, last = [], 0, lengths[0] if lengths else 0
    for s, n in zip(symbols, lengths):
        code <<= n - last
        last = n
        out.append((s, code, n))
        code += 1
    return out


def _codes() -> np.ndarray:
    """The 9 bits of each difference from -255 to 255, at difference + 255."""
    by = {s: (code, n) for s, code, n in huffman([_LENGTHS[s] for s in _ORDER], _ORDER)}
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        out[d + 255] = by[s][0] << s | (d if d >= 0 else d + (1 << s) - 1)
    return out


_CODES = _codes()
_DHT = b"\xff\xc4" + struct.pack(">H", 2 + 17 + 9) + b"\x00" + bytes(_LENGTHS.count(n) for n in range(1, 17)) + bytes(_ORDER)


def encode_lines(lines: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes of each line (rows of 64 samples), 72 to a line, before byte stuffing."""
    before = np.concatenate((np.full((len(lines), 1), 128, np.int16), lines[:, :-1].astype(np.int16)), axis=1)
    codes = _CODES[lines.astype(np.int16) - before + 255].reshape(-1, 8).astype(np.uint64)
    out = np.zeros((len(codes), 9), np.uint8)
    # eight codes of 9 bits are nine bytes
    high, low = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint64)
    for k in range(4):
        high = high << np.uint64(9) | codes[:, k]
        low = low << np.uint64(9) | codes[:, k + 4]
    for k in range(4):
        out[:, k] = high >> np.uint64(28 - 8 * k) & np.uint64(255)
        out[:, k + 5] = low >> np.uint64(24 - 8 * k) & np.uint64(255)
    out[:, 4] = (high & np.uint64(15)) << np.uint64(4) | low >> np.uint64(32)
    return out.reshape(-1, 72)


def frame(coded: np.ndarray) -> bytes:
    """A JPEG of these coded lines."""
    n = len(coded)
    head = b"\xff\xd8" + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, n, WIDTH, 1, 1, 0x11, 0) + _DHT + b"\xff\xdd" + struct.pack(">HH", 4, WIDTH) + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
    body = b"".join(part for k, line in enumerate(coded) for part in (line.tobytes().replace(b"\xff", b"\xff\x00"), bytes((0xFF, 0xD0 + k % 8))))
    return head + body[:-2] + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], lines: int) -> bytes:
    """A one-stream AVI with an idx1 index; chunk offsets in the index count from the start of the movi list's type."""
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, WIDTH, lines, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, -1, 0, 0, 0, WIDTH, lines)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, lines, 1, 8, b"MJPG", WIDTH * lines, 0, 0, 256, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index = [b"movi"], []
    at = 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def parse(media: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the frames of the first video stream, by the index, or by walking movi where there is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index, walked = float(FPS), None, None, []
    stack = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                stack.append((at + 12, at + 8 + size))
            elif name == b"strh" and media[at + 8 : at + 12] == b"vids":
                scale, rate = struct.unpack_from("<II", media, at + 28)
                fps = rate / max(scale, 1)
            elif name == b"idx1":
                index = (at + 8, size // 16)
            elif name[2:] in (b"dc", b"db"):
                walked.append((at + 8, size))
            at += 8 + size + (size & 1)
    if index is None or movi is None:
        return fps, [media[a : a + n] for a, n in walked]
    found = []
    for k in range(index[1]):
        name, _, off, size = struct.unpack_from("<4sIII", media, index[0] + 16 * k)
        if name[2:] in (b"dc", b"db"):
            found.append(media[movi + off + 8 : movi + off + 8 + size])
    return fps, found


def decode(frames: list[bytes]) -> list[np.ndarray]:
    """Samples of lossless grey JPEGs with a restart after each line. All lines of all frames with the same code table
    and width decode in step, one sample of each at a time."""
    segments: dict[tuple[bytes, int], list[tuple[int, bytes]]] = {}
    shape = []
    for k, f in enumerate(frames):
        at, table, rows, width = 2, b"", 0, 0
        while f[at + 1] != 0xDA:
            size = struct.unpack_from(">H", f, at + 2)[0]
            if f[at + 1] == 0xC3:
                rows, width = struct.unpack_from(">HH", f, at + 5)
            elif f[at + 1] == 0xC4:
                table = f[at + 5 : at + 2 + size]
            at += 2 + size
        at += 2 + struct.unpack_from(">H", f, at + 2)[0]
        body = f[at : f.rindex(b"\xff\xd9")]
        parts, lo = [], 0
        marks = np.frombuffer(body, np.uint8)
        cuts = np.flatnonzero((marks[:-1] == 0xFF) & (marks[1:] >= 0xD0) & (marks[1:] <= 0xD7)).tolist() if len(marks) > 1 else []
        for c in [*cuts, len(body)]:
            parts.append(body[lo:c].replace(b"\xff\x00", b"\xff"))
            lo = c + 2
        shape.append((rows, width))
        segments.setdefault((table, width), []).extend((k, p) for p in parts)
    found: list[list[np.ndarray]] = [[] for _ in frames]
    for (table, width), parts in segments.items():
        rows = _decode_lines(table, width, [p for _, p in parts])
        for (k, _), row in zip(parts, rows):
            found[k].append(row)
    return [np.array(x, np.uint8).reshape(s) for x, s in zip(found, shape)]


def _decode_lines(table: bytes, width: int, parts: list[bytes]) -> np.ndarray:
    counts, symbols = table[:16], list(table[16:])
    lengths = [n + 1 for n in range(16) for _ in range(counts[n])]
    size, extra = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for s, code, n in huffman(lengths, symbols):
        lo = code << 16 - n
        size[lo : lo + (1 << 16 - n)], extra[lo : lo + (1 << 16 - n)] = n, s
    longest = max(map(len, parts)) + 8
    flat = np.zeros(len(parts) * longest, np.uint8)
    sizes = np.array([len(p) for p in parts])
    base = np.arange(len(parts)) * longest
    to = np.repeat(base - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    flat[to] = np.frombuffer(b"".join(parts), np.uint8)
    bit, value = np.zeros(len(parts), np.int64), np.full(len(parts), 128, np.int64)
    out = np.zeros((len(parts), width), np.uint8)
    for x in range(width):
        at = base + (bit >> 3)
        window = np.zeros(len(parts), np.int64)
        for k in range(5):
            window = window << 8 | flat[at + k]
        peek = (window >> (24 - (bit & 7))) & 0xFFFF
        n, s = size[peek].astype(np.int64), extra[peek].astype(np.int64)
        raw = (window >> (40 - (bit & 7) - n - s)) & ((1 << s) - 1)
        value = (value + np.where((s > 0) & (raw < (1 << s) // 2), raw - (1 << s) + 1, raw)) & 0xFF
        out[:, x] = value
        bit += n + s
    return out


def shots(frames: list[np.ndarray], bins: int = 16, window: int = 8, factor: float = 3.0, least: float = 0.05) -> list[tuple[int, int]]:
    """(first, end) frames of each shot. A cut is where the histogram moves by more than the mean of the last window
    movements plus factor times their deviation, and more than least. The first movement has none before it to be compared
    with, so no shot ends after the first frame. One frame, or none, is one shot."""
    hist = np.array([np.bincount(f.ravel() * bins // 256 if f.dtype != np.uint8 else f.ravel() >> 4, minlength=bins) / max(f.size, 1) for f in frames])
    moved = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2 if len(frames) > 1 else np.zeros(0)
    cuts = [0]
    for k, d in enumerate(moved):
        past = moved[max(0, k - window) : k]
        if d > least and len(past) and d > past.mean() + factor * past.std() + 1e-9:
            cuts.append(k + 1)
    return list(zip(cuts, [*cuts[1:], len(frames)]))


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<start_s:double,end_s:double,frames:int,mean:double>>"


def store(payloads: list[bytes]) -> list[bytes]:
    """An AVI of each payload (a positive multiple of 64 bytes), 64 x 64 samples a frame, the last one shorter."""
    coded = encode_lines(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH))
    out, at = [], 0
    for p in payloads:
        n = len(p) // WIDTH
        frames = [frame(coded[at + k : at + min(k + LINES, n)]) for k in range(0, n, LINES)]
        out.append(avi(frames, min(n, LINES)))
        at += n
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ta.chunks(batches, limit=1 << 20):
        raw = [(x.as_py() or "").encode() for x in batch.column(1)]
        payloads = [b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b)) for b in raw]
        stored = store(payloads)
        read = [parse(m) for m in stored]
        samples = decode([f for _, frames in read for f in frames])
        rows, at = {k: [] for k in ("payload_sha256", "tail_crc32", "media_sha256", "clips", "payload_bytes")}, 0
        for (fps, frames), m in zip(read, stored):
            own = samples[at : at + len(frames)]
            at += len(frames)
            back = b"".join(f.tobytes() for f in own)
            rows["payload_bytes"].append(len(back))
            rows["payload_sha256"].append(hashlib.sha256(back).hexdigest())
            rows["tail_crc32"].append(zlib.crc32(back[-64:]))
            rows["media_sha256"].append(hashlib.sha256(m).hexdigest())
            rows["clips"].append([{"start_s": a / fps, "end_s": b / fps, "frames": b - a, "mean": round(float(np.mean([own[k].mean() for k in range(a, b)])), 6)} for a, b in shots(own)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(rows["payload_bytes"], pa.int64()), pa.array(rows["payload_sha256"]), pa.array(rows["tail_crc32"], pa.int64()), pa.array(map(len, stored), pa.int64()), pa.array(rows["media_sha256"]), pa.array(rows["clips"], pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("mean", pa.float64())])))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"],
        )


def through_avi(docs: DataFrame) -> DataFrame:
    """Each text stored as Motion-JPEG and read back: sizes, digests and clips. A null text is empty; the payload of an
    empty text is 64 zeros. Rows don't depend on each other, so equal texts give equal values."""
    return docs.select("doc_id", "text").mapInArrow(_run, OUT)


def clip_rows(found: DataFrame) -> DataFrame:
    """One row a clip: doc_id, clip (from 0), start_s, end_s, frames, mean. Every row of found has a clip at least, and rows
    that share a doc_id, or have none, keep their own; no rows give no rows."""
    return found.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")


def feature() -> Column:
    """The clips as text."""
    return F.array_join(F.transform("clips", lambda c: F.format_string("%.2f-%.2f:%d:%.6f", c["start_s"], c["end_s"], c["frames"], c["mean"])), ";")
