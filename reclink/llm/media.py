"""Operator 3: AVI files of motion-JPEG frames: writing, reading by the RIFF index, shots and timed clips.

The writer's frames are lossless JPEG (SOF3, predictor 1: the sample to the left) of 8-bit grey samples. Its Huffman table gives category c
a code of 9 - c bits, so every sample takes nine bits with its extra bits and whole files are coded and decoded by table look-up
in numpy. The reader takes any table (bit by bit where the rate is not fixed) and predictors 1 and 2. It also takes what cameras write, baseline
DCT frames (SOF0), grey or colour, with or without restart markers; of those it keeps the luma samples. Frames are coded, decoded and measured in blocks.

A shot ends where the histogram difference of neighbouring frames exceeds both a floor and the mean of the differences before it in
the shot by a number of their standard deviations.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads are padded with blanks to a positive multiple of this.
UNIT = 192
WIDTH, HEIGHT, FPS = 64, 24, 25
BINS = 32
#: Frames that are coded, decoded or measured together, and text bytes of the rows that are.
BLOCK, BATCH_BYTES = 256, 4 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit words by difference + 255, and differences by word."""
    words, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        words[d + 255] = ((1 << (9 - c)) - 2) << c | (d if d >= 0 else d + (1 << c) - 1)
        back[words[d + 255]] = d
    return words, back


_WORDS, _DIFFERENCES = _tables()


class Video(NamedTuple):
    width: int
    height: int
    fps: float
    payload_bytes: int | None
    frames: np.ndarray  # frame, row, column


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _jpeg_head(width: int, height: int) -> bytes:
    seg = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    sof = seg(0xC3, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0))
    dht = seg(0xC4, bytes([0, *([1] * 9), *([0] * 7), *range(8, -1, -1)]))
    return b"\xff\xd8" + sof + dht + seg(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """Lossless JPEG files of grey frames (frame, row, column)."""
    if len(frames) > BLOCK:
        return [f for at in range(0, len(frames), BLOCK) for f in encode_frames(frames[at : at + BLOCK])]
    n, height, width = frames.shape
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    words = _WORDS[d + 255].reshape(n, -1)
    bits = np.unpackbits(words.astype(">u2").view(np.uint8).reshape(n, -1, 2), axis=2)[:, :, 7:].reshape(n, -1)
    if spare := -bits.shape[1] % 8:
        bits = np.concatenate([bits, np.ones((n, spare), np.uint8)], axis=1)
    packed, head = np.packbits(bits, axis=1), _jpeg_head(width, height)
    return [head + row.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for row in packed]


def _bit_serial(bits: np.ndarray, codes: dict[tuple[int, int], int], n: int) -> np.ndarray:
    out, at = np.zeros(n, np.int64), 0
    for k in range(n):
        code = size = 0
        while (size, code) not in codes:
            code, size, at = code << 1 | int(bits[at]), size + 1, at + 1
            if size > 16:
                raise ValueError("no such code")
        c = codes[size, code]
        value = int("".join(map(str, bits[at : at + c])), 2) if c else 0
        at += c
        out[k] = value if not c or value >> (c - 1) else value - (1 << c) + 1
    return out


def _codes(body: bytes) -> dict[tuple[int, int], dict[tuple[int, int], int]]:
    """Huffman tables of one segment: by (class, number), symbols by (length, code)."""
    out, at = {}, 0
    while at < len(body):
        table, code = out.setdefault((body[at] >> 4, body[at] & 15), {}), 0
        counts, symbols = body[at + 1 : at + 17], iter(body[at + 17 :])
        for length, many in enumerate(counts, 1):
            for _ in range(many):
                table[length, code] = next(symbols)
                code += 1
            code <<= 1
        at += 17 + sum(counts)
    return out


def _lossless(head: dict, scans: list[bytes]) -> np.ndarray:
    """Samples of lossless frames that share their header."""
    precision, height, width, parts = struct.unpack_from(">BHHB", head["frame"])
    if precision != 8 or parts != 1:
        raise ValueError("8-bit grey lossless frames only")
    codes, predictor, n = head["codes"][0, 0], head["scan"][3], height * width
    if all(length + c == 9 for (length, _), c in codes.items()):
        need = -(-n * 9 // 8)
        raw = np.frombuffer(b"".join(s[:need] for s in scans), np.uint8).reshape(len(scans), need)
        bits = np.unpackbits(raw, axis=1)[:, : 9 * n].reshape(len(scans), n, 9)
        words = (bits[:, :, 0].astype(np.uint16) << 8) | np.packbits(bits[:, :, 1:], axis=2)[:, :, 0]
        back = np.zeros(512, np.int16)
        for (length, code), c in codes.items():
            v = np.arange(1 << c)
            back[(code << c) + v] = np.where(v >> max(c - 1, 0), v, v - (1 << c) + 1) if c else 0
        d = back[words].reshape(-1, height, width)
    else:
        d = np.stack([_bit_serial(np.unpackbits(np.frombuffer(s, np.uint8)), codes, n) for s in scans]).reshape(-1, height, width)
    # Samples are exact modulo 256, and so are the sums.
    d = d.astype(np.uint8)
    if predictor == 1:
        d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.uint8) + np.uint8(128)
        return np.cumsum(d, axis=2, dtype=np.uint8)
    if predictor == 2:
        d[:, 0, 0] += np.uint8(128)
        d[:, 0] = np.cumsum(d[:, 0], axis=1, dtype=np.uint8)
        return np.cumsum(d, axis=1, dtype=np.uint8)
    raise ValueError("predictors 1 and 2 only")


#: Row and column of the coefficients in the order of the scan: along diagonals, up and down in turn.
_ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
_COSINES = np.array([[(0.125 if u == 0 else 0.25) ** 0.5 * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


class _Bits:
    """Bits of an entropy-coded segment."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.left = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            if self.at == len(self.data):
                raise ValueError("a scan ends early")
            self.value, self.left, self.at = self.value << 8 | self.data[self.at], self.left + 8, self.at + 1
        self.left -= n
        found = self.value >> self.left
        self.value &= (1 << self.left) - 1
        return found

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = size = 0
        while (size, code) not in codes:
            code, size = code << 1 | self.take(1), size + 1
            if size > 16:
                raise ValueError("no such code")
        return codes[size, code]

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _baseline(head: dict, scan: bytes) -> np.ndarray:
    """Luma samples of a baseline frame whose components share one scan."""
    precision, height, width, parts = struct.unpack_from(">BHHB", head["frame"])
    shape = {head["frame"][6 + 3 * k]: head["frame"][7 + 3 * k : 9 + 3 * k] for k in range(parts)}
    order = [(head["scan"][1 + 2 * k], head["scan"][2 + 2 * k]) for k in range(head["scan"][0])]
    if precision != 8 or len(order) != parts:
        raise ValueError("8-bit frames of one scan only")
    # Of one component, blocks follow each other whatever its sampling factors say.
    across = {c: (1, 1) if parts == 1 else (s[0] >> 4, s[0] & 15) for c, s in shape.items()}
    wide, high = (max(v[k] for v in across.values()) for k in (0, 1))
    columns, rows = -(-width // (8 * wide)), -(-height // (8 * high))
    luma, (h, v) = order[0][0], across[order[0][0]]
    plane = np.zeros((rows * v, columns * h, 8, 8))
    segments = iter(_segments(scan))
    for unit in range(rows * columns):
        if unit == 0 or head["restart"] and unit % head["restart"] == 0:
            bits, before = _Bits(next(segments)), dict.fromkeys(shape, 0)
        for part, tables in order:
            for k in range(across[part][0] * across[part][1]):
                block = np.zeros((8, 8))
                before[part] += bits.signed(bits.symbol(head["codes"][0, tables >> 4]))
                block[0, 0], at = before[part], 1
                while at < 64:
                    code = bits.symbol(head["codes"][1, tables & 15])
                    if code == 0:
                        break
                    at += code >> 4
                    if code & 15:
                        if at > 63:
                            raise ValueError("a block has too many coefficients")
                        block[_ZIGZAG[at]] = bits.signed(code & 15)
                    at += 1
                if part == luma:
                    plane[unit // columns * v + k // h, unit % columns * h + k % h] = block
    plane *= head["steps"][shape[luma][1]]
    samples = np.einsum("xu,rcuv,yv->rxcy", _COSINES, plane, _COSINES).reshape(plane.shape[0] * 8, -1) + 128
    samples = np.clip(np.rint(samples), 0, 255).astype(np.uint8)
    if (h, v) != (wide, high):
        samples = samples.repeat(high // v, axis=0).repeat(wide // h, axis=1)
    return samples[:height, :width]


def _segments(scan: bytes) -> list[bytes]:
    """The parts of a scan between restart markers, without stuffed zeros."""
    return [part.replace(b"\xff\0", b"\xff") for part in re.split(rb"\xff[\xd0-\xd7]", scan)]


def _head(data: bytes) -> dict:
    """Frame and scan header, Huffman codes, quantiser steps and restart interval of a JPEG header."""
    found: dict = {"codes": {}, "steps": {}, "restart": 0, "kind": None}
    at = 2
    while at < len(data):
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if mark == 0xC4:
            found["codes"] |= _codes(body)
        elif mark == 0xDB:
            k = 0
            while k < len(body):
                wide = 1 + (body[k] >> 4)
                steps = np.zeros((8, 8))
                for place, value in zip(_ZIGZAG, struct.unpack_from(">64" + "BH"[wide - 1], body, k + 1)):
                    steps[place] = value
                found["steps"][body[k] & 15] = steps
                k += 1 + 64 * wide
        elif mark == 0xDD:
            found["restart"] = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            found["scan"] = body
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            found["kind"], found["frame"] = mark, body
        at += 2 + size
    return found


def decode_frames(files: list[bytes]) -> np.ndarray:
    """Frames of JPEG files of one size; those with one header are decoded together, in blocks."""
    out: np.ndarray | None = None
    groups: dict[bytes, list[tuple[int, int]]] = {}
    for k, f in enumerate(files):
        if f[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        while f[at + 1] != 0xDA:
            at += 2 + struct.unpack_from(">H", f, at + 2)[0]
        stop = at + 2 + struct.unpack_from(">H", f, at + 2)[0]
        groups.setdefault(f[:stop], []).append((k, stop))
    for raw, own in groups.items():
        head = _head(raw)
        if head["kind"] not in (0xC0, 0xC3):
            raise ValueError("baseline and lossless JPEG frames only")
        for lo in range(0, len(own), BLOCK):
            some = own[lo : lo + BLOCK]
            scans = [files[k][stop : files[k].rindex(b"\xff\xd9")] for k, stop in some]
            made = _lossless(head, [s.replace(b"\xff\0", b"\xff") for s in scans]) if head["kind"] == 0xC3 else np.stack([_baseline(head, s) for s in scans])
            if out is None:
                out = np.empty((len(files), *made.shape[1:]), np.uint8)
            out[[k for k, _ in some]] = made
    return out


def write_avi(payload: bytes, width: int = WIDTH, height: int = HEIGHT, fps: int = FPS) -> bytes:
    """An AVI file whose frames' samples are ``payload`` (a positive multiple of ``UNIT`` bytes); the last frame is filled with zeros."""
    height = min(height, len(payload) // width)
    size = width * height
    n = -(-len(payload) // size)
    frames = encode_frames(np.frombuffer(payload.ljust(n * size, b"\0"), np.uint8).reshape(n, height, width))
    movi, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sI2H8I4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", size, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    body = hdrl + _chunk(b"plen", struct.pack("<Q", len(payload))) + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def _walk(data: bytes, at: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, stop) of the chunks in a range; lists have the name of their kind."""
    while at + 8 <= stop:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        end = min(at + 8 + size, stop)
        yield (data[at + 8 : at + 12], at + 12, end) if name in (b"LIST", b"RIFF") else (name, at + 8, end)
        at = end + (size & 1)


def read_avi(data: bytes) -> Video:
    """Frames in the order of the file's index; without one, in the order of the movie list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    top = {name: (a, b) for name, a, b in _walk(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))}
    header = {name: (a, b) for name, a, b in _walk(data, *top[b"hdrl"])}
    stream = {name: (a, b) for name, a, b in _walk(data, *header[b"strl"])}
    scale, rate = struct.unpack_from("<2I", data, stream[b"strh"][0] + 20)
    width, height = struct.unpack_from("<ii", data, stream[b"strf"][0] + 4)
    movi = top[b"movi"][0]
    if b"idx1" in top:
        a, b = top[b"idx1"]
        entries = [e for e in struct.iter_unpack("<4s3I", data[a : b - (b - a) % 16]) if e[0][2:] in (b"dc", b"db")]
        # Offsets count from the list's kind or, in some files, from the start of the file.
        base = movi - 4 if entries and data[movi - 4 + entries[0][2] : movi + entries[0][2]] == entries[0][0] else 0
        files = [data[base + off + 8 : base + off + 8 + size] for _, _, off, size in entries]
    else:
        files = [data[a:b] for name, a, b in _walk(data, *top[b"movi"]) if name[2:] in (b"dc", b"db")]
    frames = decode_frames(files) if files else np.zeros((0, height, width), np.uint8)
    held = struct.unpack_from("<Q", data, top[b"plen"][0])[0] if b"plen" in top else None
    return Video(width, height, rate / max(scale, 1), held, frames)


def payload_of(video: Video) -> bytes:
    return video.frames.tobytes()[: video.payload_bytes]


def _histograms(frames: np.ndarray) -> np.ndarray:
    n = len(frames)
    bins = (frames.reshape(n, -1) >> 3).astype(np.int64) + BINS * np.arange(n)[:, None]
    return np.bincount(bins.ravel(), minlength=BINS * n).reshape(n, BINS)


def shots(frames: np.ndarray, spread: float = 3.0, floor: float = 0.25, least: int = 2) -> list[tuple[int, int]]:
    """(first, last + 1) of the shots. A shot has ``least`` frames at least, unless the film is shorter."""
    n = len(frames)
    if n < 2:
        return [(0, n)] if n else []
    hist = np.concatenate([_histograms(frames[at : at + BLOCK]) for at in range(0, n, BLOCK)])
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * frames[0].size)
    out, start, total, squares, seen = [], 0, 0.0, 0.0, 0
    for k, d in enumerate(change.tolist(), 1):
        mean = total / seen if seen else 0.0
        spread_now = max(squares / seen - mean * mean, 0.0) ** 0.5 if seen else 0.0
        if k - start >= least and n - k >= least and d > floor and d > mean + spread * spread_now:
            out.append((start, k))
            start, total, squares, seen = k, 0.0, 0.0, 0
        else:
            total, squares, seen = total + d, squares + d * d, seen + 1
    return [*out, (start, n)]


def clip_rows(video: Video) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frames, start and end in seconds) of the shots of a film."""
    return [(k, s, e - s, s / video.fps, e / video.fps) for k, (s, e) in enumerate(shots(video.frames))]


def _some(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches of at most 128 rows and, if they have more than one row, about ``BATCH_BYTES`` in a text or binary column."""
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < whole.num_rows:
            n = int(np.searchsorted(np.cumsum(sizes[at : at + 128]), BATCH_BYTES, side="right"))
            yield whole.slice(at, max(n, 1))
            at += max(n, 1)


def media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, n_bytes, media``: each whole text (null: empty) as UTF-8, padded, in an AVI file.

    A null id stays null; repeated rows give repeated rows; an empty table gives no rows; other columns of any name are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _some(batches, 1):
            sizes, files = [], []
            for t in b.column(1).to_pylist():
                raw = (t or "").encode()
                sizes.append(len(raw))
                files.append(write_avi(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_column]
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary").withColumnRenamed("doc_id", id_column)


def clips(files: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """``id_column, clip, first_frame, frames, start_s, end_s``: one row for each shot of each file.

    Null media and films without frames give no rows, and neither does an empty table. A null id stays null; repeated rows give repeated
    rows; other columns of any name are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _some(batches, 1):
            rows = [(key, *r) for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if data is not None for r in clip_rows(read_avi(data))]
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "clip", "first_frame", "frames", "start_s", "end_s"])

    kind = dict(files.dtypes)[id_column]
    plain = files.select(F.col(id_column).alias("doc_id"), F.col(media_column).alias("media"))
    return plain.mapInArrow(run, f"doc_id {kind}, clip int, first_frame long, frames long, start_s double, end_s double").withColumnRenamed("doc_id", id_column)


def features(files: DataFrame) -> DataFrame:
    """Digests of ``doc_id, n_bytes, media`` rows, all from the stored bytes.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``; the feature lists size, frame count and the
    timed clips (first and last frame, start and end in seconds). A null id stays null; repeated rows give repeated rows; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _some(batches, 2):
            rows = []
            for data in b.column(2).to_pylist():
                video = read_avi(data)
                payload = payload_of(video)
                cuts = ",".join(f"{s}-{s + n - 1}@{start:.2f}-{end:.2f}" for _, s, n, start, end in clip_rows(video))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{video.width}x{video.height}@{video.fps:g} frames={len(video.frames)} clips={cuts}"))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    kind = dict(files.dtypes)["doc_id"]
    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
