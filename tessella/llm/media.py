"""AVI motion-JPEG: a RIFF writer and reader whose frames are lossless JPEG images, and shot detection.

Frames are 8-bit grey JPEG images of process 14 (SOF3, lossless, predictor 1), each coded by itself, so samples come
back exactly. The Huffman table gives category s a code of 9 - s bits; with the s bits that follow, every sample takes
nine bits, which lets numpy write and read all frames of a batch at once. The reader takes the table from each image;
it reads other tables a code at a time.

Shots are cut where the difference of two frames' histograms exceeds a threshold that adapts to the differences just
before it; each clip is a timed row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .util import slices, table, texts

SIDE = 24
SAMPLES = SIDE * SIDE
FPS = 25
BINS = 16
#: A cut's difference (share of samples that change bins) is this at least, and so many deviations over the mean of the WINDOW before it.
LEAST, DEVIATIONS, WINDOW = 0.12, 2.5, 8

_LENGTHS = tuple(9 - s for s in range(9))  # of the codes of categories 0 to 8


def _head() -> bytes:
    sof = struct.pack(">HBHHB3B", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    counts = bytes(sum(n == k for n in _LENGTHS) for k in range(1, 17))
    values = bytes(sorted(range(9), key=lambda s: _LENGTHS[s]))
    dht = struct.pack(">HB", 3 + 16 + len(values), 0) + counts + values
    sos = struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
    return b"\xff\xd8\xff\xc3" + sof + b"\xff\xc4" + dht + b"\xff\xda" + sos


HEAD, TAIL = _head(), b"\xff\xd9"


def _words() -> np.ndarray:
    """The nine bits of each difference from -255 to 255."""
    d = np.arange(-255, 256)
    s = np.array([int(abs(x)).bit_length() for x in d])
    return (512 - (2 << s) + np.where(d < 0, d + (1 << s) - 1, d)).astype(np.uint16)


_WORDS = _words()


def jpegs(frames: np.ndarray) -> list[bytes]:
    """A lossless JPEG of each frame (n, SIDE, SIDE) of bytes."""
    n = len(frames)
    if not n:
        return []
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    w = _WORDS[d + 255].reshape(n, SAMPLES // 8, 8)
    out = np.empty((n, SAMPLES // 8, 9), np.uint8)
    out[:, :, 0] = w[:, :, 0] >> 1
    for k in range(1, 8):  # byte k has the low k bits of word k - 1 and the high 8 - k of word k
        out[:, :, k] = (w[:, :, k - 1] << (8 - k)).astype(np.uint8) | (w[:, :, k] >> (k + 1)).astype(np.uint8)
    out[:, :, 8] = w[:, :, 7].astype(np.uint8)
    size = SAMPLES // 8 * 9
    raw = out.reshape(n, size)
    full = (raw == 255).sum(1)
    stuffed = np.insert(raw.reshape(-1), np.flatnonzero(raw.reshape(-1) == 255) + 1, 0).tobytes()  # a zero byte after each 255
    ends = np.cumsum(full + size).tolist()
    return [HEAD + stuffed[a:b] + TAIL for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _parse(image: bytes) -> tuple[int, int, int, list[tuple[int, int, int]]]:
    """Start of the coded data, height, width and the codes (value, length, category) of a lossless grey JPEG."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    at, height, width, codes = 2, 0, 0, []
    while True:
        mark, length = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        part = image[at + 4 : at + 2 + length]
        if mark == 0xC3:
            _, height, width, n = struct.unpack(">BHHB", part[:6])
            if part[0] != 8 or n != 1:
                raise ValueError("only images of one 8-bit component are read")
        elif mark == 0xC4:
            code, values = 0, iter(part[17:])
            for bits in range(1, 17):
                for _ in range(part[bits]):
                    codes.append((code, bits, next(values)))
                    code += 1
                code <<= 1
        elif mark == 0xDA:
            if part[3] != 1:
                raise ValueError("only predictor 1 is read")
            return at + 2 + length, height, width, codes
        at += 2 + length


def _value(category: int, bits: int) -> int:
    return bits if not category or bits >> (category - 1) else bits - (1 << category) + 1


def _slow(data: bytes, n: int, codes: list[tuple[int, int, int]]) -> np.ndarray:
    """Differences read a code at a time."""
    table = {(length, code): s for code, length, s in codes}
    bits, have, at, out = 0, 0, 0, []

    def take(k: int) -> int:
        nonlocal bits, have, at
        while have < k:
            bits, have, at = (bits << 8) | data[at], have + 8, at + 1
        have -= k
        x, bits = bits >> have, bits & ((1 << have) - 1)
        return x

    for _ in range(n):
        code = length = 0
        while (length, code) not in table or not length:
            code, length = (code << 1) | take(1), length + 1
            if length > 16:
                raise ValueError("no such code")
        s = table[length, code]
        out.append(_value(s, take(s)))
    return np.array(out, np.int16)


def frames_of(images: list[bytes]) -> np.ndarray:
    """The frames (n, SIDE, SIDE) of JPEG images."""
    out = np.empty((len(images), SIDE, SIDE), np.int16)
    head, start, codes, fixed = b"", 0, [], None
    fast: list[bytes] = []
    where: list[int] = []
    size = SAMPLES // 8 * 9
    for i, image in enumerate(images):
        if not head or not image.startswith(head):
            start, height, width, codes = _parse(image)
            if (height, width) != (SIDE, SIDE):
                raise ValueError(f"frames are {SIDE} by {SIDE}")
            head, fixed = image[:start], None
            if all(length + s == 9 for _, length, s in codes):
                fixed = np.zeros(512, np.int16)
                for code, _, s in codes:
                    for bits in range(1 << s):
                        fixed[(code << s) | bits] = _value(s, bits)
                last = fixed
        data = image[start:-2].replace(b"\xff\x00", b"\xff")
        if fixed is not None and len(data) == size:
            fast.append(data)
            where.append(i)
        else:
            out[i] = _slow(data, SAMPLES, codes).reshape(SIDE, SIDE)
    if fast:
        b = np.frombuffer(b"".join(fast), np.uint8).reshape(len(fast), SAMPLES // 8, 9).astype(np.uint16)
        w = np.empty((len(fast), SAMPLES // 8, 8), np.uint16)
        for k in range(8):
            w[:, :, k] = ((b[:, :, k] << (k + 1)) | (b[:, :, k + 1] >> (7 - k))) & 511
        d = last[w].reshape(len(fast), SIDE, SIDE)
        if len(fast) == len(images):
            out = d
        else:
            out[where] = d
    out[:, 0, 0] += 128
    np.cumsum(out[:, :, 0], axis=1, out=out[:, :, 0])
    np.cumsum(out, axis=2, out=out)
    return out.astype(np.uint8)


def avi(images: list[bytes]) -> bytes:
    """A RIFF AVI file of one motion-JPEG stream, with an index."""
    n, most = len(images), max(map(len, images), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<I2H8I4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    strl = b"strlstrh" + struct.pack("<I", len(strh)) + strh + b"strf" + struct.pack("<I", len(strf)) + strf
    hdrl = b"hdrlavih" + struct.pack("<I", len(avih)) + avih + b"LIST" + struct.pack("<I", len(strl)) + strl
    movi, index, at = [b"movi"], [], 4
    for x in images:
        movi += (b"00dc", len(x).to_bytes(4, "little"), x)
        if len(x) & 1:
            movi.append(b"\0")
        index += (0x63643030, 0x10, at, len(x))
        at += 8 + len(x) + (len(x) & 1)
    idx = struct.pack(f"<{len(index)}I", *index)
    body = b"".join([b"AVI LIST", struct.pack("<I", len(hdrl)), hdrl, b"LIST", struct.pack("<I", at), *movi, b"idx1", struct.pack("<I", len(idx)), idx])
    return b"RIFF" + struct.pack("<I", len(body)) + body


def images_of(file: bytes) -> list[bytes]:
    """The stored images of an AVI file, found by its index."""
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, end, movi, index = 12, 8 + int.from_bytes(file[4:8], "little"), None, None
    while at + 8 <= end:
        kind, size = file[at : at + 4], int.from_bytes(file[at + 4 : at + 8], "little")
        if kind == b"LIST" and file[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif kind == b"idx1":
            index = np.frombuffer(file, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    starts = (index[:, 2].astype(np.int64) + movi + 8).tolist()
    return [file[a : a + n] for a, n in zip(starts, index[:, 3].tolist(), strict=True)]


def histograms(frames: np.ndarray) -> np.ndarray:
    """Counts of BINS grey levels of each frame."""
    n = len(frames)
    level = (frames.reshape(n, -1) // (256 // BINS)).astype(np.int32)
    level += np.arange(n, dtype=np.int32)[:, None] * BINS
    return np.bincount(level.reshape(-1), minlength=n * BINS).reshape(n, BINS)


def cuts(histogram: np.ndarray) -> list[int]:
    """The first frame of each shot."""
    n = len(histogram)
    if n < 2:
        return [0] if n else []
    d = np.abs(np.diff(histogram, axis=0)).sum(1) / (2 * SAMPLES)
    one, two = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    i = np.arange(n - 1)
    lo = np.maximum(i - WINDOW, 0)
    k = np.maximum(i - lo, 1)
    mean = (one[i] - one[lo]) / k
    deviation = np.sqrt(np.maximum((two[i] - two[lo]) / k - mean * mean, 0))
    return [0, *(np.flatnonzero((d > LEAST) & (d > mean + DEVIATIONS * deviation + 1e-9)) + 1).tolist()]


def encode(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) to doc_id, n_bytes and media: a text's bytes, filled with 255 to whole frames, as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, data in slices(batches, "text"):
            size = np.diff(offsets)
            frames = np.maximum(-(-size // SAMPLES), 1)
            first = np.concatenate([[0], np.cumsum(frames)])
            payload = np.full(int(first[-1]) * SAMPLES, 255, np.uint8)
            shift = np.repeat(first[:-1] * SAMPLES - offsets[:-1], size)
            payload[np.arange(len(data)) + shift] = data
            images = jpegs(payload.reshape(-1, SIDE, SIDE))
            media = [avi(images[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(size), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray, np.ndarray]]:
    for part, offsets, data in slices(batches, "media", 2 << 20):
        whole = data.tobytes()
        files = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        images = [images_of(x) for x in files]
        first = np.concatenate([[0], np.cumsum([len(x) for x in images])]).astype(np.int64)
        yield part, files, first, frames_of([x for own in images for x in own])


def describe(media: DataFrame) -> DataFrame:
    """Reads AVI files back: digests of the payload and the file, and a feature: the shots as times in ms and mean grey levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, files, first, frames in _read(batches):
            histogram, grey = histograms(frames), frames.reshape(len(frames), -1).sum(1, dtype=np.int64)
            out: list[tuple] = []
            for i, file in enumerate(files):
                a, b = int(first[i]), int(first[i + 1])
                payload = frames[a:b].tobytes()
                start = cuts(histogram[a:b])
                shots = ";".join(f"{s * 1000 // FPS}-{e * 1000 // FPS}:{int(grey[a + s : a + e].sum()) // ((e - s) * SAMPLES)}" for s, e in zip(start, [*start[1:], b - a], strict=True))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), f"frames={b - a};shots={len(start)};{shots}"))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in ("doc_id", "n_bytes")), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clips(media: DataFrame) -> DataFrame:
    """A row a shot: doc_id, clip, start_ms, end_ms, n_frames, mean_grey and samples (the clip's decoded frames)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, files, first, frames in _read(batches):
            histogram, rows = histograms(frames), []
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            for i in range(len(files)):
                a, b = int(first[i]), int(first[i + 1])
                start = cuts(histogram[a:b])
                for k, (s, e) in enumerate(zip(start, [*start[1:], b - a], strict=True)):
                    x = frames[a + s : a + e]
                    rows.append((ids[i], k, s * 1000 // FPS, e * 1000 // FPS, e - s, float(x.mean()), x.tobytes()))
            names = ["doc_id", "clip", "start_ms", "end_ms", "n_frames", "mean_grey", "samples"]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip long, start_ms long, end_ms long, n_frames long, mean_grey double, samples binary")


def op9_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents (null: empty), stored as AVI and read back."""
    return describe(encode(texts(table(spark, sf_dir, "documents"))))
