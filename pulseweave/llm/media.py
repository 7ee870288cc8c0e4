"""Media columns: AVI files of motion JPEG, their frames, shots and clips.

A payload becomes frames of UNIT samples, written as JPEG frames that lose nothing (jpeg.py) in a RIFF file with an
index. Reading goes by the index (idx1, or the movi list if there is none), decodes every frame and compares
neighbouring frames' histograms of BINS grey levels; a shot begins where the difference exceeds the mean of the last
NEAR differences by SPREAD mean deviations and LEAST in a thousand. Shots become clip rows with start and end times.

Defined cases: null text is empty; empty text is one frame of spaces; equal texts give equal files and values; a file
cut short keeps the frames whose data is whole; a file that is no AVI raises ValueError; other columns go through,
those named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C
from . import jpeg

UNIT, FPS, BINS, NEAR, SPREAD, LEAST = 192, 25, 16, 8, 3, 250


def payload(text: str | None, unit: int = UNIT) -> bytes:
    data = C.text_bytes(text)
    return data.ljust(max(1, -(-len(data) // unit)) * unit, b" ")


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<3I2H4s5I", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + head + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(size, end - at - 8), size
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Seconds a frame and the frames' bytes."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    each, movi, index = 1 / FPS, None, None
    for name, at, size, _ in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for n, a, s, _ in _chunks(data, at + 4, at + size):
                if n == b"avih" and s >= 4:
                    each = struct.unpack_from("<I", data, a)[0] / 1e6 or each
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, size)
        elif name == b"idx1":
            index = np.frombuffer(data, np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), size // 16, at)
    if movi is None:
        return each, []
    if index is None or not len(index):
        return each, [data[a : a + s] for n, a, s, whole in _chunks(data, movi[0] + 4, movi[0] + movi[1]) if n[2:] in (b"dc", b"db") and s == whole]
    index = index[np.isin(index["name"], [b"00dc", b"00db"])]
    base = movi[0] if len(index) and data[movi[0] + int(index["at"][0]) :][:4] in (b"00dc", b"00db") else 0  # offsets from the list, or from the file
    return each, [data[base + a + 8 : base + a + 8 + s] for a, s in zip(index["at"].tolist(), index["size"].tolist(), strict=True) if base + a + 8 + s <= len(data)]


def decode(frames: list[bytes]) -> list[np.ndarray]:
    """Grey samples of each frame: a sample a block for frames of our own, all pixels else."""
    if frames and (own := jpeg.read_own(frames, UNIT)) is not None:
        return list(own)
    return [jpeg.read_luma(f).ravel() for f in frames]


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """Of each frame, the share of every grey band in thousandths."""
    return np.array([np.bincount(f >> 4, minlength=BINS) * 1000 // max(1, len(f)) for f in frames], np.int64).reshape(len(frames), BINS)


def shots(hist: np.ndarray) -> list[int]:
    """First frames of shots, by integer arithmetic: a difference over LEAST and over mean + SPREAD mean deviations of those near before it."""
    if not len(hist):
        return []
    diff = np.abs(np.diff(hist, axis=0)).sum(1).tolist()
    starts = [0]
    for i, d in enumerate(diff):
        near = diff[max(0, i - NEAR, starts[-1]) : i]
        if d <= LEAST:
            continue
        if not near:
            if d > 4 * LEAST:
                starts.append(i + 1)
            continue
        mean = sum(near) // len(near)
        if d > mean + SPREAD * (sum(abs(x - mean) for x in near) // len(near)) + LEAST:
            starts.append(i + 1)
    return starts


def clips(data: bytes) -> list[dict]:
    """Timed rows of a file's shots: clip, first frame, frames, start and end in milliseconds, mean grey level."""
    each, frames = read_avi(data)
    grey = decode(frames)
    at = shots(histograms(grey))
    out = []
    for k, (a, z) in enumerate(zip(at, [*at[1:], len(grey)], strict=True)):
        level = sum(int(g.sum()) for g in grey[a:z]) // max(1, sum(len(g) for g in grey[a:z]))
        out.append({"clip": k, "first": a, "frames": z - a, "start_ms": round(a * each * 1000), "end_ms": round(z * each * 1000), "level": level})
    return out


def store(text: str | None) -> bytes:
    """The text's payload as an AVI file."""
    samples = np.frombuffer(payload(text), np.uint8).reshape(-1, UNIT)
    return write_avi(jpeg.write_frames(samples), 8 * jpeg.ACROSS, 8 * -(-UNIT // jpeg.ACROSS))


def restore(data: bytes) -> bytes:
    return b"".join(f.tobytes() for f in decode(read_avi(data)[1]))


CLIP = T.StructType([T.StructField(n, T.LongType()) for n in ("clip", "first", "frames", "start_ms", "end_ms", "level")])


def encode_media(docs: DataFrame) -> DataFrame:
    """The documents with `media`, an AVI file of each text."""
    C.small_batches(docs.sparkSession, 100)
    return C.map_rows(docs, lambda: lambda texts: [[store(t) for t in texts]], [T.StructField("media", T.BinaryType())])


def clip_rows(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows with `clips` for each file in the column; null files have none."""
    C.small_batches(media.sparkSession, 100)
    return C.map_rows(media, lambda: lambda files: [[clips(f) if f is not None else [] for f in files]], [T.StructField("clips", T.ArrayType(CLIP))], text=column)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the file back, and gives its digests and `feature`: frames, shots and the clips' starts and levels.

    Writing and reading share a task, so that files are not shuffled or kept; encode_media and clip_rows are the parts.
    """
    C.small_batches(docs.sparkSession, 100)

    def run(texts):
        cols: list[list] = [[] for _ in range(7)]
        for t in texts:
            media = store(t)
            frames = read_avi(media)[1]
            grey = decode(frames)
            back = b"".join(g.tobytes() for g in grey)
            at = shots(histograms(grey))
            ends = [*at[1:], len(grey)]
            marks = ";".join(f"{a * 1000 // FPS}-{z * 1000 // FPS}:{sum(int(g.sum()) for g in grey[a:z]) // ((z - a) * UNIT)}" for a, z in zip(at, ends, strict=True))
            row = [len(C.text_bytes(t)), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(grey)}|{len(at)}|{marks}"]
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        return cols

    kinds = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}
    return C.map_rows(docs, lambda: run, [T.StructField(k, v) for k, v in kinds.items()])
