"""Baseline JPEG for intra frames: a writer of uniform blocks that loses nothing, and a reader of baseline frames.

A sample is one 8 by 8 block of that grey level: with a DC quantiser of 8 its only coefficient is the sample less 128.
The Huffman table gives a difference of c bits a code of 9 - c bits, so every block takes 9 bits and one for its end, and
both ways are array operations. Other baseline frames (one scan, 8 bits) go through a general entropy decoder.
"""

from __future__ import annotations

import struct

import numpy as np

#: Width of a frame in blocks; a frame is as high as its samples need.
ACROSS = 16
#: Zigzag order of coefficients, from the standard's walk along diagonals.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def header(samples: int) -> bytes:
    down = -(-samples // ACROSS)
    # codes by length 1..9 for categories 8..0: one each; the code of ones only stays free
    dc = bytes([0x00, *[1] * 9, *[0] * 7, 8, 7, 6, 5, 4, 3, 2, 1, 0])
    ac = bytes([0x10, 1, *[0] * 15, 0])
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0]) + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * ACROSS, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, dc)
        + _segment(0xC4, ac)
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _codes() -> np.ndarray:
    """For each difference + 255: its ten bits."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        n = 9 - c
        code = (1 << n) - 2  # n - 1 ones, then a zero
        extra = d if d >= 0 else d + (1 << c) - 1
        out[d + 255] = ((code << c) | extra) << 1
    return out


CODES = _codes()
BITS = ((CODES[:, None] >> np.arange(9, -1, -1, dtype=np.uint16)) & 1).astype(np.uint8)
DIFFERENCE = np.full(1024, -999, np.int16)
DIFFERENCE[CODES] = np.arange(-255, 256)


def write_frames(frames: np.ndarray) -> list[bytes]:
    """frames: rows of bytes, a multiple of ACROSS each."""
    if not len(frames):
        return []
    head = header(frames.shape[1])
    level = frames.astype(np.int16) - 128
    step = np.diff(level, axis=1, prepend=np.zeros((len(frames), 1), np.int16))
    bits = BITS[step + 255].reshape(len(frames), -1)
    if extra := -bits.shape[1] % 8:
        bits = np.concatenate([bits, np.ones((len(frames), extra), np.uint8)], 1)
    scan = np.packbits(bits, axis=1)
    return [head + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in scan]


def read_own(frames: list[bytes], samples: int) -> np.ndarray | None:
    """The levels of frames that write_frames made, all of one size; None if one is not of that form."""
    head = header(samples)
    size = -(-samples * 10 // 8)
    rows = []
    for f in frames:
        if not f.startswith(head):
            return None
        scan = f[len(head) : -2].replace(b"\xff\x00", b"\xff")
        if len(scan) != size:
            return None
        rows.append(scan)
    bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), size), axis=1)[:, : samples * 10].reshape(len(rows), samples, 10)
    words = bits.astype(np.uint16) @ (1 << np.arange(9, -1, -1)).astype(np.uint16)
    step = DIFFERENCE[words]
    if (step == -999).any():
        return None
    return (np.cumsum(step, axis=1) + 128).astype(np.uint8)


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v

    def symbol(self, table: dict) -> int:
        code = 1
        while True:
            if self.at >= len(self.bits):
                raise ValueError("the scan ends within a code")
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if code in table:
                return table[code]


def _table(counts: bytes, symbols: bytes) -> dict[int, int]:
    """Codes with a one before their first bit, so that length counts."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        code <<= 1
        for _ in range(n):
            out[1 << length | code] = symbols[k]
            code, k = code + 1, k + 1
    return out


_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def read_luma(frame: bytes) -> np.ndarray:
    """The first component's samples of any baseline frame with one interleaved scan."""
    at, quant, huff, parts, restart = 2, {}, {}, [], 0
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        while frame[at + 1] == 0xFF:
            at += 1
        mark, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : n + 1], ">u2" if wide else np.uint8).astype(float)
                body = body[n + 1 :]
        elif mark in (0xC0, 0xC1):
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            for i in range(body[0]):
                for p in parts:
                    if p[0] == body[1 + 2 * i]:
                        p[4], p[5] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            break
        elif 0xC2 <= mark <= 0xCF:
            raise ValueError("only baseline frames are read")
    scan = frame[at : frame.rindex(b"\xff\xd9")]
    chunks, last, i = [], 0, 0
    while (i := scan.find(b"\xff", i)) >= 0:
        if i + 1 < len(scan) and 0xD0 <= scan[i + 1] <= 0xD7:
            chunks.append(scan[last:i])
            last = i + 2
        i += 2
    chunks.append(scan[last:])
    single = len(parts) == 1
    hmax, vmax = (1, 1) if single else (max(p[1] for p in parts), max(p[2] for p in parts))
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    h0, v0 = (1, 1) if single else (parts[0][1], parts[0][2])
    out = np.zeros((down * v0 * 8, across * h0 * 8))
    total, unit = across * down, 0
    for chunk in chunks:
        bits, before = _Bits(chunk.replace(b"\xff\x00", b"\xff")), [0] * len(parts)
        for _ in range(min(restart or total, total - unit)):
            for k, (_, ph, pv, q, td, ta) in enumerate(parts):
                for b in range(1 if single else ph * pv):
                    block = np.zeros(64)
                    c = bits.symbol(huff[td])
                    v = bits.take(c)
                    before[k] += v if not c or v >> (c - 1) else v - (1 << c) + 1
                    block[0] = before[k]
                    z = 1
                    while z < 64:
                        rs = bits.symbol(huff[0x10 | ta])
                        if rs == 0:
                            break
                        z += rs >> 4
                        if rs & 15:
                            c = rs & 15
                            v = bits.take(c)
                            block[z] = v if v >> (c - 1) else v - (1 << c) + 1
                        z += 1
                    if k == 0:
                        natural = np.zeros(64)
                        natural[ZIGZAG] = block * quant[q]
                        y, x = (unit // across) * v0 + b // h0, (unit % across) * h0 + b % h0
                        out[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = _COS @ natural.reshape(8, 8) @ _COS.T
            unit += 1
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)[: height * v0 // vmax if not single else height, : width * h0 // hmax if not single else width]
