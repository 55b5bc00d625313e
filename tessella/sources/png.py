"""PNG bytes to arrays and back: 8-bit grey, RGB and RGBA, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Bands by colour type.
BANDS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(data: np.ndarray) -> bytes:
    """Height x width (x bands) of 8-bit values."""
    data = data[:, :, None] if data.ndim == 2 else data
    height, width, bands = data.shape
    colour = {b: c for c, b in BANDS.items()}[bands]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), data.reshape(height, -1).astype(np.uint8)], axis=1)
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def as_mask(data: np.ndarray) -> np.ndarray:
    """0/255 of booleans, 0/1 or 0/255."""
    data = data.astype(np.uint8)
    return data * 255 if data.size and data.max() <= 1 else data


def decode(raw: bytes) -> np.ndarray:
    if raw[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", raw[at + 8 : at + 8 + size])
        elif kind == b"IDAT":
            body.append(raw[at + 8 : at + 8 + size])
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in BANDS or interlaced:
        raise ValueError("only plain 8-bit images are read")
    bands = BANDS[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * bands)
    out = np.zeros((height, width * bands), np.int64)
    for r in range(height):
        kind, line = rows[r, 0], rows[r, 1:].astype(np.int64)
        up = out[r - 1] if r else np.zeros(width * bands, np.int64)
        if kind == 0:
            out[r] = line
        elif kind == 2:
            out[r] = (line + up) & 255
        elif kind == 1:
            out[r] = np.cumsum(line.reshape(width, bands), axis=0).ravel() & 255
        else:
            for k in range(width * bands):
                left = out[r, k - bands] if k >= bands else 0
                corner = up[k - bands] if k >= bands else 0
                if kind == 3:
                    near = (left + up[k]) // 2
                else:
                    guess = left + up[k] - corner
                    near = min((abs(guess - left), 0, left), (abs(guess - up[k]), 1, up[k]), (abs(guess - corner), 2, corner))[2]
                out[r, k] = (line[k] + near) & 255
    return out.reshape(height, width, bands).astype(np.uint8)
