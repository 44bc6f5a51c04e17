"""Gray and colour images as PNG: what depth, colour and mask images of sequences need, without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """height x width (x channels) of 8 or 16 bits. Palettes, interlacing and fewer bits raise ValueError."""
    if data[:8] != _MAGIC:
        raise ValueError("no PNG image")
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
    width, height, bits, colour, _, _, interlaced = head
    if bits not in (8, 16) or colour not in _CHANNELS or interlaced:
        raise ValueError("an image of this kind is not read")
    channels, step = _CHANNELS[colour], _CHANNELS[colour] * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 0:
            now = line
        elif kind == 1:  # differences to the left: sums modulo 256 of every step-th byte
            now = np.add.accumulate(line.reshape(width, step), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            now = line + above
        else:
            now = _unfiltered(line.tolist(), above.tolist(), step, int(kind))
        out[y] = above = now
    image = out.view(">u2" if bits == 16 else np.uint8).reshape(height, width, channels)
    return image[:, :, 0] if channels == 1 else image


def _unfiltered(line: list[int], above: list[int], step: int, kind: int) -> np.ndarray:
    """Averages (3) and the Paeth predictor (4), which need the bytes one by one."""
    now = [0] * len(line)
    for i, x in enumerate(line):
        a, b, c = (now[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if p <= q and p <= r else b if q <= r else c
        now[i] = (x + guess) & 255
    return np.array(now, np.uint8)


def encode(image: np.ndarray) -> bytes:
    """An image of height x width (gray) or height x width x 3 or 4, of 8 or 16 bits."""
    height, width = image.shape[:2]
    bits, colour = image.dtype.itemsize * 8, {2: 0, 3: {3: 2, 4: 6}.get(image.shape[-1])}[image.ndim]
    rows = np.ascontiguousarray(image.astype(">u2") if bits == 16 else image).view(np.uint8).reshape(height, -1)
    raw = zlib.compress(np.concatenate([np.zeros((height, 1), np.uint8), rows], 1).tobytes(), 6)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + chunk(b"IDAT", raw) + chunk(b"IEND", b"")
