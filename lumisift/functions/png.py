"""PNG bytes without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from lumisift.shipping import ship

ship(__name__)


def png(pixels: np.ndarray, level: int = 1) -> bytes:
    """Bytes of an HxW grey or HxWx3 red-green-blue uint8 raster."""
    h, w = pixels.shape[:2]
    color = 2 if pixels.ndim == 3 else 0
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")
