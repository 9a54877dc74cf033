"""A minimal PNG writer for test images."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np


def write_png(path: Path, pixels: np.ndarray) -> None:
    """Gray or RGB bytes of shape (height, width, channels)."""
    height, width, channels = pixels.shape
    color = {1: 0, 3: 2}[channels]
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    signature = b"\x89PNG\r\n\x1a\n"
    path.write_bytes(signature + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
