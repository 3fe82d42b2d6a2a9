"""Compressed runs of unsigned numbers: bytes of equal weight side by side, then zstd."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(x: np.ndarray) -> bytes:
    """uint32 or uint64 values, little-endian."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return bytes([x.dtype.itemsize]) + zstandard.ZstdCompressor(1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}")


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    x = unpack(data)
    return np.cumsum(x, dtype=x.dtype)
