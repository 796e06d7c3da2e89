"""Compressed arrays that chunks and buckets send each other."""

from __future__ import annotations

import numpy as np
import zstandard


def _planes(x: np.ndarray, kind: str, width: int) -> bytes:
    raw = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize)[:, :width]
    return zstandard.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def _unplaned(raw: bytes, kind: str, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = planes.T
    return out.view(kind).reshape(-1).astype(np.int64)


def pack_ints(x: np.ndarray) -> bytes:
    """Whole numbers of 32 bits as compressed byte planes."""
    return _planes(x, "<u4", 4)


def unpack_ints(raw: bytes) -> np.ndarray:
    return _unplaned(raw, "<u4", 4)


def pack_longs(x: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, not negative, as the byte planes that aren't all zero."""
    x = np.asarray(x, np.int64)
    if len(x) and int(x.min()) < 0:
        raise ValueError("negative number")
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + _planes(x, "<u8", width)


def unpack_longs(raw: bytes) -> np.ndarray:
    return _unplaned(raw[1:], "<u8", raw[0])


def pack_sorted(x: np.ndarray) -> bytes:
    """The 40 low bits of keys that rise by them."""
    low = x.astype(np.int64) & ((1 << 40) - 1)
    return _planes(np.diff(low, prepend=0), "<u8", 5)


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(raw, "<u8", 5))


def pack_array(x: np.ndarray) -> bytes:
    """Any array by its bytes, planes first for wide elements."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T if x.itemsize > 1 and len(x) else x
    return zstandard.compress(np.ascontiguousarray(raw).tobytes(), 1)


def unpack_array(raw: bytes, kind: type) -> np.ndarray:
    data, width = np.frombuffer(zstandard.decompress(raw), np.uint8), np.dtype(kind).itemsize
    return data.view(kind) if width == 1 else np.ascontiguousarray(data.reshape(width, -1).T).view(kind).reshape(-1)


def pack_bytes(x: bytes) -> bytes:
    return zstandard.compress(x, 3)


def unpack_bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), np.uint8)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the 24 high bits of 64-bit keys: they rise with the keys, so that the 40 low bits identify a key in its bucket."""
    return ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
