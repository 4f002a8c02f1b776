"""Numbers and strings as few bytes, for what moves in large pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def squeezed(raw) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def packed(numbers: np.ndarray) -> bytes:
    """How many, and 32-bit numbers, their bytes of one worth together."""
    return len(numbers).to_bytes(4, "little") + squeezed(np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw[4:], 4 * n, codec="zstd", asbytes=True), "u1").reshape(4, n).T).view("<u4").ravel()


def edges_of(strings: pa.Array) -> np.ndarray:
    """Where each string begins in the array's bytes, and where the last ends."""
    return np.frombuffer(strings.buffers()[1], "i4")[strings.offset : strings.offset + len(strings) + 1].astype("i8")


def bytes_of(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[2] or b"", "u1")


def packed_strings(strings: pa.Array) -> tuple[bytes, bytes]:
    """Lengths and bytes of strings without nulls."""
    edges = edges_of(strings)
    return packed(np.diff(edges)), squeezed(bytes_of(strings)[edges[0] : edges[-1]].tobytes())


def unpacked_strings(sizes: bytes, raw: bytes) -> pa.Array:
    edges = np.append(0, np.cumsum(unpacked(sizes), dtype="i8"))
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype("i4")), pa.decompress(raw, int(edges[-1]), codec="zstd"))
