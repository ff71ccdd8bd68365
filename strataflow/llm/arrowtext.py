"""Vectorised text features over Arrow string buffers, shared by the operators.

All functions work on whole texts; `slices` only bounds how many documents are handled at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def slices(column: pa.Array, limit: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `limit` bytes; a longer document is a range of its own."""
    column = column.cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b
        a = b


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one document after another, and n + 1 offsets; null counts as empty."""
    column = pa.array(column.fill_null("")).cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def release() -> None:
    """Gives memory that a task no longer needs back to the system, as its worker process lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    kind = np.ones(256, np.uint8)  # 0 space, 1 word, 2 punctuation
    kind[:128] = [0 if c <= 32 or c == 127 else 1 if chr(c).isalnum() else 2 for c in range(128)]
    mult = np.random.default_rng(20240229).integers(0, 2**63, 1024, dtype=np.uint64) * U64(2) + U64(1)
    return low, kind, mult


def lowered(column: pa.Array, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The bytes in lower case, where that keeps every document's length; else the same bytes."""
    low, at = utf8(pc.utf8_lower(pa.array(column.fill_null("")).cast(pa.large_string())))
    return low if np.array_equal(at, offs) else data


def tokens(data: np.ndarray, offs: np.ndarray, hashed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word bytes and runs of punctuation, A-Z lower-cased in the hash (of other bytes, if given).

    Returns for each token its start, length, 64-bit hash, kind (1 word, 2 punctuation), and n + 1 offsets of
    the documents' tokens. Bytes of non-ASCII characters count as word bytes.
    """
    low, kind, mult = _tables()
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64), np.zeros(0, np.uint8), np.zeros(len(offs), np.int64)
    k = kind[data]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(k[1:], k[:-1], out=first[1:])
    first[offs[:-1][offs[:-1] < n]] = True
    bounds = np.flatnonzero(first)
    ends = np.append(bounds[1:], n)
    at = np.arange(n, dtype=np.int64) - np.repeat(bounds, ends - bounds)
    v = (low[data if hashed is None else hashed].astype(U64) + U64(1)) * mult[at & 1023]
    v ^= (at >> 10).astype(U64)
    h = mix(np.add.reduceat(v, bounds))
    keep = k[bounds] > 0
    starts, lens, h, kinds = bounds[keep], (ends - bounds)[keep], h[keep], k[bounds][keep]
    return starts, lens, h, kinds, np.searchsorted(starts, offs)


def per_document(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values between offsets, 0 for empty documents."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[offs[1:]] - total[offs[:-1]]


def windows(h: np.ndarray, w: int) -> np.ndarray:
    """Hash of each run of w token hashes, in order."""
    if len(h) < w:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - w + 1, U64)
    for i in range(w):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[i : len(h) - w + 1 + i])
    return out
