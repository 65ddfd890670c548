"""Vectorised hashing of words and shingles: numpy over the bytes of a whole Arrow batch, no work per row."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Python workers live long beside a JVM: what a batch took goes back to the system.
pa.set_memory_pool(pa.system_memory_pool())

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def release() -> None:
    """Free memory goes back to the system."""
    if _TRIM is not None:
        _TRIM(0)


def returning(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A generator function that gives its free memory back when it has ended; the worker lives on."""

    @functools.wraps(f)
    def run(*args):
        try:
            yield from f(*args)
        finally:
            release()

    return run


U = np.uint64
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 8192
_RNG = np.random.default_rng(20240229)
_BASE = U(int(_RNG.integers(1 << 62, 1 << 63)) | 5)
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_STEP = _RNG.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | U(1)

#: ASCII white space, as bytes
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse; at most four million are kept."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = max(n + 1, 1 << 18)
        found = []
        for b in (_BASE, _BASE_INVERSE):
            p = np.full(size, b, U)
            p[0] = 1
            found.append(np.multiply.accumulate(p))
        if size > 1 << 22:
            return found[0], found[1]
        _POWERS["up"], _POWERS["down"] = found
    return _POWERS["up"], _POWERS["down"]


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the n + 1 offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if len(texts) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def offsets(texts: pa.Array) -> np.ndarray:
    """The n + 1 offsets in bytes of the texts of a column, without touching the texts."""
    return np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)))


def pieces(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a column with their bytes and offsets; only one range's bytes are copied at a time."""
    for lo, hi in chunks(offsets(texts), size):
        yield lo, hi, *utf8(texts.slice(lo, hi - lo))


def chunks(at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes and at most CHUNK_ROWS each; a longer text is a range of its own."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        hi = min(hi, n, lo + CHUNK_ROWS)
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased, split at the bytes marked in breaks) of consecutive texts, and the n + 1 offsets of the texts' words."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    blank = breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    prior = np.empty(n, bool)
    prior[0] = True
    prior[1:] = blank[:-1]
    starts = np.flatnonzero(~blank & (prior | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = blank[1:]
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    up, down = powers(n)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, at).astype(np.int64)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive values."""
    if len(values) < k:
        return np.zeros(0, U)
    h = values[: len(values) - k + 1] * _STEP[0]
    for i in range(1, k):
        h = h + values[i : len(values) - k + 1 + i] * _STEP[i]
    return mixed(h)


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text, and their offsets. A text of 1 to k - 1 words has one: the whole sequence."""
    count = np.diff(at)
    windows = rolling(words, k)
    parts = []
    for lo, n in zip(at[:-1].tolist(), count.tolist()):
        if n >= k:
            s = np.sort(windows[lo : lo + n - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            parts.append(s[keep])
        elif n:
            parts.append(mixed((words[lo : lo + n] * _STEP[:n]).sum(keepdims=True, dtype=U) + U(n)))
        else:
            parts.append(words[:0])
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else words[:0]), np.concatenate([[0], np.cumsum(sizes)])


def binary(rows: np.ndarray) -> pa.Array:
    """Each row of a 2-d array as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int64) * width
    if len(rows) * width < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(rows.tobytes())])
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Consecutive runs of values as lists of longs."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
