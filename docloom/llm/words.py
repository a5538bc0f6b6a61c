"""Words of whole texts as 64-bit hashes, by array operations on Arrow buffers; packed integer columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are worked on in pieces of about so many bytes (a longer text is a piece of its own).
PIECE = 1 << 20
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Gives memory that is free but kept back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in order."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    up, down = _power(len(low))
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return np.searchsorted(offsets, starts, "right") - 1, mix((sums[ends] - sums[starts]) * down[starts])


def join_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of a run of words from theirs; runs of different lengths differ."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        out = mix(out * np.uint64(_BASE) + c)
    return out


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); with fewer words the whole sequence is one, without words there is none."""
    for first, data, offsets in pieces(texts):
        rows, hashes = word_hashes(data, offsets)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        full = join_hash([hashes[i : len(hashes) - size + 1 + i] for i in range(size)]) if len(hashes) >= size else hashes[:0]
        for r in range(len(offsets) - 1):
            a, b = bounds[r], bounds[r + 1]
            if b - a >= size:
                yield first + r, np.unique(full[a : b - size + 1])
            elif b > a:
                yield first + r, join_hash([hashes[i : i + 1] for i in range(a, b)])
            else:
                yield first + r, hashes[:0]


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes without the empty ones, compressed."""
    values = np.ascontiguousarray(values, np.uint64)
    planes = values.view(np.uint8).reshape(-1, 8).T
    used = 8
    while used and not planes[used - 1].any():
        used -= 1
    raw = planes[:used].tobytes()
    return len(values).to_bytes(6, "little") + bytes([used]) + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(data: bytes) -> np.ndarray:
    n, used = int.from_bytes(data[:6], "little"), data[6]
    out = np.zeros((n, 8), np.uint8)
    if n and used:
        raw = pa.decompress(data[7:], n * used, "zstd", asbytes=True)
        out[:, :used] = np.frombuffer(raw, np.uint8).reshape(used, n).T
    return out.reshape(-1).view(np.uint64)


def deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


def buckets(keys: np.ndarray, n: int, bits: int = 48) -> np.ndarray:
    """Which of n equal ranges (under 2**32) of a key space of so many bits each key lies in."""
    return (((keys >> np.uint64(bits - 32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
