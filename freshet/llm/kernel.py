"""Array helpers that run inside tasks: UTF-8 columns as flat buffers, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that a task turns into arrays at once. A longer text is handled alone.
BLOCK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them; kept for the next block."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size > 4 * BLOCK_BYTES:
            return have
        _powers[name] = have
    return have


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    raw = column.fill_null("").cast(pa.large_string())
    at = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about ``limit`` bytes."""
    data, at = text_buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs free of white space (x20, x09-x0D), and each text's first word number."""
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[1:] = solid[:-1]
    inner = at[(at < len(data))]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[:-1] = solid[1:]
    if len(after):
        after[-1] = False
    ends_at = at[at > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes in every block."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data), "up")[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * _power(_INVERSE, len(data) + 1, "down")[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text, the ascending distinct hashes of its runs of ``size`` lower-cased words.

    A text of fewer words has one hash, of its whole sequence; one without
    words has none.
    """
    data = _LOWER[data]
    starts, ends, first = words(data, at)
    h = span_hashes(data, starts, ends)
    n = len(h)
    run = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        run += mix(h[k : k + len(run)] + np.uint64((k + 1) * _ODD % (1 << 64)))
    run = mix(run)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= size:
            own = np.sort(run[lo : hi - size + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif hi > lo:
            part = np.arange(1, hi - lo + 1, dtype=np.uint64) * np.uint64(_ODD)
            yield mix(mix(h[lo:hi] + part).sum(keepdims=True) + np.uint64(hi - lo))
        else:
            yield h[:0]


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one array a row."""
    at = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, type=kind))
