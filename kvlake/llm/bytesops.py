"""Array helpers for whole texts held in Arrow batches.

A *chunk* is a run of whole rows laid out back to back as UTF-8 bytes:
``data`` (uint8) and ``offs`` (int64, one more than rows).  All helpers work on
chunks with numpy, without a Python loop per word or line.  Nulls are empty
texts.  A text longer than the chunk size is a chunk of its own.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_U = np.uint64
_ROOT = 0x9E3779B97F4A7C15 | 1
_ROOT_INV = pow(_ROOT, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def tidied(batches):
    """A function over batches that, at its end, gives what it freed back to the
    system: idle Python workers stay beside the tasks that follow."""

    @functools.wraps(batches)
    def run(*args, **how):
        try:
            yield from batches(*args, **how)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(_LIBC, "malloc_trim"):
                _LIBC.malloc_trim(0)

    return run


_LIBC = ctypes.CDLL(None)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary Arrow array; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES):
    """Yield (first row, end row, data, offs) over whole rows of about ``size`` bytes."""
    data, offs = text_buffers(column)
    n, at = len(offs) - 1, 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + size, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def segments(column: pa.Array, overlap: int, size: int = CHUNK_BYTES):
    """Yield (rows, where each begins in its text, data, offs): chunks, but a row
    longer than two chunks comes in segments that overlap by so many bytes."""
    for lo, hi, data, offs in chunks(column, size):
        if len(data) <= 2 * size:
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), data, offs
            continue
        for at in range(0, len(data) - overlap, size):
            end = min(at + size + overlap, len(data))
            yield np.array([lo]), np.array([at]), data[at:end], np.array([0, end - at])


def pieces(batch: pa.RecordBatch, column: int, size: int = 8 * CHUNK_BYTES):
    """Cut a batch into runs of whole rows of about ``size`` bytes of text."""
    _, offs = text_buffers(batch.column(column))
    n, at = batch.num_rows, 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + size, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(root: int, n: int) -> np.ndarray:
    have = _POWERS.get(root)
    if have is None or len(have) < n:
        size = (max(n, CHUNK_BYTES + 2) // 4096 + 1) * 4096
        if size > 16 * CHUNK_BYTES:  # a very long text: don't keep its table
            size = n
        have = np.full(size, root & (2**64 - 1), _U)
        have[0] = 1
        np.cumprod(have, dtype=_U, out=have)
        if size > 16 * CHUNK_BYTES:
            return have
        _POWERS[root] = have
    return have[:n]


def byte_values(lower: bool = False) -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each byte; A-Z as a-z if ``lower``."""
    v = mix(np.arange(1, 257, dtype=_U) * _U(_ROOT))
    if lower:
        v[65:91] = v[97:123]
    return v


VALUES, VALUES_LOWER = byte_values(), byte_values(lower=True)


def prefix_hash(data: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Prefix polynomial hashes: out[i] covers data[:i] (mod 2**64)."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * _powers(_ROOT, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of data[start:end], equal for equal bytes at any place."""
    inv = _powers(_ROOT_INV, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(_U))


_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


def white(data: np.ndarray) -> np.ndarray:
    return _WS[data]


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal true runs; a run never crosses a row."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n, bool)
    first[offs[:-1][offs[:-1] < n]] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | first[1:]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | first[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of words between [\\x20\\x09-\\x0D], and words per row."""
    start, end = runs(~white(data), offs)
    return start, end, np.diff(np.searchsorted(start, offs))


def lines(data: np.ndarray, offs: np.ndarray):
    """Starts, ends of \\n-split lines, and lines per row (at least one)."""
    nl = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offs[:-1], nl + 1]), kind="stable")
    end = np.sort(np.concatenate([nl, offs[1:]]), kind="stable")
    return start, end, np.diff(np.searchsorted(nl, offs)) + 1
