"""Arrow and numpy helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Freed Arrow buffers go back to the system at once: workers live on between stages.
pa.set_memory_pool(pa.system_memory_pool())

#: Words are `[^\x20\x09-\x0D]+`; these bytes part them.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def release() -> None:
    """Gives freed memory of a worker back to the system, at the end of a task that held much."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def freeing(fn):
    """A function of batches, of a group, or of its key and a group, that leaves no freed memory in the worker."""
    import inspect

    if inspect.isgeneratorfunction(fn):

        def batches(b):
            yield from fn(b)
            release()

        return batches
    if len(inspect.signature(fn).parameters) == 2:

        def keyed(key, t):
            out = fn(key, t)
            release()
            return out

        return keyed

    def group(t):
        out = fn(t)
        release()
        return out

    return group


def as_table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches).combine_chunks()


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.Table]:
    """The rows in order, in tables of about `limit` bytes of text; a longer text makes a table of its own."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(n), 0
        while at < b.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit - size, side="right")))
            if size and ends[to - 1] - base + size > limit:
                yield as_table(held)
                held, size = [], 0
                continue
            held.append(b.slice(at, to - at))
            size += int(ends[to - 1]) - base
            at = to
            if size >= limit:
                yield as_table(held)
                held, size = [], 0
    if held:
        yield as_table(held)


def column_bytes(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and the n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which each input bit moves all output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_P = pow(0x9E3779B97F4A7C15, 1, 1 << 64)
_P_INV = pow(_P, -1, 1 << 64)


@lru_cache(1)
def _byte_values() -> np.ndarray:
    """A random 64-bit value for each byte; A-Z get those of a-z."""
    v = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    v[65:91] = v[97:123]
    return v


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(p)
        if n <= 4 << 20:  # longer texts have theirs made anew
            _powers[base] = have
    return have[:n]


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows (A-Z as a-z), and the n + 1 offsets of each row's words."""
    n = len(buf)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[:-1]
    edge = edge[edge < n]
    first[edge] |= word[edge]
    edge = offsets[1:] - 1
    edge = edge[edge >= 0]
    last[edge] |= word[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    with np.errstate(over="ignore"):
        total = np.cumsum(_byte_values()[buf] * _power(_P_INV, n))
        h = total[end]
        h[start > 0] -= total[start[start > 0] - 1]
        h = h * _power(_P, n)[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(h), np.searchsorted(start, offsets)


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs, bit by bit."""
    return x.astype(np.uint64, copy=False).view(np.int64)


def packed(x: np.ndarray, width: int = 8) -> bytes:
    """Sorted unsigned integers as differences, byte planes apart, deflated: about the bytes of the differences alone."""
    import zlib

    if not len(x):
        return b""
    d = np.diff(x, prepend=x.dtype.type(0)).astype(f"<u{width}")
    return zlib.compress(d.view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpacked(data: bytes, width: int = 8) -> np.ndarray:
    import zlib

    if not data:
        return np.empty(0, f"<u{width}")
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel(), dtype=f"<u{width}")
