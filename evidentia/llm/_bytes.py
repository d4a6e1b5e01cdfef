"""Vectorised kernels over the UTF-8 bytes of many texts at once.

Everything here is plain numpy on flat arrays: one byte buffer that holds a run
of texts, and an offsets array that says where each text starts.  Nothing knows
about Spark.  Temporary arrays stay within a few times the size of one slice.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that end a word: space, and tab to carriage return.
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT2 = np.uint64(0xC2B2AE3D27D4EB4F)
_ALL = (1 << 64) - 1
#: Masks of the first n bytes of eight.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

#: Bytes hashed at one time: temporaries of eight bytes each stay in cache.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each two hashes in order. Shifts between the products keep it from being a polynomial, whose value structured texts could steer."""
    x = a ^ (a >> np.uint64(32))
    x *= _MULT
    x ^= b
    x ^= x >> np.uint64(29)
    x *= _MULT2
    x ^= x >> np.uint64(32)
    return x


def codes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, with zeros behind the end: a view, to be indexed."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def give_back() -> None:
    """Returns freed memory to the system. A Python worker lives on after its task, and what it keeps counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc: then freed memory stays with the worker
        return


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back when it has seen all."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets (a null counts as empty), without a copy where possible."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        width = np.int32
    elif pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        width = np.int64
    else:
        raise TypeError(f"text must be a string column, not {texts.type}")
    if texts.null_count:
        texts = texts.fill_null("" if "string" in str(texts.type) else b"")
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, dtype=width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def cuts(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of whole texts of at most `most` bytes each; a longer text is a run of its own."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes in a string or binary column: what becomes Python objects at one time stays small."""
    _, offsets = flat(batch.column(column))
    for i, j in cuts(offsets, most):
        yield batch.slice(i, j - i)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in `data`, and the first word of each text (one longer than the texts)."""
    n = len(data)
    inside = _WORD[data]
    fresh = np.ones(n + 1, dtype=bool)  # the byte before is no word byte, or another text's
    np.logical_not(inside, out=fresh[1:])
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    ends = np.flatnonzero(inside & fresh_next(fresh, inside, offsets)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def fresh_next(fresh: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.ones(len(inside), dtype=bool)
    if len(inside):
        np.logical_not(inside[1:], out=out[:-1])
        last = offsets[1:] - 1
        out[last[last >= 0]] = True
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span data[start:end]; other salts give independent ones. The spans are in order and don't overlap.

    Each eight bytes are mixed by themselves with their place and the span's length, then summed: no text that repeats or alternates makes spans meet.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + SLICE, side="right")), i + 1)
        a = int(starts[i])
        part = codes(data[a : int(ends[j - 1])])
        s, n = starts[i:j] - a, ends[i:j] - starts[i:j]
        seed = mix((n.astype(np.uint64) + np.uint64(salt << 32 & _ALL)) * _MULT)
        h = mix(part[s] & _MASK[np.minimum(n, 8)] ^ seed)
        long = np.flatnonzero(n > 8)
        if long.size:
            more = (n[long] - 1) // 8
            at = np.cumsum(more) - more
            step = ranges(np.ones(len(long), np.int64), more)
            x = part[np.repeat(s[long], more) + 8 * step] & _MASK[np.minimum(np.repeat(n[long], more) - 8 * step, 8)]
            x ^= mix(step.astype(np.uint64) * _MULT2 + np.repeat(seed[long], more))
            h[long] += np.add.reduceat(mix(x), at)
        out[i:j] = mix(h)
        i = j
    return out


def window_hashes(items: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of items[i:i+width] for each i; empty if there are fewer items. Runs of two, four, eight and more are joined; the last two may overlap."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return _windows(items, 1, width, np.uint64(salt * 0x9E3779B97F4A7C15 + width & _ALL), n)


def byte_windows(data: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of data[i:i+width] for each i, from eight bytes at a time; width is 8 at least."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return _windows(codes(data)[: len(data) - 7], 8, width, np.uint64(salt * 0x9E3779B97F4A7C15 + width & _ALL), n)


def _windows(items: np.ndarray, size: int, width: int, seed: np.uint64, n: int) -> np.ndarray:
    """items[i] stands for `size` units from i on; n windows of `width` units."""
    out = np.empty(n, dtype=np.uint64)
    for a in range(0, n, SLICE >> 2):
        b = min(a + (SLICE >> 2), n)
        part, upto = mix(items[a : b + width - size] + seed), size
        while upto * 2 <= width:
            part = join(part[:-upto], part[upto:])
            upto *= 2
        out[a:b] = join(part[: b - a], part[width - upto : width - upto + b - a])
    return out


def segments(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose words begin at first[t]: how many k-word windows each has, and the flags of windows that stay inside one text."""
    counts = np.diff(first)
    return np.maximum(counts - k + 1, 0), counts


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length) over all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, dtype=np.int64)
    at = np.cumsum(lengths[:-1])
    step[0] = starts[0]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)
