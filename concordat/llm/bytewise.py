"""Words of UTF-8 text as numpy arrays: places, owners and 64-bit hashes.

The operators that read every word of a corpus work on the bytes of an Arrow batch. White
space and the marks they look for are ASCII, so no text is decoded. Batches are taken in
pieces of a bounded number of bytes; one text longer than that is a piece of its own, and its
words are hashed in blocks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
BLOCK_BYTES = 4 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
CONTINUES = (np.arange(256) & 0xC0) == 0x80

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(max(n, 1 << 16), _ROOT if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps)
    return _powers[which]


def _give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, beside an executor whose memory is counted with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task's function that gives back at its end what it had allocated."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the place where each text begins (and the last ends).

    A null is an empty text.
    """
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``limit`` bytes, or one row."""
    data, at = text_bytes(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def spans(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay inside one text: starts, ends, owners."""
    if not len(member):
        none = np.zeros(0, np.int64)
        return none, none, none
    before, after = np.empty_like(member), np.empty_like(member)
    before[0], before[1:] = False, member[:-1]
    after[-1], after[:-1] = False, member[1:]
    full = at[:-1] < at[1:]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    starts = np.flatnonzero(member & ~before)
    return starts, np.flatnonzero(member & ~after) + 1, np.searchsorted(at, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap."""
    values = _LOWER_BYTE if lower else _BYTE
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        end = max(first + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
        block = data[base : ends[end - 1]]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(values[block] * _power("up", len(block))[: len(block)], out=sums[1:])
        s, e = starts[first:end] - base, ends[first:end] - base
        raw = (sums[e] - sums[s]) * _power("down", len(block) + 1)[s]
        out[first:end] = mix(raw + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = end
    return out


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


_FACTORS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive word hashes, whatever text they are in."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _FACTORS[0]
    for i in range(1, width):
        total += words[i : i + n] * _FACTORS[i]
    return mix(total + np.uint64(width))


def inside_one_text(owners: np.ndarray, width: int) -> np.ndarray:
    """Which runs of ``width`` consecutive words lie in one text."""
    n = len(owners) - width + 1
    return owners[:n] == owners[width - 1 :] if n > 0 else np.zeros(0, bool)
