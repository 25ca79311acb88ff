"""Vectorised word and n-gram hashing over Arrow text columns.

Everything here runs inside an Arrow task on one bounded slice of a record
batch.  Words are runs of bytes that are not separators; since separators are
ASCII, splitting UTF-8 bytes equals splitting code points.  A word's 64-bit
hash is a polynomial over a table of mixed byte values, taken from prefix sums
and finished by a mixer, so a text costs a few array passes and no Python loop
over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_NGRAM_BASE = U64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that one pass of array operations takes at most, unless a single word is longer.
BLOCK_BYTES = 1 << 20

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, U64(base))
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def text_slices(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into (first row, end row, bytes, offsets) of about max_bytes; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of each word of concatenated texts."""
    inside = ~separator[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # texts that touch
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are ascending and don't overlap."""
    out = np.empty(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
            low, high = int(starts[i]), int(ends[j - 1])
            up, down = _grown(high - low + 1)
            sums = np.zeros(high - low + 1, U64)
            np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
            i = j
    return out


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of 64-bit values; starts and ends are ascending, and runs may overlap."""
    out = np.empty(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
            low, high = int(starts[i]), int(ends[j - 1])
            up, down = _grown(high - low + 1)
            sums = np.zeros(high - low + 1, U64)
            np.cumsum(mix(values[low:high] + U64(1)) * up[: high - low], out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
            i = j
    return out


def ngram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each position; the last n - 1 positions have none."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        sums = np.full(count, U64(salt + n))
        for j in range(n):
            sums = sums * _NGRAM_BASE + words[j : j + count]
        return mix(sums)
