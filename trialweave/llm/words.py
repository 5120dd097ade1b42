"""Words, lines and rolling hashes of whole Arrow text columns, without a loop over words.

A slice of a text column is one byte array with document offsets.  Boundaries come from byte
comparisons, hashes from prefix sums of a polynomial modulo 2^64, so the cost per byte is a
few array operations.  Slices are a few MB each; one very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit integers over the whole word (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: One random-looking 64-bit value for each byte value.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(inverse), np.uint64)
    up[:1], down[:1] = 1, 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Hasher:
    """Hashes of byte spans; keeps the powers between slices of one task."""

    def __init__(self) -> None:
        self.up, self.down = powers(SLICE_BYTES + 1)

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.up, self.down = powers(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * self.up[: len(data)], out=prefix[1:])
        value = (prefix[end] - prefix[start]) * self.down[start]
        return mix(value + (end - start).astype(np.uint64) * _SHINGLE_BASE)


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the bytes and document offsets of its text; null counts as empty."""
    at = batch.schema.get_field_index(column)
    texts = batch.column(at)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if n == 0:
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(bounds, bounds[low] + SLICE_BYTES, "right")) - 1
        high = min(max(high, low + 1), n)
        yield batch.slice(low, high - low), data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        low = high


def runs(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each maximal run without separator bytes."""
    apart = separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins, ends = ~apart, ~apart
    begins[1:] &= apart[:-1] | first[1:-1]
    ends[:-1] &= apart[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every ``width`` words in a row, and the number of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    value = np.zeros(n, np.uint64)
    for j in range(width):
        value = value * _SHINGLE_BASE + hashes[j : j + n]
    return mix(value[at]), at
