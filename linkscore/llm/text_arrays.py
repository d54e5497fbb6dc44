"""Texts of an Arrow batch as one array of bytes, for work on all of them at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts handled together have about so many bytes (one longer text is handled alone).
CHUNK_BYTES = 4_000_000


def chunks(batch: pa.RecordBatch, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with ``text`` of about ``size`` bytes."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def bytes_and_offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes (UTF-8) one after the other, and where each text starts, and the end. Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def space_mask(data: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without white space), and the number of each text's first
    word (with the number of words at the end)."""
    inside = ~space_mask(data)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    texts = offsets[:-1][offsets[:-1] < len(data)]
    begins[texts] = inside[texts]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    last = texts[texts > 0] - 1
    finish[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.full(size, base, np.uint64)
        held[0] = 1
        held = _POWERS[base] = np.cumprod(held)
    return held[:n]


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of bytes: a polynomial over mixed byte values, mixed again.

    Prefix sums make it independent of the slices' lengths. Equal bytes give equal hashes anywhere.
    """
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * _powers(_BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_INVERSE, n + 1)[starts]
    return mixed(h + (ends - starts).astype(np.uint64))
