"""Texts of an Arrow column as one byte buffer, and spans and hashes within it.

The operators below read whole texts inside Arrow batches. A batch is cut into
parts of a few megabytes first, so the numpy arrays beside the bytes (eight
bytes an element) stay bounded whatever the batch holds; only one single text
larger than that makes a larger part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 1 << 20

# An odd multiplier and the two constants of a 64-bit finaliser.
_BASE = 0x9E3779B97F4A7C15
_MIX_1 = 0xBF58476D1CE4E5B9
_MIX_2 = 0x94D049BB133111EB

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def parts(batch: pa.RecordBatch, column: str, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch, each with about ``limit`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for first, last in zip(cuts, cuts[1:]):
        if last > first:
            yield batch.slice(first, last - first)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and their bounds (one more than texts);
    a NULL is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))


def spans(wanted: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last index of every run of ``wanted`` bytes; a run
    ends where its text ends."""
    n = len(wanted)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    first = wanted.copy()
    first[1:] &= ~wanted[:-1] | edge[1:n]
    last = wanted.copy()
    last[:-1] &= ~wanted[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words, runs of anything but ASCII white space."""
    return spans(~SPACE[data], bounds)


def per_text(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bounds of each text's spans within the list of spans."""
    return np.searchsorted(starts, bounds)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX_2)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span; equal bytes have equal hashes wherever they
    stand. Callers that must not take two texts for one compare bytes after it."""
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    found = (total[ends] - total[starts]) * down[starts]
    return mix(found + (ends - starts).astype(np.uint64) * np.uint64(_MIX_2))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` successive hashes; window i starts at i."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = (out + h[k : k + n]) * np.uint64(_BASE)
    return mix(out)


def inside(n_spans: int, owner: np.ndarray, size: int) -> np.ndarray:
    """Which windows of ``size`` spans lie within one text."""
    n = max(0, n_spans - size + 1)
    return owner[:n] == owner[size - 1 : size - 1 + n]
