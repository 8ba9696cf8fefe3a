"""Content-defined anchors of fixed-length windows, and bounded filters on them.

Each window of ``length`` bytes has an anchor: of the ``width`` grams that lie
in it whole, the one with the least hash, the last of equals. Two equal windows
have equal anchors at equal places, so a window whose anchor occurs once cannot
be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caselight.llm import text as T

SLICE = 1 << 18
BITS = 26
MOST_BITS = 29
_BLOCK = 9
_PROBES = 8
_FLUSH = 1 << 20
_PLACE = np.uint64(20)
_PLACES = np.uint64((1 << 20) - 1)


class Slice:
    """Up to ``SLICE`` window starts, with the bytes that their windows take."""

    def __init__(self, data: np.ndarray, usable: np.ndarray, length: int):
        self.data, self.usable, self.length = data, usable, length
        up, self._down = T._powers(SLICE << 1)
        self._total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._total[1:])

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every gram, and the place of each window's anchor; places
        never go back from one window to the next."""
        size = self.length - width + 1
        n = len(self.data) - size + 1
        h = (self._total[size:] - self._total[:n]) * self._down[:n]
        h *= np.uint64(T._MIX_1)
        h ^= h >> np.uint64(31)
        h *= np.uint64(T._MIX_2)
        # The place counts down, so the least of equal hashes is the last of them.
        least = (h >> _PLACE << _PLACE) | (_PLACES - np.arange(n, dtype=np.uint64))
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        return h, (_PLACES - (least & _PLACES)).astype(np.int64)


def slices(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, Slice]]:
    """The windows of all texts in a buffer, some at a time; with the place in
    the buffer where each slice begins. Long texts make several slices."""
    if len(data) < length:
        return
    ends = np.repeat(bounds[1:], np.diff(bounds))
    for at in range(0, len(data) - length + 1, SLICE):
        stop = min(len(data) - length + 1, at + SLICE)
        usable = np.arange(at, stop) + length <= ends[at:stop]
        if usable.any():
            yield at, Slice(data[at : stop + length - 1], usable, length)


def groups(places: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of wanted windows with one anchor."""
    at = np.flatnonzero(wanted)
    if not len(at):
        return at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) > 1) | (places[at[1:]] != places[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1]


def packed(values: np.ndarray) -> bytes:
    """Sorted whole numbers as steps, byte by byte."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, n * 8, "zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


class Filter:
    """Which hashes may be wanted: ``2 ** BITS`` bits, however many there are."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        place = (h >> np.uint64(64 - BITS)).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


class Probed(Filter):
    """The same, with several bits to a hash, all in one block of 512. Hashes are
    mixed first: anchors are the least of many, so their first bits are nearly
    all zero, and would fill a small part of the filter and leave the rest empty."""

    def __init__(self, bits: np.ndarray, probes: int):
        super().__init__(bits)
        self.probes = probes

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        values = _mixed(h)
        at = np.arange(len(values))
        for k in range(self.probes):
            place = _places(values[at], len(self.bits) * 8, k)
            at = at[(self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
        found = np.zeros(len(values), dtype=bool)
        found[at] = True
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    """48 bits of each hash, spread evenly."""
    return T.mix(h) >> np.uint64(16)


def _places(values: np.ndarray, size: int, k: int) -> np.ndarray:
    """The ``k``th bit of mixed hashes in a filter of ``size`` bits."""
    place = (values >> np.uint64(49 - size.bit_length())).astype(np.int64)
    if not k:
        return place
    within = T.mix(values) >> np.uint64(_BLOCK * (k - 1)) & np.uint64((1 << _BLOCK) - 1)
    return place >> _BLOCK << _BLOCK | within.astype(np.int64)


def repeated(
    rows: DataFrame,
    hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
    expected: int,
    least: int = 2,
) -> Filter:
    """A filter of the hashes that come ``least`` times or more. ``hashes`` gives
    those of a batch; ``expected`` is about how many there are in all.

    They are counted by ranges of their first bits, once mixed, so ranges are even.
    Each task sends a hash at most ``least`` times a flush, so a hot one costs no
    more than a rare one. Only the bits come to the driver: ``2 ** BITS`` of them,
    or three for each that is expected, up to ``2 ** MOST_BITS``. A hash has as many
    bits as suit the number there is room for, one if the filter is crowded.
    """
    total = 1 << min(MOST_BITS, max(BITS, (3 * expected).bit_length()))
    parts = 1 << min(total.bit_length() - 1 - _BLOCK, max(4, (expected >> 20).bit_length()))
    shift = np.uint64(49 - parts.bit_length())

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(_mixed(np.concatenate(held)), return_counts=True)
        values = np.repeat(values, np.minimum(n, least))
        owner = (values >> shift).astype(np.int64)
        edges = np.flatnonzero(np.diff(owner, prepend=-1, append=parts))
        cuts = list(zip(edges, edges[1:]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([owner[a] for a, _ in cuts], pa.int32()),
                pa.array([b - a for a, b in cuts], pa.int32()),
                pa.array([packed(values[a:b]) for a, b in cuts], pa.binary()),
            ],
            names=["part", "n", "hashes"],
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for found in hashes(batch):
                held.append(found)
                size += len(found)
                if size >= _FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        every = [unpacked(x, n) for n, x in zip(table.column("n").to_pylist(), table.column("hashes").to_pylist())]
        values, n = np.unique(np.concatenate(every), return_counts=True)
        values = values[n >= least]
        bits = np.zeros(total // parts, dtype=np.uint8)
        # The number of bits that leaves about half of them empty.
        probes = min(_PROBES, max(1, round(0.69 * len(bits) / max(1, len(values)))))
        for k in range(probes):
            bits[_places(values, total, k) - part * len(bits)] = 1
        packed_bits = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"part": pa.array([part], pa.int32()), "probes": pa.array([probes], pa.int32()), "bits": [packed_bits]})

    counted = rows.mapInArrow(send, "part int, n int, hashes binary")
    told = counted.groupBy("part").applyInArrow(count, "part int, probes int, bits binary").collect()
    bits = np.zeros(total // 8, dtype=np.uint8)
    size = len(bits) // parts
    for row in told:
        bits[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return Probed(bits, min((row["probes"] for row in told), default=1))
