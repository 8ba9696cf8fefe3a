"""Cut texts into the pieces that byte-level tokenizers work on.

The cutting pattern is that of the rank files: contractions, then an optional
blank before a run of letters, of numbers or of other signs, then white space.
Over ASCII and Latin letters it is worked out on byte classes for a whole part
at once; a text with any other character goes through the pattern itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from caselight.llm import text


# The published cutting pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PATTERN = regex.compile(PATTERN)

_LETTER, _DIGIT, _SIGN, _BLANK = 0, 1, 2, 3
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[0x80:] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK

# Bytes of characters the byte classes can't tell: U+0080-00BF, and above U+024F.
_OTHER = np.zeros(256, dtype=bool)
_OTHER[0xC2] = True
_OTHER[0xC9:] = True


def _simple(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts all of whose characters the byte classes describe rightly."""
    odd = _OTHER[data] | ((data >= 0x1C) & (data <= 0x1F))
    cross = data == 0xC3
    cross[:-1] &= (data[1:] == 0x97) | (data[1:] == 0xB7)
    cross[-1:] = False
    seen = np.concatenate([[0], np.cumsum(odd | cross)])
    return seen[bounds[1:]] == seen[bounds[:-1]]


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which bytes begin a piece, for texts of simple characters."""
    n = len(data)
    kind = _CLASS[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    text_first, text_last = edge[:n], edge[1:]
    change = np.ones(n, dtype=bool)
    change[1:] = (kind[1:] != kind[:-1]) | text_first[1:]
    blank = kind == _BLANK
    ends_run = np.ones(n, dtype=bool)
    ends_run[:-1] = change[1:]
    # The last of a run of white space stands alone, or goes with what follows.
    last_blank = blank & ends_run & ~text_last
    first = change | last_blank
    joins = last_blank & (data == 0x20)
    at = np.flatnonzero(joins) + 1
    first[at] = False
    # Contractions: a sign run that starts with ' and no blank before it.
    quote = np.flatnonzero((data == 0x27) & change & ~text_last)
    if len(quote):
        before = np.zeros(len(quote), dtype=bool)
        inner = quote > 0
        before[inner] = joins[quote[inner] - 1]
        quote = quote[~before]
        one = data[quote + 1]
        room = quote + 2 < n
        two = np.zeros(len(quote), np.uint8)
        two[room] = data[np.minimum(quote + 2, n - 1)][room]
        two[room] *= ~text_last[np.minimum(quote + 1, n - 1)][room]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for which, size in ((single, 2), (double & ~single, 3)):
            q = quote[which]
            first[q + 1] = False
            end = q + size
            end = end[end < n]
            first[end] = True
    return first


def cut(data: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """All pieces of all texts, in order, and each text's bounds in that list."""
    raw = data.tobytes()
    if not len(data):
        return [], np.zeros(len(bounds), np.int64)
    simple = _simple(data, bounds)
    starts = np.flatnonzero(_cuts(data, bounds))
    limits = np.searchsorted(starts, bounds)
    if simple.all():
        ends = np.append(starts[1:], len(raw)).tolist()
        return [raw[a:b] for a, b in zip(starts.tolist(), ends)], limits
    pieces: list[bytes] = []
    counts = np.zeros(len(bounds), np.int64)
    for k in range(len(bounds) - 1):
        if simple[k]:
            at = [*starts[limits[k] : limits[k + 1]].tolist(), int(bounds[k + 1])]
            own = [raw[a:b] for a, b in zip(at, at[1:])]
        else:
            own = [x.encode() for x in _PATTERN.findall(raw[bounds[k] : bounds[k + 1]].decode())]
        pieces += own
        counts[k + 1] = len(own)
    return pieces, np.cumsum(counts)


class Places:
    """Place of a key (0 or more) in a fixed list of different keys, by open
    addressing in an array a fifth full at most."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(5 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.places = np.full(1 << self.bits, -1, dtype=np.int64)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]
            held = self.keys[slots[left]] == keys[left]
            self.places[slots[left[held]]] = left[held]
            left = left[~held]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(text._BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Places, or -1 for what is no key; -1 itself never is."""
        slots = self._slot(wanted)
        held = self.keys[slots]
        out = np.where(held == wanted, self.places[slots], -1)
        left = np.flatnonzero((held != wanted) & (held >= 0) & (wanted >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[left]]
            hit = held == wanted[left]
            out[left[hit]] = self.places[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class Numbered:
    """Numbers for pieces, and what ``resolve`` says about each new one.

    Pieces are looked up one by one and resolved together, all that are new in
    a part at once. Past ``most`` pieces the store starts again, so its size is
    bounded however many different pieces a task sees.
    """

    def __init__(self, resolve: Callable[[list[bytes]], None], reset: Callable[[], None], most: int = 100_000):
        self.resolve, self.reset, self.most = resolve, reset, most
        self.numbers: dict[bytes, int] = {}

    def __call__(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.numbers) > self.most:
            self.numbers.clear()
            self.reset()
        known = self.numbers
        new = [x for x in set(pieces) if x not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.resolve(new)
        return np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + size), one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


