"""Which documents hold a test item: MinHash containment search, then a check.

A test item is short and a document may be long, so the likeness of the two as
sets says nothing; what counts is the share of the item's shingles that the
document holds. Items are dealt into classes by their number of shingles, and an
item is kept as its k least shingle hashes, k set by the class: one more than the
shingles that an item of the class may lack. Of an item that a document holds to
the threshold, at least one such minimum is then among the document's shingle
hashes, so the search loses nothing. A document's own sketch would lose nearly
everything, as few of a long document's minima come from a short passage.

A pair goes on if enough minima are found, and is kept after its distinct
shingles are compared as bytes. Documents are read once, where they lie; items
are the broadcast side, in blocks of a bounded number of bytes, with a pass over
the documents for each.

Defined results: words are runs of anything but ASCII white space, in lower
case; texts of fewer words than a shingle, and NULL texts, have no shingles and
match nothing, as document or as item. Repeated rows are answered one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from caselight.llm import text as T
from caselight.llm.pretokens import ragged

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 20


def _lower(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return T.buffer(pc.utf8_lower(pc.fill_null(texts, "")))


def _shingle_hashes(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle and the text it is in."""
    starts, ends = T.words(data, bounds)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    hashes = T.window_hashes(T.span_hashes(data, starts, ends), size)
    whole = T.inside(len(starts), owner, size)
    return hashes[whole], owner[: len(whole)][whole]


def shingle_set(raw: bytes, size: int) -> set[bytes]:
    """All different shingles of a text that is in lower case already."""
    found = raw.split()
    return {b" ".join(found[k : k + size]) for k in range(len(found) - size + 1)}


@dataclass
class Items:
    """A block of items as their minima. ``first`` and ``count`` give each
    different minimum's run in ``holders``, the items it is a minimum of."""

    keys: list
    texts: list[bytes]
    sizes: np.ndarray
    needed: np.ndarray
    minima: np.ndarray
    first: np.ndarray
    count: np.ndarray
    holders: np.ndarray

    @staticmethod
    def build(keys: list, texts: list[str], shingle: int, threshold: float) -> Items:
        data, bounds = _lower(pa.array(texts, pa.large_string()))
        raw = data.tobytes()
        hashes, owner = _shingle_hashes(data, bounds, shingle)
        sizes = np.zeros(len(texts), np.int64)
        needed = np.zeros(len(texts), np.int64)
        pairs: list[tuple[np.ndarray, int]] = []
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        for k in range(len(texts)):
            own = np.unique(hashes[edges[k] : edges[k + 1]])
            sizes[k] = len(own)
            if not len(own):
                continue
            largest = (1 << int(len(own)).bit_length()) - 1
            lacking = int((1 - threshold) * largest + 1e-9)
            least = own[: lacking + 1]
            pairs.append((least, k))
            needed[k] = max(1, len(least) - int((1 - threshold) * len(own) + 1e-9))
        flat = np.concatenate([np.zeros(0, np.uint64), *(m for m, _ in pairs)])
        holder = np.concatenate([np.zeros(0, np.int64), *(np.full(len(m), k) for m, k in pairs)])
        order = np.argsort(flat, kind="stable")
        minima, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        ends = bounds.tolist()
        return Items(keys, [raw[a:b] for a, b in zip(ends, ends[1:])], sizes, needed, minima, first, count, holder[order])


class Search:
    """Finds a block's items in texts of Arrow columns; one per task."""

    def __init__(self, items: Items, shingle: int, threshold: float):
        self.items, self.shingle, self.threshold = items, shingle, threshold
        self.seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.seen[items.minima >> np.uint64(64 - _FILTER_BITS)] = True
        self.sets: dict[int, set[bytes]] = {}

    def _set(self, item: int) -> set[bytes]:
        if item not in self.sets:
            self.sets[item] = shingle_set(self.items.texts[item], self.shingle)
        return self.sets[item]

    def candidates(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) pairs with enough of the item's minima in the text."""
        hashes, owner = _shingle_hashes(data, bounds, self.shingle)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _FILTER_BITS)])
        slot = np.searchsorted(self.items.minima, hashes[maybe])
        inside = slot < len(self.items.minima)
        maybe, slot = maybe[inside], slot[inside]
        hit = self.items.minima[slot] == hashes[maybe]
        found = np.unique(np.stack([owner[maybe[hit]], slot[hit]]), axis=1)
        count = self.items.count[found[1]]
        item = self.items.holders[ragged(self.items.first[found[1]], count)]
        pair, times = np.unique(np.stack([np.repeat(found[0], count), item]), axis=1, return_counts=True)
        enough = times >= self.items.needed[pair[1]]
        return pair[0][enough], pair[1][enough]

    def __call__(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(place of the text, item, shingles of the item in the text)."""
        data, bounds = _lower(texts)
        if not len(self.items.minima) or not len(data):
            return []
        place, item = self.candidates(data, bounds)
        found, last, own = [], -1, set()
        for k, i in zip(place.tolist(), item.tolist()):
            if k != last:
                last, own = k, shingle_set(data[bounds[k] : bounds[k + 1]].tobytes(), self.shingle)
            shared = len(self._set(i) & own)
            if shared >= self.threshold * len(self._set(i)) - 1e-9:
                found.append((k, i, shared))
        return found


def _blocks(items: DataFrame, key: str, text: str, shingle: int, threshold: float, block_bytes: int) -> Iterator[Items]:
    """Items in blocks of about ``block_bytes`` of text, one on the driver at a time."""
    known = items.select(key, text).where(F.col(text).isNotNull())
    total = known.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64(key, text), F.lit(blocks)) == block).collect()
        yield Items.build([r[0] for r in rows], [r[1] for r in rows], shingle, threshold)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item it holds: both keys, ``shared`` and
    ``item_shingles`` (different shingles), and ``containment``, their ratio."""
    spark = docs.sparkSession
    schema = t.StructType(
        [
            docs.schema[key],
            t.StructField(item_key, items.schema[item_key].dataType),
            t.StructField("shared", t.LongType()),
            t.StructField("item_shingles", t.LongType()),
            t.StructField("containment", t.DoubleType()),
        ]
    )
    key_type = pa.schema([("k", _arrow(items, item_key))]).field(0).type
    found = spark.createDataFrame([], schema)
    for block in _blocks(items, item_key, item_text, shingle, threshold, block_bytes):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = Search(held.value, shingle, threshold)
            for batch in batches:
                for part in T.parts(batch, text):
                    hits = search(part.column(text))
                    if hits:
                        place, item, shared = (np.array(x, dtype=np.int64) for x in zip(*hits))
                        size = search.items.sizes[item]
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column(key).take(pa.array(place)),
                                pa.array([search.items.keys[i] for i in item.tolist()], key_type),
                                pa.array(shared),
                                pa.array(size),
                                pa.array(shared / size),
                            ],
                            names=schema.names,
                        )

        found = found.unionByName(docs.select(key, text).mapInArrow(run, schema))
    return found


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def without_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns. Each block
    of items takes its rows out where they are read; nothing is shuffled."""
    for block in _blocks(items, item_key, item_text, shingle, threshold, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = Search(held.value, shingle, threshold)
            for batch in batches:
                for part in T.parts(batch, text):
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[k for k, _, _ in search(part.column(text))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
