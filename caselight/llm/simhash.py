"""SimHash fingerprints and groups of near duplicates.

A fingerprint takes one pass over a text where it is read. Fingerprints are then
compared exactly, in tiles: two that differ in at most r of 64 bits agree in at
least one of r + 1 ranges of bits, so different fingerprints are dealt by (range,
its bits), and within such a group cut into tiles of like population count.
Tiles are compared with numpy exclusive-or and bit counts; tile pairs whose
population counts differ by more than r are skipped, as two fingerprints are
never closer than their population counts. A group of more than one tile is
dealt on as tile pairs, each its own row, so a hot range of bits is shared
among tasks. What a tile pair finds is reduced to a spanning forest before it
leaves the task.

Copies of a fingerprint are one row from the start; documents come back by a
join on the fingerprint at the end.

Defined results: a NULL, empty or blank text has fingerprint zero and is linked
like any other; a text of fewer words than a shingle has one shingle, all its
words. Rows are documents: two rows with one doc_id are two members of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from caselight.llm import text as T
from caselight.llm.components import connected_components
from caselight.llm.line_dedup import fresh
from caselight.storage import written

BITS = 64
SEED = 42
TILE = 2048
BUCKET = 4096

_BIT = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit that is set in more than half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(n, 8)
    if n < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BIT for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _text_hashes(raw: bytes, starts: list[int], ends: list[int], shingle: int) -> np.ndarray:
    """XXH64 of all shingles of one text, given the spans of its words in
    ``raw``, where one blank follows each word."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    if n < shingle:
        return np.array([xxhash.xxh64_intdigest(raw[starts[0] : ends[-1]], SEED)], dtype=np.uint64)
    views = map(raw.__getitem__, map(slice, starts, ends[shingle - 1 :]))
    return np.fromiter(map(xxhash.xxh64_intdigest, views, repeat(SEED)), dtype=np.uint64, count=n - shingle + 1)


def fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    """Fingerprints of the texts of an Arrow column."""
    data, bounds = T.buffer(texts)
    data = T.ascii_lower(data)
    starts, ends = T.words(data, bounds)
    limits = T.per_text(starts, bounds).tolist()
    # Words with one blank after each, without what else was between them.
    sizes = ends - starts
    keep = ~T.SPACE[data]
    at = np.cumsum(sizes + 1) - (sizes + 1)
    spaced = np.full(int((sizes + 1).sum()), 0x20, dtype=np.uint8)
    order = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
    spaced[order] = data[keep]
    raw, first, last = spaced.tobytes(), at.tolist(), (at + sizes).tolist()
    return np.array(
        [fingerprint(_text_hashes(raw, first[a:b], last[a:b], shingle)) for a, b in zip(limits, limits[1:])],
        dtype=np.uint64,
    )


def fingerprints(df: DataFrame, keys: list[str], text: str, shingle: int) -> DataFrame:
    """The key columns and ``fp``, a long that holds the fingerprint's 64 bits."""
    source = df.select(*keys, text)
    schema = t.StructType([*(df.schema[k] for k in keys), t.StructField("fp", t.LongType())])
    names = [*keys, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.parts(batch, text):
                found = fingerprints_of(part.column(text), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(found)], names=names)

    return source.mapInArrow(run, schema)


def _ranges(parts: int) -> list[tuple[int, int]]:
    """First bit and width of ``parts`` ranges that cover the 64 bits."""
    edges = [BITS * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def compare_tiles(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or within one): pairs
    (place in the two tiles taken as one list, a smaller such place)."""
    both = np.concatenate([left, right])
    roots = np.arange(len(both))
    found_a, found_b = [], []
    for first in range(0, len(left), 256):
        block = left[first : first + 256]
        close = np.bitwise_count(block[:, None] ^ right[None, :]) <= radius
        a, b = np.nonzero(close)
        found_a.append(a + first)
        found_b.append(b + len(left))
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    # Least place of each group: labels go along the links until none changes.
    while True:
        new = roots.copy()
        np.minimum.at(new, a, roots[b])
        np.minimum.at(new, b, roots[a])
        new = new[new]
        if (new == roots).all():
            break
        roots = new
    place = np.flatnonzero(roots != np.arange(len(both)))
    return place, roots[place]


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (u, v) that join every two of the different ``fp`` within ``radius``
    bits, directly or through others; few more than there are fingerprints."""
    ranges = F.array(*(F.shiftrightunsigned("fp", first).bitwiseAND((1 << size) - 1) for first, size in _ranges(radius + 1)))
    dealt = distinct.select("fp", F.posexplode(ranges).alias("range", "bits"))
    sizes = dealt.groupBy("range", "bits").agg(F.count("*").alias("size")).where("size > 1")
    # Groups of one member hold no pair, and most bits of a range are rare.
    grouped = dealt.join(sizes, ["range", "bits"])
    # Tiles within a group: by population count, then by a hash where one count
    # holds more than a tile.
    counted = grouped.withColumn("ones", F.bit_count("fp"))
    cells = counted.groupBy("range", "bits", "ones").agg(F.count("*").alias("n"))
    split = F.ceil(F.col("n") / tile)
    alone = written(
        cells.groupBy("range", "bits").agg(F.sum("n").alias("size"), F.max("n").alias("most")), "tile-groups"
    )
    small = alone.where(F.col("size") <= tile).select("range", "bits")
    whole = counted.join(small, ["range", "bits"]).select(
        F.xxhash64("range", "bits").alias("pair"), "fp", F.lit(0).alias("side")
    )
    # A large group: its cells as tiles, and a row for each tile pair that may hold a link.
    large = cells.join(alone.where(F.col("size") > tile).select("range", "bits"), ["range", "bits"])
    tiles = large.withColumn("cut", split).select(
        "range", "bits", "ones", "cut", F.explode(F.sequence(F.lit(0), (F.col("cut") - 1).cast("int"))).alias("piece")
    )
    near = (
        tiles.alias("a")
        .join(
            tiles.withColumn("other", F.explode(F.sequence(F.col("ones") - radius, F.col("ones")))).alias("b"),
            F.expr(
                "a.range = b.range and a.bits = b.bits and a.ones = b.other"
                " and (a.ones < b.ones or a.piece <= b.piece)"
            ),
        )
        .selectExpr(
            "a.range", "a.bits", "a.ones as ones_a", "a.piece as piece_a", "a.cut as cut_a",
            "b.ones as ones_b", "b.piece as piece_b", "b.cut as cut_b",
            "xxhash64(a.range, a.bits, a.ones, a.piece, b.ones, b.piece) as pair",
        )
    )
    sides = near.selectExpr("range", "bits", "ones_a as ones", "piece_a as piece", "cut_a as cut", "pair", "0 as side")
    sides = sides.unionByName(
        near.selectExpr("range", "bits", "ones_b as ones", "piece_b as piece", "cut_b as cut", "pair", "1 as side")
    )
    placed = counted.join(large.select("range", "bits", "ones", split.alias("cut")), ["range", "bits", "ones"])
    placed = placed.withColumn("piece", F.expr("cast(pmod(xxhash64(fp), cut) as int)"))
    paired = placed.join(sides, ["range", "bits", "ones", "cut", "piece"]).select("pair", "fp", "side")

    def run(table: pa.Table) -> pa.Table:
        pair, side = table.column("pair").to_numpy(), table.column("side").to_numpy()
        order = np.lexsort((side, pair))
        pair, side = pair[order], side[order]
        fp = table.column("fp").to_numpy().view(np.uint64)[order]
        edges = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]
        found_u, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, last in zip(edges, edges[1:]):
            middle = first + int(np.searchsorted(side[first:last], 1))
            left, right = np.sort(fp[first:middle]), np.sort(fp[middle:last])
            if len(right) == 0:
                right = left
            a, b = compare_tiles(left, right, radius)
            both = np.concatenate([left, right]).view(np.int64)
            u, v = both[a], both[b]
            found_u.append(u[u != v])
            found_v.append(v[u != v])
        return pa.table({"u": np.concatenate(found_u), "v": np.concatenate(found_v)})

    # Tile pairs are small; a task takes some of them at a time. Their number
    # grows with the fingerprints, so what a bucket holds does not.
    buckets = max(1, distinct.count() * (radius + 1) // BUCKET)
    bucketed = whole.unionByName(paired).withColumn("bucket", F.pmod("pair", F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInArrow(run, "u long, v long")


def _components(prints: DataFrame, key: Column, radius: int, tile: int) -> DataFrame:
    """(fp, least): of each fingerprint the least ``key`` of those reachable."""
    # Documents of a fingerprint are counted as one from here on.
    classes = written(prints.groupBy("fp").agg(F.min(key).alias("first")), "fingerprint-classes")
    # The order of signed longs does not matter: the root only names a group.
    found = connected_components(links(classes.select("fp"), radius, tile))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    return rooted.join(least, "root").select("fp", "least")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, tile: int = TILE
) -> DataFrame:
    """Per document: its key, ``fingerprint`` (16 hex digits), and
    ``component_id``, the least key of those reachable over links."""
    prints = written(fingerprints(docs, [key], text, shingle), "fingerprints")
    by_print = _components(prints, F.col(key), radius, tile)
    return prints.join(by_print, "fp").select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id")
    )


def representatives(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, tile: int = TILE
) -> DataFrame:
    """One row of ``docs`` for each group: the one of least (key, hash of the whole
    row). Rows are told apart by both, so two texts under one key are judged each
    by itself; of a repeated row one stays. A row without a key is in no group of
    others' and stays."""
    names = docs.columns
    row, n = fresh(docs, "row", "n")
    marked = docs.withColumn(row, F.xxhash64(*names))
    prints = written(fingerprints(marked.where(F.col(key).isNotNull()), [key, row], text, shingle), "fingerprints")
    place = F.struct(F.col(key).alias("key"), F.col(row).alias("row"))
    by_print = _components(prints, place, radius, tile)
    counted = prints.groupBy("fp", key, row).agg(F.count("*").alias(n)).join(by_print, "fp")
    stays = place == F.col("least")
    # 0: goes; more: so many rows of which one stays.
    told = counted.select(key, row, F.when(stays, F.col(n)).otherwise(0).alias(n)).where(F.col(n) != 1)
    told = written(told, "not-alone")
    alone = marked.join(told.select(key, row).hint("shuffle_hash"), [key, row], "left_anti").select(*names)
    many = marked.join(told.where(F.col(n) > 1).select(key, row), [key, row])
    one = many.groupBy(key, row).agg(F.any_value(F.struct(*names)).alias(n)).select(f"{n}.*")
    return alone.unionByName(one)
