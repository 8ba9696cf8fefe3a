"""Repeated byte strings by sorting suffixes over a difference cover.

A text is read eight bytes to a character, from each of its first eight places
on. Of every three successive characters, the suffixes at the second and third
are the sample: for any two suffixes, one of the three next shifts puts both
into it. Sampled triples of characters are sorted and named by their order; then
triples of names, as often as it takes until names stand for 168 bytes, and once
more with the single characters that are left. The other suffixes are merged
with each half of the sample by sorting on what they begin with and the rank of
the sampled suffix behind it; neighbours with equal prefixes of ``LENGTH`` bytes
are then found by comparing those keys. As no more than ``LENGTH`` bytes matter,
no suffix is sorted deeper.

Work is distributed by blocks and by parts. A block holds some texts and the
names of their places. For a sort each block sends the distinct keys it has, once
each, to the part that a hash of the key names; the part sorts what all blocks
sent and answers with names. Any order will do that is the same everywhere, so
parts need not be ranges, and no key, however hot, makes a part uneven: a part
has it once a block. Blocks and parts both grow in number with the text, not in
size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm import text as T
from caselight.storage import delete, release_shuffles, scratch_path

LENGTH = 200
BLOCK = 1 << 19
PART = 1 << 19
_CHAR = 8
_ROW = "block int, n long, data binary, ends binary, weights binary, names binary, state binary"


def _squeezed(columns: np.ndarray) -> bytes:
    """A matrix of whole numbers, byte by byte."""
    raw = np.ascontiguousarray(columns.astype("<u8", copy=False)).view(np.uint8).reshape(len(columns), -1)
    return pa.compress(np.ascontiguousarray(raw.T).tobytes(), "zstd", asbytes=True)


def _restored(raw: bytes, rows: int, columns: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, rows * columns * 8, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(columns * 8, rows).T).view("<u8").reshape(rows, columns)


class _Block:
    """Some texts one after the other, with what is known of their places."""

    def __init__(self, row: dict):
        self.row = row
        self.data = np.frombuffer(row["data"], np.uint8)
        ends = np.frombuffer(row["ends"], np.int64)
        sizes = np.diff(ends, prepend=0)
        place = np.arange(len(self.data))
        self.left = np.repeat(ends, sizes) - place
        self.residue = (place - np.repeat(ends - sizes, sizes)) // _CHAR % 3
        self.weight = np.repeat(np.frombuffer(row["weights"], np.int64), sizes)
        self.start = self.left >= LENGTH
        padded = np.concatenate([self.data, np.zeros(_CHAR, np.uint8)]).astype(np.uint64)
        self.char = np.zeros(len(self.data), np.uint64)
        for k in range(_CHAR):
            self.char = self.char << np.uint64(8) | padded[k : k + len(self.data)]
        # Sampled places whose rank is asked for, and those that their names rest on.
        top = self.start & (self.residue != 0)
        top |= self._behind(self.start & (self.residue != 2), _CHAR) | self._behind(self.start & (self.residue != 1), 2 * _CHAR)
        middle = top | self._behind(top, 72) | self._behind(top, 96)
        low = middle | self._behind(middle, 24) | self._behind(middle, 48)
        self.wanted = {24: low, 72: middle, 168: top}
        self.final = top | self.start

    def _behind(self, mask: np.ndarray, steps: int) -> np.ndarray:
        out = np.zeros_like(mask)
        out[steps:] = mask[:-steps]
        return out

    def state(self, mask: np.ndarray, columns: int) -> list[np.ndarray]:
        """The stored columns, spread over all places."""
        at = np.flatnonzero(mask)
        held = _restored(self.row["state"], len(at), columns)
        out = [np.zeros(len(self.data), np.uint64) for _ in range(columns)]
        for k in range(columns):
            out[k][at] = held[:, k]
        return out

    def with_state(self, columns: list[np.ndarray], mask: np.ndarray) -> dict:
        at = np.flatnonzero(mask)
        return self.row | {"state": _squeezed(np.column_stack([c[at].astype(np.uint64) for c in columns]))}

    def at(self, column: np.ndarray, places: np.ndarray, steps: int) -> np.ndarray:
        """The column ``steps`` behind the places; 0 past the end of the text."""
        inside = self.left[places] > steps
        return np.where(inside, column[np.minimum(places + steps, len(column) - 1)], np.uint64(0))


class _Sort:
    """One sort of all blocks: which keys a block sends, how many names and sums
    it gets for each, and what it makes of them."""

    names: tuple[int, ...] = ()
    sums = 0

    def dealt(self, keys: np.ndarray) -> np.ndarray:
        """What decides the part of a key: the shortest prefix that is named, as
        equal ones must meet to get one name."""
        return keys[:, : min(self.names)] if self.names else keys

    def keys(self, b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, a row of numbers for each, and the weights to be added up."""
        raise NotImplementedError

    def answered(self, b: _Block, places: np.ndarray, told: np.ndarray) -> dict:
        raise NotImplementedError


class _Triples(_Sort):
    """Names of sampled triples: of characters first, of names then."""

    names = (3,)

    def __init__(self, length: int):
        self.length = length

    def keys(self, b):
        places = np.flatnonzero(b.wanted[self.length])
        of = b.char if self.length == 24 else b.state(b.wanted[self.length // 3], 1)[0]
        step = self.length // 3
        return places, np.column_stack([b.at(of, places, k * step) for k in range(3)]), np.zeros((len(places), 0), np.int64)

    def answered(self, b, places, told):
        column = np.zeros(len(b.data), np.uint64)
        column[places] = told[:, 0]
        return b.with_state([column], b.wanted[self.length])


class _Ranks(_Sort):
    """The sample's order by 184, 192 and 200 bytes: three names of 72 bytes that
    cover 168, and characters. Equal sampled starts are added up."""

    names = (5, 6)
    sums = 1

    def keys(self, b):
        places = np.flatnonzero(b.wanted[168])
        (of,) = b.state(b.wanted[72], 1)
        columns = [b.at(of, places, k) for k in (0, 72, 96)] + [b.at(b.char, places, k) for k in (168, 176, 184, 192)]
        weight = np.where(b.start & (b.residue != 0), b.weight, 0)[places]
        return places, np.column_stack(columns), weight[:, None]

    def answered(self, b, places, told):
        columns = [np.zeros(len(b.data), np.uint64) for _ in range(3)]
        for k in range(3):
            columns[k][places] = told[:, k]
        return b.with_state(columns, b.final)


class _Merge(_Sort):
    """Suffixes outside the sample sorted with one half of it, on ``half``
    characters and the rank of the sampled suffix behind them."""

    sums = 2

    def __init__(self, half: int):
        self.half = half

    def keys(self, b):
        short, long, _ = b.state(b.final, 3)
        places = np.flatnonzero(b.start & ((b.residue == 0) | (b.residue == self.half)))
        chars = [b.at(b.char, places, k * _CHAR) for k in range(self.half)]
        rank = b.at(long if self.half == 1 else short, places, self.half * _CHAR)
        weight, own = b.weight[places], b.residue[places] == 0
        return places, np.column_stack([*chars, rank]), np.column_stack([np.where(own, weight, 0), np.where(own, 0, weight)])

    def answered(self, b, places, told):
        short, long, total = b.state(b.final, 3)
        own = b.residue[places] == 0
        # The suffixes of residue 0 have no rank of their own: their sum is kept
        # in ``total``, from both merges.
        both = np.where(own, told[:, 1], told[:, 0])
        if self.half == 1:
            both = both + np.where(own, told[:, 0], 0)
        total[places] += both.astype(np.uint64)
        return b.with_state([short, long, total], b.final)


def _mixed(keys: np.ndarray) -> np.ndarray:
    mixed = np.zeros(len(keys), np.uint64)
    for k in range(keys.shape[1]):
        mixed = T.mix(mixed * np.uint64(T._BASE) + keys[:, k])
    return mixed


def _distinct(keys: np.ndarray, dealt: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows by part in which equal keys are neighbours, the place
    of the first of each distinct key in it, and the parts of those. ``dealt`` are
    the columns that decide the part."""
    mixed = _mixed(keys)
    part = (_mixed(dealt) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(mixed) if parts == 1 else np.lexsort((mixed, part))
    same = mixed[order[1:]] == mixed[order[:-1]]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    if (new[1:] & same).any():  # two keys with one hash may alternate
        order = np.lexsort((*keys.T[::-1], part))
        new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    first = np.flatnonzero(new)
    return order, first, part[order[first]]


def _sorted(blocks: DataFrame, sort: _Sort, parts: int) -> DataFrame:
    """The blocks after one sort."""
    names = ["block", "n", "data", "ends", "weights", "names", "state"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places, keys, weights = sort.keys(_Block(row))
                if not len(places):
                    continue
                order, first, owner = _distinct(keys, sort.dealt(keys), parts)
                rows = keys[order[first]]
                sums = np.add.reduceat(weights[order], first, axis=0) if sort.sums else weights[: len(first)]
                edges = np.flatnonzero(np.diff(owner, prepend=-1, append=parts))
                cuts = list(zip(edges.tolist(), edges[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(owner[a]) for a, _ in cuts], pa.int32()),
                        pa.array([row["block"]] * len(cuts), pa.int32()),
                        pa.array([z - a for a, z in cuts], pa.int32()),
                        pa.array([keys.shape[1]] * len(cuts), pa.int32()),
                        pa.array(
                            [_squeezed(np.column_stack([rows[a:z], sums[a:z].astype(np.uint64)])) for a, z in cuts], pa.binary()
                        ),
                    ],
                    names=["part", "block", "n", "width", "keys"],
                )

    def name(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        part, width = sent[0]["part"], sent[0]["width"]
        rows = np.concatenate([_restored(x["keys"], x["n"], width + sort.sums) for x in sent])
        keys, weights = rows[:, :width], rows[:, width:].astype(np.int64)
        order = np.lexsort(keys.T[::-1])
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
        first = np.flatnonzero(new)
        told = []
        for depth in sort.names:
            later = np.zeros(len(keys), np.int64)
            later[1:] = (keys[order[1:], :depth] != keys[order[:-1], :depth]).any(axis=1)
            told.append(np.cumsum(later) * parts + part + 1)
        if sort.sums:
            added = np.add.reduceat(weights[order], first, axis=0)[np.cumsum(new) - 1]
            told.extend(added.T)
        out = np.zeros((len(keys), len(told)), np.uint64)
        out[order] = np.column_stack(told).astype(np.uint64)
        edges = np.cumsum([0, *(x["n"] for x in sent)])
        return pa.table(
            {
                "block": pa.array([x["block"] for x in sent], pa.int32()),
                "part": pa.array([part] * len(sent), pa.int32()),
                "told": pa.array([_squeezed(out[a:z]) for a, z in zip(edges, edges[1:])], pa.binary()),
            }
        )

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        b = _Block(row)
        places, keys, weights = sort.keys(b)
        order, first, owner = _distinct(keys, sort.dealt(keys), parts)
        width = len(sort.names) + sort.sums
        counts = np.bincount(owner, minlength=parts)
        answers = sorted(zip(right.column("part").to_pylist(), right.column("told").to_pylist()))
        values = np.concatenate([np.zeros((0, width), np.uint64), *(_restored(x, int(counts[p]), width) for p, x in answers)])
        number = np.zeros(len(places), np.int64)
        if len(places):
            group = np.zeros(len(places), np.int64)
            group[first[1:]] = 1
            number[order] = np.cumsum(group)
        return pa.Table.from_pylist([sort.answered(b, places, values[number])], schema=_arrow())

    sent = blocks.mapInArrow(send, "part int, block int, n int, width int, keys binary")
    told = sent.groupBy("part").applyInArrow(name, "block int, part int, told binary")
    return blocks.select(*names).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(take, _ROW)


def _arrow() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _ROW.split(", ")])


def blocks_of(texts: DataFrame, total: int) -> DataFrame:
    """Texts (``piece``, ``bytes``, weight ``n``) packed into blocks."""
    n_blocks = max(1, total // BLOCK)

    def pack(table: pa.Table) -> pa.Table:
        data = table.column("bytes").to_pylist()
        row = {
            "block": table.column("block")[0].as_py(),
            "n": len(data),
            "data": b"".join(data),
            "ends": np.cumsum([len(x) for x in data], dtype=np.int64).tobytes(),
            "weights": table.column("n").to_numpy().astype(np.int64).tobytes(),
            "names": b"".join(table.column("piece").to_pylist()),
            "state": b"",
        }
        return pa.Table.from_pylist([row], schema=_arrow())

    dealt = texts.select(F.expr(f"cast(pmod(xxhash64(piece), {n_blocks}) as int)").alias("block"), "piece", "bytes", "n")
    return dealt.groupBy("block").applyInArrow(pack, _ROW)


def repeated_starts(texts: DataFrame, total: int) -> DataFrame:
    """Where strings of ``LENGTH`` bytes start in the ``bytes`` of texts that
    occur twice or more, in all texts together, a text with weight ``n`` counting
    n times: (``piece``, ``runs``), a run being the first and the last of successive
    such starts; one row for each text that has any. ``piece`` is a name of 16
    bytes; ``total`` is about how many bytes there are.
    """
    spark = texts.sparkSession
    parts = max(1, total // PART)
    blocks, path = blocks_of(texts, total), None
    for sort in (None, _Triples(24), _Triples(72), _Ranks(), _Merge(1), _Merge(2)):
        after = blocks if sort is None else _sorted(blocks, sort, parts)
        new = scratch_path(spark, "suffix-blocks")
        after.write.option("compression", "zstd").parquet(new)
        if path is not None:
            delete(spark, path)
        after_schema = after.schema
        del after, blocks
        release_shuffles(spark)
        blocks, path = spark.read.schema(after_schema).parquet(new), new

    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                total = b.state(b.final, 3)[2]
                again = b.start & (total >= 2)
                ends = np.frombuffer(row["ends"], np.int64)
                begins = np.concatenate([[0], ends])
                first, last = T.spans(again, begins)
                owner = np.searchsorted(ends, first, side="right")
                runs = np.column_stack([first, last - 1]) - begins[owner][:, None]
                cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=len(ends)))
                if not len(first):
                    continue
                cuts = list(zip(cuts, cuts[1:]))
                at = [int(owner[a]) * 16 for a, _ in cuts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["names"][k : k + 16] for k in at], pa.binary()),
                        pa.array([[{"first": x, "last": y} for x, y in runs[a:z].tolist()] for a, z in cuts], kind),
                    ],
                    names=["piece", "runs"],
                )

    return blocks.mapInArrow(read, "piece binary, runs array<struct<first:bigint,last:bigint>>")
