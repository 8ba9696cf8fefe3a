"""Byte-level BPE encoding and decoding of whole texts.

Every piece of a text is merged with a segment tree over the ranks of its
adjacent pairs: the root holds the leftmost pair of lowest rank, a merge
changes three leaves and the nodes above them, and the piece is done when the
root holds no pair that merges. The trees of all new pieces of a part are kept
side by side in numpy arrays, so a step takes one merge in each of them.

Nothing is shuffled: a row is encoded where it is read. The vocabulary is a
fixed table of some 50,000 entries, read on the driver and broadcast.

Defined results: a NULL or empty text has no ids and decodes to the empty text;
the string of an added token within a text is that token, as in the tokenizers
library; columns of the input beside the text pass through.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as t

from caselight.llm import text as T
from caselight.llm.pretokens import Numbered, Places, cut, ragged

_NONE = np.int64(1) << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """What a byte-level BPE file holds, as arrays.

    ``pair_ids`` has left and right id of every merge in rank order and
    ``merged`` the id it makes; ``lengths`` and ``data`` hold each id's bytes.
    """

    byte_ids: np.ndarray
    pair_ids: np.ndarray
    merged: np.ndarray
    lengths: np.ndarray
    data: np.ndarray
    added: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as source:
            told = json.load(source)
        letters = byte_letters()
        ids = told["model"]["vocab"]
        added = {x["content"]: x["id"] for x in told["added_tokens"]}
        as_bytes = {i: bytes(letters[c] for c in token) for token, i in ids.items() if token not in added}
        as_bytes |= {i: token.encode() for token, i in added.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        size = max(as_bytes) + 1
        lengths = np.array([len(as_bytes.get(i, b"")) for i in range(size)], dtype=np.int64)
        data = np.frombuffer(b"".join(as_bytes.get(i, b"") for i in range(size)), dtype=np.uint8)
        byte_ids = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            byte_ids[b] = ids[letter]
        return Vocabulary(
            byte_ids,
            np.array([(ids[a], ids[b]) for a, b in pairs], dtype=np.int64),
            np.array([ids[a + b] for a, b in pairs], dtype=np.int64),
            lengths,
            data,
            added,
        )


class PairRanks:
    """Rank of a pair of ids."""

    def __init__(self, pairs: np.ndarray):
        self.places = Places(pairs[:, 0] << 32 | pairs[:, 1])

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, or _NONE for pairs that don't merge (any with a negative id)."""
        found = self.places(np.where((left >= 0) & (right >= 0), left << 32 | right, -1))
        return np.where(found >= 0, found, _NONE)


def merge_pieces(pieces: list[bytes], words: Vocabulary, ranks: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row and how many each has. Pieces are handled by
    size class, so that the trees beside each other have the same height."""
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    heights = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    groups, found, counts = [], [], np.zeros(len(pieces), np.int64)
    for height in np.unique(heights).tolist():
        group = np.flatnonzero(heights == height)
        step = max(1, (1 << 20) >> height)
        for first in range(0, len(group), step):
            some = group[first : first + step]
            ids, counts[some] = _merge_class([pieces[k] for k in some.tolist()], sizes[some], height, words, ranks)
            groups.append(some)
            found.append(ids)
    order = np.concatenate(groups)
    out = np.zeros(int(counts.sum()), np.int64)
    out[ragged((np.cumsum(counts) - counts)[order], counts[order])] = np.concatenate(found)
    return out, counts


def _merge_class(
    pieces: list[bytes], sizes: np.ndarray, height: int, words: Vocabulary, ranks: PairRanks
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of at most 2**height bytes, one after the other, and how
    many each has."""
    count, width = len(pieces), 1 << height
    stride = width + 1
    symbols = np.full((count, stride), -1, dtype=np.int64)
    column = np.arange(stride)
    filled = column < sizes[:, None]
    symbols[filled] = words.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    flat = symbols.ravel()
    following = np.tile(column + 1, count).reshape(count, stride)
    preceding = np.tile(column - 1, count).reshape(count, stride)

    # Node 1 is the root, leaves start at ``width``. A leaf's key orders pairs
    # by rank, then by place.
    tree = np.full((count, 2 * width), _NONE, dtype=np.int64)
    leaf_rank = ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(count, width)
    tree[:, width:] = np.where(leaf_rank < _NONE, leaf_rank * stride + column[:-1], _NONE)
    at = width
    while at > 1:
        half = at // 2
        tree[:, half:at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
        at = half

    nodes = tree.ravel()
    rows = np.flatnonzero(tree[:, 1] < _NONE) if width > 1 else np.zeros(0, np.int64)
    if width == 1:
        return flat[flat >= 0], np.minimum(sizes, 1)
    follow, precede = following.ravel(), preceding.ravel()

    def renew(row: np.ndarray, place: np.ndarray) -> None:
        """The nodes above some leaves, from below."""
        base = row * (2 * width)
        node = (width + place) >> 1
        for _ in range(height):
            two = base + 2 * node
            nodes[base + node] = np.minimum(nodes[two], nodes[two + 1])
            node >>= 1

    def key_of(row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Key of the pair at ``place`` and what follows it."""
        here = row * stride + place
        rank = ranks(flat[here], flat[row * stride + np.minimum(follow[here], width)])
        return np.where(rank < _NONE, rank * stride + place, _NONE)

    while len(rows):
        top = nodes[rows * (2 * width) + 1]
        rank, place = top // stride, top % stride
        here = rows * stride + place
        right = follow[here]
        beyond = follow[rows * stride + right]
        flat[here] = words.merged[rank]
        flat[rows * stride + right] = -1
        follow[here] = beyond
        known = beyond < width
        precede[(rows * stride + beyond)[known]] = place[known]
        gone = right < width
        before = precede[here]
        has = before >= 0
        row = np.concatenate([rows, rows[has], rows[gone]])
        leaf = np.concatenate([place, before[has], right[gone]])
        keyed = len(rows) + int(has.sum())
        key = np.full(len(row), _NONE)
        key[:keyed] = key_of(row[:keyed], leaf[:keyed])
        nodes[row * (2 * width) + width + leaf] = key
        renew(row, leaf)
        rows = rows[nodes[rows * (2 * width) + 1] < _NONE]
    kept = symbols >= 0
    return symbols[kept], kept.sum(axis=1)


class Codec:
    """Encodes texts of Arrow columns and decodes ids; one per task."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.ranks = PairRanks(words.pair_ids)
        self.starts = np.cumsum(words.lengths) - words.lengths
        self.numbered = Numbered(self._resolve, self._reset)
        self._reset()

    def _reset(self) -> None:
        self.ids = np.zeros(0, np.int64)
        self.firsts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.texts: list[str] = []

    def _resolve(self, new: list[bytes]) -> None:
        ids, sizes = merge_pieces(new, self.words, self.ranks)
        ends = np.cumsum(sizes)
        self.firsts = np.concatenate([self.firsts, len(self.ids) + ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        told = list(map(str, ids.tolist()))
        self.texts += [",".join(told[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, each text's bounds, and its ids as decimal
        numbers joined by commas."""
        data, bounds = T.buffer(texts)
        marks = [x for x in self.words.added if x.encode() in data.tobytes()]
        if marks:
            return self._encode_marked(texts, marks)
        pieces, limits = cut(data, bounds)
        numbers = self.numbered(pieces)
        sizes = self.sizes[numbers]
        ids = self.ids[ragged(self.firsts[numbers], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[limits]
        told = list(map(self.texts.__getitem__, numbers.tolist()))
        return ids, ends, [",".join(told[a:b]) for a, b in zip(limits.tolist(), limits[1:].tolist())]

    def _encode_marked(self, texts: pa.Array, marks: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """As encode(), with added tokens in some text: it is cut there."""
        import regex

        pattern = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(marks, key=len, reverse=True)) + ")")
        split = [pattern.split(x or "") for x in texts.to_pylist()]
        plain = pa.array([x for row in split for x in row[::2]], pa.large_string())
        data, bounds = T.buffer(plain)
        pieces, limits = cut(data, bounds)
        numbers = self.numbered(pieces)
        runs = iter([numbers[a:b] for a, b in zip(limits, limits[1:])])
        out = []
        for row in split:
            own = []
            for k, x in enumerate(row):
                if k % 2:
                    own.append(np.array([self.words.added[x]]))
                else:
                    n = next(runs)
                    own.append(self.ids[ragged(self.firsts[n], self.sizes[n])])
            out.append(np.concatenate(own))
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
        return np.concatenate(out), bounds, [",".join(map(str, x.tolist())) for x in out]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; bytes that are no character become U+FFFD."""
        sizes = self.words.lengths[ids]
        raw = self.words.data[ragged(self.starts[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends, ends[1:])]


def _shared(df: DataFrame, words: Vocabulary):
    return df.sparkSession.sparkContext.broadcast(words)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of every whole text in ``out`` (an array of int)."""
    words = _shared(df, Vocabulary.read(path))
    schema = t.StructType([*(f for f in df.schema.fields if f.name != out), t.StructField(out, t.ArrayType(t.IntegerType(), False))])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(words.value)
        for batch in batches:
            for part in T.parts(batch, text):
                ids, bounds, _ = codec.encode(part.column(text))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists], names=[*names, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text that the ids stand for in ``out``; NULL ids: empty."""
    words = _shared(df, Vocabulary.read(path))
    schema = t.StructType([*(f for f in df.schema.fields if f.name != out), t.StructField(out, t.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(words.value)
        for batch in batches:
            lists = [np.array(x or [], dtype=np.int64) for x in batch.column(ids).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *lists])
            texts = pa.array([x.decode() for x in codec.decode(flat, bounds)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), texts], names=[*names, out])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, how many ids its text has, and SHA-256 of the ids and of
    the text decoded from them. Encodes and decodes in one pass over a row, so
    that ids of a long text never leave the task."""
    words = _shared(df, Vocabulary.read(path))
    source = df.select(key, text)
    kind = df.schema[key].dataType
    schema = t.StructType(
        [
            t.StructField(key, kind),
            t.StructField("n_tokens", t.LongType()),
            t.StructField("ids_sha256", t.StringType()),
            t.StructField("decoded_sha256", t.StringType()),
        ]
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(words.value)
        for batch in batches:
            for part in T.parts(batch, text):
                ids, bounds, told = codec.encode(part.column(text))
                back = codec.decode(ids, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in told]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    ],
                    names=names,
                )

    return source.mapInArrow(run, schema)
