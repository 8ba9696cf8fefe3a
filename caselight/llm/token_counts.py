"""How many word pieces greedy longest-match makes of every whole text.

The vocabulary is a trie with failure links. At a node where the next byte has
no way on, the longest piece that fits is cut off, and the failure link leads to
the node of what is then left over; how many pieces that cuts off is known
beforehand for every node. So a piece of text is read once, byte by byte, and
only a count is kept - no piece is ever built.

All new pieces of a part are read side by side in numpy arrays, one byte of each
at a step. Nothing is shuffled; the vocabulary is a fixed table of some 50,000
entries, read on the driver and broadcast.

Defined results: a NULL or empty text has 0 pieces. Texts are cut by the
byte-level pattern first; every single byte is in the vocabulary, so every text
can be matched. Added tokens are no word pieces and are read as ordinary text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as t

from caselight.llm import text as T
from caselight.llm.bpe import Vocabulary
from caselight.llm.pretokens import Numbered, Places, cut


@dataclass
class Automaton:
    """Ways on by (node, byte) and where they lead, failure links, pieces cut off
    on a failure, and pieces cut off when the text ends at a node."""

    ways: Places
    targets: np.ndarray
    fail: np.ndarray
    popped: np.ndarray
    at_end: np.ndarray

    @staticmethod
    def build(vocabulary: set[bytes]) -> Automaton:
        """Every byte of every entry must be an entry itself."""
        ways: list[dict[int, int]] = [{}]
        whole = [False]
        for entry in vocabulary:
            node = 0
            for b in entry:
                after = ways[node].get(b)
                if after is None:
                    after = ways[node][b] = len(ways)
                    ways.append({})
                    whole.append(False)
                node = after
            whole[node] = node > 0
        fail = [0] * len(ways)
        popped = [0] * len(ways)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for b, child in ways[parent].items():
                queue.append(child)
                if whole[child]:
                    # The node is a piece: it is cut off and nothing is left.
                    fail[child], popped[child] = 0, 1
                    continue
                # Else follow the parent's failures until the byte has a way on.
                at, cut_off = fail[parent], popped[parent]
                while b not in ways[at]:
                    if at == 0:
                        raise ValueError("a byte of the vocabulary is no entry of it")
                    cut_off += popped[at]
                    at = fail[at]
                fail[child], popped[child] = ways[at][b], cut_off
        at_end = [0] * len(ways)
        for node in range(1, len(ways)):
            at, count = node, 0
            while at:
                count += popped[at]
                at = fail[at]
            at_end[node] = count
        told = [(node << 8 | b, after) for node, own in enumerate(ways) for b, after in own.items()]
        return Automaton(
            Places(np.array([k for k, _ in told], dtype=np.int64)),
            np.array([v for _, v in told], dtype=np.int64),
            np.array(fail, dtype=np.int64),
            np.array(popped, dtype=np.int64),
            np.array(at_end, dtype=np.int64),
        )

    def step(self, nodes: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Where each node's way on by a byte leads; -1 if there is none."""
        place = self.ways(nodes << 8 | following)
        return np.where(place >= 0, self.targets[place], -1)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of greedy longest matches in every piece."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        firsts = (np.cumsum(sizes) - sizes)[order]
        sorted_sizes = -sizes[order]
        nodes = np.zeros(len(pieces), np.int64)
        found = np.zeros(len(pieces), np.int64)
        for place in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(sorted_sizes, -place, side="left"))
            following = data[firsts[:live] + place]
            after = self.step(nodes[:live], following)
            stuck = np.flatnonzero(after < 0)
            while len(stuck):
                at = nodes[stuck]
                if not at.all():
                    raise ValueError("a byte of the text is in no entry of the vocabulary")
                found[stuck] += self.popped[at]
                nodes[stuck] = self.fail[at]
                after[stuck] = self.step(nodes[stuck], following[stuck])
                stuck = stuck[after[stuck] < 0]
            nodes[:live] = after
        found += self.at_end[nodes]
        out = np.zeros(len(pieces), np.int64)
        out[order] = found
        return out


class Counter:
    """Counts word pieces of texts of Arrow columns; one per task."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.numbered = Numbered(self._resolve, self._reset)
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, np.int64)

    def _resolve(self, new: list[bytes]) -> None:
        self.known = np.concatenate([self.known, self.automaton.counts(new)])

    def __call__(self, texts: pa.Array) -> np.ndarray:
        pieces, limits = cut(*T.buffer(texts))
        numbers = self.numbered(pieces)
        own = self.known[numbers]
        return np.diff(np.concatenate([[0], np.cumsum(own)])[limits])


def vocabulary_of(path: str) -> set[bytes]:
    """Entries of a byte-level vocabulary file, without added tokens."""
    told = Vocabulary.read(path)
    raw = told.data.tobytes()
    ends = np.cumsum(told.lengths)
    added = set(told.added.values())
    return {raw[e - n : e] for i, (e, n) in enumerate(zip(ends.tolist(), told.lengths.tolist())) if n and i not in added}


def token_counts(df: DataFrame, path: str, text: str = "text", out: str = "n_pieces") -> DataFrame:
    """``df`` with the number of word pieces of every whole text in ``out``."""
    automaton = df.sparkSession.sparkContext.broadcast(Automaton.build(vocabulary_of(path)))
    schema = t.StructType([*(f for f in df.schema.fields if f.name != out), t.StructField(out, t.LongType())])
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(automaton.value)
        for batch in batches:
            for part in T.parts(batch, text):
                columns = [*(part.column(n) for n in names), pa.array(count(part.column(text)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, out])

    return df.mapInArrow(run, schema)
