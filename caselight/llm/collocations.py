"""Phrases whose words meet more often than their parts would have it.

Counts come from depth-truncated suffix trees, partitioned vertically. A suffix
is a word and up to three behind it in its piece. Word prefixes are counted
first; one with more suffixes than the memory budget is extended by a further
word, and its extensions counted, until each fits. All suffixes are then dealt to
groups of prefixes, each group about as large as the budget, by ranges of the
prefix's hash; every group builds its subtrees by itself: it sorts its suffixes,
whose equal ones are leaves with a total, and reads the count of each node from
the totals of the leaves below. Only a prefix over budget has suffixes in several
groups; its counts are added up at the end.

Each task merges equal suffixes before it sends them, so a phrase in a third of
all rows costs a row a task. Words under the least count are in no phrase that
counts; a filter of fixed size leaves most of them out, and if a corpus fills it
up, more suffixes are sent and the result is the same. Words go by a hash of 64
bits; that no two of them share one is checked, and another seed taken if they do.

Defined results: a NULL text is empty, a NULL language ``und``. A repeated row
counts again. A table without a phrase that counts gives no rows. Texts may be
of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm import text as T
from caselight.llm.anchors import BITS, Filter, packed, unpacked
from caselight.llm.difference_cover import _restored, _squeezed
from caselight.storage import written

DEPTH = 4
LEAST = 30
TOP = 2000
BUDGET = 1 << 20
_FLUSH = 1 << 20
_WORDS = 1 << 18

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[0x20, 0x09]] = True


class _Words:
    """The words of some texts: their bytes, a hash with the language in it, and
    which of them begin a piece."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        data, bounds = T.buffer(batch.column("text"))
        self.data = T.ascii_lower(data)
        self.starts, self.ends = T.spans(~_BETWEEN[self.data], bounds)
        owner = np.searchsorted(bounds, self.starts, side="right") - 1
        coded = batch.column("lang").dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy()[owner]
        marks = np.array([xxhash.xxh64_intdigest(x, seed) for x in self.langs], dtype=np.uint64)
        table = T.mix(np.arange(256, dtype=np.uint64) + np.uint64((seed + 1) * T._MIX_2 & 0xFFFFFFFFFFFFFFFF))
        up, down = T._powers(1 << max(21, len(data).bit_length()))
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[self.data] * up[: len(data)], out=total[1:])
        found = (total[self.ends] - total[self.starts]) * down[self.starts]
        self.ids = T.mix(found + marks[self.lang]) if len(found) else found
        self.ids[self.ids == 0] = 1
        breaks = np.concatenate([[0], np.cumsum(_ENDS[self.data])])[self.starts]
        self.begins = np.ones(len(self.starts), dtype=bool)
        self.begins[1:] = (np.diff(breaks) > 0) | (np.diff(owner) > 0)


def _word_rows(docs: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        words: dict[int, tuple[str, str]] = {}

        def flush() -> pa.RecordBatch:
            ids = list(counts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([words[i][0] for i in ids], pa.string()),
                    pa.array([words[i][1] for i in ids], pa.string()),
                    pa.array(np.array(ids, dtype=np.uint64).view(np.int64)),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                names=["lang", "word", "id", "n"],
            )

        for batch in batches:
            for part in T.parts(batch, "text"):
                w = _Words(part, seed)
                ids, at, n = np.unique(w.ids, return_index=True, return_counts=True)
                raw, first, last = w.data.tobytes(), w.starts[at].tolist(), w.ends[at].tolist()
                for k, (i, more) in enumerate(zip(ids.tolist(), n.tolist())):
                    if i in counts:
                        counts[i] += more
                    else:
                        counts[i] = more
                        words[i] = (w.langs[w.lang[at[k]]], raw[first[k] : last[k]].decode())
                if len(counts) >= _WORDS:
                    yield flush()
                    counts.clear()
                    words.clear()
        if counts:
            yield flush()

    return docs.mapInArrow(run, "lang string, word string, id long, n long")


def word_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, id, n) of every word, and the seed by which no two of them
    have one id."""
    for seed in range(8):
        rows = _word_rows(docs, seed)
        words = written(rows.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")), "words")
        name = F.struct("lang", "word")
        shared = words.groupBy("id").agg(F.min(name).alias("a"), F.max(name).alias("b")).where("a <> b")
        if shared.isEmpty():
            return words, seed
    raise RuntimeError("words share hashes whatever the seed")


def _filter_of(ids: DataFrame) -> Filter:
    """The bits of ``id``; a number for each 64 of them comes to the driver."""
    place = ids.select(F.shiftrightunsigned("id", 64 - BITS).alias("place"))
    each = F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))")
    told = place.groupBy(F.expr("cast(place div 64 as int)").alias("at")).agg(each.alias("bits")).toArrow()
    bits = np.zeros((1 << BITS) // 64, dtype=np.int64)
    bits[told.column("at").to_numpy()] = told.column("bits").to_numpy()
    return Filter(bits.view(np.uint8))


def _suffixes(w: _Words, frequent: Filter) -> np.ndarray:
    """A row of ids for each suffix of two words and more, 0 behind its end."""
    usable = frequent.may_hold(w.ids)
    n = len(w.ids)
    out = np.zeros((n, DEPTH), dtype=np.uint64)
    out[:, 0] = np.where(usable, w.ids, np.uint64(0))
    for k in range(1, min(DEPTH, n)):
        goes_on = (out[: n - k, k - 1] != 0) & ~w.begins[k:] & usable[k:]
        out[: n - k, k] = np.where(goes_on, w.ids[k:], np.uint64(0))
    return out[out[:, 1] != 0]


def _prefix_keys(rows: np.ndarray) -> list[np.ndarray]:
    """A hash for each suffix's first word, first two, and so on; that of a
    shorter suffix is the one of all it has."""
    keys = [rows[:, 0]]
    for k in range(1, rows.shape[1]):
        longer = T.mix(keys[-1] * np.uint64(T._BASE) + rows[:, k])
        keys.append(np.where(rows[:, k] != 0, longer, keys[-1]))
    return keys


def _levels(keys: list[np.ndarray], over: list[np.ndarray]) -> np.ndarray:
    """How many words of each suffix name its group: one more than there are
    prefixes over budget, of one word, two, and so on, that it begins with."""
    level = np.ones(len(keys[0]), dtype=np.int64)
    for k, hot in enumerate(over):
        level[(level == k + 1) & np.isin(keys[k], hot)] = k + 2
    return level


def _prefixes_over(docs: DataFrame, seed: int, frequent, over: list[np.ndarray], budget: int) -> np.ndarray:
    """Hashes of those prefixes over budget that extend the last of ``over``."""
    depth = len(over)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.parts(batch, "text"):
                rows = _suffixes(_Words(part, seed), frequent.value)
                keys = _prefix_keys(rows)
                asked = (_levels(keys, over) == depth + 1) & (rows[:, depth] != 0)
                found, n = np.unique(keys[depth][asked], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["key", "n"])

    counted = docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    told = counted.where(F.col("n") > budget).select("key").toArrow()
    return np.sort(told.column("key").to_numpy().view(np.uint64))


def phrase_counts(docs: DataFrame, words: DataFrame, seed: int, least: int, budget: int) -> DataFrame:
    """(ids, n): phrases of two to four words, as arrays of ids, that come
    ``least`` times or more."""
    spark = docs.sparkSession
    some = words.where(F.col("n") >= least)
    total = some.agg(F.sum("n")).first()[0] or 0
    # As many prefixes as there are can be over budget if it is a share of all.
    budget = max(budget, total >> 22)
    frequent = spark.sparkContext.broadcast(_filter_of(some))
    hot = some.where(F.col("n") > budget).select("id").toArrow().column("id").to_numpy().view(np.uint64)
    over = []
    while len(hot) and len(over) < DEPTH - 1:
        over.append(np.sort(hot))
        if len(over) < DEPTH - 1:
            hot = _prefixes_over(docs, seed, frequent, over, budget)
    n_groups = max(1, -(-total // budget))

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        keys = _prefix_keys(rows)
        level = _levels(keys, over)
        key = np.choose(np.minimum(level, DEPTH) - 1, keys)
        group = ((key >> np.uint64(32)) * np.uint64(n_groups) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((*rows.T[::-1], group))
        rows, group, level = rows[order], group[order], level[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        n = np.diff(first, append=len(rows))
        rows, group, level = rows[first], group[first], level[first]
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=n_groups)).tolist()
        sent = []
        for a, z in zip(edges, edges[1:]):
            ids, codes = np.unique(rows[a:z], return_inverse=True)
            table = np.column_stack([codes.reshape(z - a, DEPTH), n[a:z], level[a:z]])
            sent.append((int(group[a]), z - a, len(ids), packed(ids), _squeezed(table)))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = [pa.array([x[k] for x in sent], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["part", "size", "n_ids", "ids", "suffixes"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in T.parts(batch, "text"):
                held.append(_suffixes(_Words(part, seed), frequent.value))
                size += len(held[-1])
                if size >= _FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def count(table: pa.Table) -> pa.Table:
        rows, leaves, level = [], [], []
        for x in table.to_pylist():
            ids = unpacked(x["ids"], x["n_ids"])
            coded = _restored(x["suffixes"], x["size"], DEPTH + 2).astype(np.int64)
            rows.append(ids[coded[:, :DEPTH]])
            leaves.append(coded[:, DEPTH])
            level.append(coded[:, DEPTH + 1])
        rows, leaves, level = np.concatenate(rows), np.concatenate(leaves), np.concatenate(level)
        order = np.lexsort(rows.T[::-1])
        rows, leaves, level = rows[order], leaves[order], level[order]
        branches = np.ones(len(rows), dtype=bool)
        out_ids, out_n = [], []
        for depth in range(1, DEPTH + 1):
            branches[1:] = (rows[1:, :depth] != rows[:-1, :depth]).any(axis=1)
            if depth == 1:
                continue
            first = np.flatnonzero(branches)
            n = np.add.reduceat(leaves, first)
            here = rows[first, depth - 1] != 0
            keep = here & ((n >= least) | (level[first] > depth))
            out_ids.extend(rows[first[keep], :depth].view(np.int64).tolist())
            out_n.extend(n[keep].tolist())
        return pa.table({"ids": pa.array(out_ids, pa.list_(pa.int64())), "n": pa.array(out_n, pa.int64())})

    sent = docs.mapInArrow(send, "part int, size int, n_ids int, ids binary, suffixes binary")
    counted = sent.groupBy("part").applyInArrow(count, "ids array<bigint>, n bigint")
    return counted.groupBy("ids").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _parts_of(size: int) -> str:
    """The cuts of ``ids`` of that size: after one word, two, and so on."""
    cuts = (f"struct({k} as k, slice(ids, 1, {k}) as left, slice(ids, {k + 1}, {size - k}) as right)" for k in range(1, size))
    return f"array({', '.join(cuts)})"


def _inner_of(size: int) -> str:
    """Shorter phrases of two words and more within ``ids`` of that size."""
    inner = (f"slice(ids, {a}, {n})" for n in range(2, size) for a in range(1, size - n + 2))
    return f"array({', '.join(inner)})"


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    budget: int = BUDGET,
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n
    and score."""
    told = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words, seed = word_counts(told)
    counts = written(phrase_counts(told, words, seed, least, budget), "phrase-counts")

    known = counts.unionByName(words.where(F.col("n") >= least).select(F.array("id").alias("ids"), "n"))
    known = written(known, "known-counts")
    cuts = F.expr(f"case size(ids) when 2 then {_parts_of(2)} when 3 then {_parts_of(3)} else {_parts_of(4)} end")
    cut = counts.select("ids", F.col("n").alias("a"), F.explode(cuts).alias("cut")).select("ids", "a", "cut.*")
    cut = cut.join(known.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left")
    cut = cut.join(known.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right")
    # Decimals, as the product may pass 64 bits; div leaves whole numbers.
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("lowest")
    scored = cut.groupBy("ids", "a").agg(lowest).select("ids", "a", "lowest.score", "lowest.l", "lowest.r")

    inner = F.expr(f"case size(ids) when 3 then {_inner_of(3)} else {_inner_of(4)} end")
    within = counts.where("size(ids) > 2").select(F.explode(inner).alias("ids"), F.col("n").alias("longer"))
    within = within.groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = scored.join(within, "ids", "left").where("longer is null or longer * decimal(100) < a * decimal(80)").drop("longer")

    ids = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelt = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    spelt = ids.groupBy("ids").agg(F.min("lang").alias("lang"), spelt.alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(spelt, "ids").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
