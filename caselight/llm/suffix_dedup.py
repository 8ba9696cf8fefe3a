"""Remove every byte that a string of 200 bytes covers which also starts elsewhere.

Repeated strings are found by sorting suffixes over a difference cover
(``difference_cover``). Sorting every suffix of a large corpus moves some forty
bytes for each of its own, so text that cannot be repeated is left out first, and
equal text goes in once, with its count:

1. Windows of 200 bytes whose anchor (``anchors``) occurs once are dropped, first
   by anchors that are 137 bytes long, then, of the rest, by such of 185 bytes.
   What occurs twice is told by a filter of fixed size; it may keep too much,
   never too little, so a corpus that fills it up costs time and nothing else.
2. The windows left are cut into pieces at places that content names, their
   outermost ones into pieces of their own. Equal pieces are counted as one. A
   piece that has no anchor in common with a different one is alone with its
   strings: they are repeated if the piece is, as its count says.
3. The other pieces are cut into groups, the windows that share an anchor, and
   equal groups are counted as one. What is left are groups that have an anchor in
   common with a different one, where a passage begins, ends or was changed. Of
   these go the windows that a third filter, of whole windows, knows to be single.
4. The suffixes of these groups are sorted, and the prefixes of neighbours
   compared. A string's count is the sum of the groups it starts in.

What is found goes back by piece to all places where the piece stands, and by a
digest of the text to the documents. Only texts that lose something are shuffled.

Defined results: strings are judged on the input, not on what is left; they never
span two documents; overlaps and repeats within a document count. A NULL text is
empty. Rows are documents: a repeated row is a copy, and all copies of 200 bytes
or more are removed whole. Texts may be of any length, as arrays are bounded by
slices of 2^18 windows; what is left of a text is made in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm import anchors as A
from caselight.llm import text as T
from caselight.llm.difference_cover import LENGTH, repeated_starts
from caselight.llm.line_dedup import fresh
from caselight.storage import release_shuffles, scratch_path, written

COARSE = 64
FINE = 16
CUT = 16


def _wanted(s: A.Slice, coarse: A.Filter) -> np.ndarray:
    """Windows whose coarse anchor may be repeated."""
    h, at = s.anchors(COARSE)
    first, last = A.groups(at, s.usable)
    keep = coarse.may_hold(h[at[first]])
    return _covered(first[keep], last[keep], len(s.usable))


def _covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last + 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _distinct_places(at: np.ndarray) -> np.ndarray:
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int, A.Slice]]:
    for part in T.parts(batch, text, A.SLICE):
        data, bounds = T.buffer(part.column(text))
        for at, s in A.slices(data, bounds, LENGTH):
            yield part, bounds, at, s


def _pieces(s: A.Slice, coarse: A.Filter, fine: A.Filter) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of every piece of a slice."""
    h, at = s.anchors(FINE)
    first, last = A.groups(at, _wanted(s, coarse))
    found = h[at[first]]
    keep = fine.may_hold(found)
    first, last, found = first[keep], last[keep], found[keep]
    n = len(first)
    if not n:
        return first, last
    begins = np.ones(n, dtype=bool)
    begins[1:] = first[1:] != last[:-1] + 1
    run = np.cumsum(begins) - 1
    run_first, run_last = first[begins], last[np.append(np.flatnonzero(begins)[1:], n) - 1]
    outer = (first - run_first[run] < FINE) | (run_last[run] - last < FINE)
    cut = begins | (~outer & (found >> np.uint64(8) & np.uint64(CUT - 1) == 0))
    cut[1:] |= outer[1:] != outer[:-1]
    begin = np.flatnonzero(cut)
    return first[begin], last[np.append(begin[1:], n) - 1]


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)], dtype=np.int64)


def _groups_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Of pieces, the windows that share a fine anchor: hash of the anchor, owner,
    place of the first in the piece, how many, and all bytes; some at a time."""
    data, bounds = _joined(column)
    for at, s in A.slices(data, bounds, LENGTH):
        h, places = s.anchors(FINE)
        first, last = A.groups(places, s.usable)
        owner = np.searchsorted(bounds, at + first, side="right") - 1
        yield h[places[first]], owner, at + first - bounds[owner], last - first + 1, s.data[first[0] :].tobytes()


def _window_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, owner and place of every window of short texts."""
    data, bounds = _joined(column)
    at = np.arange(len(data))
    owner = np.searchsorted(bounds, at, side="right") - 1
    at, owner = at[bounds[owner + 1] - at >= LENGTH], owner[bounds[owner + 1] - at >= LENGTH]
    return T.span_hashes(data, at, at + LENGTH), owner, at - bounds[owner]


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(mark_1, mark_2, found): for each text that loses something, by the
    two marks of its content, pieces (first, starts, runs) with the windows in
    them that are repeated; all of them where ``runs`` is NULL."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def coarse_anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, _, s in _slices(batch, "text"):
            h, at = s.anchors(COARSE)
            yield h[_distinct_places(at[s.usable])]

    coarse = spark.sparkContext.broadcast(A.repeated(texts, coarse_anchors, 2 * total // COARSE))

    def fine_anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, _, s in _slices(batch, "text"):
            h, at = s.anchors(FINE)
            yield h[_distinct_places(at[_wanted(s, coarse.value)])]

    fine = spark.sparkContext.broadcast(A.repeated(texts, fine_anchors, 2 * total // COARSE))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mark_1", "mark_2", "first", "starts", "piece", "bytes"]
        for batch in batches:
            for part, bounds, at, s in _slices(batch, "text"):
                first, last = _pieces(s, coarse.value, fine.value)
                if not len(first):
                    continue
                owner = np.searchsorted(bounds, at + first, side="right") - 1
                raw = s.data.tobytes()
                held = [raw[a : z + LENGTH] for a, z in zip(first.tolist(), last.tolist())]
                place = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("mark_1").take(place),
                        part.column("mark_2").take(place),
                        pa.array(at + first - bounds[owner]),
                        pa.array(last - first + 1, pa.int32()),
                        pa.array([xxhash.xxh3_128_digest(x) for x in held], pa.binary()),
                        pa.array(held, pa.binary()),
                    ],
                    names=names,
                )

    marked = texts.select("text", *_marks("text"))
    pieces = marked.mapInArrow(cut, "mark_1 long, mark_2 long, first long, starts int, piece binary, bytes binary")
    path = scratch_path(spark, "pieces")
    pieces.write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(pieces.schema).parquet(path)

    # Equal bytes, not only equal names, are one piece.
    distinct = written(pieces.groupBy("piece", "bytes").agg(F.count("*").alias("n")), "distinct-pieces")
    release_shuffles(spark)
    found = _found_in(distinct)
    places = pieces.select("mark_1", "mark_2", "first", "starts", "piece").distinct().join(found, "piece")
    each = F.struct("first", "starts", "runs")
    return places.groupBy("mark_1", "mark_2").agg(F.collect_set(each).alias("found"))


def _shared_anchors(texts: DataFrame, total: int) -> A.Filter:
    """Fine anchors that stand at two places of ``bytes`` or more."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for h, *_ in _groups_of(batch.column("bytes")):
            yield h

    return A.repeated(texts.select("bytes"), hashes, total // FINE)


def _found_in(distinct: DataFrame) -> DataFrame:
    """(piece, runs): pieces that have repeated windows, and which; all where
    ``runs`` is NULL. ``distinct`` has each piece once, with its count."""
    spark = distinct.sparkSession
    size = distinct.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shared = spark.sparkContext.broadcast(_shared_anchors(distinct, size))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups of pieces that have an anchor in common with others."""
        for batch in batches:
            known = list(_groups_of(batch.column("bytes")))
            hard = np.zeros(batch.num_rows, dtype=bool)
            for h, owner, *_ in known:
                hard[owner[shared.value.may_hold(h)]] = True
            held = batch.column("bytes").to_pylist()
            for h, owner, first, n, _ in known:
                keep = hard[owner]
                h, owner, first, n = h[keep], owner[keep], first[keep], n[keep]
                spans = zip(owner.tolist(), first.tolist(), n.tolist())
                names = [xxhash.xxh3_128_digest(held[o][a : a + m + LENGTH - 1]) for o, a, m in spans]
                place = pa.array(owner)
                columns = [
                    pa.array(names, pa.binary()), pa.array(h.view(np.int64)), batch.column("piece").take(place),
                    pa.array(first), pa.array(n), batch.column("n").take(place),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "anchor", "piece", "first", "size", "n"])

    schema = "name binary, anchor long, piece binary, first long, size long, n long"
    grouped = written(distinct.select("piece", "bytes", "n").mapInArrow(groups, schema), "anchor-groups")
    one = F.min(F.struct("piece", "first", "size", "anchor")).alias("one")
    counted = written(grouped.groupBy("name").agg(F.sum("n").alias("weight"), one), "equal-groups")
    release_shuffles(spark)

    # Of a group that stands twice every window is repeated.
    again = grouped.where("n = 1").join(counted.where("weight > 1").select("name"), "name")
    again = again.select("piece", "first", (F.col("first") + F.col("size") - 1).alias("last"))

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column("anchor").to_numpy().view(np.uint64)

    unlike = counted.select("name", "weight", "one.*")
    contested = spark.sparkContext.broadcast(A.repeated(unlike.select("anchor"), anchors, size // FINE))

    def still(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(contested.value.may_hold(batch.column("anchor").to_numpy().view(np.uint64))))

    asked = unlike.mapInArrow(still, unlike.schema)
    # One row of bytes a group, and no piece has more groups than it is long.
    texts = asked.join(distinct.select("piece", F.col("bytes").alias("whole")), "piece")
    begin = F.substring("whole", F.col("first").cast("int") + 1, F.col("size").cast("int") + LENGTH - 1)
    texts = written(texts.select("name", "weight", "piece", "first", begin.alias("bytes")), "contested-groups")

    def windows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _window_hashes(batch.column("bytes"))[0]

    many = texts.agg(F.sum(F.octet_length("bytes") - LENGTH + 1)).first()[0] or 0
    twice = spark.sparkContext.broadcast(A.repeated(texts.select("bytes"), windows, many))

    names = texts.columns

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups from the first to the last window that may stand in another."""
        for batch in batches:
            h, owner, place = _window_hashes(batch.column("bytes"))
            keep = twice.value.may_hold(h)
            owner, place = owner[keep], place[keep]
            edges = np.flatnonzero(np.diff(owner, prepend=-1, append=batch.num_rows))
            rows, first, last = owner[edges[:-1]], place[edges[:-1]], place[edges[1:] - 1]
            held = batch.column("bytes").to_pylist()
            cut = [held[o][a : z + LENGTH] for o, a, z in zip(rows.tolist(), first.tolist(), last.tolist())]
            at = pa.array(rows)
            columns = [batch.column(c).take(at) for c in ("name", "weight", "piece")]
            begins = pa.array(batch.column("first").to_numpy()[rows] + first)
            yield pa.RecordBatch.from_arrays([*columns, begins, pa.array(cut, pa.binary())], names=names)

    left = written(texts.mapInArrow(trimmed, texts.schema), "trimmed-groups")
    release_shuffles(spark)
    size = left.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    parts = again
    if size:
        found = repeated_starts(left.selectExpr("name as piece", "bytes", "weight as n"), size)
        # What stands twice as a whole needs no answer.
        mine = left.where("weight = 1").select("name", "piece", "first")
        told = mine.join(found.select(F.col("piece").alias("name"), "runs"), "name")
        each = told.select("piece", F.explode("runs").alias("run"), F.col("first").alias("at"))
        spans = each.selectExpr("piece", "at + run.first as first", "at + run.last as last")
        parts = parts.unionByName(spans)
    runs = parts.groupBy("piece").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    kind = runs.schema["runs"].dataType
    whole = distinct.where("n > 1").select("piece", F.lit(None).cast(kind).alias("runs"))
    return written(whole.unionByName(runs), "found-pieces")


def _marks(text: str):
    return F.xxhash64(text).alias("mark_1"), F.xxhash64(F.lit(1), F.col(text)).alias("mark_2")


def without_repeats(
    docs: DataFrame, text: str = "text", kept: str = "kept", spans: str = "spans", buckets: int = 1 << 19
) -> DataFrame:
    """``docs`` with the bytes of ``text`` that stay in ``kept`` (binary: a cut
    may fall within a character), and the maximal removed runs in ``spans``, as
    pairs of the first byte and the first behind it. Columns of those names are
    replaced; all others pass through."""
    found = written(repeated_spans(docs, text), "repeated-spans")
    others = [c for c in docs.columns if c.lower() not in (kept.lower(), spans.lower())]
    docs = docs.select(*others)
    raw, mark_1, mark_2, list_of = fresh(docs, "raw", "mark_1", "mark_2", "found")
    marked = docs.withColumn(raw, F.coalesce(F.col(text), F.lit("")))
    marked = marked.withColumns(dict(zip((mark_1, mark_2), _marks(raw))))
    bucket = "pmod(hash({}), {})"
    hit = F.broadcast(found.selectExpr(bucket.format("mark_1", buckets) + " as bucket").distinct())
    here = F.expr(bucket.format(f"`{mark_1}`", buckets)) == hit["bucket"]
    touched, rest = marked.join(hit, here, "left_semi"), marked.join(hit, here, "left_anti")
    found = found.select(F.col("mark_1").alias("m1"), F.col("mark_2").alias("m2"), F.col("found").alias(list_of))
    same = (F.col(mark_1) == F.col("m1")) & (F.col(mark_2) == F.col("m2"))
    joined = touched.join(found, same, "left").select(*others, raw, list_of)
    kind = "array<struct<first:bigint,last:bigint>>"
    schema = docs.select(*others).withColumn(kept, F.lit(b"")).withColumn(spans, F.lit(None).cast(kind)).schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, gone = [], []
            for value, pieces in zip(batch.column(raw), batch.column(list_of)):
                data = value.as_py().encode()
                runs = _removed(pieces.as_py() or [])
                at, out = 0, []
                for first, last in runs:
                    out.append(data[at:first])
                    at = last
                left.append(b"".join([*out, data[at:]]))
                gone.append([{"first": a, "last": z} for a, z in runs])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            columns = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(left, pa.binary()), pa.array(gone, kind)], names=schema.names)

    changed = joined.mapInArrow(remove, schema)
    same_text = rest.select(*others, F.col(raw).cast("binary").alias(kept), F.array().cast(kind).alias(spans))
    return changed.unionByName(same_text)


def _removed(pieces: list[dict]) -> list[tuple[int, int]]:
    """Byte spans that the repeated windows cover, joined where they touch."""
    spans = []
    for p in pieces:
        runs = [(0, p["starts"] - 1)] if p["runs"] is None else [(r["first"], r["last"]) for r in p["runs"]]
        spans.extend((p["first"] + a, p["first"] + z + LENGTH) for a, z in runs)
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out
