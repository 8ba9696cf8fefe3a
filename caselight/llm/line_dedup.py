"""Remove passages of lines that an earlier document, or an earlier place of the
same one, holds too.

Lines are hashed, and a rolling hash over two successive line hashes says where
a chunk ends, so boundaries depend on content alone and text inserted before a
passage does not shift those within it. A line of ``long_words`` or more is a
chunk by itself. A passage seldom begins and ends on a boundary; so that it goes
to its first and last line, the smallest multi-line chunks, two neighbouring
lines, are counted beside the content-defined ones, however short; and so is a
single line of ``passage_words``, or one that is all its text has.

Chunks are counted by hash, with partial counts before the shuffle. The first
occurrence in the order of (key, content, line) stays. Every line of the others
is compared as bytes with the line it repeats, and then removed; a run of such lines of fewer than
``passage_words`` stays, being no passage but two common lines that met, unless
it is the whole document. As a line goes only if an earlier equal line exists,
no line is ever lost altogether.

What is shuffled: chunk hashes (a few numbers a line), then the texts of those
documents only that hold or lend a repeated chunk. They are told from the others
by a broadcast table of hash buckets, at most ``BUCKETS`` rows of one number;
when most buckets are hit, more texts are shuffled and the result is the same.

Defined results: lines are split at \\n; lines without a word are in no chunk
and stay, and the others are numbered without them, so copies may have other
empty lines. A NULL text stays NULL. Rows equal in key and text are one document
and fare alike. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from caselight.llm import text as T
from caselight.storage import written

DIVISOR = 4
MOST_LINES = 16
LEAST_WORDS = 1
LONG_WORDS = 50
PASSAGE_WORDS = 30
BUCKETS = 1 << 19


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def chunks(
    texts: pa.Array,
    least_words: int = LEAST_WORDS,
    long_words: int = LONG_WORDS,
    passage_words: int = PASSAGE_WORDS,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash, first and last line of every chunk. Lines of a chunk follow
    each other but for lines without a word."""
    owner, found, first, last, asks, number, _ = _counted(texts, least_words, long_words, passage_words)
    return owner[asks], found[asks], number[first[asks]], number[last[asks]]


def _counted(
    texts: pa.Array, least_words: int, long_words: int, passage_words: int
) -> tuple[np.ndarray, ...]:
    """As ``chunks``, and with the lines that are no chunk but that a text of one
    line may repeat; then which are chunks. First and last are places in a list
    of all lines with a word; it follows as their numbers within their text, all
    lines counted, and those with a word counted."""
    data, bounds = T.buffer(texts)
    starts, ends = T.spans(data != 0x0A, bounds)
    word_starts, _ = T.words(data, bounds)
    n_words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    starts, ends, n_words = starts[n_words > 0], ends[n_words > 0], n_words[n_words > 0]
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, np.zeros(0, bool), none, none
    owner = np.searchsorted(bounds, starts, side="right") - 1
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    number = breaks[starts] - breaks[bounds[owner]]
    hashes = T.span_hashes(data, starts, ends)

    ends_text = np.ones(n, dtype=bool)
    ends_text[:-1] = owner[1:] != owner[:-1]
    rolling = hashes.copy()
    rolling[1:] += np.where(ends_text[:-1], np.uint64(0), hashes[:-1] * np.uint64(T._BASE))
    long = n_words >= long_words
    cut = ends_text | long | (T.mix(rolling) % np.uint64(DIVISOR) == 0)
    cut[:-1] |= long[1:]
    last_cut = np.maximum.accumulate(np.where(np.concatenate([[True], cut[:-1]]), np.arange(n), 0))
    cut |= (np.arange(n) - last_cut) % MOST_LINES == MOST_LINES - 1
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    first, last = first[last > first], last[last > first]
    pair = np.flatnonzero(~ends_text)
    inner = pair[~np.isin(pair, first[last - first == 1])]
    single = np.arange(n)
    begins_text = np.concatenate([[True], ends_text[:-1]])
    ordinal = single - np.maximum.accumulate(np.where(begins_text, single, 0))
    first, last = np.concatenate([first, inner, single]), np.concatenate([last, inner + 1, single])

    total = np.concatenate([[0], np.cumsum(n_words)])
    size, held = last - first + 1, total[last + 1] - total[first]
    alone = begins_text & ends_text
    asks = np.where(size > 1, held >= least_words, (held >= min(long_words, passage_words)) | alone[first])
    found = np.zeros(len(first), np.uint64)
    for k in range(int(size.max(initial=0))):
        live = size > k
        found[live] = T.mix(found[live] * np.uint64(T._MIX_1) + hashes[first[live] + k])
    return owner[first], T.mix(found + size.astype(np.uint64)), first, last, asks, number, ordinal


def _chunk_rows(docs: DataFrame, key: str, mark: str, text: str, *limits: int) -> DataFrame:
    schema = t.StructType(
        [
            t.StructField("hash", t.LongType()),
            t.StructField("doc", docs.schema[key].dataType),
            t.StructField("mark", t.LongType()),
            t.StructField("first", t.IntegerType()),
            t.StructField("last", t.IntegerType()),
            t.StructField("asks", t.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.parts(batch, text):
                owner, found, first, last, asks, _, ordinal = _counted(part.column(text), *limits)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.view(np.int64)),
                        part.column(key).take(at),
                        part.column(mark).take(at),
                        pa.array(ordinal[first], pa.int32()),
                        pa.array(ordinal[last], pa.int32()),
                        pa.array(asks),
                    ],
                    names=schema.names,
                )

    return docs.select(key, mark, text).mapInArrow(run, schema)


def _repeated_lines(rows: DataFrame) -> DataFrame:
    """(doc, mark, line) of each line of a chunk that stands earlier too, with
    the earliest line (of, of_mark, of_line) it repeats; only lines with a word
    are numbered."""
    earliest = (
        rows.groupBy("hash")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc", "mark", "first", "last")).alias("own"))
        .where("n > 1")
        .select("hash", "own")
    )
    later = rows.where("asks").join(earliest, "hash").where(
        "not (doc <=> own.doc and mark = own.mark and first = own.first) and last - first = own.last - own.first"
    )
    lines = later.select(
        "doc", "mark", "own", F.col("first").alias("from"), F.explode(F.sequence("first", "last")).alias("line")
    )
    of = F.struct(
        F.col("own.doc").alias("of"),
        F.col("own.mark").alias("of_mark"),
        (F.col("own.first") + F.col("line") - F.col("from")).alias("of_line"),
    )
    return lines.groupBy("doc", "mark", "line").agg(F.min(of).alias("own")).select("doc", "mark", "line", "own.*")


def removed_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    long_words: int = LONG_WORDS,
    passage_words: int = PASSAGE_WORDS,
) -> tuple[DataFrame, DataFrame, str]:
    """Documents with a content mark; (doc, mark, gone) with the lines that go
    from each document that loses any, by number among its lines with a word; and
    the mark's name."""
    (mark,) = fresh(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64(key, text))
    rows = written(_chunk_rows(marked, key, mark, text, least_words, long_words, passage_words), "line-chunks")
    repeated = written(_repeated_lines(rows), "repeated-lines")

    lent = repeated.selectExpr("of as doc", "of_mark as mark", "of_line as line").distinct()
    asked = repeated.unionByName(lent, allowMissingColumns=True)
    # One row per document, no longer than its list of lines.
    asked = asked.groupBy("doc", "mark").agg(F.collect_list(F.struct("line", "of", "of_mark", "of_line")).alias("asked"))
    touched, _ = _by_bucket(marked, mark, asked)
    touched = touched.select(F.col(key).alias("k"), F.col(mark).alias("m"), F.col(text).alias("t"))
    texts = touched.join(asked.hint("shuffle_hash"), F.expr("k <=> doc and m = mark"))
    told = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    lines = texts.select("doc", "mark", told.alias("lines"), F.explode("asked").alias("a"))
    lines = written(lines.select("doc", "mark", "a.*", F.get("lines", "a.line").alias("words")), "line-texts")
    ours, theirs = lines.where("of_line is not null"), lines.where("of_line is null")
    theirs = theirs.selectExpr("doc as b", "mark as b_mark", "line as b_line", "words as b_words").distinct()
    equal = ours.join(theirs, F.expr("of <=> b and of_mark = b_mark and of_line = b_line and words = b_words"))
    gone = equal.groupBy("doc", "mark").agg(F.collect_set("line").alias("gone"))
    return marked, written(gone, "removed-lines"), mark


def _by_bucket(docs: DataFrame, mark: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be in ``asked``, and those that are surely not."""
    bucket = "pmod(hash({}), {})"
    hit = F.broadcast(asked.selectExpr(bucket.format("mark", BUCKETS) + " as bucket").distinct())
    here = F.expr(bucket.format(f"`{mark}`", BUCKETS)) == hit["bucket"]
    return docs.join(hit, here, "left_semi"), docs.join(hit, here, "left_anti")


def passages(lines: list[str], repeated: set[int], least: int) -> set[int]:
    """Those of the repeated lines that lie in a run of at least ``least`` words;
    all of them where no other line has a word. Lines without a word do not end a
    run."""
    if all(k in repeated or not line.encode().split() for k, line in enumerate(lines)):
        return repeated
    out: set[int] = set()
    run: list[int] = []
    words = 0
    for k, line in enumerate([*lines, None]):
        n = len(line.encode().split()) if line is not None else 1
        if k in repeated:
            run.append(k)
            words += n
        elif n:
            if words >= least:
                out.update(run)
            run, words = [], 0
    return out


def line_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    long_words: int = LONG_WORDS,
    passage_words: int = PASSAGE_WORDS,
    removed: str | None = None,
) -> DataFrame:
    """``docs`` without repeated passages in ``text``, and with the number of
    lines taken out in ``removed`` if that is named."""
    marked, gone, mark = removed_lines(docs, key, text, least_words, long_words, passage_words)
    touched, rest = _by_bucket(marked, mark, gone)
    lines, of, of_mark = fresh(marked, "gone", "gone_from", "gone_mark")
    gone = gone.select(F.col("doc").alias(of), F.col("mark").alias(of_mark), F.col("gone").alias(lines))
    same = F.col(key).eqNullSafe(F.col(of)) & (F.col(mark) == F.col(of_mark))
    both = touched.join(gone.hint("shuffle_hash"), same, "left").select(*docs.columns, lines)
    kept = [c for c in docs.columns if c != removed]
    schema = t.StructType([docs.schema[c] for c in kept])
    if removed:
        schema = schema.add(removed, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for value, out in zip(batch.column(text).to_pylist(), batch.column(lines).to_pylist()):
                drop: set[int] = set()
                if out:
                    split = value.split("\n")
                    told = [k for k, x in enumerate(split) if x.encode().split()]
                    drop = passages(split, {told[k] for k in out}, passage_words)
                    value = "\n".join(x for k, x in enumerate(split) if k not in drop)
                counts.append(len(drop))
                texts.append(value)
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in kept]
            extra = [pa.array(counts, pa.int64())] if removed else []
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=schema.names)

    changed = both.mapInArrow(run, schema)
    rest = rest.select(*kept, *([F.lit(0).cast("long").alias(removed)] if removed else []))
    return changed.unionByName(rest)
