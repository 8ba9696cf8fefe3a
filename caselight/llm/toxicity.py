"""Toxicity by learning from confirmed toxic examples and unlabelled text.

What is known is a set of toxic texts, and any amount of text that may or may
not be. A linear classifier in numpy is fitted to the non-negative risk of
positive and unlabelled examples: with class prior p, toxic texts stand for p of
all text and the part of the unlabelled risk that they explain is taken off it;
where that would leave less than nothing, the step goes back instead. With the
logistic loss the score is a probability.

A text is the set of its words, and of the beginnings (of 4 to 6 bytes) of
longer ones, all hashed to 22 bits, so that unseen forms of a known stem count.
Candidates for weights are those that make a text toxic with a chance of
``LEAST_POSTERIOR`` by themselves and are in ``LEAST_SHARE`` of the toxic texts,
counted in tasks over both samples; only those reach the driver.

Samples are bounded: ``POSITIVES`` toxic texts, fetched by a broadcast of their
keys, and about ``UNLABELLED`` of all, whatever their labels. Every text is
scored whole, where it is read.

Defined results: NULL and empty texts have no words and get the score of the
offset alone; with no toxic example to learn from every score is 0. A label
counts once for each key; NULL labels and keys count as none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from caselight.llm import samples
from caselight.llm import text as T
from caselight.storage import written

POSITIVES = 4_000
UNLABELLED = 12_000
CANDIDATES = 20_000
LEAST_COUNT = 3
LEAST_SHARE = 0.01
LEAST_POSTERIOR = 0.75
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6)
_BITS = 22

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(0x80, 0x100)]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hashed word or beginning), repeats included."""
    data, bounds = T.buffer(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends = T.spans(_LETTER[data], bounds)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    places, found = [owner], [T.span_hashes(data, starts, ends)]
    for size in BEGINNINGS:
        longer = ends - starts > size
        first = starts[longer]
        places.append(owner[longer])
        found.append(T.mix(T.span_hashes(data, first, first + size) + np.uint64(size)))
    return np.concatenate(places), (np.concatenate(found) >> np.uint64(64 - _BITS)).astype(np.int64)


def fit_weights(
    positive: tuple[np.ndarray, np.ndarray, int],
    unlabelled: tuple[np.ndarray, np.ndarray, int],
    width: int,
    prior: float,
    steps: int = 400,
    rate: float = 0.1,
    decay: float = 1e-4,
    slack: float = 0.0,
) -> tuple[np.ndarray, float]:
    """Weights and offset of least non-negative risk. Examples are given as
    (row, column) places of ones, and the number of rows."""
    weights = np.zeros(width + 1)
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros(width + 1), np.zeros(width + 1)

    def level(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, weights=weights[columns], minlength=n) + weights[-1]

    def back(slope: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out = np.empty(width + 1)
        out[:-1] = np.bincount(columns, weights=slope[rows], minlength=width)
        out[-1] = slope.sum()
        return out

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(x / 2))

    for step in range(1, steps + 1):
        p, u = level(*positive), level(*unlabelled)
        # Risk of calling unlabelled text clean, less the toxic text within it.
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        slope = back(sigmoid(u) / len(u), *unlabelled[:2]) - back(prior * sigmoid(p) / len(p), *positive[:2])
        if negative < -slack:
            slope = -slope
        else:
            slope += back(-prior * sigmoid(-p) / len(p), *positive[:2])
        slope[:-1] += decay * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


class Model:
    """Weights of hashed features, by ascending feature, and the offset."""

    def __init__(self, columns: np.ndarray, weights: np.ndarray, offset: float):
        self.columns, self.weights, self.offset = columns, weights, offset

    @staticmethod
    def fit(
        docs: DataFrame,
        labels: DataFrame,
        key: str = "doc_id",
        text: str = "text",
        label: str = "toxic",
        positives: int = POSITIVES,
        unlabelled: int = UNLABELLED,
        candidates: int = CANDIDATES,
        prior: float | None = None,
    ) -> Model | None:
        """None without a toxic example. ``prior`` is the share of toxic text;
        unless given, that among the labels one may learn from, less a standard
        error: a prior too high would take more off the risk than there is."""
        known = samples.learnable(labels.select(F.col(key).alias("key"), F.col(label).alias("y")), "key")
        known = known.where("y is not null").groupBy("key").agg(F.max("y").alias("y"))
        told = known.agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("toxic")).first()
        if not told["toxic"]:
            return None
        if prior is None:
            share = told["toxic"] / told["n"]
            prior = max(share / 2, share - np.sqrt(share * (1 - share) / told["n"]))
        prior = min(0.99, prior)
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
        rows = samples.learnable(rows, "key")
        total = rows.count()
        # At most ``positives`` keys, so their number bounds the broadcast.
        keys = known.where("y = 1").orderBy(F.xxhash64("key", F.lit("toxic")), "key").limit(positives).select("key")
        toxic = rows.join(F.broadcast(keys), "key").withColumn("toxic", F.lit(1))
        sampled = samples.about(rows, "key", F.lit(min(1.0, unlabelled / max(total, 1)))).withColumn("toxic", F.lit(0))
        both = written(toxic.unionByName(sampled).select("text", "toxic"), "toxicity-sample")
        sizes = {r["toxic"]: r["n"] for r in both.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not sizes.get(1) or not sizes.get(0):
            return None
        counts = both.mapInArrow(_count_features, "feature long, toxic int, n long")
        counts = counts.groupBy("feature").agg(
            F.sum(F.expr("if(toxic = 1, n, 0)")).alias("p"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("u")
        )
        lift = (F.col("p") / sizes[1]) / ((F.col("u") + 1) / sizes[0])
        chosen = counts.where(F.col("p") >= max(LEAST_COUNT, LEAST_SHARE * sizes[1])).withColumn("lift", lift)
        chosen = chosen.where(F.col("lift") >= LEAST_POSTERIOR / prior)
        top = chosen.orderBy(F.desc(F.col("p") * F.log("lift")), "feature").limit(candidates).select("feature").collect()
        columns = np.sort(np.array([r[0] for r in top], dtype=np.int64))
        places = _places(both, columns)
        weights, offset = fit_weights(*places, len(columns), prior)
        return Model(columns, weights, offset)

    def scores(self, texts: pa.Array) -> np.ndarray:
        place, found = features(texts)
        level = np.full(len(texts), self.offset)
        if len(self.columns):
            slot = np.minimum(np.searchsorted(self.columns, found), len(self.columns) - 1)
            hit = self.columns[slot] == found
            pair = np.unique(place[hit] * len(self.columns) + slot[hit])
            level += np.bincount(pair // len(self.columns), self.weights[pair % len(self.columns)], minlength=len(texts))
        return 0.5 * (1 + np.tanh(level / 2))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a part each feature is, apart for toxic and others."""
    for batch in batches:
        for part in T.parts(batch, "text"):
            place, found = features(part.column("text"))
            pair = np.unique(place << _BITS | found)
            toxic = part.column("toxic").to_numpy()[pair >> _BITS].astype(np.int64)
            both, n = np.unique(toxic << _BITS | pair & (1 << _BITS) - 1, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both & (1 << _BITS) - 1), pa.array(both >> _BITS, pa.int32()), pa.array(n)],
                names=["feature", "toxic", "n"],
            )


def _places(both: DataFrame, columns: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Candidates in each text of the samples, toxic ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.parts(batch, "text"):
                place, found = features(part.column("text"))
                slot = np.minimum(np.searchsorted(columns, found), max(0, len(columns) - 1))
                hit = columns[slot] == found if len(columns) else np.zeros(len(found), bool)
                pair = np.unique(place[hit] << 32 | slot[hit])
                edges = np.searchsorted(pair >> 32, np.arange(part.num_rows + 1))
                held = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(pair & 0xFFFFFFFF, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), held], names=["toxic", "held"])

    found = both.mapInArrow(run, "toxic int, held array<int>").toArrow()
    out = []
    for kind in (1, 0):
        own = found.filter(pc.equal(found["toxic"], kind))["held"].combine_chunks()
        sizes = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
        out.append((np.repeat(np.arange(len(own)), sizes), own.flatten().to_numpy().astype(np.int64), len(own)))
    return out


def score(
    docs: DataFrame,
    model: Model | None,
    text: str = "text",
    out: str = "score",
    predicted: str = "predicted",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with the probability that ``text`` is toxic, and 1 where it is
    ``threshold`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in (out, predicted)]
    schema = t.StructType([*fields, t.StructField(out, t.DoubleType()), t.StructField(predicted, t.IntegerType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            for part in T.parts(batch, text):
                found = known.scores(part.column(text)) if known else np.zeros(part.num_rows)
                columns = [*(part.column(n) for n in names), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
