"""Language of every text by string kernels.

Two texts are as like as the byte n-grams (of two to four bytes) that both hold,
each counted once: a blended-spectrum presence kernel, scaled to 1 for equal
texts. Landmark texts of every language span the space (Nystroem): a text
becomes its kernel values with them, whitened, and one ridge regression for each
language against the rest gives the scores. N-grams are hashed to ``BUCKETS``, so
a text is a row of zeros and ones, and a batch's scores are two matrix products.

Landmarks and regression learn from bounded samples (``per_language`` texts of
each); the sums the regression needs are made in tasks and added up, so the
driver holds matrices of landmarks by landmarks only. Every text is scored
whole, where it is read.

Defined results: a text that is NULL or has no letter is ``und`` with score 0,
as is every text if there is nothing to learn from. Equal scores go to the
language first in order. Rows with a NULL key or language are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.window import Window

from caselight.llm import samples
from caselight.llm import text as T
from caselight.storage import written

SIZES = (2, 3, 4)
BUCKETS = 1 << 15
LANDMARKS = 64
PER_LANGUAGE = 1500
RIDGE = 1e-4
UNKNOWN = "und"
_ROWS = 64
_TASKS = 16

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True


def presence(data: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """One row of zeros and ones for each text, from bytes in lower case. Runs
    between letters count as one blank's bytes each."""
    rows = len(bounds) - 1
    held = np.zeros((rows, buckets), dtype=np.float32)
    if not len(data):
        return held
    signs = np.where(_LETTER[data], data, np.uint8(0x20)).astype(np.uint32)
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    flat = held.ravel()
    gram = signs
    shift = np.uint32(32 - int(buckets - 1).bit_length())
    for size in range(2, max(SIZES) + 1):
        gram = gram[:-1] << np.uint32(8) | signs[size - 1 :]
        if size in SIZES and len(gram):
            whole = owner[: len(gram)] == owner[size - 1 :]
            slot = (gram[whole] + np.uint32(size * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1) >> shift
            flat[owner[: len(gram)][whole] * buckets + slot] = 1.0
    return held


def has_letters(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    plain = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 0x80))])[bounds]
    found = np.diff(plain) > 0
    for k in np.flatnonzero(~found & (np.diff(bounds) > 0)):
        found[k] = any(c.isalpha() for c in data[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lower-case bytes of some texts at a time."""
    data, bounds = T.buffer(pc.utf8_lower(pc.fill_null(texts, "")))
    for first in range(0, len(bounds) - 1, _ROWS):
        own = bounds[first : first + _ROWS + 1]
        yield data[own[0] : own[-1]], own - own[0]


class Kernel:
    """Kernel values with landmarks, whose presence is kept as bits."""

    def __init__(self, landmarks: np.ndarray, buckets: int):
        self.buckets = buckets
        marks = np.unpackbits(landmarks, axis=1, count=buckets).astype(np.float32)
        self.marks = marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        held = presence(data, bounds, self.buckets)
        return held @ self.marks.T / np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))

    def between(self) -> np.ndarray:
        return (self.marks @ self.marks.T).astype(np.float64)


def _landmarks(sample: DataFrame, each: int, buckets: int) -> np.ndarray:
    """Presence bits of ``each`` texts of every language."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key", F.lit("landmark")), "key")
    chosen = sample.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.parts(batch, "text"):
                bits = [np.packbits(presence(d, b, buckets) > 0, axis=1) for d, b in _pieces(part.column("text"))]
                rows = pa.array([x.tobytes() for x in np.concatenate(bits)], pa.binary())
                columns = [part.column("lang"), part.column("place"), rows]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "place", "bits"])

    found = chosen.mapInArrow(run, "lang string, place int, bits binary").orderBy("lang", "place").collect()
    return np.stack([np.frombuffer(r["bits"], dtype=np.uint8) for r in found])


def _sums(sample: DataFrame, landmarks: np.ndarray, languages: list[str], buckets: int) -> tuple[np.ndarray, int]:
    """Sums of products of kernel values with themselves and with +1 or -1 for
    each language, added up from one matrix a task."""
    width = len(landmarks) + 1
    held = sample.sparkSession.sparkContext.broadcast(landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(held.value, buckets)
        place = {x: k for k, x in enumerate(languages)}
        total, rows = np.zeros((width, width + len(languages))), 0
        for batch in batches:
            for part in T.parts(batch, "text"):
                values = np.concatenate([kernel(d, b) for d, b in _pieces(part.column("text"))]).astype(np.float64)
                values = np.hstack([values, np.ones((len(values), 1))])
                signs = np.full((len(values), len(languages)), -1.0)
                signs[np.arange(len(values)), [place[x] for x in part.column("lang").to_pylist()]] = 1.0
                total += values.T @ np.hstack([values, signs])
                rows += len(values)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([rows])], names=["total", "n"])

    found = sample.coalesce(_TASKS).mapInArrow(run, "total binary, n long").collect()
    total = sum(np.frombuffer(r["total"]).reshape(width, -1) for r in found)
    return total, sum(r["n"] for r in found)


class Model:
    """Landmarks, and for each language the weights of kernel values (and of 1)."""

    def __init__(self, landmarks: np.ndarray, weights: np.ndarray, languages: list[str], buckets: int):
        self.landmarks, self.weights, self.languages, self.buckets = landmarks, weights, languages, buckets

    @staticmethod
    def fit(
        docs: DataFrame,
        key: str = "doc_id",
        text: str = "text",
        lang: str = "lang",
        landmarks: int = LANDMARKS,
        per_language: int = PER_LANGUAGE,
        ridge: float = RIDGE,
        buckets: int = BUCKETS,
    ) -> Model | None:
        """None if no row may be learned from."""
        rows = samples.learnable(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")), "key")
        rows = rows.where("lang is not null and text is not null")
        counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return None
        shares = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))))
        sample = written(samples.about(rows, "key", shares[F.col("lang")]), "language-sample")
        languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
        if not languages:
            return None
        marks = _landmarks(sample, max(1, landmarks // len(languages)), buckets)
        total, n = _sums(sample, marks, languages, buckets)
        # Whitening by the landmarks' own kernel, then ridge regression, folded
        # into one matrix that is applied to raw kernel values.
        values, vectors = np.linalg.eigh(Kernel(marks, buckets).between())
        sound = values > 1e-6 * values.max()
        white = vectors[:, sound] / np.sqrt(values[sound])
        outer = np.zeros((len(marks) + 1, white.shape[1] + 1))
        outer[:-1, :-1], outer[-1, -1] = white, 1.0
        gram = outer.T @ total[:, : len(marks) + 1] @ outer
        penalty = ridge * n * np.eye(len(gram))
        penalty[-1, -1] = 0
        weights = outer @ np.linalg.solve(gram + penalty, outer.T @ total[:, len(marks) + 1 :])
        return Model(marks, weights, languages, buckets)


def identify(docs: DataFrame, model: Model | None, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of ``text`` and how sure it is (0 to 1): where
    between -1 and 1 its language's regression lies."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in (out, score)]
    schema = t.StructType([*fields, t.StructField(out, t.StringType()), t.StructField(score, t.DoubleType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        kernel = Kernel(known.landmarks, known.buckets) if known else None
        for batch in batches:
            for part in T.parts(batch, text):
                told, sure = [], []
                for data, bounds in _pieces(part.column(text)):
                    lettered = has_letters(data, bounds)
                    if kernel is None:
                        lettered[:] = False
                        scores = np.zeros((len(lettered), 1))
                    else:
                        scores = kernel(data, bounds) @ known.weights[:-1] + known.weights[-1]
                    best = scores.argmax(axis=1)
                    level = (np.clip(scores.max(axis=1), -1, 1) + 1) / 2
                    told += [known.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
                    sure += np.where(lettered, level, 0.0).tolist()
                columns = [*(part.column(n) for n in names), pa.array(told, pa.string()), pa.array(sure, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
