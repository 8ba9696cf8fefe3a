"""Oversampling by interpolation between near points of one class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.functions.hashing import int_draw, seeded_hash, unit_draw
from caselight.operators.neighbors import (
    distinct_points,
    feature_vector,
    nearest_points,
    point_id,
)
from caselight.operators.ordering import hash_index
from caselight.storage import written

_CHUNK = 100_000


def smote(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    k: int = 5,
    seed: int = 0,
    **sizes: int,
) -> DataFrame:
    """Bring every class up to the size of the largest.

    A new row lies between a row of its class and one of that row's k nearest
    same-class rows: base row, neighbour and step are drawn from a hash of
    (label, draw number, seed). Originals stay. The result has ``key`` as text
    (new rows get keys of their own), ``label``, the features as double and
    ``synthetic``.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("size"))
    counts = written(counts, "class-sizes")
    largest, least = counts.agg(F.max("size"), F.min("size")).first()
    short = counts.where(F.col("size") < (largest or 0))
    if least != largest and least < k + 1:
        c, n = counts.orderBy("size", "label").first()
        raise ValueError(f"class {c!r} has {n} rows, at least {k + 1} are needed")
    originals = df.select(
        F.col(key).cast("string").alias(key),
        F.col(label),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in features],
        F.lit(False).alias("synthetic"),
    )
    if least == largest:
        return originals

    minor = df.join(short.select(F.col("label").alias(label)), label, "left_semi").select(*df.columns)
    rows = hash_index(minor, label, key, seed, "row").select(
        F.col(label).alias("label"), "row", feature_vector(features).alias("base")
    ).withColumn("point", point_id(F.col("base")))

    # Long runs of draws are cut into chunks that are dealt out before they are
    # written out, as one class may need most of the new rows.
    draws = (
        short.selectExpr("label", "size", f"explode(sequence(0L, {largest} - size - 1, {_CHUNK}L)) as chunk")
        .repartition("label", "chunk")
        .selectExpr(
            "label", "size", f"explode(sequence(chunk, least(chunk + {_CHUNK}, {largest} - size) - 1)) as draw"
        )
    )
    digest = seeded_hash(seed, "label", "draw")
    draws = draws.select(
        "label",
        "draw",
        int_draw(digest, F.col("size")).alias("row"),
        int_draw(digest, k, start=9).cast("int").alias("slot"),
        unit_draw(digest, start=21).alias("step"),
    )
    # Which rows are drawn decides whose neighbours have to be found. Tables that
    # grow with the rows are merged, as a broadcast passes through the driver.
    bases = written(draws.join(rows.hint("merge"), ["label", "row"]), "draws")
    points = written(distinct_points(minor, features, label, key), "distinct-points")
    near = nearest_points(points, k, bases.select("label", "point"), **sizes)
    ends = near.join(
        points.select("label", F.col("point").alias("neighbour"), F.col("vec").alias("end")).hint("merge"),
        ["label", "neighbour"],
    ).select("label", "point", "slot", "end")
    # A point with many copies may be the base of many draws; that side of the
    # join is the one adaptive execution can split.
    new = bases.join(ends.hint("merge"), ["label", "point", "slot"]).select(
        F.concat_ws(":", F.lit("new"), "label", "draw").alias(key),
        F.col("label").alias(label),
        *[
            (F.col("base")[i] + F.col("step") * (F.col("end")[i] - F.col("base")[i])).alias(c)
            for i, c in enumerate(features)
        ],
        F.lit(True).alias("synthetic"),
    )
    return originals.unionByName(new)
