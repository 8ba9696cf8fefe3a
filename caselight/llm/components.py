"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.storage import delete, scratch_path


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """For (u, v): u with the least of itself and its neighbours. Aggregated
    before the shuffle, so a node that most edges touch costs one row a task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _linked(pairs: DataFrame, keep: Column) -> DataFrame:
    """Each neighbour v of u that ``keep`` names, linked to u's least neighbour.
    A join, not a gathered list: a popular node's edges may be split."""
    joined = pairs.join(_least_neighbour(pairs), "u").where(keep)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge; the root is the least node
    reachable, by the order of the column's type.

    Large-star and small-star steps take turns: the first links every larger
    neighbour of a node to its least neighbour, the second every smaller one and
    the node itself. The number of rounds grows with the logarithm of the
    number of nodes, not with the length of paths. After each round the edges
    are a written table in the shared folder, so a lost executor costs the
    round it was in, and that of the round before is deleted. Only two numbers
    a round reach the driver. Edges with a NULL end link nothing.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    current = both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before, last_path, first = None, None, True
    while True:
        if not first:
            symmetric = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _linked(symmetric, F.col("v") > F.col("u"))
            pointed = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
            small = _linked(pointed, F.lit(True)).unionByName(_least_neighbour(pointed).where("u <> m").withColumnRenamed("m", "v"))
            current = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        path = scratch_path(spark, "edges")
        current.write.parquet(path)
        current = spark.read.schema(current.schema).parquet(path)
        if last_path is not None:
            delete(spark, last_path)
        last_path, first = path, False
        told = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        state = (told["n"], told["h"])
        if state == before or state[0] == 0:
            break
        before = state
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
