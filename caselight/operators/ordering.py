"""Global order without a one-task window.

Three ways to work in a total order while every task sees only its share:

* ``row_index``   number rows in any order that ends in a unique key;
* ``hash_index``  number the rows of each group in seeded-hash order, where the
  block borders are known beforehand, so nothing needs sampling or storing;
* ``running`` / ``lagged``  running totals and previous rows over a numeric
  column whose values are unique (collapse equal values first).

All add up per block first; the table of block totals has one row per block,
a number set by the session and not by the data, so it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.functions.hashing import prefix_digits, seeded_hash
from caselight.storage import written

_BLOCK = "_block"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in these


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _whole_table(*order: Column) -> Window:
    """A window over all rows of a block-total table (bounded, see above)."""
    return Window.partitionBy(F.lit(0)).orderBy(*order)


def row_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number rows 0, 1, ... in ``order``, which must end in a unique key.

    One range shuffle: each partition numbers its own sorted rows, the result
    is written once (range borders are sampled, so they must not be drawn
    twice), and the sizes of earlier partitions are added.
    """
    local = "_local_id"
    saved = written(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(local, F.monotonically_increasing_id()),
        "row-index",
    ).withColumn(_BLOCK, F.shiftright(local, _ROW_BITS))
    before = _whole_table(F.col(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        saved.groupBy(_BLOCK)
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(_BLOCK, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    in_block = F.col(local).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return saved.join(F.broadcast(offsets), _BLOCK).select(
        *df.columns, (F.col("_before") + in_block).alias(name)
    )


def hash_index(
    df: DataFrame, group: str, key: str, seed: int, name: str, across_groups: bool = False
) -> DataFrame:
    """Number the rows of each group 0, 1, ... in the order of hash(key, seed).

    ``across_groups`` goes on counting from one group to the next, groups
    ordered by their smallest key. ``key`` must be unique. Blocks are hash
    prefixes, so even one group with most of the rows spreads evenly, and the
    numbers do not depend on how many blocks there are.
    """
    digits = prefix_digits(_partitions(df))
    digest = "_digest"
    hashed = df.withColumn(digest, seeded_hash(seed, key)).withColumn(
        _BLOCK, F.substring(digest, 1, digits)
    )
    blocks = hashed.groupBy(group, _BLOCK).agg(
        F.count(F.lit(1)).alias("_size"), F.min(key).alias("_first")
    )
    if across_groups:
        # As many rows as there are blocks and groups, so one window may hold them.
        group_first = F.min("_first").over(Window.partitionBy(group))
        blocks = blocks.withColumn("_first", group_first)
        earlier = _whole_table(F.col("_first"), F.col(group), F.col(_BLOCK))
    else:
        earlier = Window.partitionBy(group).orderBy(_BLOCK)
    before = F.sum("_size").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.withColumn("_before", F.coalesce(before, F.lit(0)))
    offsets = offsets.select(
        F.col(group).alias("_group"), F.col(_BLOCK).alias("_of"), "_before"
    )
    inside = F.row_number().over(Window.partitionBy(group, _BLOCK).orderBy(digest, key))
    return (
        hashed.withColumn("_inside", inside)
        .join(
            offsets,
            F.col(group).eqNullSafe(F.col("_group")) & (F.col(_BLOCK) == F.col("_of")),
        )
        .select(*df.columns, (F.col("_before") + F.col("_inside") - 1).alias(name))
    )


def _with_blocks(df: DataFrame, order: str, blocks: int | None) -> DataFrame:
    """Add the quantile block of ``order``; equal values share a block. A frame
    that has its blocks keeps them."""
    if _BLOCK in df.columns:
        return df
    wanted = blocks or _partitions(df)
    cuts: list[float] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        cuts = sorted(set(df.approxQuantile(order, shares, 1 / (4 * wanted))))
        cuts = [c for c in cuts if abs(c) != float("inf")]
    if not cuts:
        return df.withColumn(_BLOCK, F.lit(0.0))
    return Bucketizer(
        splits=[-float("inf"), *cuts, float("inf")],
        inputCol=order,
        outputCol=_BLOCK,
        handleInvalid="keep",
    ).transform(df)


def running(
    df: DataFrame,
    order: str,
    sums: Sequence[str] = (),
    mins: Sequence[str] = (),
    descending: bool = False,
    blocks: int | None = None,
    keep_blocks: bool = False,
) -> DataFrame:
    """Add ``running_sum_<c>`` and ``running_min_<c>`` up to and with each row.

    ``order`` is a double column, without NULL and unique. ``keep_blocks`` lets
    a second pass over the same order do without new borders and a new shuffle.
    """
    jobs = [("sum", c, F.sum) for c in sums] + [("min", c, F.min) for c in mins]
    ranked = _with_blocks(df, order, blocks)
    sort = F.col(order).desc() if descending else F.col(order)
    block_sort = F.col(_BLOCK).desc() if descending else F.col(_BLOCK)
    before = _whole_table(block_sort).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranked.groupBy(_BLOCK)
        .agg(*[f(c).alias(f"_{kind}_{c}") for kind, c, f in jobs])
        .select(_BLOCK, *[f(f"_{kind}_{c}").over(before).alias(f"_{kind}_{c}") for kind, c, f in jobs])
    )
    local = Window.partitionBy(_BLOCK).orderBy(sort).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranked.select(
        "*", *[f(c).over(local).alias(f"_in_{kind}_{c}") for kind, c, f in jobs]
    )

    def total(kind: str, c: str) -> Column:
        earlier, here = F.col(f"_{kind}_{c}"), F.col(f"_in_{kind}_{c}")
        if kind == "sum":
            return F.coalesce(earlier, F.lit(0)) + here
        return F.least(earlier, here)

    own = [c for c in df.columns if c != _BLOCK] + ([_BLOCK] if keep_blocks else [])
    return inside.join(F.broadcast(offsets), _BLOCK).select(
        *own, *[total(kind, c).alias(f"running_{kind}_{c}") for kind, c, _ in jobs]
    )


def lagged(
    df: DataFrame,
    order: str,
    columns: Sequence[str],
    descending: bool = False,
    blocks: int | None = None,
) -> DataFrame:
    """Add ``previous_<c>``: the value of ``c`` one row earlier in ``order``."""
    ranked = _with_blocks(df, order, blocks)
    sort = F.col(order).desc() if descending else F.col(order)
    block_sort = F.col(_BLOCK).desc() if descending else F.col(_BLOCK)
    last = F.min_by if descending else F.max_by
    borders = (
        ranked.groupBy(_BLOCK)
        .agg(last(F.struct(*columns), F.col(order)).alias("_last"))
        .select(_BLOCK, F.lag("_last").over(_whole_table(block_sort)).alias("_border"))
    )
    local = Window.partitionBy(_BLOCK).orderBy(sort)
    inside = ranked.withColumn("_inside", F.lag(F.struct(*columns)).over(local))
    previous = F.coalesce(F.col("_inside"), F.col("_border"))
    return inside.join(F.broadcast(borders), _BLOCK).select(
        *df.columns, *[previous[c].alias(f"previous_{c}") for c in columns]
    )
