"""k nearest neighbours within each class, exact unless asked otherwise.

Points are split by a metric tree: a cell with more points than a chunk gets
pivots and each of its points goes to the nearest, again and again until every
cell holds at most a chunk. The tree is a table; a row has a cell's pivot, the
least and largest distance of its points from it, and the cell above. Pivots are
joined to the points they concern, so nothing is held on the driver and there is
no bound on cells.

Cells near one another are put together to blocks. Points are first compared
within their block; the distance of the k-th point found there then rules out
whole branches from the root on, by their rings and by the planes between pivots.
Blocks that are left to a block are compared with it the nearest first, in two
passes, the k-th distance shrinks between them, and nothing farther is returned.

What is sent is a block for each pair of blocks, not a vector for each point and
cell; both sides of a pair look for neighbours in the same task, so a pair is sent
once. Vectors are sent as single precision if that is all they hold. Each class
has few blocks, so what is sent stays in proportion to the points until a block is
as large as a task may hold.

``method="lsh"`` compares only points that share a bucket of signs of random
projections, in any of several tables, near buckets included. What it finds is
measured exactly; it may miss neighbours. It is never chosen for the caller.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.storage import written

_CHUNK = 65536  # points per side of one comparison task, and in a cell, at most
_LEAST = 4096  # and so many are not dealt to several tasks
_SHARES = 16  # comparison tasks deal a class into so many sides, if a chunk allows
_FAN = 64  # cells a cell is split into at a time
_PLANES = 4  # of the pivots nearest to a point bound its distance from the others
_FIRST = 3  # blocks that a block is compared with in the first pass
_BLOCK = 256  # visitors compared at a time inside a task
_TILE = 1024  # and hosts they are compared with
_GATHER = 16384  # pairs measured exactly at a time


def feature_vector(features: Sequence[str]) -> Column:
    """The features as doubles. A missing one (NULL or NaN) is an error, as it is
    where models are fitted: it has no distance to anything. -0.0 becomes 0.0."""

    def known(name: str) -> Column:
        value = F.col(f"`{name}`").cast("double")
        missing = F.raise_error(F.lit(f"feature {name} is missing in a row")).cast("double")
        return F.when(value.isNull() | F.isnan(value), missing).otherwise(value + F.lit(0.0))

    return F.array(*[known(c) for c in features])


def point_id(vector: Column) -> Column:
    """Equal vectors of known numbers, and only these, share an id."""
    return F.md5(F.array_join(F.transform(vector, lambda x: x.cast("string")), ",").cast("binary"))


def distinct_points(df: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
    """(label, point, vec, copies, first_key) per distinct vector of a class."""
    return (
        df.select(F.col(label).alias("label"), F.col(key).alias("key"), feature_vector(features).alias("vec"))
        .withColumn("point", point_id(F.col("vec")))
        .groupBy("label", "point")
        .agg(
            F.first("vec").alias("vec"),
            F.count(F.lit(1)).alias("copies"),
            F.min("key").alias("first_key"),
        )
    )


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _rounding(points: np.ndarray) -> float:
    """By how much squares of ``_distances`` to these points may be off."""
    return 1e-12 * points.shape[1] * (1 + float((points * points).sum(1).max()))


def _tiles(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and radius of each tile of points; a radius is infinite or unknown
    where a feature is."""
    tiles = [b[first : first + _TILE] for first in range(0, len(b), _TILE)]
    centres = np.array([tile.mean(0) for tile in tiles])
    return centres, np.array([_distances(tile, c[None]).max() for tile, c in zip(tiles, centres)])


def _exact(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    out = np.empty(len(row))
    for at in range(0, len(row), _GATHER):
        some = slice(at, at + _GATHER)
        out[some] = np.sqrt(((a[row[some]] - b[col[some]]) ** 2).sum(1))
    return out


def _named_border(square: np.ndarray, k: int, named: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A value in each row that k named ones do not exceed; infinite where few of
    the least are named."""
    most = min(4 * k, square.shape[1])
    near = np.argpartition(square, most - 1, axis=1)[:, :most]
    judged = named(np.repeat(np.arange(len(near)), most), near.ravel()).reshape(near.shape)
    least = np.where(judged, np.take_along_axis(square, near, 1), np.inf)
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def _nearest(
    a: np.ndarray,
    b: np.ndarray,
    k: int,
    own: np.ndarray,
    order: np.ndarray,
    reach: np.ndarray | None = None,
    named: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Visitor, host and distance of the k hosts nearest to each visitor, by
    distance and ``order``. Left out are the host ``own`` (-1: none), what is
    farther than ``reach``, and pairs that are not ``named``.

    The fast product form of the distance is off by rounding, so it only picks
    out which hosts may be among the k; these are measured again exactly. Hosts
    are taken a tile at a time, and the k-th distance so far rules out most of
    the next one, or all of it where hosts that lie together follow one another.
    """
    b_norm = (b * b).sum(1)
    most = b_norm[np.isfinite(b_norm)].max(initial=0.0)
    b_turned = np.ascontiguousarray(b.T)
    held = np.empty(_BLOCK * _TILE)
    centres, radius = _tiles(b)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(a), _BLOCK):
        block = a[start : start + _BLOCK]
        norm = (block * block).sum(1)
        slack = 1e-12 * a.shape[1] * (norm + most)
        far = np.full(len(block), np.inf) if reach is None else reach[start : start + _BLOCK] * (1 + 1e-9)
        limit = far * far - norm + slack
        mine = own[start : start + _BLOCK]
        row, col, exact = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        twice = -2 * block
        gap = _distances(block, centres) - radius
        gap -= 1e-6 * (1 + np.sqrt(norm + most))[:, None]  # distances are off by rounding
        for first in range(0, len(b), _TILE):
            with np.errstate(invalid="ignore"):
                beyond = gap[:, first // _TILE] > np.sqrt(np.maximum(limit + norm, 0))
            if beyond.all():
                continue
            tile = b_turned[:, first : first + _TILE]
            width = tile.shape[1]
            square = held[: len(block) * width].reshape(len(block), width)
            np.matmul(twice, tile, out=square)
            square += b_norm[first : first + _TILE]  # less the visitor's own square
            here = np.flatnonzero((mine >= first) & (mine < first + width))
            square[here, mine[here] - first] = np.inf
            if width > k and np.count_nonzero(square <= limit[:, None]) > 4 * k * len(block):
                if named is None:
                    border = np.partition(square, k - 1, axis=1)[:, k - 1]
                else:
                    border = _named_border(square, k, lambda r, c: named(r + start, c + first))
                limit = np.minimum(limit, np.where(np.isfinite(border), border + 2 * slack, np.inf))
            at, other = np.divmod(np.flatnonzero(square <= limit[:, None]), width)
            sound = np.isfinite(square[at, other])
            if named is not None:
                sound[sound] = named(at[sound] + start, other[sound] + first)
            at, other = at[sound], other[sound] + first
            if not len(at):
                continue
            row, col = np.concatenate([row, at]), np.concatenate([col, other])
            exact = np.concatenate([exact, _exact(block, b, at, other)])
            sort = np.lexsort((order[col], exact, row))
            row, col, exact = row[sort], col[sort], exact[sort]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < k
            row, col, exact, rank = row[keep], col[keep], exact[keep], rank[keep]
            full = rank == k - 1
            limit[row[full]] = np.minimum(limit[row[full]], exact[full] ** 2 - norm[row[full]] + slack[row[full]])
        found.append((row + start, col, exact))
    row, col, exact = (np.concatenate(part) for part in zip(*found))
    return row, col, exact


def _packed(vec: pd.Series) -> pd.DataFrame:
    """The vector in single precision if it is the same, else in double."""
    wide = _stack(vec)
    with np.errstate(over="ignore"):
        thin = wide.astype(np.float32)
    same = (thin == wide).all(1)
    return pd.DataFrame(
        {
            "thin": [row.tobytes() if all_ else None for row, all_ in zip(thin, same)],
            "wide": [None if all_ else row.tobytes() for row, all_ in zip(wide, same)],
        }
    )


def _matrix(thin: pa.ChunkedArray, wide: pa.ChunkedArray) -> np.ndarray:
    """Rows that were packed."""
    parts = [
        (np.flatnonzero(column.is_valid().to_numpy()), np.frombuffer(b"".join(column.drop_null().to_pylist()), kind))
        for column, kind in ((thin, np.float32), (wide, np.float64))
    ]
    parts = [(rows, values.reshape(len(rows), -1)) for rows, values in parts if len(rows)]
    out = np.empty((len(thin), parts[0][1].shape[1]))
    for rows, values in parts:
        out[rows] = values
    return out


def _bits(masks: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(masks.to_pylist()), np.uint8).reshape(len(masks), -1)


def _share(size: Column, chunk: int) -> Column:
    """How many points of a class of ``size`` one side of a comparison has."""
    return F.least(F.lit(chunk), F.greatest(F.lit(_LEAST), F.ceil(size / _SHARES)))


def _deals(asking: DataFrame, sizes: DataFrame, chunk: int, beside: DataFrame | None) -> DataFrame:
    """Which parts of cells go to which comparisons: (label, cell, part), the two
    parts ``one``, ``i``, ``two``, ``j`` that are compared, the ``side`` this is (2
    if they are the same), whether it ``asks`` and whether it is ``told`` of."""
    place = ["label", "cell"]
    whole = sizes.groupBy("label").agg(F.sum("size").alias("whole"))
    parts = sizes.join(whole, "label").select(*place, F.ceil(F.col("size") / _share(F.col("whole"), chunk)).alias("parts"))
    if beside is None:
        beside = asking.select(*place, F.col("cell").alias("other"))
    turned = F.col("cell") > F.col("other")
    pairs = beside.groupBy(
        "label", F.least("cell", "other").alias("one"), F.greatest("cell", "other").alias("two")
    ).agg(F.max(~turned).alias("forth"), F.max(turned | (F.col("cell") == F.col("other"))).alias("back"))

    def numbered(cell: str, part: str) -> DataFrame:
        last = F.col("parts") - 1
        return parts.select("label", F.col("cell").alias(cell), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias(part))

    def side(cell: str, part: str, number: int, asks: str, told: str) -> Column:
        named = {"cell": F.col(cell), "part": F.col(part), "side": F.lit(number), "asks": F.col(asks), "told": F.col(told)}
        return F.struct(*[c.alias(n) for n, c in named.items()])

    first, second = side("one", "i", 0, "forth", "back"), side("two", "j", 1, "back", "forth")
    alone = F.array(side("one", "i", 2, "forth", "back"))
    task = ["label", "one", "i", "two", "j"]
    compared = pairs.join(numbered("one", "i"), ["label", "one"]).join(numbered("two", "j"), ["label", "two"])
    compared = compared.where((F.col("one") < F.col("two")) | (F.col("i") <= F.col("j")))
    same = (F.col("one") == F.col("two")) & (F.col("i") == F.col("j"))
    dealt = compared.select(*task, F.explode(F.when(same, alone).otherwise(F.array(first, second))).alias("s"))
    return dealt.select(*task, "s.*").join(parts, place)


def _compare(
    visits: DataFrame,
    cells: DataFrame,
    sizes: DataFrame,
    k: int,
    chunk: int,
    beside: DataFrame | None = None,
) -> DataFrame:
    """k nearest points of its cell for every visit ``(label, cell, point)``, a
    point of ``cells``; or, if ``beside`` has (label, cell, other), of the cells
    that are beside its own. Compared part by part, then the k best of all. Where
    visits have a ``reach``, none that is farther; where points have ``looks`` and
    ``stands``, of pairs only in which what one looks into and the other stands in
    have a bit in common; where cells have ``own``, points may be in several, and
    only those are found that are there by themselves."""
    place = ["label", "cell"]
    deals = written(_deals(visits.select(*place).distinct(), sizes, chunk, beside), "deals")
    named = ["looks", "stands"] if "looks" in cells.columns else []
    leaf = ["leaf"] if "leaf" in cells.columns else []
    asked = ["reach"] if "reach" in visits.columns else []
    asking = visits.select(*place, "point", *asked, F.lit(True).alias("visits"))
    many = "own" in cells.columns
    stays = F.col("own") if many else F.lit(True)
    packed = F.pandas_udf(_packed, "struct<thin: binary, wide: binary>")("vec").alias("packed")
    drawn = F.xxhash64("point").alias("drawn")
    rows = cells.select(*place, "point", drawn, packed, "copies", "first_key", stays.alias("own"), *named, *leaf)
    rows = rows.join(asking.hint("merge"), [*place, "point"], "left")
    parts = deals.select(*place, "parts").distinct()
    rows = rows.join(parts, place).withColumn("part", F.pmod("drawn", "parts")).drop("parts", "drawn")
    rows = rows.withColumn("visits", F.coalesce("visits", F.lit(False)))
    task = ["label", "one", "i", "two", "j"]
    asks, told = F.col("asks") & F.col("visits"), F.col("told") & F.col("own")
    sent = rows.join(deals.drop("parts"), [*place, "part"]).where(told | asks).select(
        *task, "side", asks.alias("asks"), told.alias("told"), F.unhex("point").alias("point"), "packed.*", "copies", "first_key",
        *asked, *named, *leaf,
    )
    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = (
        f"label {types['label']}, point binary, distance double, "
        f"first_key {types['first_key']}, neighbour binary, copies bigint"
    )

    def one_way(visitors: pa.Table, locals_: pa.Table) -> pa.Table:
        visitors, locals_ = visitors.filter(visitors["asks"]), locals_.filter(locals_["told"])
        if visitors.num_rows and locals_.num_rows:
            keys = locals_["first_key"].combine_chunks()
            order = np.empty(len(keys), np.int64)
            order[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
            own = pc.index_in(visitors["point"], value_set=locals_["point"].combine_chunks())
            reach = pc.fill_null(visitors["reach"], float("inf")).to_numpy() if asked else None
            judge = None
            if named:
                looks, stands = _bits(visitors["looks"]), _bits(locals_["stands"])

                def judge(row: np.ndarray, col: np.ndarray) -> np.ndarray:
                    return (looks[row] & stands[col]).any(1)

            with np.errstate(invalid="ignore"):  # a feature may be infinite
                row, col, exact = _nearest(
                    _matrix(visitors["thin"], visitors["wide"]),
                    _matrix(locals_["thin"], locals_["wide"]),
                    k,
                    pc.fill_null(own, -1).to_numpy().astype(np.int64),
                    order,
                    reach,
                    judge,
                )
        else:
            row, col, exact = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        mine, theirs = visitors.select(["label", "point"]).take(row), locals_.select(["first_key", "point", "copies"]).take(col)
        return pa.table(
            {
                "label": mine["label"],
                "point": mine["point"],
                "distance": pa.array(exact, pa.float64()),
                "first_key": theirs["first_key"],
                "neighbour": theirs["point"],
                "copies": theirs["copies"],
            }
        )

    def compare(rows: pa.Table) -> pa.Table:
        if leaf:
            rows = rows.sort_by("leaf")
        first, second, alone = (rows.filter(pc.equal(rows["side"], n)) for n in range(3))
        turns = [(alone, alone)] if alone.num_rows else [(first, second), (second, first)]
        return pa.concat_tables([one_way(*turn) for turn in turns])

    found = sent.groupBy(*task).applyInArrow(compare, schema)
    if many:
        found = found.distinct()
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("point", "neighbour")]
    return _k_least(found, k).select("label", hexed[0], "distance", "first_key", hexed[1], "copies")


def _dealt(df: DataFrame, sizes: DataFrame, chunk: int) -> DataFrame:
    """Cut the rows of each cell into parts of about a chunk."""
    parts = F.ceil(F.col("size") / chunk)
    return df.join(sizes, ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("point"), parts)).drop("size")


def _to_all_parts(pivots: DataFrame, sizes: DataFrame, chunk: int) -> DataFrame:
    """A cell's pivots, once for each of its parts; under names of their own."""
    last = F.ceil(F.col("size") / chunk) - 1
    dealt = pivots.join(sizes, ["label", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return dealt.select(*[F.col(c).alias(f"pivot_{c}") for c in ("label", "cell", "part", *pivots.columns[2:])])


def _tree(points: DataFrame, chunk: int, fan: int) -> tuple[DataFrame, DataFrame | None]:
    """The points with the ``cell`` each ends up in; and the cells with ``parent``,
    pivot ``at``, ``inner`` and ``outer`` distance and ``leaf``, or None if no
    class is larger than a chunk."""
    open_ = points.withColumn("cell", F.lit(""))
    done, level, levels = None, None, []
    place = ["label", "cell"]
    types = {f.name: f.dataType.simpleString() for f in open_.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in open_.columns) + ", child int, away double"
    while True:
        sizes = written(open_.groupBy(*place).agg(F.count(F.lit(1)).alias("size")), "cell-sizes")
        large = sizes.where(F.col("size") > chunk)
        small = open_.join(sizes.where(F.col("size") <= chunk).select(*place), place, "left_semi").select(*open_.columns)
        done = small if done is None else done.unionByName(small)
        if level is not None:
            leaf = sizes.select(*place, (F.col("size") <= chunk).alias("leaf"))
            levels.append(written(level.join(leaf, place), "tree-level"))
        if large.isEmpty():
            return written(done, "cells"), reduce(DataFrame.unionByName, levels) if levels else None
        split = open_.join(large.select(*place), place, "left_semi").select(*open_.columns)
        # Ids are hashes, so the least are a random, repeatable choice.
        rank = F.row_number().over(Window.partitionBy(*place).orderBy("point"))
        pivots = split.select(*place, "point", "vec").withColumn("child", rank).where(F.col("child") <= fan)
        pivots = written(pivots.select(*place, "child", F.col("vec").alias("at")), "pivots")

        def assign(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            mine = mine.drop(columns="part")
            if not len(mine) or not len(theirs):
                return mine.iloc[:0].assign(child=0, away=0.0)
            pivots = _stack(theirs["pivot_at"])
            apart = _distances(_stack(mine["vec"]), pivots)
            # Pivots too near to one another to tell apart share what is nearest to
            # them, so that a dense clump is split all the same, each time anew.
            square = apart * apart
            same = square <= square.min(1)[:, None] + _rounding(pivots)
            place = mine["cell"] + mine["point"]
            draw = place.map(lambda x: zlib.crc32(x.encode())).to_numpy() % same.sum(1)
            chosen = ((np.cumsum(same, axis=1) == (draw + 1)[:, None]) & same).argmax(1)
            return mine.assign(child=theirs["pivot_child"].to_numpy()[chosen], away=apart[np.arange(len(mine)), chosen])

        key = [*place, "part"]
        dealt = _dealt(split, large, chunk).select(*open_.columns, "part")
        spread = _to_all_parts(pivots, large, chunk)
        near = dealt.groupBy(*key).cogroup(spread.groupBy(*[f"pivot_{c}" for c in key])).applyInPandas(assign, schema)
        near = written(near, "assigned")
        below = F.concat_ws("/", "cell", "child")
        level = (
            near.groupBy(*place, "child")
            .agg(F.min("away").alias("inner"), F.max("away").alias("outer"))
            .join(pivots, [*place, "child"])
            .select("label", below.alias("cell"), F.col("cell").alias("parent"), "at", "inner", "outer")
        )
        open_ = near.withColumn("cell", below).select(*open_.columns)


def _blocks(cells: DataFrame, tree: DataFrame, chunk: int) -> DataFrame:
    """(label, leaf, block): leaves of one parent that lie near one another, as
    many as one side of a comparison may have."""
    sizes = cells.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.groupBy("label").agg(F.sum("size").alias("whole"))
    share = _share(F.col("whole"), chunk).alias("share")
    leaves = tree.where("leaf").join(sizes, ["label", "cell"]).join(whole, "label")
    types = {f.name: f.dataType.simpleString() for f in tree.schema}

    def pack(mine: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("cell", ignore_index=True)
        pivots, size, share = _stack(mine["at"]), mine["size"].to_numpy(), mine["share"].iloc[0]
        block = np.full(len(mine), -1)
        while (block < 0).any():
            first = int(np.argmax(block < 0))
            block[first], room = first, share - size[first]
            with np.errstate(invalid="ignore"):
                near = np.argsort(_distances(pivots[[first]], pivots)[0], kind="stable")
            for i in near:
                if block[i] < 0 and size[i] <= room:
                    block[i], room = first, room - size[i]
        return pd.DataFrame({"label": mine["label"], "leaf": mine["cell"], "block": mine["cell"].to_numpy()[block]})

    return (
        leaves.select("label", "parent", "cell", "at", "size", share)
        .groupBy("label", "parent")
        .applyInPandas(pack, f"label {types['label']}, leaf string, block string")
    )


def _visits(guests: DataFrame, points: DataFrame, tree: DataFrame, chunk: int) -> DataFrame:
    """(label, home, cell, bound, guests) of every leaf, beside its own, that may
    hold one of the k nearest of any guest of a home: how near such a leaf may be,
    and for how many. ``guests`` has (label, point, home, reach)."""
    types = {f.name: f.dataType.simpleString() for f in guests.schema}
    schema = f"label {types['label']}, home string, cell string, bound double, guests bigint"

    def descend(mine: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        names = ["label", "home", "cell", "bound", "guests"]
        if not len(mine) or not len(cells):
            return pd.DataFrame(columns=names)
        home = mine["home"].iloc[0]
        reach = mine["reach"].to_numpy(dtype=float)
        limit = np.where(np.isnan(reach), np.inf, reach) * (1 + 1e-9)
        branches = [(parent, part.reset_index(drop=True)) for parent, part in cells.groupby("pivot_parent")]
        branches.sort(key=lambda branch: branch[0].count("/"))  # from the root on
        pivots = {parent: _stack(part["pivot_at"]) for parent, part in branches}
        least: dict[str, float] = {}
        count: dict[str, int] = {}
        for first in range(0, len(mine), _BLOCK):
            block, most = _stack(mine["vec"].iloc[first : first + _BLOCK]), limit[first : first + _BLOCK]
            above = {"": np.zeros(len(block))}
            for parent, part in branches:
                if parent not in above:
                    continue
                at = pivots[parent]
                between, apart = _distances(at, at), _distances(block, at)
                slack = 1e-6 * (1 + np.abs(at).max())  # distances are off by rounding
                bound = np.maximum(apart - part["pivot_outer"].to_numpy(), part["pivot_inner"].to_numpy() - apart)
                square, rounding = apart**2, 2 * _rounding(at)
                closest = np.argsort(apart, axis=1)[:, :_PLANES]
                for i in closest.T:
                    # Who belongs to j is no nearer to i.
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = (square - np.take_along_axis(square, i[:, None], 1) - rounding) / (2 * between[i])
                    bound = np.fmax(bound, np.where(between[i] > 0, plane, 0))
                bound = np.maximum(bound - slack, above[parent][:, None])
                for j, (cell, leaf) in enumerate(zip(part["pivot_cell"], part["pivot_leaf"])):
                    near = bound[:, j] <= most
                    if not near.any():
                        continue
                    if not leaf:
                        above[cell] = bound[:, j]
                    elif cell != home:
                        least[cell] = min(least.get(cell, np.inf), bound[near, j].min())
                        count[cell] = count.get(cell, 0) + int(near.sum())
        if not least:
            return pd.DataFrame(columns=names)
        out = pd.DataFrame({"cell": list(least), "bound": list(least.values()), "guests": list(count.values())})
        return out.assign(label=mine["label"].iloc[0], home=home)[names]

    place = ["label", "home"]
    parts = F.ceil(F.col("size") / min(chunk, _LEAST))
    homes = guests.groupBy(*place).agg(F.count(F.lit(1)).alias("size")).select(*place, parts.alias("parts"))
    dealt = guests.join(points.select("label", "point", "vec").hint("merge"), ["label", "point"]).join(homes, place)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts"))).select(*place, "part", "vec", "reach")
    last = F.col("parts") - 1
    spread = homes.select(*place, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part")).join(tree, "label")
    spread = spread.select(*[F.col(c).alias(f"pivot_{c}") for c in spread.columns])
    key = [*place, "part"]
    found = dealt.groupBy(*key).cogroup(spread.groupBy(*[f"pivot_{c}" for c in key])).applyInPandas(descend, schema)
    return found.groupBy(*place, "cell").agg(F.min("bound").alias("bound"), F.sum("guests").alias("guests"))


def nearest_points(
    points: DataFrame,
    k: int,
    wanted: DataFrame | None = None,
    chunk: int = _CHUNK,
    fan: int = _FAN,
) -> DataFrame:
    """The k nearest neighbours of each distinct point, copies counted singly:
    ``(label, point, slot, neighbour, distance)`` with slots 0..k-1 in order of
    (distance, smallest key). The other copies of a point come first, at
    distance 0. ``wanted(label, point)`` limits whose neighbours are sought.
    ``points`` is read several times and should be a stored table.
    """
    cells, tree = _tree(points, chunk, fan)
    if tree is not None:
        # A class that is one cell is a block of its own.
        blocks = written(_blocks(cells, tree, chunk), "blocks")
        cells = cells.withColumnRenamed("cell", "leaf").join(blocks, ["label", "leaf"], "left")
        cells = written(cells.withColumn("cell", F.coalesce("block", F.lit(""))).drop("block"), "in-blocks")
    guests = cells if wanted is None else cells.join(
        wanted.select("label", "point").distinct().hint("merge"), ["label", "point"], "left_semi"
    )
    sizes = written(cells.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("size")), "block-sizes")
    found = _compare(guests.select("label", "cell", "point"), cells, sizes, k, chunk)
    if tree is None:
        return _slots(guests.select("label", "point", "copies"), found, k)
    found = written(found, "own-block")
    homes = guests.select("label", "point", "cell")
    met = None
    for most in (_FIRST, None):
        # What is farther than the k-th found by now is not visited any more.
        visits = written(homes.join(_kth_distance(found, k).hint("merge"), ["label", "point"], "left"), "visits")
        near = _visits(visits.withColumnRenamed("cell", "home"), cells, tree, chunk)
        near = near.withColumnRenamed("cell", "leaf").join(blocks, ["label", "leaf"]).where("block <> home")
        near = near.select("label", F.col("home").alias("cell"), F.col("block").alias("other"), "bound", "guests")
        near = near.groupBy("label", "cell", "other").agg(F.min("bound").alias("bound"), F.sum("guests").alias("guests"))
        if met is not None:
            near = near.join(met, ["label", "cell", "other"], "left_anti")
        # Either direction has a pair looked at, and then both do that need it.
        drawn = F.xxhash64(F.least("cell", "other"), F.greatest("cell", "other"))
        order = Window.partitionBy("label", "cell").orderBy("bound", F.desc("guests"), drawn, "other")
        near = written(near.withColumn("rank", F.row_number().over(order)), "pairs")
        if near.isEmpty():
            break
        if most is not None:
            now = near.where(F.col("rank") <= most).select("label", "cell", "other")
            turned = now.select("label", F.col("other").alias("cell"), F.col("cell").alias("other"))
            near = near.join(now.union(turned).distinct(), ["label", "cell", "other"], "left_semi")
        met = written(near.select("label", "cell", "other"), "met")
        more = _compare(visits.join(met.select("label", "cell").distinct(), ["label", "cell"], "left_semi"), cells, sizes, k, chunk, met)
        found = written(_k_least(found.unionByName(more), k), "found")
    return _slots(guests.select("label", "point", "copies"), found, k)


def nearest_points_lsh(
    points: DataFrame,
    k: int,
    wanted: DataFrame | None = None,
    chunk: int = _CHUNK,
    tables: int = 8,
    bits: int = 3,
    probes: int = 3,
    seed: int = 0,
) -> DataFrame:
    """As ``nearest_points``, of the points only that share a bucket with the one
    asked for. A bucket is the signs of ``bits`` random projections; a point is
    put into one bucket of each of ``tables`` tables and looks into that and the
    ``probes`` ones behind the planes nearest to it. More tables and probes find
    more, more bits compare less. Centre the features first: planes go through 0.

    Where the tables together name as many pairs as there are, pairs named by
    several are not compared each time: every pair is looked at once, by distance
    first, and counts if any table names it.
    """
    size = points.select(F.size("vec").alias("size")).first()
    if size is None:
        return nearest_points(points, k, wanted, chunk)
    planes = np.random.default_rng(seed).normal(size=(tables * bits, size["size"]))

    @F.pandas_udf("array<struct<cell: string, own: boolean>>")
    def buckets(vec: pd.Series) -> pd.Series:
        side = _stack(vec) @ planes.T
        out = []
        for row in side.reshape(len(side), tables, bits):
            mine = []
            for table, margins in enumerate(row):
                code = sum(1 << i for i in range(bits) if margins[i] > 0)
                mine.append({"cell": f"{table}:{code}", "own": True})
                for i in np.argsort(np.abs(margins))[:probes]:
                    mine.append({"cell": f"{table}:{code ^ (1 << int(i))}", "own": False})
            out.append(mine)
        return pd.Series(out)

    if tables * (1 + probes) >= 2**bits:
        return _nearest_named(points, k, wanted, chunk, buckets, tables, bits)
    dealt = written(points.select("*", F.explode(buckets("vec")).alias("b")).select("*", "b.cell", "b.own").drop("b"), "buckets")
    guests = dealt if wanted is None else dealt.join(
        wanted.select("label", "point").distinct().hint("merge"), ["label", "point"], "left_semi"
    )
    sizes = dealt.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("size"))
    found = _compare(guests.select("label", "cell", "point"), dealt, sizes, k, chunk)
    return _slots(guests.where("own").select("label", "point", "copies").distinct(), found, k)


def _nearest_named(
    points: DataFrame,
    k: int,
    wanted: DataFrame | None,
    chunk: int,
    buckets: Callable[[str], Column],
    tables: int,
    bits: int,
) -> DataFrame:
    """As the buckets would have it, of all pairs of a class. A point stands in one
    bucket of each table and looks into some: as bits, one for each bucket."""

    @F.pandas_udf("struct<looks: binary, stands: binary>")
    def masks(found: pd.Series) -> pd.DataFrame:
        looks = np.zeros((len(found), tables << bits), bool)
        stands = np.zeros_like(looks)
        for i, each in enumerate(found):
            for b in each:
                table, code = map(int, b["cell"].split(":"))
                looks[i, (table << bits) + code] = True
                stands[i, (table << bits) + code] |= b["own"]
        packed = [np.packbits(m, axis=1) for m in (looks, stands)]
        return pd.DataFrame({c: [row.tobytes() for row in m] for c, m in zip(("looks", "stands"), packed)})

    told = points.withColumn("b", masks(buckets("vec")))
    cells = written(told.select(*points.columns, F.lit("").alias("cell"), "b.looks", "b.stands"), "buckets")
    guests = cells if wanted is None else cells.join(
        wanted.select("label", "point").distinct().hint("merge"), ["label", "point"], "left_semi"
    )
    sizes = cells.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("size"))
    found = _compare(guests.select("label", "cell", "point"), cells, sizes, k, chunk)
    return _slots(guests.select("label", "point", "copies"), found, k)


def _k_least(found: DataFrame, k: int) -> DataFrame:
    """The k best of each point so far."""
    order = Window.partitionBy("label", "point").orderBy("distance", "first_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _kth_distance(found: DataFrame, k: int) -> DataFrame:
    """The k-th smallest distance of each point; NULL while fewer are known."""
    order = Window.partitionBy("label", "point").orderBy("distance", "first_key")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .groupBy("label", "point")
        .agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("reach"))
    )


def _slots(points: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Lay out k slots: own copies first, then neighbours with their copies."""
    order = Window.partitionBy("label", "point").orderBy("distance", "first_key")
    best = (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .groupBy("label", "point")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "distance", "copies"))).alias("near"))
    )
    others = """flatten(transform(near, n ->
        array_repeat(struct(n.neighbour as neighbour, n.distance as distance),
                     int(least(n.copies, {k})))))"""
    own = """array_repeat(struct(point as neighbour, 0D as distance),
                          int(least(copies - 1, {k})))"""
    return (
        points.join(best.hint("merge"), ["label", "point"], "left")
        .withColumn("near", F.expr("coalesce(near, array())"))
        .select(
            "label", "point",
            F.expr(
                f"posexplode(slice(concat({own.format(k=k)}, {others.format(k=k)}), 1, {k}))"
            ).alias("slot", "hit"),
        )
        .select("label", "point", "slot", "hit.neighbour", "hit.distance")
    )


def knn_within_class(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    k: int = 5,
    method: str = "exact",
    **sizes: int,
) -> DataFrame:
    """k nearest same-class neighbours of every distinct point, named by the
    smallest key among equal points: ``(label, key, slot, neighbour, distance)``.
    ``method`` is ``exact`` or, if neighbours may be missed, ``lsh``."""
    nearest = {"exact": nearest_points, "lsh": nearest_points_lsh}[method]
    points = written(distinct_points(df, features, label, key), "distinct-points")
    names = points.select("label", "point", "first_key")
    return (
        nearest(points, k, **sizes)
        .join(names.withColumnRenamed("first_key", "key").hint("merge"), ["label", "point"])
        .join(
            names.select("label", F.col("point").alias("neighbour"), F.col("first_key").alias("neighbour_key")).hint("merge"),
            ["label", "neighbour"],
        )
        .select("label", "key", "slot", F.col("neighbour_key").alias("neighbour"), "distance")
    )
