import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.operators import neighbors
from caselight.operators.neighbors import knn_within_class, nearest_points, distinct_points
from caselight.operators.smote import smote
from caselight.storage import written

NAMES = ["x", "y", "z"]


def cloud(spark, sizes, seed=0, clumps=False):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label, n in sizes.items():
        centre = rng.normal(size=(4, 3)) * (8 if clumps else 0)
        for p in centre[rng.integers(0, 4, n)] + rng.normal(size=(n, 3)):
            rows.append((i, label, *map(float, p)))
            i += 1
    df = spark.createDataFrame(rows, "id long, label int, x double, y double, z double")
    return written(df, "cloud"), rows


def brute(rows, k):
    out = {}
    for label in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == label]
        points = np.array([r[2:] for r in mine])
        apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
        np.fill_diagonal(apart, np.inf)
        for i, r in enumerate(mine):
            order = sorted(range(len(mine)), key=lambda j: (apart[i, j], mine[j][0]))[:k]
            out[r[0]] = [mine[j][0] for j in order if np.isfinite(apart[i, j])]
    return out


@pytest.mark.parametrize("clumps, sizes", [(False, {}), (True, {}), (False, {"chunk": 60, "fan": 5}), (True, {"chunk": 16, "fan": 4})])
def test_neighbours_are_exact(spark, clumps, sizes):
    df, rows = cloud(spark, {0: 200, 1: 60, 2: 3}, clumps=clumps)
    got = {}
    for r in knn_within_class(df, NAMES, "label", "id", 5, **sizes).orderBy("key", "slot").collect():
        got.setdefault(r["key"], []).append(r["neighbour"])
    assert got == brute(rows, 5)


def test_cells_are_split_until_they_hold_a_chunk(spark):
    df, _ = cloud(spark, {0: 200, 1: 60, 2: 3})
    points = written(distinct_points(df, NAMES, "label", "id"), "points")
    cells, tree = neighbors._tree(points, 16, 3)
    assert cells.groupBy("label", "cell").count().agg(F.max("count")).first()[0] <= 16
    assert cells.count() == 263
    levels = {r["cell"].count("/") + 1 for r in tree.collect()}
    assert len(levels) >= 3
    small = written(points.where("label = 2"), "few")
    assert neighbors._tree(small, 16, 3)[1] is None


def test_a_clump_too_dense_to_tell_apart_is_split(spark):
    rows = [(i, 0, 1.0 + i * 1e-13, 2.0, 3.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, x double, y double, z double")
    points = written(distinct_points(df, NAMES, "label", "id"), "points")
    cells, tree = neighbors._tree(points, 16, 4)
    assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 16
    assert max(r["cell"].count("/") for r in tree.collect()) < 5


def test_clumps_are_not_compared_with_one_another(spark):
    df, rows = cloud(spark, {0: 200}, clumps=True)
    points = written(distinct_points(df, NAMES, "label", "id"), "points")
    cells, tree = neighbors._tree(points, 16, 4)
    sizes = cells.groupBy("label", "cell").agg(F.count("*").alias("size"))
    own = neighbors._compare(cells, cells, sizes, 5, 16)
    homes = cells.select("label", "point", F.col("cell").alias("home"))
    homes = homes.join(neighbors._kth_distance(own, 5), ["label", "point"], "left")
    visits = neighbors._visits(homes, points, tree, 16)
    assert visits.count() < cells.count() * sizes.count() / 2


def test_projections_find_nearly_all(spark):
    df, rows = cloud(spark, {0: 300, 1: 90})
    want = {r["key"]: set() for r in df.select(F.col("id").alias("key")).collect()}
    for key, near in brute(rows, 5).items():
        want[key] = set(near)
    got = {k: set() for k in want}
    for r in knn_within_class(df, NAMES, "label", "id", 5, method="lsh").collect():
        got[r["key"]].add(r["neighbour"])
    found = sum(len(got[k] & want[k]) for k in want) / sum(map(len, want.values()))
    assert found >= 0.9
    with pytest.raises(KeyError):
        knn_within_class(df, NAMES, "label", "id", 5, method="auto")


def test_copies_are_each_others_neighbours(spark):
    rows = [(i, 0, 1.0, 2.0, 3.0) for i in range(40)]  # one hot group of copies
    rows += [(100, 0, 5.0, 5.0, 5.0), (101, 0, 5.0, 5.0, 5.0), (102, 0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, label int, x double, y double, z double")
    points = written(distinct_points(df, NAMES, "label", "id"), "points")
    assert points.count() == 3
    near = {}
    for r in knn_within_class(df, NAMES, "label", "id", 3).orderBy("key", "slot").collect():
        near.setdefault(r["key"], []).append(r["neighbour"])
    assert near[0] == [0, 0, 0]
    assert near[100] == [100, 0, 0]  # its copy, then two of the forty
    assert near[102] == [100, 100, 0]
    some = nearest_points(points, 3, points.filter("first_key = 102").select("label", "point"))
    assert some.count() == 3


def test_smote_balances_and_interpolates(spark):
    df, rows = cloud(spark, {0: 200, 1: 31, 2: 6})
    made = smote(df, NAMES, "label", "id", seed=3)
    counts = {r["label"]: r["count"] for r in made.groupBy("label").count().collect()}
    assert counts == {0: 200, 1: 200, 2: 200}
    assert made.select("id").distinct().count() == 600
    originals = made.filter("not synthetic").select(F.col("id").cast("long"), "label", *NAMES)
    assert originals.exceptAll(df).count() == 0 and originals.count() == len(rows)
    near = brute(rows, 5)
    where = {r[0]: np.array(r[2:]) for r in rows}
    label = {r[0]: r[1] for r in rows}
    for r in made.filter("synthetic").collect():
        p = np.array([r[c] for c in NAMES])
        on_segment = any(
            abs(np.linalg.norm(p - where[a]) + np.linalg.norm(p - where[b]) - np.linalg.norm(where[a] - where[b])) < 1e-9
            for a in where if label[a] == r["label"] for b in near[a]
        )
        assert on_segment
    again = smote(df.repartition(5), NAMES, "label", "id", seed=3)
    assert made.exceptAll(again).count() == 0
    other = smote(df, NAMES, "label", "id", seed=4)
    assert made.exceptAll(other).count() > 0


def test_smote_of_copies_stays_on_the_copy(spark):
    rows = [(i, 1, 1.0, 1.0, 1.0) for i in range(8)] + [(10 + i, 0, float(i), 0.0, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, label int, x double, y double, z double")
    made = smote(df, NAMES, "label", "id")
    new = made.filter("synthetic")
    assert new.count() == 12
    assert new.filter("x = 1 and y = 1 and z = 1").count() == 12


def test_smote_needs_k_and_one(spark):
    df, _ = cloud(spark, {0: 20, 1: 6})
    assert smote(df, NAMES, "label", "id").filter("label = 1").count() == 20
    small, _ = cloud(spark, {0: 20, 1: 5})
    with pytest.raises(ValueError, match="at least 6"):
        smote(small, NAMES, "label", "id")
    even, _ = cloud(spark, {0: 9, 1: 9})
    assert smote(even, NAMES, "label", "id").count() == 18


@pytest.mark.parametrize("hole", [None, float("nan")])
def test_missing_feature_is_refused(spark, hole):
    rows = [(i, int(i >= 15), float(i % 7), float(i % 5)) for i in range(60)]
    rows[3] = (3, 0, hole, 1.0)
    df = spark.createDataFrame(rows, "id int, label int, a double, b double")
    with pytest.raises(Exception, match="feature a is missing"):
        smote(df, ["a", "b"], "label", "id").count()
    with pytest.raises(Exception, match="feature a is missing"):
        neighbors.knn_within_class(df, ["a", "b"], "label", "id", 2).count()


def test_zero_and_negative_zero_are_one_point(spark):
    rows = [(0, 0, 0.0), (1, 0, -0.0), (2, 0, 1.0)]
    df = spark.createDataFrame(rows, "id int, label int, a double")
    got = neighbors.knn_within_class(df, ["a"], "label", "id", 1).collect()
    assert {(r["key"], r["neighbour"], r["distance"]) for r in got} == {(0, 0, 0.0), (2, 0, 1.0)}


def test_many_classes_all_reach_the_largest(spark):
    rows = [(c * 100 + i, c, float(i), float(i % 3)) for c in range(12) for i in range(6 + (c == 0) * 4)]
    df = spark.createDataFrame(rows, "id int, label int, a double, b double")
    got = smote(df, ["a", "b"], "label", "id").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {c: 10 for c in range(12)}


def test_later_passes_return_nothing_beyond_what_is_known(spark, monkeypatch):
    df, rows = cloud(spark, {0: 150}, clumps=True)
    compare, seen = neighbors._compare, []

    def kept(visits, *rest):
        seen.append((written(visits, "seen-visits"), written(compare(visits, *rest), "seen")))
        return seen[-1][1]

    monkeypatch.setattr(neighbors, "_compare", kept)
    points = written(distinct_points(df, NAMES, "label", "id"), "points")
    near = nearest_points(points, 5, chunk=40, fan=4)
    assert near.count() == 150 * 5
    visits, found = seen[1]
    known = neighbors._kth_distance(seen[0][1], 5)
    beyond = found.join(known, ["label", "point"]).where("distance > reach * (1 + 1e-9)")
    assert beyond.count() == 0
    assert found.count() < visits.count() * 5


def test_tiles_and_order_of_a_comparison(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(neighbors, "_TILE", 16)
    monkeypatch.setattr(neighbors, "_BLOCK", 8)
    b = rng.integers(0, 3, size=(90, 3)).astype(float)  # many ties
    b[7] = np.inf
    order = rng.permutation(90)
    own = np.arange(90)
    named = rng.random((90, 90)) < 0.6
    with np.errstate(invalid="ignore"):
        exact = np.sqrt(((b[:, None] - b[None]) ** 2).sum(-1))
    for pairs, reach in ((None, None), (named, None), (None, np.full(90, 1.0)), (named, np.full(90, 1.5))):
        judge = None if pairs is None else lambda r, c: pairs[r, c]
        with np.errstate(invalid="ignore"):
            row, col, away = neighbors._nearest(b, b, 4, own, order, reach, judge)
        for i in range(90):
            sound = [j for j in range(90) if j != i and np.isfinite(exact[i, j])]
            sound = [j for j in sound if pairs is None or pairs[i, j]]
            sound = [j for j in sound if reach is None or exact[i, j] <= reach[i]]
            assert list(col[row == i]) == sorted(sound, key=lambda j: (exact[i, j], order[j]))[:4]


def test_pairs_named_by_many_tables_are_compared_once(spark, monkeypatch):
    df, rows = cloud(spark, {0: 120, 1: 30})
    points = written(distinct_points(df, NAMES, "label", "id"), "points")
    compare, sent = neighbors._compare, []

    def counted(visits, *rest):
        sent.append(visits.count())
        return compare(visits, *rest)

    monkeypatch.setattr(neighbors, "_compare", counted)
    got = neighbors.nearest_points_lsh(points, 5, tables=4, bits=2, probes=1, chunk=50)
    assert sent == [150]
    # What the tables name, by the definition.
    planes = np.random.default_rng(0).normal(size=(8, 3))
    at = {r["point"]: np.array(r["vec"]) for r in points.collect()}
    label = {r["point"]: r["label"] for r in points.collect()}
    key = {r["point"]: r["first_key"] for r in points.collect()}

    def codes(p):
        margins = (planes @ p).reshape(4, 2)
        own = [sum(1 << i for i in range(2) if m[i] > 0) for m in margins]
        return own, [{c, c ^ (1 << int(np.argmin(np.abs(m))))} for c, m in zip(own, margins)]

    coded = {p: codes(v) for p, v in at.items()}
    near = {}
    for r in got.orderBy("slot").collect():
        near.setdefault(r["point"], []).append(r["neighbour"])
    for p in at:
        named = [
            q for q in at
            if q != p and label[q] == label[p] and any(o in s for o, s in zip(coded[q][0], coded[p][1]))
        ]
        named.sort(key=lambda q: (np.sqrt(((at[p] - at[q]) ** 2).sum()), key[q]))
        assert near[p] == named[:5]


def test_points_do_not_pass_through_the_driver(spark):
    df, _ = cloud(spark, {0: 60, 1: 20})
    plans = [
        smote(df, NAMES, "label", "id")._jdf.queryExecution().executedPlan().toString(),
        knn_within_class(df, NAMES, "label", "id", 3)._jdf.queryExecution().executedPlan().toString(),
    ]
    for plan in plans:
        joins = [line for line in plan.splitlines() if "Join " in line]
        assert any("SortMergeJoin" in j and "point" in j for j in joins)
        assert not any("BroadcastHashJoin" in j and ("point" in j or "neighbour" in j or "row" in j) for j in joins)


def watched(monkeypatch):
    """What each comparison is asked and what it returns, as stored tables."""
    compare, seen = neighbors._compare, []

    def kept(visits, *rest):
        seen.append((written(visits, "asked"), written(compare(visits, *rest), "returned")))
        return seen[-1][1]

    monkeypatch.setattr(neighbors, "_compare", kept)
    return seen


def test_points_are_not_sent_to_each_cell_by_themselves(spark, monkeypatch):
    df, rows = cloud(spark, {0: 300})  # no cell can be ruled out
    seen = watched(monkeypatch)
    got = {}
    for r in knn_within_class(df, NAMES, "label", "id", 5, chunk=16, fan=4).orderBy("key", "slot").collect():
        got.setdefault(r["key"], []).append(r["neighbour"])
    assert got == brute(rows, 5)
    assert all(asked.count() <= 300 for asked, _ in seen)
    assert len(seen) == 3


def test_a_comparison_returns_the_best_of_all_its_parts(spark, monkeypatch):
    df, _ = cloud(spark, {0: 120, 1: 30})
    points = written(distinct_points(df, NAMES, "label", "id"), "points")
    seen = watched(monkeypatch)
    assert neighbors.nearest_points_lsh(points, 5, tables=4, bits=2, probes=1, chunk=25).count() == 750
    (asked, returned), = seen
    assert returned.count() == 5 * asked.count() == 750


def test_parts_of_a_class_do_not_grow_in_number(spark):
    def dealt(size, chunk=65536):
        sizes = spark.createDataFrame([(0, "", size)], "label int, cell string, size long")
        return neighbors._deals(sizes.select("label", "cell"), sizes, chunk, None).collect()

    assert len(dealt(3000)) == 1
    for size in (100_000, 1_000_000):
        rows = dealt(size)
        assert {r["part"] for r in rows} == set(range(16))
        tasks = [(r["i"], r["j"]) for r in rows]
        assert len(set(tasks)) == 16 * 17 // 2 and len(tasks) == 16 * 16  # each pair once, each part 16 times
    assert {r["part"] for r in dealt(2_000_000)} == set(range(31))


def test_pairs_of_cells_are_sent_once_for_both_ways(spark):
    sizes = spark.createDataFrame([(0, c, 10) for c in "abc"], "label int, cell string, size long")
    beside = spark.createDataFrame([(0, "a", "b"), (0, "b", "a"), (0, "c", "a")], "label int, cell string, other string")
    rows = neighbors._deals(beside.select("label", "cell").distinct(), sizes, 65536, beside).collect()
    assert sorted((r["one"], r["two"], r["cell"], r["side"], r["asks"], r["told"]) for r in rows) == [
        ("a", "b", "a", 0, True, True),
        ("a", "b", "b", 1, True, True),
        ("a", "c", "a", 0, False, True),
        ("a", "c", "c", 1, True, False),
    ]


def test_visits_count_the_guests_that_need_a_leaf(spark):
    df, rows = cloud(spark, {0: 200}, clumps=True)
    points = written(distinct_points(df, NAMES, "label", "id"), "points")
    cells, tree = neighbors._tree(points, 16, 4)
    sizes = cells.groupBy("label", "cell").agg(F.count("*").alias("size"))
    known = neighbors._kth_distance(neighbors._compare(cells, cells, sizes, 5, 16), 5)
    homes = cells.select("label", "point", F.col("cell").alias("home")).join(known, ["label", "point"], "left")
    visits = neighbors._visits(homes, points, tree, 16)
    assert visits.agg(F.sum("guests")).first()[0] < cells.count() * sizes.count() / 2
    # Every leaf that holds a point within reach of one of a home is named.
    at = {r["point"]: (r["cell"], np.array(r["vec"])) for r in cells.collect()}
    reach = {r["point"]: r["reach"] for r in known.collect() if r["reach"] is not None}
    named = {(r["home"], r["cell"]) for r in visits.collect()}
    for p, (home, here) in at.items():
        for cell, there in at.values():
            if cell != home and np.sqrt(((here - there) ** 2).sum()) <= reach.get(p, np.inf):
                assert (home, cell) in named


def test_blocks_hold_leaves_of_one_parent_up_to_a_share(spark):
    df, _ = cloud(spark, {0: 400, 1: 90, 2: 5})
    points = written(distinct_points(df, NAMES, "label", "id"), "points")
    cells, tree = neighbors._tree(points, 40, 8)
    blocks = written(neighbors._blocks(cells, tree, 40), "blocks")
    leaves = cells.where("cell <> ''").select("label", F.col("cell").alias("leaf")).distinct()
    assert leaves.exceptAll(blocks.select("label", "leaf")).count() == 0
    assert blocks.count() == leaves.count() > blocks.select("label", "block").distinct().count()
    held = cells.withColumnRenamed("cell", "leaf").join(blocks, ["label", "leaf"]).groupBy("label", "block").count()
    assert held.agg(F.max("count")).first()[0] <= 40
    parents = blocks.groupBy("label", "block").agg(F.countDistinct(F.regexp_replace("leaf", "[^/]*$", "")).alias("n"))
    assert parents.where("n > 1").count() == 0


@pytest.mark.parametrize("sizes", [{}, {"chunk": 16, "fan": 4}])
def test_single_and_double_precision_and_infinite_points(spark, sizes):
    rng = np.random.default_rng(5)
    single = rng.normal(size=(60, 3)).astype(np.float32).astype(float)
    double = np.vstack([single[:30] + 1e-12, rng.normal(size=(30, 3)) * 1e3])  # not told apart in single precision
    rows = [(i, 0, *map(float, p)) for i, p in enumerate(np.vstack([single, double]))]
    df = spark.createDataFrame(
        rows + [(200, 0, float("inf"), 0.0, 1e300)], "id long, label int, x double, y double, z double"
    )
    got = {}
    for r in knn_within_class(df, NAMES, "label", "id", 3, **sizes).orderBy("key", "slot").collect():
        got.setdefault(r["key"], []).append(r["neighbour"])
    assert {k: v for k, v in got.items() if k != 200} == brute(rows, 3)


def test_buckets_that_name_few_pairs(spark):
    df, _ = cloud(spark, {0: 150})
    points = written(distinct_points(df, NAMES, "label", "id"), "points")
    got = {}
    for r in neighbors.nearest_points_lsh(points, 4, tables=2, bits=4, probes=2, chunk=20).orderBy("slot").collect():
        got.setdefault(r["point"], []).append(r["neighbour"])
    planes = np.random.default_rng(0).normal(size=(8, 3))
    at = {r["point"]: np.array(r["vec"]) for r in points.collect()}

    def codes(p):
        margins = (planes @ p).reshape(2, 4)
        own = [sum(1 << i for i in range(4) if m[i] > 0) for m in margins]
        return own, [{c, *(c ^ (1 << int(i)) for i in np.argsort(np.abs(m))[:2])} for c, m in zip(own, margins)]

    coded = {p: codes(v) for p, v in at.items()}
    for p in at:
        named = [q for q in at if q != p and any(o in s for o, s in zip(coded[q][0], coded[p][1]))]
        named.sort(key=lambda q: ((at[p] - at[q]) ** 2).sum())
        assert got.get(p, []) == named[:4]


def test_tiles_out_of_reach_are_not_compared(monkeypatch):
    rng = np.random.default_rng(6)
    b = np.vstack([rng.normal(size=(1024, 4)) + 100 * i for i in range(4)])
    measured, exact = [], neighbors._exact
    monkeypatch.setattr(neighbors, "_exact", lambda a, b, row, col: measured.append(set(col // 1024)) or exact(a, b, row, col))
    row, col, away = neighbors._nearest(b, b, 3, np.arange(len(b)), np.arange(len(b)), np.full(len(b), 50.0))
    assert all(len(tiles) == 1 for tiles in measured)
    assert (row // 1024 == col // 1024).all() and len(row) == 3 * len(b)
