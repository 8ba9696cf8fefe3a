import math
import random

import pytest
from pyspark.sql import functions as F

from caselight.operators import columns, folds, ordering, profile
from caselight.sources.tables import read_table, read_tables, write_scores
from caselight.storage import shared_dir, written


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 0)], ["a", "b x", "c", "Label"])
    assert columns.select_positions(df, [1, 3]).columns == ["b x", "Label"]
    assert columns.split_label(df, "Label") == (["a", "b x", "c"], "Label")
    assert columns.drop_columns(df, ["b x"]).columns == ["a", "c", "Label"]
    assert columns.feature_subset(["p", "q", "r"], [2, 0]) == ["r", "p"]
    assert columns.feature_subset(["p", "q"]) == ["p", "q"]
    with pytest.raises(ValueError):
        columns.drop_columns(df, ["nope"])
    with pytest.raises(ValueError):
        columns.split_label(df, "nope")


def test_union_keeps_copies_and_wants_same_columns(spark):
    a = spark.createDataFrame([(1, 2)], ["x", "y"])
    b = spark.createDataFrame([(2, 1)], ["y", "x"])
    assert columns.union_tables([a, b, a]).collect() == [(1, 2)] * 3
    with pytest.raises(Exception):
        columns.union_tables([a, a.withColumnRenamed("y", "z")]).collect()


def test_row_index_spreads_a_hot_value(spark):
    # A third of the rows share one sort value; the key breaks the tie.
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.rand(1)).alias("x"))
    df = written(df, "hot")
    got = ordering.row_index(df, [F.col("x"), F.col("id")], "n").collect()
    expected = {r["id"]: i for i, r in enumerate(sorted(got, key=lambda r: (r["x"], r["id"])))}
    assert all(r["n"] == expected[r["id"]] for r in got)


@pytest.mark.parametrize("blocks", [1, 3, 50])
@pytest.mark.parametrize("descending", [False, True])
def test_running_matches_a_loop(spark, blocks, descending):
    random.seed(blocks)
    data = [(float(x), random.randint(1, 9), random.random()) for x in random.sample(range(10**6), 400)]
    df = spark.createDataFrame(data, "x double, n int, m double")
    got = {
        r["x"]: (r["running_sum_n"], r["running_min_m"])
        for r in ordering.running(df, "x", ["n"], ["m"], descending, blocks).collect()
    }
    total, least = 0, math.inf
    for x, n, m in sorted(data, reverse=descending):
        total, least = total + n, min(least, m)
        assert got[x] == (total, least)


@pytest.mark.parametrize("descending", [False, True])
def test_lagged_matches_a_loop(spark, descending):
    data = [(float(x), x * 2) for x in random.Random(3).sample(range(10**6), 200)]
    df = spark.createDataFrame(data, "x double, v int")
    got = {r["x"]: r["previous_v"] for r in ordering.lagged(df, "x", ["v"], descending, 9).collect()}
    before = None
    for x, v in sorted(data, reverse=descending):
        assert got[x] == before
        before = v


def test_running_handles_infinite_order_values(spark):
    df = spark.createDataFrame([(float("inf"), 1), (1.0, 2), (float("-inf"), 4)], "x double, n int")
    got = {r["x"]: r["running_sum_n"] for r in ordering.running(df, "x", ["n"], blocks=2).collect()}
    assert got == {float("-inf"): 4, 1.0: 6, float("inf"): 7}


def test_hash_index_is_dense_and_free_of_layout(spark):
    df = spark.range(1000).select("id", (F.col("id") < 900).alias("hot"))
    one = ordering.hash_index(df, "hot", "id", 5, "n")
    for hot, size in ((True, 900), (False, 100)):
        got = sorted(r["n"] for r in one.filter(F.col("hot") == hot).collect())
        assert got == list(range(size))
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        other = ordering.hash_index(df.repartition(13), "hot", "id", 5, "n")
        assert one.exceptAll(other).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_profile(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, 1), (2.0, 5.0, 0), (None, 5.0, 1), (float("nan"), 5.0, None)],
        "x double, c double, label int",
    )
    assert profile.shape(df).first() == (4, 3)
    assert [tuple(r) for r in profile.value_counts(df, "label").collect()] == [(1, 2), (0, 1)]
    shares = {r["label"]: r["share"] for r in profile.class_share(df, "label").collect()}
    assert shares[1] == pytest.approx(2 / 3)
    stats = {r["feature"]: r for r in profile.describe_features(df, ["x", "c"]).collect()}
    assert (stats["x"]["count"], stats["x"]["mean"], stats["x"]["variance"]) == (2, 1.5, 0.5)
    assert stats["c"]["variance"] == 0


def test_scaler(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("x"), F.lit(0.1).alias("c"))
    scaled = profile.apply_scaler(df, profile.fit_scaler(df, ["x", "c"]))
    row = scaled.agg(F.avg("x"), F.var_pop("x"), F.min("c"), F.max("c")).first()
    assert row[0] == pytest.approx(0, abs=1e-12) and row[1] == pytest.approx(1)
    assert row[2] == row[3] == 0
    assert scaled.columns == df.columns
    one = df.limit(1)
    assert profile.apply_scaler(one, profile.fit_scaler(one, ["x"])).first()["x"] == 0


@pytest.mark.parametrize("k", [2, 4, 5, 10])
def test_folds(spark, k):
    df = spark.range(1003).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 1000, "b").otherwise("c").alias("y"))
    got = folds.stratified_folds(df, "y", k, 1004, "id")
    assert got.count() == 1003
    assert got.select("id").distinct().count() == 1003
    by = {}
    for r in got.groupBy("y", "fold").count().collect():
        by.setdefault(r["y"], {})[r["fold"]] = r["count"]
    for sizes in by.values():
        per = [sizes.get(f, 0) for f in range(k)]
        assert max(per) - min(per) <= 1
    whole = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert max(whole) - min(whole) <= 1
    other = folds.stratified_folds(df, "y", k, 1005, "id")
    assert got.exceptAll(other).count() > 0


def test_folds_one_class_and_split(spark):
    df = spark.range(10).select("id", F.lit(1).alias("y"))
    got = folds.stratified_folds(df, "y", 5, 1, "id")
    train, valid = folds.fold_split(got, 2)
    assert (train.count(), valid.count()) == (8, 2)
    report = {r["side"]: r for r in folds.split_report(got, 2, "y").collect()}
    assert report["train"]["share"] == pytest.approx(0.8)
    assert report["valid"]["positive_rate"] == 1
    with pytest.raises(ValueError):
        folds.stratified_folds(df, "y", 1, 1, "id")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n bigint, s string")
    df.write.option("header", True).csv(str(tmp_path / "c"))
    df.write.parquet(str(tmp_path / "p1"))
    df.write.parquet(str(tmp_path / "p2"))
    assert read_table(spark, str(tmp_path / "c"), "csv", df.schema).count() == 2
    assert read_tables(spark, [str(tmp_path / p) for p in ("p1", "p2")], df.schema).count() == 4
    write_scores(df, str(tmp_path / "s"), row_id=True, order_by=["s"])
    back = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert sorted(map(tuple, back.collect())) == [("1", "1", "a"), ("2", "2", "b")]
    write_scores(df, str(tmp_path / "plain"))
    assert spark.read.option("header", True).csv(str(tmp_path / "plain")).columns == ["n", "s"]


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
