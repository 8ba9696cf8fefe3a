"""Boosted trees: fit, cross-validated search, scores and importances.

Trees are MLlib's, so scores differ from other boosting libraries; what is
compared is metrics.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.operators.folds import fold_split, stratified_folds
from caselight.operators.smote import smote
from caselight.storage import scratch_path, use_checkpoints, written

VECTOR = "_features"


@dataclass(frozen=True)
class BoostParams:
    """Rounds, rate and seed; depth is the usual default of 6."""

    rounds: int = 1000
    rate: float = 0.01
    seed: int = 111
    depth: int = 6


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the feature vector MLlib takes. A row with a missing feature is an
    error there, not silently dropped."""
    return VectorAssembler(
        inputCols=list(features), outputCol=VECTOR, handleInvalid="error"
    ).transform(df)


def _classifier(df: DataFrame, label: str, params: BoostParams) -> GBTClassifier:
    use_checkpoints(df.sparkSession)
    return GBTClassifier(
        featuresCol=VECTOR,
        labelCol=label,
        maxIter=params.rounds,
        stepSize=params.rate,
        seed=params.seed,
        maxDepth=params.depth,
        checkpointInterval=10,  # cuts the lineage that grows with the rounds
    )


def fit_gbt(
    df: DataFrame, features: Sequence[str], label: str, params: BoostParams = BoostParams()
) -> GBTClassificationModel:
    return _classifier(df, label, params).fit(assemble(df, features))


def score(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``score`` (probability of class 1) and ``prediction`` (0/1)."""
    scored = model.transform(assemble(df, features))
    return scored.select(
        *df.columns,
        vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def _grid(base: BoostParams, grid: Mapping[str, Sequence]) -> list[BoostParams]:
    names = list(grid)
    return [replace(base, **dict(zip(names, v))) for v in product(*grid.values())]


def _results(df: DataFrame, trials: Sequence[BoostParams], means: Sequence[float]) -> DataFrame:
    best = max(range(len(means)), key=lambda i: means[i])
    rows = [
        (p.rounds, p.rate, p.seed, p.depth, float(m), i == best)
        for i, (p, m) in enumerate(zip(trials, means))
    ]
    return df.sparkSession.createDataFrame(
        rows, "rounds int, rate double, seed int, depth int, accuracy double, best boolean"
    )


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model as it was after its first ``rounds`` trees."""
    sc = SparkContext.getOrCreate()
    java = model._java_obj
    trees, weights = java.trees()[:rounds], java.treeWeights()[:rounds]
    kind = sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    tree_array = sc._gateway.new_array(kind, len(trees))
    weight_array = sc._gateway.new_array(sc._jvm.double, len(weights))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        tree_array[i], weight_array[i] = tree, weight
    shorter = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), tree_array, weight_array)
    out = GBTClassificationModel(shorter)
    out._resetUid(model.uid)
    return out.setFeaturesCol(VECTOR)


def grid_search(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    grid: Mapping[str, Sequence],
    base: BoostParams = BoostParams(),
    k: int = 10,
    seed: int = 1004,
    parallelism: int = 4,
    oversample: str = "before_cv",
    smote_seed: int = 0,
) -> tuple[GBTClassificationModel, DataFrame]:
    """Best parameters by mean accuracy over stratified folds, refitted on all rows.

    ``oversample="before_cv"`` balances the classes once, so made rows and their
    parents may sit in different folds; ``"within_fold"`` balances each training
    part alone; ``"none"`` does not balance. Returns the model and one row per
    parameter set.

    Trees are added one after another, so parameter sets that differ in rounds
    alone share one ensemble a fold: it is grown to the most rounds, and judged
    after the first so many trees of each, all in one pass over the held rows.
    """
    if oversample not in ("before_cv", "within_fold", "none"):
        raise ValueError("oversample is 'before_cv', 'within_fold' or 'none'")
    trials = _grid(base, grid)

    def balanced(part: DataFrame) -> DataFrame:
        return smote(part, features, label, key, seed=smote_seed)

    rows = df.select(key, label, *features)
    everything = written(balanced(rows), "balanced") if oversample != "none" else rows
    to_fold = everything if oversample == "before_cv" else rows
    folded = stratified_folds(to_fold, label, k, seed, key).persist()
    per_fold = balanced if oversample == "within_fold" else None
    try:
        means = _mean_over_folds(folded, features, label, trials, k, per_fold, parallelism)
    finally:
        folded.unpersist()
    best = trials[max(range(len(means)), key=lambda i: means[i])]
    return fit_gbt(everything, features, label, best), _results(df, trials, means)


def _mean_over_folds(
    folded: DataFrame,
    features: Sequence[str],
    label: str,
    trials: Sequence[BoostParams],
    k: int,
    balanced: Callable[[DataFrame], DataFrame] | None,
    parallelism: int,
) -> list[float]:
    """Mean accuracy of every parameter set over the folds, which do not depend
    on one another and are submitted side by side."""
    most: dict[BoostParams, int] = {}
    for p in trials:
        alike = replace(p, rounds=0)
        most[alike] = max(most.get(alike, 0), p.rounds)

    def run(fold: int) -> list[float]:
        train, valid = fold_split(folded, fold)
        part = assemble(train if balanced is None else written(balanced(train), "balanced"), features)
        part = part.select(label, VECTOR).persist()
        try:
            grown = {alike: _classifier(part, label, replace(alike, rounds=n)).fit(part) for alike, n in most.items()}
        finally:
            part.unpersist()
        held = assemble(valid, features).select(label, VECTOR)
        for i, p in enumerate(trials):
            model = first_rounds(grown[replace(p, rounds=0)], p.rounds)
            model = model.setPredictionCol(f"_said{i}").setProbabilityCol("").setRawPredictionCol("")
            held = model.transform(held)
        right = [F.avg((F.col(label) == F.col(f"_said{i}")).cast("double")) for i in range(len(trials))]
        return list(held.agg(*right).first())

    with ThreadPool(parallelism) as pool:
        each = pool.map(run, range(k))
    return [sum(x) / k for x in zip(*each)]


def feature_importance(
    model: GBTClassificationModel, df: DataFrame, names: Sequence[str], kind: str = "splits"
) -> DataFrame:
    """(feature, importance), highest first: how often a feature splits a node,
    or MLlib's gain-based share. A feature never used has 0."""
    spark = df.sparkSession
    all_names = spark.createDataFrame(list(enumerate(names)), "index int, feature string")
    if kind == "gain":
        gains = model.featureImportances.toArray().tolist()
        found = spark.createDataFrame(
            [(i, float(g)) for i, g in enumerate(gains)], "index int, importance double"
        )
    elif kind == "splits":
        path = scratch_path(spark, "model")
        model.save(path)
        nodes = spark.read.parquet(f"{path}/data")
        split = F.col("nodeData.split.featureIndex")
        found = (
            nodes.filter(split >= 0)
            .groupBy(split.alias("index"))
            .agg(F.count(F.lit(1)).cast("double").alias("importance"))
        )
    else:
        raise ValueError("kind is 'splits' or 'gain'")
    return (
        all_names.join(found, "index", "left")
        .select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


