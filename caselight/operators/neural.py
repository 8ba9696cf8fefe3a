"""Neural classifier: fit with history, sweep over folds and feature subsets.

The network is MLlib's multilayer perceptron (sigmoid hidden units, softmax
output), trained on all partitions at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.functions.hashing import seeded_hash
from caselight.operators.boosting import VECTOR, assemble, score
from caselight.operators.columns import feature_subset, union_tables
from caselight.operators.folds import fold_split
from caselight.operators.metrics import evaluate, loss_of

# Two hidden layers, passes, seed, feature subsets. A pass over
# minibatches becomes one step over all rows, so 20 steps are far fewer updates.
HIDDEN = (23, 23)
EPOCHS = 20
SEED = 42
SUBSETS = ((16, 17, 18, 19, 20), (13, 15, 17, 18, 19))

_HISTORY = "step int, side string, metric string, value double"


def _network(
    features: Sequence[str], label: str, hidden: Sequence[int], seed: int, solver: str, rate: float
) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        featuresCol=VECTOR,
        labelCol=label,
        layers=[len(features), *hidden, 2],
        seed=seed,
        solver=solver,
        stepSize=rate,
        tol=0.0,
    )


def _measures(
    model: MultilayerPerceptronClassificationModel,
    sides: dict[str, DataFrame],
    features: Sequence[str],
    label: str,
    step: int,
) -> list[tuple[int, str, str, float]]:
    out = []
    for side, part in sides.items():
        row = evaluate(score(model, part, features), label).first()
        out += [(step, side, "loss", row["log_loss"]), (step, side, "accuracy", row["accuracy"])]
    return out


def mixed(df: DataFrame, key: str, seed: int, partitions: int | None = None) -> DataFrame:
    """Rows dealt out and ordered by a seeded hash of their key, over as many
    partitions as the session shuffles into unless told otherwise.

    The solver averages over blocks of rows, a short last one weighing as much
    as a full one, so rows that lie sorted by class would pull the fit to the
    class of the last block. Mixed, every block is a sample of all rows, and how
    the input lies makes no difference.
    """
    place = seeded_hash(seed, f"`{key}`")
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_place", place).repartition(partitions, "_place").sortWithinPartitions("_place").drop("_place")


def fit_mlp(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    valid: DataFrame | None = None,
    hidden: Sequence[int] = HIDDEN,
    max_iter: int = EPOCHS,
    seed: int = SEED,
    history_every: int = 0,
    solver: str = "gd",
    rate: float = 0.03,
    key: str | None = None,
    initial_weights: Sequence[float] | None = None,
) -> tuple[MultilayerPerceptronClassificationModel, DataFrame]:
    """Train, and measure loss and accuracy every ``history_every`` steps.

    Training goes on from the weights of the step before, which gradient
    descent allows without a change of course. ``max_iter=0`` returns the
    network as initialised, or as ``initial_weights`` say. Returns (model,
    history), the history empty when it is not asked for. Rows are mixed by
    ``key`` first; without it they must be mixed already (see ``mixed``).
    """
    rows = mixed(df.select(key, label, *features), key, seed) if key else df
    train = assemble(rows.select(label, *features), features).select(label, VECTOR).persist()
    sides = {"train": df} | ({"valid": valid} if valid is not None else {})
    try:
        network = _network(features, label, hidden, seed, solver, rate)
        if initial_weights is not None:
            network = network.setInitialWeights(Vectors.dense(list(initial_weights)))
        stride = min(history_every, max_iter) if history_every else max_iter
        model = network.setMaxIter(stride).fit(train)
        history, done = [], stride
        if history_every:
            history += _measures(model, sides, features, label, done)
        while done < max_iter:
            stride = min(history_every, max_iter - done)
            model = network.setInitialWeights(model.weights).setMaxIter(stride).fit(train)
            done += stride
            history += _measures(model, sides, features, label, done)
    finally:
        train.unpersist()
    return model, df.sparkSession.createDataFrame(history, _HISTORY)


def sweep(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    folds: int,
    subsets: Sequence[Sequence[int]] = SUBSETS,
    max_iter: int = EPOCHS,
    history_every: int = EPOCHS,
    seed: int = SEED,
    parallelism: int = 4,
    fold: str = "fold",
    key: str | None = None,
    hidden: Sequence[int] = HIDDEN,
    initial_weights: Sequence[float] | None = None,
) -> DataFrame:
    """Train one network per fold and feature subset:
    ``(fold, subset, step, side, metric, value)``.

    The trainings do not depend on each other and are submitted side by side. The
    measures of all of them, at all steps, come out of one aggregate over one
    table that has the scores of all networks side by side.
    """
    rows = (mixed(df.select(key, fold, label, *features), key, seed) if key else df).persist()

    def run(job: tuple[int, int]) -> list[tuple[int, int, int, MultilayerPerceptronClassificationModel]]:
        k, s = job
        train, _ = fold_split(rows, k, fold)
        names = feature_subset(features, subsets[s])
        return [
            (k, s, step, model)
            for step, model in _trained(train, names, label, hidden, max_iter, seed, history_every, initial_weights)
        ]

    jobs = [(k, s) for k in range(folds) for s in range(len(subsets))]
    try:
        with ThreadPool(parallelism) as pool:
            models = [m for part in pool.map(run, jobs) for m in part]
        return _compared(rows, models, features, subsets, label, fold)
    finally:
        rows.unpersist()


def _trained(
    train: DataFrame,
    names: Sequence[str],
    label: str,
    hidden: Sequence[int],
    max_iter: int,
    seed: int,
    every: int,
    initial_weights: Sequence[float] | None = None,
) -> list[tuple[int, MultilayerPerceptronClassificationModel]]:
    """The network after every so many steps, and after the last."""
    known = assemble(train.select(label, *names), names).select(label, VECTOR).persist()
    try:
        network = _network(names, label, hidden, seed, "gd", 0.03)
        if initial_weights is not None:
            network = network.setInitialWeights(Vectors.dense(list(initial_weights)))
        out, done = [], 0
        while done < max_iter or not out:
            stride = min(every or max_iter, max_iter - done)
            model = network.setMaxIter(stride).fit(known)
            done += stride
            out.append((done, model))
            network = network.setInitialWeights(model.weights)
        return out
    finally:
        known.unpersist()


def _compared(
    rows: DataFrame,
    models: Sequence[tuple[int, int, int, MultilayerPerceptronClassificationModel]],
    features: Sequence[str],
    subsets: Sequence[Sequence[int]],
    label: str,
    fold: str,
) -> DataFrame:
    """Loss and accuracy of every network on either side of its fold."""
    table = rows
    for s, subset in enumerate(subsets):
        table = assemble(table, feature_subset(features, subset)).withColumnRenamed(VECTOR, f"_in{s}")
    for i, (_, s, _, model) in enumerate(models):
        scored = model.setFeaturesCol(f"_in{s}").setProbabilityCol("_p").setPredictionCol(f"_said{i}").setRawPredictionCol("")
        table = scored.transform(table).withColumn(f"_score{i}", vector_to_array("_p")[1]).drop("_p")
    sums = []
    for i, (k, _, _, _) in enumerate(models):
        right = (F.col(label) == F.col(f"_said{i}")).cast("double")
        for side, here in (("train", F.col(fold) != k), ("valid", F.col(fold) == k)):
            sums.append(F.avg(F.when(here, loss_of(label, f"_score{i}"))).alias(f"{i}:{side}:loss"))
            sums.append(F.avg(F.when(here, right)).alias(f"{i}:{side}:accuracy"))
    measured = table.agg(*sums).first().asDict()
    out = []
    for name, value in measured.items():
        i, side, metric = name.split(":")
        k, s, step, _ = models[int(i)]
        out.append((k, s, step, side, metric, value))
    return rows.sparkSession.createDataFrame(out, f"fold int, subset int, {_HISTORY}")


def score_both_sides(
    model: MultilayerPerceptronClassificationModel,
    train: DataFrame,
    valid: DataFrame,
    features: Sequence[str],
) -> DataFrame:
    """Score training and validation rows together, marked by ``side``."""
    parts = [
        score(model, part.selectExpr("*", f"'{side}' as side"), features)
        for side, part in (("train", train), ("valid", valid))
    ]
    return union_tables(parts)
