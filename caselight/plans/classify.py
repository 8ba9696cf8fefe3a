"""Train and judge the two classifiers on report features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caselight.operators.boosting import BoostParams, feature_importance, grid_search, score
from caselight.operators.columns import drop_columns, feature_subset, select_positions, split_label
from caselight.operators.folds import fold_split, split_report, stratified_folds
from caselight.operators.metrics import (
    accuracy,
    auprc,
    classification_report,
    pr_curve,
    prediction_share,
    roc_auc,
)
from caselight.operators.neural import EPOCHS, SEED, SUBSETS, fit_mlp, score_both_sides, sweep
from caselight.operators.profile import apply_scaler, fit_scaler
from caselight.sources.tables import read_table
from caselight.storage import written

# Columns kept by position, columns dropped, folds and their seed.
BOOST_COLUMNS = tuple(range(2, 29))
BOOST_DROPPED = ("Reported by pregnancy", "Reported by different use pattern")
NEURAL_COLUMNS = tuple(range(1, 49))
BOOST_FOLDS, NEURAL_FOLDS, SEARCH_FOLDS, FOLD_SEED = 4, 5, 10, 1004
BOOST_GRID = {"rounds": (1000,), "rate": (0.01,), "seed": (111,)}


def read_features(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    key: str,
    positions: Sequence[int],
    label: str = "Label",
    dropped: Sequence[str] = (),
    fmt: str = "csv",
) -> tuple[DataFrame, list[str]]:
    """A feature table from a file: its columns by position and without the
    dropped ones, the label as 0/1, features as double, and the key beside
    them. Returns the table and the feature names."""
    table = read_table(spark, path, fmt, schema)
    at = [*positions] if table.columns.index(key) in positions else [table.columns.index(key), *positions]
    kept = drop_columns(select_positions(table, at), list(dropped))
    names, label = split_label(kept.drop(key), label)
    features = [F.col(f"`{n}`").cast("double").alias(n) for n in names]
    return kept.select(key, F.col(label).cast("int").alias(label), *features), names


@dataclass
class Judged:
    split: DataFrame
    results: DataFrame
    scored: DataFrame
    measures: dict[str, DataFrame]


def boosted(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    grid: Mapping[str, Sequence] = BOOST_GRID,
    base: BoostParams = BoostParams(),
    folds: int = BOOST_FOLDS,
    search_folds: int = SEARCH_FOLDS,
    oversample: str = "before_cv",
) -> Judged:
    """Fold 0 held out; the rest balanced, searched and refitted; then judged."""
    folded = written(stratified_folds(df, label, folds, FOLD_SEED, key), "folds")
    train, valid = fold_split(folded, 0)
    model, results = grid_search(
        train, features, label, key, grid, base, search_folds, FOLD_SEED, oversample=oversample
    )
    scored = written(score(model, valid, features), "scored")
    return Judged(
        split=split_report(folded, 0, label),
        results=results,
        scored=scored,
        measures={
            "roc_auc": roc_auc(scored, label),
            "auprc": auprc(scored, label),
            "pr_curve": pr_curve(scored, label),
            "report": classification_report(scored, label),
            "importance": feature_importance(model, df, features),
        },
    )


def neural(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    subsets: Sequence[Sequence[int]] = SUBSETS,
    folds: int = NEURAL_FOLDS,
    max_iter: int = EPOCHS,
    history_every: int = 1,
    scale_on_train: bool = False,
) -> Judged:
    """Standardise, sweep folds and subsets, then train the final and the
    untrained network on fold 0 and score training and validation rows.

    The scaler is fitted on all rows; ``scale_on_train`` fits it on the
    training side of fold 0.
    """
    folded = written(stratified_folds(df, label, folds, FOLD_SEED, key), "folds")
    base = fold_split(folded, 0)[0] if scale_on_train else folded
    scaled = written(apply_scaler(folded, fit_scaler(base, features)), "scaled")
    results = sweep(scaled, features, label, folds, subsets, max_iter, history_every, key=key)
    train, valid = fold_split(scaled, 0)
    names = feature_subset(features, subsets[0])
    final, _ = fit_mlp(train, names, label, max_iter=max_iter, seed=SEED, key=key)
    blank, _ = fit_mlp(train, names, label, max_iter=0, seed=SEED, key=key)
    scored = score_both_sides(final, train, valid, names)
    control = score_both_sides(blank, train, valid, names)
    return Judged(
        split=split_report(folded, 0, label),
        results=results,
        scored=scored,
        measures={
            "accuracy": accuracy(scored, label),
            "shares": prediction_share(scored),
            "control_accuracy": accuracy(control, label),
            "control_shares": prediction_share(control),
        },
    )
