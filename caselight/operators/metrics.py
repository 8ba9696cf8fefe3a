"""Judging scored predictions: columns ``label`` (0/1), ``score`` and ``prediction``.

Curve and rank measures only need how many positives and negatives have each
score. That table is written once; what follows reads it, not the predictions.

A row counts in a measure if all that the measure reads of it is known; rows with
a missing label, score or prediction are left out of every measure that needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.operators.ordering import lagged, running
from caselight.storage import written

_SMALLEST = 1e-15


def score_counts(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score."""
    positive = (F.col(label) == 1).cast("long")
    return written(
        pred.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.sum(positive).alias("positives"), F.sum(1 - positive).alias("negatives")),
        "score-counts",
    )


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs ranked
    right, ties counting half. NULL when a class is missing."""
    counts = running(score_counts(pred, label, score), "score", sums=["negatives"])
    below = F.col("running_sum_negatives") - F.col("negatives") / 2
    sums = counts.agg(
        F.sum(F.col("positives") * below).alias("won"),
        F.sum("positives").cast("double").alias("p"),
        F.sum("negatives").cast("double").alias("q"),
    )
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return sums.select(
        F.when(both, F.col("won") / (F.col("p") * F.col("q"))).alias("roc_auc")
    )


def pr_curve(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the end point
    (NULL, 1, 0). Recall is NULL when nothing is positive."""
    counts = score_counts(pred, label, score)
    total = counts.agg(F.sum("positives").cast("double")).scalar()
    taken = running(counts, "score", sums=["positives", "negatives"], descending=True)
    hit, miss = F.col("running_sum_positives"), F.col("running_sum_negatives")
    points = taken.select(
        F.col("score").alias("threshold"),
        (hit / (hit + miss)).alias("precision"),
        F.when(total > 0, hit / total).alias("recall"),
    )
    end = pred.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def auc_trapezoid(curve: DataFrame, x: str, y: str, order: str) -> DataFrame:
    """Area under ``y`` over ``x`` by the trapezoid rule along ``order``, whose
    values are unique; NULL, at most once, is the far end."""
    along = "_along"
    placed = curve.select(
        F.coalesce(F.col(order).cast("double"), F.lit(float("inf"))).alias(along), x, y
    )
    steps = lagged(placed, along, [x, y], descending=True)
    area = (F.col(x) - F.col(f"previous_{x}")) * (F.col(y) + F.col(f"previous_{y}")) / 2
    return steps.agg(F.abs(F.sum(area)).alias("area"))


def auprc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the precision-recall curve."""
    curve = pr_curve(pred, label, score)
    return auc_trapezoid(curve, "recall", "precision", "threshold").select(
        F.col("area").alias("auprc")
    )


def classification_report(
    pred: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 in one pass.
    A ratio over nothing is 0."""
    actual, said = F.col(label) == 1, F.col(prediction) == 1
    counts = pred.agg(
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(~actual & ~said).alias("tn"),
    )
    return counts.selectExpr(
        "tp", "fp", "fn", "tn",
        "coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0D) as accuracy",
        "coalesce(tp / nullif(tp + fp, 0), 0D) as precision",
        "coalesce(tp / nullif(tp + fn, 0), 0D) as recall",
        "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0D) as f1",
    )


def accuracy(
    pred: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    right = (F.col(label) == F.col(prediction)).cast("double")
    return pred.agg(F.avg(right).alias("accuracy"))


def loss_of(label: str, score: str) -> Column:
    """Cross-entropy of a row; NULL if its label or score is missing."""
    chance = F.greatest(F.lit(_SMALLEST), F.least(F.lit(1 - _SMALLEST), F.col(score)))
    given = F.when(F.col(label) == 1, chance).otherwise(1 - chance)
    known = F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    return F.when(known, -F.log(given))


def log_loss(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Mean cross-entropy over rows; probabilities are kept off 0 and 1."""
    return pred.agg(F.avg(loss_of(label, score)).alias("log_loss"))


def evaluate(
    pred: DataFrame, label: str = "label", score: str = "score", prediction: str = "prediction"
) -> DataFrame:
    """Loss and accuracy in one pass, each over the rows it can be told for."""
    right = (F.col(label) == F.col(prediction)).cast("double")
    return pred.agg(F.avg(loss_of(label, score)).alias("log_loss"), F.avg(right).alias("accuracy"))


def prediction_share(pred: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Count and share of each predicted class."""
    counts = pred.where(F.col(prediction).isNotNull()).groupBy(F.col(prediction).cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.col("count") / total)
