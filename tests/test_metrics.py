import math
import random

import pytest
from pyspark.sql import functions as F

from caselight.operators import metrics


def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, score double, prediction int")


@pytest.fixture(scope="module")
def tied(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(500):
        y = int(rnd.random() < 0.2)
        s = 0.9 if rnd.random() < 0.33 else round(min(1.0, max(0.0, rnd.gauss(0.4 + 0.2 * y, 0.2))), 2)
        rows.append((y, s, int(s >= 0.5)))
    return rows


def auc_by_pairs(rows):
    pos = [s for y, s, _ in rows if y]
    neg = [s for y, s, _ in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def curve_by_hand(rows):
    out = [(1.0, 0.0)]
    p = sum(y for y, _, _ in rows)
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        tp = sum(1 for y, s, _ in rows if s >= t and y)
        out.append((tp / sum(1 for _, s, _ in rows if s >= t), tp / p))
    return out


def test_roc_auc(spark, tied):
    df = frame(spark, tied)
    got = metrics.roc_auc(df).first()[0]
    assert got == pytest.approx(auc_by_pairs(tied))
    moved = df.withColumn("score", F.exp(F.col("score") * 3) - 7)
    assert metrics.roc_auc(moved).first()[0] == pytest.approx(got)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class(spark, label):
    df = frame(spark, [(label, 0.2, 0), (label, 0.7, 1)])
    assert metrics.roc_auc(df).first()[0] is None


def test_pr_curve_and_area(spark, tied):
    df = frame(spark, tied)
    want = curve_by_hand(tied)
    got = metrics.pr_curve(df).orderBy(F.desc_nulls_first("threshold")).collect()
    assert [(r["precision"], r["recall"]) for r in got] == [pytest.approx(w) for w in want]
    area = sum((b[1] - a[1]) * (a[0] + b[0]) / 2 for a, b in zip(want, want[1:]))
    assert metrics.auprc(df).first()[0] == pytest.approx(area)


def test_report(spark):
    df = frame(spark, [(1, 0.9, 1), (1, 0.1, 0), (0, 0.8, 1), (0, 0.2, 0), (0, 0.3, 0)])
    r = metrics.classification_report(df).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 2)
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (0.6, 0.5, 0.5, 0.5)
    assert metrics.accuracy(df).first()[0] == 0.6
    none = metrics.classification_report(frame(spark, [(0, 0.1, 0)])).first()
    assert none["f1"] == 0 and none["precision"] == 0


def test_loss_and_shares(spark):
    df = frame(spark, [(1, 0.8, 1), (0, 0.4, 0), (1, 0.0, 0)])
    want = -(math.log(0.8) + math.log(0.6) + math.log(1e-15)) / 3
    assert metrics.log_loss(df).first()[0] == pytest.approx(want)
    both = metrics.evaluate(df).first()
    assert both["log_loss"] == pytest.approx(want) and both["accuracy"] == pytest.approx(2 / 3)
    shares = {r["prediction"]: (r["count"], r["share"]) for r in metrics.prediction_share(df).collect()}
    assert shares == {1: (1, pytest.approx(1 / 3)), 0: (2, pytest.approx(2 / 3))}


def test_rows_with_something_missing_count_nowhere(spark):
    rows = [(1, 0.9, 1), (None, 0.9, 1), (1, None, None), (0, float("nan"), 0)]
    pred = spark.createDataFrame(rows, "label int, score double, prediction int")
    alone = spark.createDataFrame(rows[:1], pred.schema)
    assert metrics.log_loss(pred).first()[0] == pytest.approx(metrics.log_loss(alone).first()[0])
    assert metrics.evaluate(pred).first()["log_loss"] == pytest.approx(-math.log(0.9))
    assert metrics.prediction_share(pred).agg({"share": "sum"}).first()[0] == pytest.approx(1)
    assert metrics.score_counts(pred).count() == 1
