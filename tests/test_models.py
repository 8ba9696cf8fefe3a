import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.operators import boosting, neural
from caselight.operators.boosting import BoostParams
from caselight.operators.folds import fold_split, stratified_folds
from caselight.operators.metrics import accuracy, evaluate
from caselight.plans import classify
from caselight.storage import written

NAMES = [f"f{i}" for i in range(6)]
FAST = BoostParams(rounds=4, rate=0.3, depth=2)


@pytest.fixture(scope="module")
def data(spark):
    """The label follows f1 and f3; one column is constant."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(260, 6))
    x[:, 5] = 1.0
    y = (x[:, 1] + 0.8 * x[:, 3] + 0.3 * rng.normal(size=260) > 0.9).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(260)]
    schema = "row_id long, label int, " + ", ".join(f"{c} double" for c in NAMES)
    return written(spark.createDataFrame(rows, schema), "features")


def test_gbt_scores_and_importance(spark, data):
    model = boosting.fit_gbt(data, NAMES, "label", FAST)
    scored = boosting.score(model, data, NAMES)
    assert scored.filter("score < 0 or score > 1").count() == 0
    assert scored.filter("prediction <> cast(score > 0.5 as int)").count() == 0
    assert accuracy(scored).first()[0] > 0.85
    splits = boosting.feature_importance(model, data, NAMES)
    rows = splits.collect()
    assert {r["feature"] for r in rows} == set(NAMES)
    inner = sum((t.numNodes - 1) // 2 for t in model.trees)
    assert sum(r["importance"] for r in rows) == inner
    assert rows[0]["feature"] in ("f1", "f3")
    assert next(r for r in rows if r["feature"] == "f5")["importance"] == 0
    gain = boosting.feature_importance(model, data, NAMES, "gain")
    assert gain.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        boosting.feature_importance(model, data, NAMES, "weight")


def test_missing_feature_is_an_error(spark, data):
    holed = data.withColumn("f0", F.when(F.col("row_id") > 3, F.col("f0")))
    with pytest.raises(Exception, match="null"):
        boosting.fit_gbt(holed, NAMES, "label", FAST)


@pytest.mark.parametrize("oversample", ["before_cv", "within_fold", "none"])
def test_grid_search(spark, data, oversample):
    model, results = boosting.grid_search(
        data, NAMES, "label", "row_id", {"rounds": [1, 3]}, FAST, k=2, oversample=oversample
    )
    rows = results.collect()
    assert [r["rounds"] for r in rows] == [1, 3]
    assert sum(r["best"] for r in rows) == 1
    best = next(r for r in rows if r["best"])
    assert best["accuracy"] == max(r["accuracy"] for r in rows) > 0.6
    assert len(model.trees) == best["rounds"]


def test_first_rounds_are_the_shorter_fit(spark, data):
    grown = boosting.fit_gbt(data, NAMES, "label", FAST)
    for rounds in (1, 2, 4):
        alone = boosting.fit_gbt(data, NAMES, "label", BoostParams(rounds=rounds, rate=0.3, depth=2))
        both = [boosting.score(m, data, NAMES).select("row_id", "score", "prediction") for m in (boosting.first_rounds(grown, rounds), alone)]
        assert both[0].exceptAll(both[1]).count() == 0


def test_grid_search_option(spark, data):
    with pytest.raises(ValueError):
        boosting.grid_search(data, NAMES, "label", "row_id", {}, FAST, oversample="later")


def test_mlp_history_goes_on_where_it_stopped(spark, data):
    train, valid = fold_split(stratified_folds(data, "label", 4, 1, "row_id"), 0)
    whole, none = neural.fit_mlp(train, NAMES, "label", max_iter=6)
    assert none.count() == 0
    steps, history = neural.fit_mlp(train, NAMES, "label", valid, max_iter=6, history_every=2)
    assert {(r["step"], r["side"], r["metric"]) for r in history.collect()} == {
        (s, side, m) for s in (2, 4, 6) for side in ("train", "valid") for m in ("loss", "accuracy")
    }
    assert np.allclose(whole.weights.toArray(), steps.weights.toArray(), atol=1e-6)


def _train_loss(spark, rows, steps):
    model, _ = neural.fit_mlp(rows, NAMES, "label", max_iter=steps, key="row_id")
    return evaluate(boosting.score(model, rows, NAMES)).first()["log_loss"]


def test_training_lowers_the_loss_however_rows_lie(spark, data):
    by_class = data.repartition(1).sortWithinPartitions("label").persist()
    dealt = data.repartition(5, "label").persist()
    losses = [_train_loss(spark, rows, 20) for rows in (data, by_class, dealt)]
    assert max(losses) < _train_loss(spark, data, 0)
    assert max(losses) - min(losses) < 0.005


def test_initial_weights_are_used(spark, data):
    given = [0.1 * (i % 7 - 3) for i in range(5 * 2 + 2 + 2 * 2 + 2)]
    model, _ = neural.fit_mlp(data, NAMES[:5], "label", hidden=(2,), max_iter=0, initial_weights=given)
    assert np.allclose(model.weights.toArray(), given)


def test_untrained_network(spark, data):
    one, _ = neural.fit_mlp(data, NAMES[:5], "label", max_iter=0, seed=7)
    two, _ = neural.fit_mlp(data, NAMES[:5], "label", max_iter=0, seed=7)
    assert len(one.weights) == 738  # 5-23-23-2
    assert np.array_equal(one.weights.toArray(), two.weights.toArray())
    assert evaluate(boosting.score(one, data, NAMES[:5])).first()["log_loss"] > 0


def test_sweep(spark, data):
    folded = stratified_folds(data, "label", 2, 1, "row_id")
    got = neural.sweep(folded, NAMES, "label", 2, [(0, 1, 2), (1, 3)], max_iter=3, history_every=3)
    assert got.count() == 2 * 2 * 4
    assert got.select("fold", "subset").distinct().count() == 4


def test_boosted_job(spark, data):
    out = classify.boosted(
        data, NAMES, "label", "row_id", {"rounds": [3]}, FAST, folds=4, search_folds=2
    )
    assert out.scored.count() == 65
    assert out.measures["roc_auc"].first()[0] > 0.7
    assert 0 < out.measures["auprc"].first()[0] <= 1
    assert out.results.count() == 1
    assert {r["side"]: r["rows"] for r in out.split.collect()} == {"train": 195, "valid": 65}


def test_neural_job(spark, data):
    out = classify.neural(
        data, NAMES, "label", "row_id", [(0, 1, 2), (1, 3, 4)], folds=2, max_iter=4, history_every=2
    )
    assert out.results.select("fold", "subset", "step").distinct().count() == 8
    assert out.scored.groupBy("side").count().count() == 2 and out.scored.count() == 260
    for name in ("accuracy", "control_accuracy"):
        assert 0 <= out.measures[name].first()[0] <= 1
    assert out.measures["shares"].agg(F.sum("share")).first()[0] == pytest.approx(1)
