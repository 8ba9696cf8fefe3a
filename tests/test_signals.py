import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.functions.special import gamma_cdf
from caselight.operators import prior, signals
from caselight.operators.signals import THETA_INIT, Theta
from caselight.plans import scoring
from caselight.storage import shared_dir, written


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "id int, var1 string, study_drug string, var2 string")


def scores(df):
    return {(r["var1"], r["var2"]): r for r in df.collect()}


def test_disproportionality_counts_distinct_ids(spark):
    rows = [(1, "a", "s", "x"), (1, "a", "t", "x"), (2, "a", "s", "y"), (3, "b", "s", "x"),
            (4, "b", "s", "z"), (5, None, "s", "x"), (None, "a", "s", "x")]
    got = scores(signals.disproportionality(pairs_of(spark, rows)))
    assert set(got) == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")}
    ax = got["a", "x"]
    assert (ax["N"], ax["E"], ax["RR"]) == (1, 1.0, 1.0)
    assert ax["PRR"] == 1.0  # (1/2) / (1/2)
    assert got["a", "y"]["PRR"] == math.inf  # y is seen with a only


def test_disproportionality_var1_with_every_id(spark):
    rows = [(i, "a", "s", "x" if i < 3 else "y") for i in range(5)]
    got = scores(signals.disproportionality(pairs_of(spark, rows)))
    assert got["a", "x"]["PRR"] is None
    assert got["a", "x"]["RR"] == 1.0


def test_one_id_with_a_third_of_the_rows(spark):
    rows = [(0, f"a{i}", "s", f"x{i % 7}") for i in range(300)]
    rows += [(1 + i, f"a{i % 20}", "s", f"x{i % 7}") for i in range(600)]
    got = signals.disproportionality(pairs_of(spark, rows))
    ids = {}
    for i, a, _, x in rows:
        ids.setdefault((a, x), set()).add(i)
    assert {(r["var1"], r["var2"]): r["N"] for r in got.collect()} == {k: len(v) for k, v in ids.items()}


@pytest.fixture(scope="module")
def points(spark):
    rows = [(n, e) for n in (1, 2, 3, 10, 250, 40000) for e in (1e-4, 0.3, 1.7, 12.0, 900.0)]
    return written(spark.createDataFrame(rows, "N bigint, E double"), "points")


def test_weight_mean_and_quantiles_by_simulation(spark):
    """Values at N = 3 and 1, E = 1.7 from a large simulation of the model."""
    df = spark.createDataFrame([(3, 1.7), (1, 1.7)], "N bigint, E double")
    got = {r["N"]: r for r in signals.posterior_quantiles(signals.ebgm(df, digits=4), digits=4).collect()}
    assert got[3]["EBGM"] == pytest.approx(0.9510, abs=2e-3)
    assert got[3]["QUANT_025"] == pytest.approx(0.2998, abs=2e-3)
    assert got[3]["QUANT_975"] == pytest.approx(3.222, abs=1e-2)


def test_weight_matches_plain_formula(points):
    def density(n, a, b, e):
        return math.exp(
            math.lgamma(a + n) - math.lgamma(a) - math.lgamma(n + 1)
            + a * math.log(b / (b + e)) + n * math.log(e / (b + e))
        )

    a1, b1, a2, b2, p = THETA_INIT.astuple()
    for r in signals.mixture_weight(points.filter("N <= 250")).collect():
        one, two = p * density(r["N"], a1, b1, r["E"]), (1 - p) * density(r["N"], a2, b2, r["E"])
        if one + two > 0:
            assert r["qn"] == pytest.approx(one / (one + two), rel=1e-8, abs=1e-300)


def test_quantiles_give_back_their_share(points):
    wide = signals.posterior_quantiles(signals.mixture_weight(points), digits=12).collect()
    a1, b1, a2, b2, _ = THETA_INIT.astuple()
    for r in wide:
        n, e, qn = r["N"], r["E"], r["qn"]
        for name, share in (("QUANT_025", 0.025), ("QUANT_975", 0.975)):
            x = r[name]
            cdf = qn * gamma_cdf(np.array([a1 + n]), np.array([(b1 + e) * x])) + (1 - qn) * gamma_cdf(
                np.array([a2 + n]), np.array([(b2 + e) * x])
            )
            assert cdf[0] == pytest.approx(share, abs=1e-6)


def test_score_lies_between_its_quantiles(points):
    for r in signals.posterior_quantiles(signals.ebgm(points)).collect():
        assert r["QUANT_025"] <= r["EBGM"] <= r["QUANT_975"]


def test_quantiles_pass_nulls_and_run_in_one_python_call(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "N bigint, E double")
    got = signals.posterior_quantiles(df)
    assert [r["QUANT_025"] for r in got.collect()].count(None) == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("solve(") == 1


def by_hand(rows, count, bin_size, keep):
    chosen = sorted(e for n, e, _ in rows if n == count)
    rest = [r for r in rows if r[0] != count]
    thinned = (len(chosen) - keep) // bin_size * bin_size
    bins = [chosen[i : i + bin_size] for i in range(0, thinned, bin_size)]
    return rest + [(count, sum(b) / bin_size, bin_size) for b in bins] + [(count, e, 1) for e in chosen[thinned:]]


def plain(rows):
    return sorted((n, round(e, 9), w) for n, e, w in rows)


@pytest.mark.parametrize("shape", ["spread", "hot", "all equal"])
def test_squash_matches_a_loop(spark, shape):
    rnd = random.Random(1)
    value = {
        "spread": lambda: rnd.random(),
        "hot": lambda: 0.5 if rnd.random() < 0.4 else round(rnd.random(), 2),
        "all equal": lambda: 0.25,
    }[shape]
    rows = [(1, value(), 1) for _ in range(1037)] + [(2, value(), 1) for _ in range(211)] + [(7, 3.0, 1)]
    df = spark.createDataFrame(rows, "N bigint, E double, weight bigint")
    once = prior.squash(df, 1, 10, 20, 5, 100)
    want = by_hand(rows, 1, 10, 20)
    assert plain(map(tuple, once.collect())) == plain(want)
    twice = prior.squash(once, 2, 7, 0, 5, 100)
    assert plain(map(tuple, twice.collect())) == plain(by_hand(want, 2, 7, 0))
    assert twice.agg(F.sum("weight")).first()[0] == len(rows)


def test_squash_errors(spark):
    df = spark.createDataFrame([(1, i / 7) for i in range(200)], "N bigint, E double")
    with pytest.raises(ValueError, match="at least 500"):
        prior.squash(df)
    with pytest.raises(ValueError, match="bins"):
        prior.squash(df, min_pts=100)
    done = prior.squash(df, 1, 5, 10, 5, 100)
    with pytest.raises(ValueError, match="already"):
        prior.squash(done, 1, 5, 0, 1, 1)


def log_lik(rows, t):
    total = 0.0
    for n, e, w in rows:
        parts = [
            s * math.exp(
                math.lgamma(a + n) - math.lgamma(a) - math.lgamma(n + 1)
                + a * math.log(b / (b + e)) + n * math.log(e / (b + e))
            )
            for s, a, b in ((t.p, t.alpha1, t.beta1), (1 - t.p, t.alpha2, t.beta2))
        ]
        zero = t.p * (t.beta1 / (t.beta1 + e)) ** t.alpha1 + (1 - t.p) * (t.beta2 / (t.beta2 + e)) ** t.alpha2
        total -= w * math.log(sum(parts) / (1 - zero))
    return total


def test_likelihood_and_fit(spark):
    rng = np.random.default_rng(4)
    rows = []
    while len(rows) < 600:
        e = float(rng.gamma(1.5, 1.5) + 0.05)
        part = rng.gamma(2.0, 1 / 4.0) if rng.random() < 0.7 else rng.gamma(3.0, 1.0)
        n = int(rng.poisson(part * e))
        if n:
            rows.append((n, e, int(rng.integers(1, 4))))
    df = written(spark.createDataFrame(rows, "N bigint, E double, weight bigint"), "lik")
    thetas = [THETA_INIT, Theta(1, 1, 2, 3, 0.5), Theta(0.01, 5, 30, 0.2, 0.99)]
    got = {r["theta_id"]: r["neg_log_lik"] for r in prior.neg_log_lik(df, thetas).collect()}
    for i, t in enumerate(thetas):
        assert got[i] == pytest.approx(log_lik(rows, t), rel=1e-9)
    fitted = prior.fit_prior(df)
    best = fitted.first()
    assert best["neg_log_lik"] < got[0]
    assert best["converged"] and best["gradient"] <= 1e-6
    with pytest.raises(ArithmeticError):
        prior.fit_prior(df, most=1)
    theta = prior.theta_of(fitted)
    assert log_lik(rows, theta) == pytest.approx(best["neg_log_lik"], rel=1e-8)
    for i in range(5):  # no small move along an axis improves
        for f in (0.99, 1.01):
            moved = list(theta.astuple())
            moved[i] *= f
            if moved[4] < 1:
                assert log_lik(rows, Theta(*moved)) >= best["neg_log_lik"] - 1e-3


def test_score_job(spark, tmp_path):
    rows = [(i, f"d{i % 4}", "s", f"r{i % 3}") for i in range(60)]
    files = []
    for k in range(6):
        files.append(str(tmp_path / f"in{k}"))
        part = spark.createDataFrame([r for r in rows if r[0] % 6 == k], "a int, b string, c string, d string")
        part.write.option("header", True).csv(files[-1])
    pairs = scoring.read_pairs(spark, files, "a int, b string, c string, d string")
    assert pairs.columns == ["id", "var1", "study_drug", "var2"] and pairs.count() == 60
    scoring.score_pairs(pairs, str(tmp_path / "out"), row_id=True)
    out = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert out.columns == ["row_id", "var1", "var2", "N", "E", "RR", "PRR", "EBGM", "QUANT_025", "QUANT_975"]
    assert out.count() == 12


def test_jobs_leave_no_scratch(spark, tmp_path):
    def stored():
        base = shared_dir(spark).removeprefix("file:")
        return {os.path.join(d, f) for d, _, files in os.walk(base) for f in files if f.endswith(".parquet")}

    rng = np.random.default_rng(6)
    rows = [(i, f"d{a}", "s", f"r{b}") for i, (a, b) in enumerate(rng.zipf(1.3, (15000, 2)) % 900)]
    pairs = spark.createDataFrame(rows, "id int, var1 string, study_drug string, var2 string")
    before = stored()
    got = scoring.score_pairs(pairs, str(tmp_path / "out"))
    assert got.columns[:3] == ["var1", "var2", "N"] and got.where("N > 0").count() == got.count() > 1000
    assert scoring.prior_of(pairs).first()["p"] > 0
    assert stored() == before


@pytest.fixture(scope="module")
def thinned(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        e = float(rng.gamma(0.7, 1.0) + 0.01)
        lam = rng.gamma(0.3, 10.0) if rng.random() < 0.3 else rng.gamma(2.0, 0.25)
        n = int(rng.poisson(lam * e))
        if n:
            rows.append((n, e, 1 + len(rows) % 3))
    return spark.createDataFrame(rows, "N bigint, E double, weight bigint").persist()


def nll(thinned, points):
    rows = prior.neg_log_lik(thinned, [prior._to_theta(x) for x in points]).collect()
    return [r["neg_log_lik"] for r in sorted(rows, key=lambda r: r["theta_id"])]


@pytest.mark.parametrize("theta", [THETA_INIT, signals.Theta(1.0, 1.0, 1.0, 2.0, 0.5), signals.Theta(30.0, 9.0, 0.01, 0.02, 0.99)])
def test_slopes_and_curvatures_are_those_of_the_value(thinned, theta):
    x, h = prior._to_free(theta), 1e-4
    value, gradient, hessian = prior._at(thinned, x)
    steps = [x + s * h * np.eye(5)[i] for i in range(5) for s in (1, -1)]
    f = nll(thinned, [x, *steps])
    assert value == pytest.approx(f[0], rel=1e-13)
    by_step = [(f[1 + 2 * i] - f[2 + 2 * i]) / (2 * h) for i in range(5)]
    assert gradient == pytest.approx(by_step, rel=1e-5, abs=1e-4)
    slopes = [prior._at(thinned, p)[1] for p in steps]
    bent = np.array([(slopes[2 * i] - slopes[2 * i + 1]) / (2 * h) for i in range(5)])
    assert np.allclose(bent, hessian, rtol=1e-5, atol=1e-5 * np.abs(hessian).max())


def test_fitted_prior_is_flat_where_sql_says_so(thinned, tmp_path):
    """The reported theta goes into another engine's formula, and its slopes there
    are next to nothing for a unit of value."""
    import duckdb

    fitted = prior.fit_prior(thinned).first()
    assert fitted["converged"] and fitted["steps"] < 40
    thinned.write.parquet(str(tmp_path / "thinned"))
    engine = duckdb.connect()

    def value(x):
        a1, b1, a2, b2, p = (repr(float(v)) + "::double" for v in prior._to_theta(x).astuple())
        nb = (
            "exp(lgamma({a} + N) - lgamma({a}) - lgamma(N + 1) + {a} * ln({b} / ({b} + E)) + N * ln(E / ({b} + E)))"
        )
        sql = f"""select -sum(weight * ln(({p} * {nb.format(a=a1, b=b1)} + (1 - {p}) * {nb.format(a=a2, b=b2)})
            / (1 - {p} * pow({b1} / ({b1} + E), {a1}) - (1 - {p}) * pow({b2} / ({b2} + E), {a2}))))
            from read_parquet('{tmp_path}/thinned/*.parquet')"""
        return engine.sql(sql).fetchall()[0][0]

    x = prior._to_free(prior.theta_of(thinned.sparkSession.createDataFrame([fitted])))
    here = value(x)
    assert here == pytest.approx(fitted["neg_log_lik"], rel=1e-10)
    for i in range(5):
        up, down = (value(x + s * 1e-4 * np.eye(5)[i]) for s in (1, -1))
        assert abs(up - down) / 2e-4 / (1 + here) < 1e-6
        assert min(up, down) >= here - 1e-9 * here


def test_standard_errors_are_those_of_the_curvature(thinned):
    fitted = prior.fit_prior(thinned)
    row, theta = fitted.first(), prior.theta_of(fitted)
    hessian = prior._at(thinned, prior._to_free(theta))[2]
    spread = np.sqrt(np.diag(np.linalg.inv(hessian)))
    assert row["se_alpha1"] == pytest.approx(theta.alpha1 * spread[0], rel=1e-6)
    assert row["se_p"] == pytest.approx(theta.p * (1 - theta.p) * spread[4], rel=1e-6)


def test_likelihoods_are_sums_of_one_pass(thinned):
    plan = prior.neg_log_lik(thinned, [THETA_INIT] * 12)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange SinglePartition") == 1


def test_counting_takes_more_parts_for_more_rows(spark, monkeypatch):
    """What a task counts must not grow with the table, and counts are the same."""
    rows = [(k % 90, f"a{k % 7}", f"b{k * k % 11}") for k in range(600)] + [(None, "a1", "b1"), (1, None, "b1")]
    pairs = spark.createDataFrame(rows, "id int, var1 string, var2 string")
    known = {r for r in rows if None not in r}
    want = {}
    for first, second in {r[1:] for r in known}:
        ids1, ids2 = ({r[0] for r in known if r[k] == v} for k, v in ((1, first), (2, second)))
        together = len([r for r in known if r[1:] == (first, second)])
        want[first, second] = (together, len(ids1) * len(ids2) / 90)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    used, write = [], signals.written

    def spy(df, *names):
        used.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return write(df, *names)

    monkeypatch.setattr(signals, "_ROWS", 40)
    monkeypatch.setattr(signals, "written", spy)
    got = {(r["var1"], r["var2"]): (r["N"], r["E"]) for r in signals.disproportionality(pairs).collect()}
    assert got == want
    assert used and min(used) == 16
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_counting_shuffles_the_rows_once(spark, monkeypatch):
    """Pairs and margins come from one shuffle of the rows, and a small margin is
    joined without a shuffle of the pairs."""
    plans, write, parts = [], signals.written, signals.written_parts

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(signals, "written_parts", lambda df, *a: parts(seen(df), *a))
    monkeypatch.setattr(signals, "written", lambda df, *a: write(seen(df), *a))
    pairs = spark.createDataFrame([(k % 9, f"a{k % 4}", f"b{k % 5}") for k in range(60)], "id int, var1 string, var2 string")
    assert signals.disproportionality(pairs).count() == 20
    assert plans[0].count("REPARTITION_BY_NUM") == 1
    assert "SortMergeJoin" not in plans[1]


def test_counting_nothing(spark):
    pairs = spark.createDataFrame([(1, None, "b")], "id int, var1 string, var2 string")
    assert signals.disproportionality(pairs).collect() == []


def test_every_theta_runs_the_same_program(thinned):
    """Were the numbers part of generated code, each step would compile anew."""

    def plans(theta):
        both = (prior.slopes(thinned, theta), prior._value_sums(thinned, [theta, THETA_INIT]))
        texts = [df._jdf.queryExecution().optimizedPlan().toString() for df in both]
        return [re.sub(r"#\d+L?|add\([^)]*\)", "", t) for t in texts]

    assert plans(THETA_INIT) == plans(signals.Theta(30.0, 9.0, 0.01, 0.02, 0.99))


def test_row_of_no_chance_is_left_out_of_the_value(spark):
    """A row whose chance to be seen rounds to nothing, and rows that lack a value."""
    schema = "N bigint, E double, weight bigint"
    rows = [(1, 0.5, 2), (3, 1.5, 1)]
    odd = [(1, 1e-320, 1), (None, 0.5, 1), (1, None, 1), (1, 0.0, 1)]
    tiny = Theta(1e-9, 1e9, 1e-9, 1e9, 0.5)
    for theta in (THETA_INIT, tiny):
        few, all_ = (
            prior.neg_log_lik(spark.createDataFrame(r, schema), [theta]).first()["neg_log_lik"]
            for r in (rows, rows + odd[theta is THETA_INIT:])
        )
        assert all_ == pytest.approx(few, rel=1e-12)
    nothing = spark.createDataFrame([], schema)
    assert prior.neg_log_lik(nothing, [THETA_INIT]).first()["neg_log_lik"] is None
