"""Thinning the (N, E) table and fitting the prior to it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.functions.special import np_digamma, np_ln_gamma, np_trigamma
from caselight.operators.ordering import running
from caselight.operators.signals import THETA_INIT, Theta
from caselight.storage import written

_CHUNK = 100_000
_THETA = ("alpha1", "beta1", "alpha2", "beta2", "p")


def squash(
    df: DataFrame,
    count: int = 1,
    bin_size: int = 50,
    keep_pts: int = 100,
    min_bin: int = 50,
    min_pts: int = 500,
) -> DataFrame:
    """Thin the points with ``N == count``: in order of E, each run of
    ``bin_size`` points becomes one point at their mean E with that weight. The
    ``keep_pts`` largest and what does not fill a bin stay as they are.

    Points with equal E are interchangeable, so they are counted first and each
    distinct E then covers a stretch of positions; a very common E costs one
    row until its bins are written out. ``df`` is read twice, so give it a
    stored table if it is dear.
    """
    if "weight" not in df.columns:
        df = df.withColumn("weight", F.lit(1))
    points = df.select(
        F.col("N").cast("bigint"), F.col("E").cast("double"), F.col("weight").cast("bigint")
    )
    chosen = points.filter(F.col("N") == count)
    rest = points.filter(F.col("N") != count)
    counted = written(
        chosen.groupBy("E").agg(
            F.count(F.lit(1)).alias("points"), F.max("weight").alias("heaviest")
        ),
        "squash",
    )
    total, heaviest = counted.agg(F.sum("points"), F.max("heaviest")).first()
    total = total or 0
    if total < min_pts:
        raise ValueError(f"{total} points with N = {count}, at least {min_pts} are needed")
    if heaviest > 1:
        raise ValueError(f"points with N = {count} are thinned already")
    bins = (total - keep_pts) // bin_size
    if bins < min_bin:
        raise ValueError(f"only {bins} bins, at least {min_bin} are needed")
    thinned = bins * bin_size

    placed = running(counted, "E", sums=["points"]).selectExpr(
        "E", "running_sum_points - points as start", "running_sum_points as stop"
    )
    spread = placed.filter(F.col("start") < thinned).selectExpr(
        "E",
        "start",
        f"least(stop, {thinned}) as end",
        f"start div {bin_size} as first",
        f"(least(stop, {thinned}) - 1) div {bin_size} as last",
    )
    # The first and the last bin of a stretch may be shared with neighbours ...
    shared = (
        spread.selectExpr(
            "E",
            f"""inline(if(first = last,
                    array(struct(first as bin, end - start as size)),
                    array(struct(first as bin, (first + 1) * {bin_size} - start as size),
                          struct(last as bin, end - last * {bin_size} as size))))""",
        )
        .groupBy("bin")
        .agg(F.expr(f"sum(E * size) / {bin_size}").alias("E"))
        .selectExpr("E", f"bigint({bin_size}) as weight")
    )
    # ... and those between hold nothing but this E. Long stretches are cut into
    # chunks that are dealt out before they are written out.
    own = (
        spread.selectExpr("E", "last - first - 1 as inner_bins")
        .filter("inner_bins > 0")
        .selectExpr("E", "inner_bins", f"explode(sequence(0L, inner_bins - 1, {_CHUNK}L)) as chunk")
        .repartition("E", "chunk")
        .selectExpr(
            "E", f"explode(sequence(chunk, least(chunk + {_CHUNK}, inner_bins) - 1)) as bin"
        )
        .selectExpr("E", f"bigint({bin_size}) as weight")
    )
    # At most keep_pts + bin_size - 1 points in all.
    kept = (
        placed.filter(F.col("stop") > thinned)
        .selectExpr("E", f"explode(sequence(greatest(start, {thinned}), stop - 1)) as point")
        .selectExpr("E", "1L as weight")
    )
    new = shared.union(own).union(kept).selectExpr(f"bigint({count}) as N", "E", "weight")
    return rest.unionByName(new)


def _log_parts(n: np.ndarray, e: np.ndarray, theta: Theta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: the log weight of either part, and the chance of a count above
    zero. expm1 keeps that exact where it is tiny."""
    a1, b1, a2, b2, p = theta.astuple()

    def log_part(a: float, b: float, log_share: float) -> np.ndarray:
        of_n = _of_each(n, lambda x: np_ln_gamma(a + x) - np_ln_gamma(x + 1.0))
        return log_share + of_n - math.lgamma(a) - a * np.log1p(e / b) + n * (np.log(e) - np.log(b + e))

    seen = -(p * np.expm1(-a1 * np.log1p(e / b1)) + (1 - p) * np.expm1(-a2 * np.log1p(e / b2)))
    return log_part(a1, b1, math.log(theta.p)), log_part(a2, b2, math.log1p(-theta.p)), seen


def _of_each(n: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``f`` of every count, worked out once for equal ones: there are few."""
    distinct, at = np.unique(n, return_inverse=True)
    return f(distinct)[at.ravel()]


def _value(w: np.ndarray, one: np.ndarray, two: np.ndarray, seen: np.ndarray) -> float:
    """The sum of a batch; a row whose chance to be seen rounds to nothing is left out."""
    mixture = np.maximum(one, two) + np.log1p(np.exp(-np.abs(one - two)))
    return -float(np.sum(np.where(seen <= 0, 0.0, w * (mixture - np.log(seen)))))


def _summed(
    squashed: DataFrame, names: Sequence[str], sums: Callable[[np.ndarray, np.ndarray, np.ndarray], Sequence[float]]
) -> DataFrame:
    """One row: the totals of what ``sums(N, E, weight)`` says of each batch.

    The formulas run on whole batches: as generated code they would be another
    program for each theta, and one too long for the JVM to compile.
    """
    rows = squashed.selectExpr("double(N) as N", "double(E) as E", "double(weight) as w")
    known = rows.where("N is not null and E > 0 and w is not null")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                with np.errstate(all="ignore"):
                    found = sums(*(rows[c].to_numpy(float) for c in ("N", "E", "w")))
                yield pd.DataFrame([found], columns=list(names), dtype=float)

    parts = known.mapInPandas(add, ", ".join(f"{c} double" for c in names))
    return parts.agg(*[F.sum(c).alias(c) for c in names])


def _value_sums(squashed: DataFrame, thetas: Sequence[Theta]) -> DataFrame:
    def sums(n: np.ndarray, e: np.ndarray, w: np.ndarray) -> list[float]:
        return [_value(w, *_log_parts(n, e, t)) for t in thetas]

    return _summed(squashed, [f"value_{i}" for i in range(len(thetas))], sums)


def neg_log_lik(squashed: DataFrame, thetas: Sequence[Theta]) -> DataFrame:
    """Weighted negative log-likelihood, zero-truncated, for every theta.

    The thetas are parameters, a few dozen at most. Each has a sum of its own in
    one aggregate without keys, so no row is copied and every task sends one row.
    """
    names = ", ".join(f"value_{i}" for i in range(len(thetas)))
    found = _value_sums(squashed, thetas).selectExpr(f"array({names}) as sums")
    rows = [(i, *map(float, t.astuple())) for i, t in enumerate(thetas)]
    trial = squashed.sparkSession.createDataFrame(rows, "theta_id int, " + ", ".join(f"{c} double" for c in _THETA))
    return trial.withColumn("neg_log_lik", F.get(found.scalar(), F.col("theta_id")))


def _to_free(theta: Theta) -> np.ndarray:
    a1, b1, a2, b2, p = theta.astuple()
    return np.array([math.log(a1), math.log(b1), math.log(a2), math.log(b2), math.log(p / (1 - p))])


def _to_theta(x: np.ndarray) -> Theta:
    return Theta(*(math.exp(v) for v in x[:4]), 1 / (1 + math.exp(-x[4])))


def slopes(squashed: DataFrame, theta: Theta) -> DataFrame:
    """One row: the value of ``neg_log_lik`` at ``theta``, its slopes and its
    curvatures, exact, in (ln alpha1, ln beta1, ln alpha2, ln beta2, logit p).

    All 21 numbers are sums of one aggregate. Columns: ``value``, ``slope_i``
    and ``curve_i_j`` for i >= j.
    """
    names = ["value", *[f"slope_{i}" for i in range(5)]]
    names += [f"curve_{i}_{j}" for i in range(5) for j in range(i + 1)]
    return _summed(squashed, names, lambda n, e, w: _slope_sums(n, e, w, theta))


def _slope_sums(n: np.ndarray, e: np.ndarray, w: np.ndarray, theta: Theta) -> list[float]:
    """The 21 sums over a batch."""
    p = theta.p
    one, two, seen = _log_parts(n, e, theta)
    r = 1 / (1 + np.exp(two - one))
    nothing = np.zeros_like(e)
    # Of either part, slopes of the log weight and of the log chance of zero for
    # all five parameters, and the curvatures for its own two.
    slope, zero, bent, zero_bent, log_zero = [], [], [], [], []
    for at, a, b, mixed in ((0, theta.alpha1, theta.beta1, 1 - p), (2, theta.alpha2, theta.beta2, -p)):
        share, log1p = e / (b + e), np.log1p(e / b)
        of_n = _of_each(n, lambda x: np_digamma(a + x)) - np_digamma(np.array(a))
        curved = _of_each(n, lambda x: np_trigamma(a + x)) - np_trigamma(np.array(a))
        u, z, zv, left = a * (of_n - log1p), -a * log1p, a * share, b / (b + e)
        slope.append([nothing] * at + [u, zv - n * left] + [nothing] * (2 - at) + [mixed])
        # d log(chance of zero) / d ln b is a E / (b + E)
        zero.append([nothing] * at + [z, zv] + [nothing] * (2 - at) + [mixed])
        bent.append({(at, at): u + a * a * curved, (at + 1, at): zv, (at + 1, at + 1): -(a + n) * share * left})
        zero_bent.append({(at, at): z, (at + 1, at): zv, (at + 1, at + 1): -a * share * left})
        log_zero.append(z)
    q = [p * np.exp(log_zero[0]) / seen, (1 - p) * np.exp(log_zero[1]) / seen]
    mine = [r, 1 - r]
    g = [r * slope[0][i] + (1 - r) * slope[1][i] for i in range(5)]
    k = [q[0] * zero[0][i] + q[1] * zero[1][i] for i in range(5)]

    def curve(i: int, j: int) -> float:
        apart = (slope[0][i] - slope[1][i]) * (slope[0][j] - slope[1][j])
        total = k[i] * k[j] + r * (1 - r) * apart
        for part in range(2):
            total = total + q[part] * zero[part][i] * zero[part][j]
            if (i, j) in bent[part]:
                total = total + mine[part] * bent[part][i, j] + q[part] * zero_bent[part][i, j]
        if i == j == 4:
            total = total - p * (1 - p) * (1 + q[0] + q[1])
        return -float(np.sum(w * total))

    return [
        _value(w, one, two, seen),
        *[-float(np.sum(w * (g[i] + k[i]))) for i in range(5)],
        *[curve(i, j) for i in range(5) for j in range(i + 1)],
    ]


def _values(table: DataFrame, points: Sequence[np.ndarray]) -> np.ndarray:
    row = _value_sums(table, [_to_theta(x) for x in points]).first()
    return np.array([math.inf if v is None or math.isnan(v) else v for v in row])


def _at(table: DataFrame, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, slopes and curvatures; the value is infinite where they are not known."""
    row = slopes(table, _to_theta(x)).first()
    size = len(x)
    gradient = np.array([row[f"slope_{i}"] for i in range(size)], dtype=float)
    hessian = np.zeros((size, size))
    for i in range(size):
        for j in range(i + 1):
            hessian[i, j] = hessian[j, i] = math.nan if row[f"curve_{i}_{j}"] is None else row[f"curve_{i}_{j}"]
    known = row["value"] is not None and np.isfinite(gradient).all() and np.isfinite(hessian).all()
    return (row["value"] if known else math.inf), gradient, hessian


def _steps(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> list[np.ndarray]:
    """Where downhill steps of growing damping lead, the undamped one first. Axes
    that bend down count as bent up, so a step leads away from a saddle."""
    size, axes = np.linalg.eigh(hessian)
    size = np.maximum(np.abs(size), 1e-8 * max(1.0, np.abs(size).max()))
    out = []
    for damping in (0.0, 1e-4, 1e-3, 1e-2, 0.1, 0.3, 1.0, 3.0, 10.0, 100.0):
        step = -axes @ ((axes.T @ gradient) / (size + damping * np.abs(size).mean()))
        length = np.linalg.norm(step)
        out.append(x + step * min(1.0, 2.0 / length if length else 1.0))
    return out


def fit_prior(
    squashed: DataFrame, theta_init: Theta = THETA_INIT, tolerance: float = 1e-6, most: int = 500
) -> DataFrame:
    """Minimise ``neg_log_lik`` from ``theta_init``; one row: theta, its value,
    steps, the gradient's largest part for a unit of value, ``converged``, and the
    standard error of each parameter (``se_...``; NULL where the likelihood is
    flat in some direction).

    The fit goes on until that is below ``tolerance``, or until no step leads
    further down; in the latter case ``converged`` is false. A fit that is still
    on its way after ``most`` steps is an error, not a result.

    Newton steps of bounded length. One Spark job a step gives value, slopes and
    curvatures, all exact; one more tries steps of several dampings side by side
    and takes the lowest, as the likelihood has flat valleys and more than one low.
    Standard errors come from the inverse of the last curvatures. Logs and a logit
    keep the parameters in range.
    """
    spark = squashed.sparkSession
    table = squashed.groupBy("N", "E").agg(F.sum("weight").alias("weight")).persist()
    try:
        x, steps = _to_free(theta_init), 0
        value, gradient, hessian = _at(table, x)
        slope = math.inf
        while math.isfinite(value):
            slope = float(np.abs(gradient).max() / (1 + abs(value)))
            if slope <= tolerance:
                break
            if steps >= most:
                raise ArithmeticError(f"the prior has not settled after {most} steps")
            steps += 1
            points = _steps(x, gradient, hessian)
            values = _values(table, points)
            best = int(np.argmin(values))
            if values[best] >= value:
                break
            tried = _at(table, points[best])
            if not tried[0] < value:
                break
            x, (value, gradient, hessian) = points[best], tried
        theta = _to_theta(x)
        errors: list[float | None] = [None] * 5
        if math.isfinite(value) and np.linalg.eigvalsh(hessian)[0] > 0:
            scale = np.array([*theta.astuple()[:4], theta.p * (1 - theta.p)])
            errors = [float(e) for e in scale * np.sqrt(np.diag(np.linalg.inv(hessian)))]
        row = (*theta.astuple(), float(value), steps, slope, slope <= tolerance, *errors)
        return spark.createDataFrame(
            [row],
            ", ".join(f"{c} double" for c in _THETA)
            + ", neg_log_lik double, steps int, gradient double, converged boolean, "
            + ", ".join(f"se_{c} double" for c in _THETA),
        )
    finally:
        table.unpersist()


def theta_of(fitted: DataFrame) -> Theta:
    """The one row of ``fit_prior`` as a ``Theta``."""
    r = fitted.first()
    return Theta(r["alpha1"], r["beta1"], r["alpha2"], r["beta2"], r["p"])
