"""Disproportionality of (var1, var2) pairs and their empirical-Bayes scores."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.special import digamma, gamma_cdf, gamma_log_density, ln_gamma, number
from caselight.storage import dealt_to, written, written_parts


@dataclass(frozen=True)
class Theta:
    """Two-gamma-mixture prior: shapes, rates and the share of the first part."""

    alpha1: float
    beta1: float
    alpha2: float
    beta2: float
    p: float

    def astuple(self) -> tuple[float, ...]:
        return astuple(self)


_PAIR, _VAR1, _VAR2, _ALL = range(4)  # what a count in the pair-count table is of
_ROWS = 250_000  # rows a task counts

# The starting prior, which is also the one the scores use.
THETA_INIT = Theta(alpha1=0.2, beta1=0.1, alpha2=2.0, beta2=4.0, p=1 / 3)


def disproportionality(
    df: DataFrame, id: str = "id", var1: str = "var1", var2: str = "var2", digits: int = 2
) -> DataFrame:
    """N, E, RR and PRR of every observed (var1, var2) pair, counting distinct ids.

    Rows with a NULL id or variable belong to no pair. One shuffle brings the
    rows of an id together, in as many parts as the rows need, so that what a
    task holds does not grow with the table; all that follows within an id needs
    no other. (id, var1, var2) triples are made distinct, and each gives four
    keys - the pair, var1, var2 and none - whose ids are made distinct again and
    counted; one plan does both, so the rows are read and shuffled once. Rows are
    dealt by id alone, so a variable found in most reports does not fill one task;
    only counts meet by variable.
    The counts are written once and joined from there, in parts of that number
    too; the joined table is stored, as callers read it several times.

    PRR is infinite when only var1's reports have var2, and NULL when every
    report has var1.
    """
    rows = df.select(
        F.col(id).alias("id"), F.col(var1).alias("var1"), F.col(var2).alias("var2")
    ).filter("id is not null and var1 is not null and var2 is not null")
    parts = rows.count() // _ROWS + 1
    triples = rows.repartition(parts, "id").distinct()
    none1, none2 = (F.lit(None).cast(triples.schema[c].dataType) for c in ("var1", "var2"))

    def key(kind: int, first: Column, second: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), first.alias("var1"), second.alias("var2"))

    keys = F.array(
        key(_PAIR, F.col("var1"), F.col("var2")),
        key(_VAR1, F.col("var1"), none2),
        key(_VAR2, none1, F.col("var2")),
        key(_ALL, none1, none2),
    )
    found = triples.select("id", F.inline(keys)).distinct()
    tally = found.groupBy("kind", "var1", "var2").agg(F.count(F.lit(1)).alias("ids"))
    with dealt_to(df.sparkSession, parts):
        of_kind = written_parts(tally, "pair-counts", "kind", (_PAIR, _VAR1, _VAR2, _ALL))
        total = of_kind[_ALL].select(F.col("ids").cast("double")).scalar()
        counted = (
            of_kind[_PAIR]
            .select("var1", "var2", F.col("ids").alias("N"))
            .join(of_kind[_VAR1].select("var1", F.col("ids").cast("double").alias("ids1")), "var1")
            .join(of_kind[_VAR2].select("var2", F.col("ids").cast("double").alias("ids2")), "var2")
            .select("*", total.alias("ids"))
        )
        counted = written(counted, "counted-pairs")
    return counted.withColumn("E", F.expr("ids1 * ids2 / ids")).selectExpr(
        "var1",
        "var2",
        "N",
        "E",
        f"round(N / E, {digits}) as RR",
        f"""case when ids = ids1 then null
                 when ids2 = N then double('Infinity')
                 else round((N / ids1) / ((ids2 - N) / (ids - ids1)), {digits})
            end as PRR""",
    )


def _log_odds(theta: Theta) -> str:
    """Log of first over second posterior weight; the shared N! cancels."""
    a1, b1, a2, b2 = (number(v) for v in theta.astuple()[:4])
    fixed = (
        math.log(theta.p / (1 - theta.p)) - math.lgamma(theta.alpha1) + math.lgamma(theta.alpha2)
    )
    return (
        f"{number(fixed)} + {ln_gamma(f'N + {a1}')} - {ln_gamma(f'N + {a2}')} "
        f"- {a1} * log1p(E / {b1}) + {a2} * log1p(E / {b2}) "
        f"+ N * ln((E + {b2}) / (E + {b1}))"
    )


def mixture_weight(df: DataFrame, theta: Theta = THETA_INIT) -> DataFrame:
    """Add ``qn``, the posterior weight of the first gamma part."""
    return df.withColumn("qn", F.expr(f"1 / (1 + exp(-({_log_odds(theta)})))"))


def _with_weight(df: DataFrame, theta: Theta) -> DataFrame:
    return df if "qn" in df.columns else mixture_weight(df, theta)


def ebgm(df: DataFrame, theta: Theta = THETA_INIT, digits: int = 2) -> DataFrame:
    """Add ``EBGM``, the geometric mean of the posterior, and ``qn`` if absent."""
    a1, b1, a2, b2 = (number(v) for v in theta.astuple()[:4])
    mean_log = (
        f"qn * ({digamma(f'N + {a1}')} - ln(E + {b1})) "
        f"+ (1 - qn) * ({digamma(f'N + {a2}')} - ln(E + {b2}))"
    )
    return _with_weight(df, theta).withColumn("EBGM", F.expr(f"round(exp({mean_log}), {digits})"))


def _quantile(prob: float, theta: Theta, n: np.ndarray, e: np.ndarray, qn: np.ndarray) -> np.ndarray:
    """Posterior quantile of each row: Newton steps kept inside a bracket."""
    a1, a2 = n + theta.alpha1, n + theta.alpha2
    r1, r2 = e + theta.beta1, e + theta.beta2

    def excess(x, rows):
        return (
            qn[rows] * gamma_cdf(a1[rows], r1[rows] * x)
            + (1 - qn[rows]) * gamma_cdf(a2[rows], r2[rows] * x)
            - prob
        )

    def slope(x, rows):
        return qn[rows] * r1[rows] * np.exp(gamma_log_density(a1[rows], r1[rows] * x)) + (
            1 - qn[rows]
        ) * r2[rows] * np.exp(gamma_log_density(a2[rows], r2[rows] * x))

    low = np.zeros_like(e)
    high = np.maximum(a1 / r1, a2 / r2)
    rows = np.arange(len(e))
    while len(rows):
        rows = rows[excess(high[rows], rows) < 0]
        high[rows] *= 2
    x = high / 2
    rows = np.arange(len(e))
    for _ in range(200):
        if not len(rows):
            break
        here = x[rows]
        gap = excess(here, rows)
        below = gap < 0
        low[rows] = np.where(below, here, low[rows])
        high[rows] = np.where(below, high[rows], here)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            step = here - gap / slope(here, rows)
        # A step of nothing lands on the border just moved and has to count.
        inside = (step >= low[rows]) & (step <= high[rows])
        after = np.where(inside, step, (low[rows] + high[rows]) / 2)
        x[rows] = np.where(gap == 0, here, after)
        rows = rows[np.abs(x[rows] - here) > 1e-12 * np.maximum(1e-12, here)]
    if len(rows):
        raise ArithmeticError(f"{len(rows)} quantiles have not settled")
    return x


def posterior_quantiles(
    df: DataFrame,
    theta: Theta = THETA_INIT,
    percents: Mapping[str, float] = {"QUANT_025": 2.5, "QUANT_975": 97.5},
    digits: int = 2,
) -> DataFrame:
    """Add one posterior-quantile column per entry of ``percents``.

    Inverting the mixture has no column form, so N, E and qn go through one
    Arrow call. Equal (N, E) are solved once per batch there, which needs no
    shuffle to find them.
    """
    names = list(percents)

    def solve(n: pd.Series, e: pd.Series, qn: pd.Series) -> pd.DataFrame:
        rows = np.column_stack([n.to_numpy(float), e.to_numpy(float), qn.to_numpy(float)])
        known = ~np.isnan(rows).any(axis=1)
        distinct, back = np.unique(rows[known], axis=0, return_inverse=True)
        out = {}
        for i, name in enumerate(names):
            values = np.full(len(rows), np.nan)
            if len(distinct):
                values[known] = _quantile(percents[name] / 100, theta, *distinct.T.copy())[
                    back.ravel()
                ]
            out[f"q{i}"] = values
        return pd.DataFrame(out)

    kind = "struct<" + ", ".join(f"q{i}: double" for i in range(len(names))) + ">"
    solver = F.pandas_udf(solve, kind)
    had_weight = "qn" in df.columns
    solved = _with_weight(df, theta).withColumn("_q", solver("N", "E", "qn"))
    for i, name in enumerate(names):
        solved = solved.withColumn(name, F.round(F.col(f"_q.q{i}"), digits))
    return solved.drop("_q") if had_weight else solved.drop("_q", "qn")


def posterior_quantile(
    df: DataFrame, theta: Theta, percent: float, name: str, digits: int = 2
) -> DataFrame:
    return posterior_quantiles(df, theta, {name: percent}, digits)


def signal_scores(df: DataFrame, theta: Theta = THETA_INIT, digits: int = 2) -> DataFrame:
    """All scores of a pair table ``(id, var1, ..., var2)``."""
    pairs = mixture_weight(disproportionality(df, digits=digits), theta)
    scored = posterior_quantiles(ebgm(pairs, theta, digits), theta, digits=digits)
    return scored.drop("qn")
