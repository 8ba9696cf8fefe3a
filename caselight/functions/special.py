"""Special functions: log-gamma and its first two derivatives as SQL expressions,
and the regularised incomplete gamma function on numpy arrays.

The expressions use the Stirling series after moving the argument up by eight,
so they stay inside generated code. They are built as text for ``F.expr`` and
``selectExpr``: one call hands over the whole formula, where building it from
column objects takes a call per operation.
"""

from __future__ import annotations

import math

import numpy as np

_SHIFT = 8
_HALF_LOG_TWO_PI = 0.5 * math.log(2.0 * math.pi)


def number(value: float) -> str:
    """A double literal."""
    return f"{float(value)!r}D"


def _series(w: str, coefficients: tuple[float, ...]) -> str:
    """c0 + w * (c1 + w * (c2 + ...))"""
    text = number(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        text = f"({number(c)} + {w} * {text})"
    return text


def ln_gamma(x: str) -> str:
    """SQL text for the natural log of the gamma function of ``x`` > 0."""
    x = f"cast({x} as double)"
    y = f"({x} + {_SHIFT})"
    product = " * ".join(f"({x} + {i})" for i in range(_SHIFT))
    # Stirling series: B2/(2*1) + B4/(4*3) + B6/(6*5) + ... over odd powers
    series = _series(f"(1 / ({y} * {y}))", (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188))
    return (
        f"(({y} - 0.5D) * ln({y}) - {y} + {number(_HALF_LOG_TWO_PI)} "
        f"+ {series} / {y} - ln({product}))"
    )


def digamma(x: str) -> str:
    """SQL text for the derivative of ``ln_gamma`` at ``x`` > 0."""
    x = f"cast({x} as double)"
    y = f"({x} + {_SHIFT})"
    w = f"(1 / ({y} * {y}))"
    steps = " + ".join(f"1 / ({x} + {i})" for i in range(_SHIFT))
    series = _series(w, (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132))
    return f"(ln({y}) - 0.5D / {y} - {w} * {series} - ({steps}))"


def trigamma(x: str) -> str:
    """SQL text for the derivative of ``digamma`` at ``x`` > 0."""
    x = f"cast({x} as double)"
    y = f"({x} + {_SHIFT})"
    w = f"(1 / ({y} * {y}))"
    steps = " + ".join(f"1 / (({x} + {i}) * ({x} + {i}))" for i in range(_SHIFT))
    series = _series(w, (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66))
    return f"(1 / {y} + {w} * (0.5D + {series} / {y}) + {steps})"


def ln_choose(n: str, k: str) -> str:
    """SQL text for the log of the binomial coefficient."""
    return f"({ln_gamma(f'{n} + 1')} - {ln_gamma(f'{k} + 1')} - {ln_gamma(f'({n}) - ({k}) + 1')})"


def _stirling_rest(n: str) -> str:
    """SQL text for what Stirling's formula leaves of the log of n factorial, n >= 1."""
    series = _series(f"(1 / ({n} * {n}))", (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188))
    exact = f"{ln_gamma(f'{n} + 1')} - ({n} + 0.5D) * ln({n}) + {n} - {number(_HALF_LOG_TWO_PI)}"
    return f"(case when {n} < 16 then {exact} else {series} / {n} end)"


def _deviance(x: str, mean: str) -> str:
    """SQL text for x ln(x / mean) + mean - x, exact where x is near the mean."""
    v = f"(({x} - {mean}) / ({x} + {mean}))"
    near = _series(f"({v} * {v})", tuple(1 / (2 * j + 1) for j in range(1, 9)))
    return (
        f"(case when abs({x} - {mean}) < 0.1D * ({x} + {mean}) "
        f"then ({x} - {mean}) * {v} + 2 * {x} * {v} * {v} * {v} * {near} "
        f"else {x} * ln({x} / {mean}) + {mean} - {x} end)"
    )


def ln_binomial(x: str, n: str, p: str) -> str:
    """SQL text for the log chance of ``x`` hits in ``n`` draws, 0 < p < 1, by its
    saddle point: big terms cancel before they are rounded."""
    x, n, rest = f"cast({x} as double)", f"cast({n} as double)", f"(cast({n} as double) - cast({x} as double))"
    return (
        f"(case when {x} = 0 then {n} * log1p(-{p}) when {x} = {n} then {n} * ln({p}) else "
        f"{_stirling_rest(n)} - {_stirling_rest(x)} - {_stirling_rest(rest)} "
        f"- {_deviance(x, f'({n} * {p})')} - {_deviance(rest, f'({n} * (1 - {p}))')} "
        f"+ 0.5D * ln({n} / ({x} * {rest})) - {number(_HALF_LOG_TWO_PI)} end)"
    )


def ln_hypergeom(x: str, big_m: str, big_n: str, n: str) -> str:
    """SQL text for the log chance of ``x`` marked ones among n drawn from big_n
    that hold big_m, where 0 < n < big_n and that chance is not zero."""
    p = f"(cast({n} as double) / {big_n})"
    return (
        f"({ln_binomial(x, big_m, p)} + {ln_binomial(f'({n} - ({x}))', f'({big_n} - {big_m})', p)} "
        f"- {ln_binomial(n, big_n, p)})"
    )


# --- numpy side: used inside Arrow batches only -----------------------------

_QUADRATURE_FROM = 100.0  # shape above which series get long
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def np_ln_gamma(a: np.ndarray) -> np.ndarray:
    y = a + _SHIFT
    product = np.ones_like(a)
    for i in range(_SHIFT):
        product = product * (a + i)
    w = 1.0 / (y * y)
    series = (1 / 12 + w * (-1 / 360 + w * (1 / 1260 + w * (-1 / 1680 + w / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + _HALF_LOG_TWO_PI + series - np.log(product)


def np_digamma(a: np.ndarray) -> np.ndarray:
    y = a + _SHIFT
    w = 1.0 / (y * y)
    series = 1 / 12 + w * (-1 / 120 + w * (1 / 252 + w * (-1 / 240 + w / 132)))
    return np.log(y) - 0.5 / y - w * series - sum(1.0 / (a + i) for i in range(_SHIFT))


def np_trigamma(a: np.ndarray) -> np.ndarray:
    y = a + _SHIFT
    w = 1.0 / (y * y)
    series = 1 / 6 + w * (-1 / 30 + w * (1 / 42 + w * (-1 / 30 + w * 5 / 66)))
    return 1 / y + w * (0.5 + series / y) + sum(1.0 / ((a + i) * (a + i)) for i in range(_SHIFT))


def gamma_log_density(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log of the unit-rate gamma density of shape a at x, stable for large a."""
    small = a < 10
    safe_a = np.where(small, 10.0, a)
    # For large shapes write Gamma(a) by Stirling so that big terms cancel.
    w = 1.0 / (safe_a * safe_a)
    tail = (1 / 12 + w * (-1 / 360 + w * (1 / 1260 + w * (-1 / 1680 + w / 1188)))) / safe_a
    ratio = (x - safe_a) / safe_a
    large_value = (
        safe_a * (np.log1p(np.maximum(ratio, -1 + 1e-300)) - ratio)
        + 0.5 * np.log(safe_a)
        - _HALF_LOG_TWO_PI
        - tail
        - np.log(x)
    )
    small_a = np.where(small, a, 1.0)
    small_value = (small_a - 1) * np.log(x) - x - np_ln_gamma(small_a)
    return np.where(small, small_value, large_value)


def _by_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    term = 1.0 / a
    total = term.copy()
    n = a.copy()
    while True:
        n = n + 1
        term = term * x / n
        total = total + term
        if np.all(term <= total * 1e-16):
            return total * x * np.exp(gamma_log_density(a, x))


def _by_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper tail by Lentz' method for the continued fraction."""
    tiny = 1e-300
    b = x + 1 - a
    c = np.full_like(a, 1 / tiny)
    d = 1 / np.where(b == 0, tiny, b)
    h = d.copy()
    for i in range(1, 2000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 4e-16 * 8):
            break
    else:
        raise ArithmeticError("the continued fraction has not settled")
    return h * x * np.exp(gamma_log_density(a, x))


def _by_quadrature(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integrate the density from x outwards over the part that carries weight."""
    sd = np.sqrt(a)
    upper = x >= a
    far = np.where(upper, np.maximum(a, x) + 12 * sd + 60, np.maximum(0.0, np.minimum(a, x) - 12 * sd))
    half = (far - x) / 2
    t = x[:, None] + half[:, None] * (_NODES[None, :] + 1)
    shape = np.broadcast_to(a[:, None], t.shape)
    dens = np.exp(gamma_log_density(shape, np.maximum(t, 1e-300)))
    mass = np.abs(half) * (dens * _WEIGHTS[None, :]).sum(axis=1)
    return np.where(upper, 1 - mass, mass)


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x), elementwise."""
    a = np.asarray(a, dtype=float)
    x = np.asarray(x, dtype=float)
    out = np.zeros_like(x)
    wide = (x > 0) & (a >= _QUADRATURE_FROM)
    low = (x > 0) & ~wide & (x < a + 1)
    high = (x > 0) & ~wide & ~low
    if wide.any():
        out[wide] = _by_quadrature(a[wide], x[wide])
    if low.any():
        out[low] = _by_series(a[low], x[low])
    if high.any():
        out[high] = 1 - _by_fraction(a[high], x[high])
    return np.clip(out, 0.0, 1.0)
