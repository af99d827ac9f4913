"""Aggregate expressions with guarded edge cases."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ecoframe.functions.nulls import safe_div

_CONSTANT = 1e-8


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; null for n < 2 or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    px = F.when(both, x.cast("double"))
    py = F.when(both, y.cast("double"))
    sx, sy = F.stddev_pop(px), F.stddev_pop(py)
    usable = (F.count(px) >= 2) & (sx > _CONSTANT) & (sy > _CONSTANT)
    return F.when(usable, safe_div(F.covar_pop(px, py), sx * sy))


def r2_standard(y: Column, p: Column) -> Column:
    """1 - residual sum of squares / total sum of squares."""
    return 1 - safe_div(F.avg((y - p) * (y - p)), F.var_pop(y))


def r2_variance(y: Column, p: Column, spread: Column | None = None) -> Column:
    """Variance explained: var(p) / (var(spread or p) + var(y - p))."""
    return safe_div(F.var_pop(p), F.var_pop(spread if spread is not None else p) + F.var_pop(y - p))


def inverse_link(eta: Column, link: str) -> Column:
    if link == "logit":
        return 1 / (1 + F.exp(-eta))
    if link == "log":
        return F.exp(eta)
    if link == "identity":
        return eta
    raise ValueError(f"Unsupported link: {link}")


def logit(p: Column) -> Column:
    return F.ln(safe_div(p, 1 - p))


def student_t_quantile(prob: float, dof: float) -> float:
    """Quantile of Student's t by bisection on its distribution function."""

    def cdf(t: float) -> float:
        x = dof / (dof + t * t)
        tail = 0.5 * _incomplete_beta(dof / 2.0, 0.5, x)
        return 1.0 - tail if t > 0 else tail

    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < prob else (low, mid)
    return (low + high) / 2


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function (continued fraction, modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0)
