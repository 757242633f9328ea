"""Statistics as column expressions over aggregates, and p-values of correlations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def wilson(k: Column, n: Column, z: float = 1.959964, clamp: bool = True) -> tuple[Column, Column]:
    """Score interval of a share; (0, 0) of nothing."""
    p = k / F.when(n > 0, n)
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    low, high = (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)
    if clamp:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def kappa(observed: Column, expected: Column, degenerate: float = math.nan) -> Column:
    return F.when(expected == 1, F.lit(degenerate)).otherwise((observed - expected) / F.when(expected != 1, 1 - expected))


def pearson(x: str, y: str) -> Column:
    """``corr``, NaN where a side is constant or there are fewer than two rows."""
    flat = (F.count(x) < 2) | (F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0) | (F.coalesce(F.stddev_pop(y), F.lit(0.0)) == 0)
    return F.when(flat, F.lit(math.nan)).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def _continued_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the incomplete beta's continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised; the symmetric form is taken where the fraction converges fast."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return scale * _continued_fraction(a, b, x) / a if x * (a + b + 2) < a + 1 else 1 - scale * _continued_fraction(b, a, 1 - x) / b


def p_of_r(r: float, n: int) -> float:
    """Two-sided p of a correlation by the t approximation; NaN without degrees of freedom."""
    if n < 3 or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([p_of_r(float(a), int(b)) for a, b in zip(r, n)], dtype="float64")


def bootstrap_ci(values: np.ndarray, n_boot: int, alpha: float, seed: int, block: int = 1 << 22) -> tuple[float, float, float, float]:
    """(mean, low, high, share of replicate means above 0) with NumPy's seeded stream; blocks bound the memory."""
    n = len(values)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    rng, means, rows = np.random.default_rng(seed), [], max(1, block // n)
    for i in range(0, n_boot, rows):
        means.append(values[rng.integers(0, n, size=(min(rows, n_boot - i), n))].mean(axis=1))
    means = np.concatenate(means)
    low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(values.mean()), float(low), float(high), float((means > 0).mean())
