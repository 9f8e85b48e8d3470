"""The normal distribution and counter-based random numbers over numpy arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def cdf(z: np.ndarray) -> np.ndarray:
    """By the complementary error function's Chebyshev-fitted form, to 1.2e-7 relative."""
    x = np.abs(np.asarray(z, float)) / np.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Coefficients in t of the published fit, constant first.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    power = c[-1]
    for a in reversed(c[:-1]):
        power = power * t + a
    tail = t * np.exp(-x * x + power) / 2
    return np.where(np.asarray(z) > 0, 1 - tail, tail)


def ppf(p: np.ndarray) -> np.ndarray:
    """The inverse of cdf, by Newton steps from a logistic start."""
    p = np.clip(np.asarray(p, float), 1e-12, 1 - 1e-12)
    z = np.clip(np.log(p / (1 - p)) / 1.702, -6, 6)
    for _ in range(12):
        density = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
        z = np.clip(z - np.clip((cdf(z) - p) / np.maximum(density, 1e-12), -1, 1), -7.5, 7.5)
    return z


def uniform(seed: int, stream: int, row: np.ndarray) -> np.ndarray:
    """A number in (0, 1) that depends on seed, stream and row alone."""
    x = np.asarray(row).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + stream * 0x8CB92BA72F3D8DD7) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def normal(seed: int, stream: int, row: np.ndarray) -> np.ndarray:
    return ppf(uniform(seed, stream, row))


def ppf_column(p: Column) -> Column:
    """The inverse of the normal distribution function as an expression, to 1.2e-9 relative (Acklam's rational form)."""
    # Coefficients of the published approximation, highest power first.
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
    low = 0.02425

    def polynomial(coefficients: list[float], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + F.lit(k)
        return out

    middle = p - 0.5
    tail = lambda q: polynomial(c, q) / polynomial(d, q)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < low, tail(F.sqrt(-2 * F.ln(p))))
        .when(p > 1 - low, -tail(F.sqrt(-2 * F.ln(1 - p))))
        .otherwise(polynomial(a, middle * middle) * middle / polynomial(b, middle * middle))
    )


def student_lower(alpha: float, freedom: int) -> float:
    """The one-sided quantile of Student's distribution at 1 - alpha, by bisection on its density's integral."""
    if freedom <= 0:
        return math.inf
    scale = math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi)

    def upper(t: float) -> float:
        # The integral over theta of the density at sqrt(freedom) * tan(theta).
        grid = np.linspace(0, math.atan(t / math.sqrt(freedom)), 2001)
        f = np.cos(grid) ** (freedom - 1)
        return 0.5 - scale * math.sqrt(freedom) * float((f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * (grid[1] - grid[0]) / 3)

    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upper(mid) > alpha else (lo, mid)
    return (lo + hi) / 2
