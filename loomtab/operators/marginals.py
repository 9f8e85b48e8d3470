"""Marginals on the unit interval: beta distributions as expressions, inflated and plain, with an empirical one where none fits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.operators.ranks import bracketed, value_ranks

#: Terms of the continued fraction, and halvings of the inverse.
TERMS, HALVINGS = 60, 48
#: Most distinct values of a discrete marginal, and the greatest distances at which a beta distribution is taken, inflated or plain.
MOST_LEVELS, INFLATED_KS, BETA_KS = 12, 0.12, 0.08


def beta_cdf(x: Column, a: float, b: float) -> Column:
    """The regularised incomplete beta function of x, cut off at 0 and 1, by its continued fraction on the side where that is short."""
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double")))

    def tail(v: Column, p: float, q: float) -> Column:
        """By the fraction's convergents from the last term to the first."""

        def step(f: Column, k: Column) -> Column:
            m = F.lit(TERMS) - k
            even = m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1))
            # The m-th pair: 1 + even / (1 + odd / f), where the first pair has no even part.
            inner = 1 + odd / f
            return F.when(m == 0, inner).otherwise(1 + even / inner)

        fraction = F.aggregate(F.sequence(F.lit(0), F.lit(TERMS)), F.lit(1.0), step)
        return F.exp(front + p * F.ln(v) + q * F.log1p(-v)) / p / fraction

    inside = F.when(u <= (a + 1) / (a + b + 2), tail(u, a, b)).otherwise(1 - tail(1 - u, b, a))
    return F.when(u <= 0, 0.0).when(u >= 1, 1.0).otherwise(inside)


def beta_ppf(p: Column, a: float, b: float) -> Column:
    """The inverse of beta_cdf, by halving."""
    ends = F.aggregate(
        F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")),
        lambda s, _: F.when(beta_cdf((s["lo"] + s["hi"]) / 2, a, b) < p, F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))),
    )
    return F.when(p.isNotNull(), (ends["lo"] + ends["hi"]) / 2)


def beta_moments(mean: float, variance: float) -> tuple[float, float]:
    """The parameters of the beta distribution with these moments, within 0.05 and 500."""
    m = min(max(mean, 1e-4), 1 - 1e-4)
    size = max(m * (1 - m) / max(variance, 1e-9) - 1, 1e-3)
    return min(max(m * size, 0.05), 500.0), min(max((1 - m) * size, 0.05), 500.0)


def beta_distance(df: DataFrame, x: str, a: float, b: float) -> float:
    """The greatest distance of x's distribution function from the beta one, over ranges of its counted values; 0 for an empty column."""
    ranked = value_ranks(df, x)
    f = beta_cdf(F.col(x), a, b)
    below = F.col("upto") - F.col("n")
    total = df.agg(F.count(x).alias("total"))
    gap = F.greatest(F.abs(f - F.col("upto") / F.col("total")), F.abs(f - below / F.col("total")))
    return float(ranked.join(F.broadcast(total)).agg(F.max(gap)).first()[0] or 0.0)


def fit_marginal(df: DataFrame, x: str) -> dict:
    """kind and parameters of a column on the unit scale: spike, bernoulli, ordinal, inflated, beta or quantiles.

    One value is a spike; zeros and ones are a Bernoulli variable; few distinct
    values, or more than a quarter at both ends, are ordinal levels with shares; a
    column with more than 3 % zeros is an inflated beta, any other a beta, where
    its distance is small; all else are quantiles. Missing values are left out; a
    column without values is a spike at one half.
    """
    c = F.col(x).cast("double")
    rows = df.select(c.alias(x)).filter(F.col(x).isNotNull() & ~F.isnan(x))
    s = rows.agg(
        F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.count_if(F.col(x) == 0).alias("zeros"), F.count_if(F.col(x) == 1).alias("ones"),
        F.avg(F.when(F.col(x) > 0, F.col(x))).alias("mean0"), F.var_pop(F.when(F.col(x) > 0, F.col(x))).alias("var0"),
    ).first()
    n = s["n"]
    if not n or s["lo"] == s["hi"]:
        return {"kind": "spike", "value": 0.5 if not n else float(s["lo"])}
    if s["zeros"] + s["ones"] == n:
        return {"kind": "bernoulli", "share": s["ones"] / n}
    few = rows.select(x).distinct().limit(MOST_LEVELS + 1).count() <= MOST_LEVELS
    if few:
        counts = sorted((r[x], r["count"]) for r in rows.groupBy(x).count().collect())  # MOST_LEVELS at most
        return {"kind": "ordinal", "levels": [float(v) for v, _ in counts], "shares": [k / n for _, k in counts]}
    if s["zeros"] > 0.03 * n and s["ones"] + s["zeros"] <= 0.25 * n + s["zeros"]:
        a, b = beta_moments(s["mean0"], s["var0"])
        if beta_distance(rows.filter(F.col(x) > 0), x, a, b) <= INFLATED_KS:
            return {"kind": "inflated", "zeros": s["zeros"] / n, "a": a, "b": b}
    a, b = beta_moments(s["mean"], s["var"])
    if s["zeros"] + s["ones"] <= 0.25 * n and beta_distance(rows, x, a, b) <= BETA_KS:
        return {"kind": "beta", "a": a, "b": b}
    k = int(np.clip(2 * round(math.sqrt(n)) + 1, 9, 33))
    found, _ = bracketed(rows, {x: F.col(x)}, [i / (k - 1) for i in range(k)])
    return {"kind": "quantiles", "knots": found[x][1]}


def value_at(u: Column, fitted: dict) -> Column:
    """The marginal's value at a probability."""
    kind = fitted["kind"]
    if kind == "spike":
        return F.when(u.isNotNull(), F.lit(float(fitted["value"])))
    if kind == "bernoulli":
        return F.when(u.isNotNull(), (u > 1 - fitted["share"]).cast("double"))
    if kind == "ordinal":
        out, upto = F.lit(float(fitted["levels"][-1])), 1.0
        for v, s in zip(reversed(fitted["levels"][:-1]), reversed(fitted["shares"][1:]), strict=True):
            upto -= s
            out = F.when(u <= upto, F.lit(float(v))).otherwise(out)
        return F.when(u.isNotNull(), out)
    if kind == "inflated":
        z = fitted["zeros"]
        return F.when(u <= z, 0.0).otherwise(beta_ppf((u - z) / (1 - z), fitted["a"], fitted["b"]))
    if kind == "beta":
        return beta_ppf(u, fitted["a"], fitted["b"])
    knots = fitted["knots"]
    at = u * (len(knots) - 1)
    low = F.least(F.floor(at), F.lit(len(knots) - 2)).cast("int")
    held = F.array(*(F.lit(float(v)) for v in knots))
    return F.get(held, low) + (at - low) * (F.get(held, low + 1) - F.get(held, low))
