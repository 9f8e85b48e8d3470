"""Additive models of coded features, with pairs, and hinge models: fitted from sums by code, not from rows.

A cycle of backfitting needs, for each feature, the sums of y by code and how
often two features' codes meet. Both come from one aggregation, so cycles run on
counts alone. Pairs take one aggregation of residuals by both codes; a hinge
takes one of running sums by feature and code, in which every knot is tried. The
driver's tables are bounded by features, pairs and codes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Additive:
    """base + a value for each feature's code + a value for each pair's codes."""

    base: float
    levels: int
    mains: dict[str, list[float]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], list[float]] = field(default_factory=dict)  # codes of the first, then the second

    def main(self) -> Column:
        out = F.lit(float(self.base))
        for c, values in self.mains.items():
            out = out + F.coalesce(F.get(F.array(*(F.lit(float(v)) for v in values)), F.col(c).cast("int")), F.lit(0.0))
        return out

    def output(self) -> Column:
        """The model's value, over columns of codes; a missing code adds nothing."""
        out = self.main()
        for (a, b), values in self.pairs.items():
            at = F.col(a).cast("int") * self.levels + F.col(b).cast("int")
            out = out + F.coalesce(F.get(F.array(*(F.lit(float(v)) for v in values)), at), F.lit(0.0))
        return out


def meetings(df: DataFrame, codes: list[str], y: Column, levels: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Counts of two features' codes together (the diagonal holds a feature's own), sums of y by code, and count and sum of all rows.

    Rows without y are left out; a missing code is in none of its feature's cells.
    """
    d = len(codes)
    rows = df.filter(y.isNotNull()).select(y.cast("double").alias("__y"), *codes)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    cells = F.array(*(F.struct(F.lit(k).alias("p"), F.col(codes[i]).cast("int").alias("a"), F.col(codes[j]).cast("int").alias("b")) for k, (i, j) in enumerate(pairs)))
    counts = rows.select("__y", F.explode(cells).alias("c")).filter("c.a is not null and c.b is not null").groupBy("c.p", "c.a", "c.b").agg(F.count("*").alias("n"), F.sum("__y").alias("s"))
    n, s = np.zeros((d, levels, d, levels)), np.zeros((d, levels))
    for r in counts.collect():  # pairs of features x codes x codes
        i, j = pairs[r["p"]]
        n[i, r["a"], j, r["b"]] = n[j, r["b"], i, r["a"]] = r["n"]
        if i == j:
            s[i, r["a"]] = r["s"]
    whole = rows.agg(F.count("*"), F.sum("__y")).first()
    return n, s, float(whole[0]), float(whole[1] or 0.0)


def backfitted(n: np.ndarray, s: np.ndarray, rows: float, total: float, penalty: float = 5.0, cycles: int = 50, close: float = 1e-7) -> tuple[float, np.ndarray]:
    """The base and each feature's values after so many cycles, each feature in its turn fitted to what the others leave.

    A value is the shrunken mean of its code's residuals; a feature's values are
    centred over the rows.
    """
    d, levels = s.shape
    base = total / max(rows, 1.0)
    f = np.zeros((d, levels))
    own = np.stack([np.diag(n[j, :, j]) for j in range(d)]) if d else np.zeros((0, levels))
    for _ in range(cycles):
        before = f.copy()
        for j in range(d):
            others = sum((n[j, :, k] @ f[k] for k in range(d) if k != j), np.zeros(levels))
            f[j] = (s[j] - base * own[j] - others) / (own[j] + penalty)
            f[j] = np.where(own[j] > 0, f[j] - (own[j] @ f[j]) / max(own[j].sum(), 1.0), 0.0)
        if np.abs(f - before).max(initial=0) < close:
            break
    return base, f


def pair_sums(df: DataFrame, pairs: list[tuple[str, str]], residual: Column) -> DataFrame:
    """a, b, code_a, code_b, n and s, the sum of residuals: all pairs in one aggregation."""
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("int").alias("code_a"), F.col(b).cast("int").alias("code_b")) for a, b in pairs))
    rows = df.select(residual.alias("__r"), F.explode(cells).alias("c")).filter("__r is not null and c.code_a is not null and c.code_b is not null")
    return rows.groupBy("c.a", "c.b", "c.code_a", "c.code_b").agg(F.count("*").alias("n"), F.sum("__r").alias("s"))


def fit(df: DataFrame, codes: list[str], y: Column, levels: int, penalty: float = 5.0, pairs: int = 0, pair_penalty: float = 5.0, least_gain: float = 1e-3) -> Additive:
    """Main effects by backfitting, then the pairs, one after another, that take most of the squared residuals, each at least a part of them."""
    base, f = backfitted(*meetings(df, codes, y, levels), penalty)
    model = Additive(base, levels, {c: f[j].tolist() for j, c in enumerate(codes)})
    every = list(combinations(codes, 2))
    for _ in range(min(pairs, len(every))):
        residual = y.cast("double") - model.output()
        left = [p for p in every if p not in model.pairs]
        whole = df.agg(F.sum(residual * residual)).first()[0]
        values: dict[tuple[str, str], np.ndarray] = {p: np.zeros(levels * levels) for p in left}
        gains = dict.fromkeys(left, 0.0)
        for r in pair_sums(df, left, residual).collect():  # pairs x codes x codes
            v = r["s"] / (r["n"] + pair_penalty)
            values[r["a"], r["b"]][r["code_a"] * levels + r["code_b"]] = v
            gains[r["a"], r["b"]] += 2 * v * r["s"] - v * v * r["n"]
        best = max(left, key=lambda p: round(gains[p], 9))
        if not whole or gains[best] < least_gain * whole:
            break
        model.pairs[best] = values[best].tolist()
    return model


# --- Hinges.


@dataclass
class Hinges:
    """An intercept and weighted hinges: (feature, knot, side), max(0, x - knot) for side 1, max(0, knot - x) for -1."""

    intercept: float
    terms: list[tuple[str, float, int]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def output(self) -> Column:
        out = F.lit(float(self.intercept))
        for term, w in zip(self.terms, self.weights, strict=True):
            out = out + F.lit(float(w)) * hinge(*term)
        return out


def hinge(feature: str, knot: float, side: int) -> Column:
    return F.greatest(F.lit(0.0), (F.col(feature).cast("double") - F.lit(float(knot))) * side)


def knot_sums(df: DataFrame, columns: list[str], residual: Column, width: float, terms: list[Column] = ()) -> DataFrame:
    """feature, bin (floor(x / width)), and the sums that every hinge needs: n, x, x^2, r and r x, and t and t x of the terms so far."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))
    named = {f"t{k}": t for k, t in enumerate(terms)}
    rows = df.select(residual.alias("__r"), *(t.alias(n) for n, t in named.items()), F.explode(cells).alias("c")).filter("__r is not null and c.x is not null")
    rows = rows.select("c.feature", "c.x", "__r", *named, F.floor(F.col("c.x") / width).cast("long").alias("bin"))
    more = [s for n in named for s in (F.sum(n).alias(n), F.sum(F.col(n) * F.col("x")).alias(f"{n}x"))]
    return rows.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum("__r").alias("r"), F.sum(F.col("__r") * F.col("x")).alias("rx"), *more)


def best_knot(sums: list, g: np.ndarray, width: float, least: int = 20) -> tuple[str, float, list[int], float] | None:
    """feature, knot, sides and gain of the pair of hinges that lowers the squared error most, all other weights refitted.

    sums are knot_sums of the residuals of a model with the terms whose products
    (with the intercept's) g holds; both hinges' products with terms, residuals
    and each other come from running sums. Knots are bins' lower borders; a side
    with fewer than least rows has no hinge.
    """
    inverse, best = np.linalg.pinv(g), None
    for feature in sorted({s["feature"] for s in sums}):
        own = sorted((s for s in sums if s["feature"] == feature), key=lambda s: s["bin"])
        names = ["n", "x", "xx", "r", "rx", *(f"t{k}{e}" for k in range(len(g) - 1) for e in ("", "x"))]
        upto = np.cumsum(np.array([[s[n] or 0.0 for n in names] for s in own], float), axis=0)
        for k, s in enumerate(own):
            knot, below = s["bin"] * width, upto[k - 1] if k else np.zeros(len(names))
            sides, products, square, follow = [], [], [], []
            for side, v in ((1, upto[-1] - below), (-1, below)):
                if v[0] < least or upto[-1][0] - v[0] < 0:
                    continue
                sides.append(side)
                products.append(side * np.concatenate(([v[1] - knot * v[0]], v[6::2] - knot * v[5::2])))
                square.append(v[2] - 2 * knot * v[1] + knot * knot * v[0])
                follow.append(side * (v[4] - knot * v[3]))
            if not sides:
                continue
            c, h = np.array(products), np.array(follow)
            m = np.diag(square) - c @ inverse @ c.T
            kept = [j for j in range(len(sides)) if m[j, j] > 1e-6 * max(square[j], 1e-9)]
            if not kept:
                continue
            gain = float(h[kept] @ np.linalg.pinv(m[np.ix_(kept, kept)], rcond=1e-6) @ h[kept])
            if best is None or gain > best[3] * (1 + 1e-9) + 1e-12:
                best = feature, float(knot), [sides[j] for j in kept], gain
    return best


def solved(df: DataFrame, terms: list[tuple[str, float, int]], y: Column) -> tuple[np.ndarray, float]:
    """The matrix of products of (1, terms, y), from one aggregation, and the number of rows."""
    every = [F.lit(1.0), *(hinge(*t) for t in terms), y.cast("double")]
    whole = every[-1].isNotNull()
    for e in every[1:-1]:
        whole = whole & e.isNotNull()
    k = len(every)
    r = df.filter(whole).agg(*(F.sum(every[i] * every[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k))).first()
    g = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return g, g[0, 0]


def least_squares(g: np.ndarray, kept: list[int]) -> tuple[np.ndarray, float]:
    """Weights of an intercept and the kept terms, and the squared error, from a matrix of products."""
    at = [0, *(1 + k for k in kept)]
    pull = 1e-9 * np.diag(np.maximum(np.diag(g)[at], 1.0))
    w = np.linalg.lstsq(g[np.ix_(at, at)] + pull, g[at, -1], rcond=1e-12)[0]
    return w, float(max(g[-1, -1] - 2 * w @ g[at, -1] + w @ g[np.ix_(at, at)] @ w, 0.0))


def fit_hinges(df: DataFrame, columns: list[str], y: Column, width: float, knots: int = 5, cost: float = 3.0) -> Hinges:
    """Hinges forward, a knot at a time, each the one that lowers the error most, then backward by generalised cross-validation.

    A knot takes one aggregation of running sums and one of products. Going back
    needs no rows: all smaller models are solved from one matrix.
    """
    model = Hinges(0.0)
    g, n = solved(df, [], y)
    if not n:
        return model
    model.intercept = float(g[0, -1] / n)
    chosen: list[tuple[str, float, int]] = []
    for _ in range(knots):
        terms = [hinge(*t) for t in chosen]
        found = best_knot(knot_sums(df, columns, y.cast("double") - model.output(), width, terms).collect(), g[:-1, :-1], width)  # features x bins
        if found is None or found[3] <= 1e-9 * max(g[-1, -1], 1e-9):
            break
        new = [(found[0], found[1], side) for side in found[2] if (found[0], found[1], side) not in chosen]
        if not new:
            break
        chosen += new
        g, n = solved(df, chosen, y)
        w, _ = least_squares(g, list(range(len(chosen))))
        model = Hinges(float(w[0]), list(chosen), w[1:].tolist())
    kept = list(range(len(chosen)))
    criterion = lambda k: least_squares(g, k)[1] / n / max(1 - (1 + len(k) * (1 + cost / 2)) / n, 1e-9) ** 2
    best = (criterion(kept), kept)
    while kept:
        kept = min(([k for k in kept if k != out] for out in kept), key=criterion)
        best = min(best, (criterion(kept), kept), key=lambda b: b[0])
    w, _ = least_squares(g, best[1])
    return Hinges(float(w[0]), [chosen[k] for k in best[1]], w[1:].tolist())
