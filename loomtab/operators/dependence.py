"""Dependence of normal scores: independence, trees, factors, full matrices, vines of pair copulas and mixtures, chosen by held-out likelihood.

Scores lie in columns of a table. What every Gaussian candidate needs is one sum
of outer products, made where the rows are. A vine is fitted level by level: the
conditional columns of a level come from the pair copulas of the levels before,
and one aggregation scores all pairs, families and parameters of the level. A
mixture takes one aggregation a round. The likelihoods of all candidates on the
held-out rows come from one pass. The driver gets numbers whose count depends on
columns, families and regimes alone.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.functions import normal

LOG_2PI = float(np.log(2 * np.pi))
#: Eigenvalues and variances stay above this.
FLOOR = 1e-3
#: Parameters among which a level's pair copulas are chosen.
GAUSSIAN = [round(k / 20, 2) for k in range(-19, 20)]
CLAYTON = [0.2, 0.4, 0.7, 1.0, 1.5, 2.2, 3.2, 4.5, 6.5]
FRANK = [-16.0, -10.0, -6.0, -4.0, -2.5, -1.2, 1.2, 2.5, 4.0, 6.0, 10.0, 16.0]
#: Rounds of a mixture's fit.
ROUNDS = 20
EDGE = 1e-6


def array_sums(df: DataFrame, make, size: int) -> np.ndarray:
    """The sum over batches of rows of make(rows), an array of a fixed size, added up on the executors."""

    def run(frames):
        total = np.zeros(size)
        for pdf in frames:
            if len(pdf):
                total += make(pdf)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "value": total[at]})

    out = np.zeros(size)
    for r in df.mapInPandas(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def scores_of(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return pdf[columns].to_numpy(dtype=float) if columns else np.zeros((len(pdf), 0))


def correlation_of(sums: np.ndarray, shrink: float = 0.02) -> np.ndarray:
    """The correlation matrix of sums of outer products of (1, scores), shrunken towards independence."""
    n = max(sums[0, 0], 1.0)
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    r = (1 - shrink) * np.clip(cov / np.outer(sd, sd), -0.995, 0.995)
    r[np.diag(cov) <= 1e-12, :] = 0.0
    r[:, np.diag(cov) <= 1e-12] = 0.0
    np.fill_diagonal(r, 1.0)
    return r


def nearest_correlation(r: np.ndarray) -> np.ndarray:
    """A positive definite matrix near r with ones on its diagonal."""
    values, vectors = np.linalg.eigh((r + r.T) / 2)
    near = vectors @ np.diag(np.maximum(values, FLOOR)) @ vectors.T
    sd = np.sqrt(np.diag(near))
    return near / np.outer(sd, sd)


def spanning_tree(weight: np.ndarray) -> list[tuple[int, int]]:
    """Edges (parent, child) of the maximum spanning tree grown from the first node, ties to lesser numbers."""
    d = len(weight)
    inside, edges = [0] if d else [], []
    while len(inside) < d:
        a, b = max(((a, b) for a in inside for b in range(d) if b not in inside), key=lambda e: (weight[e], -e[1], -e[0]))
        edges.append((a, b))
        inside.append(b)
    return edges


@dataclass
class Gaussian:
    """Scores of a normal distribution whose correlation a tree, factors or a whole matrix gives."""

    kind: str
    d: int
    parents: list = field(default_factory=list)  # of a tree: (parent, child, correlation), parents first
    loadings: list = field(default_factory=list)  # of factors: a row a column
    lower: list = field(default_factory=list)  # of a matrix: its lower triangle, by rows

    def matrix(self) -> np.ndarray:
        r = np.eye(self.d)
        if self.kind == "tree":
            done: list[int] = sorted(set(range(self.d)) - {b for _, b, _ in self.parents})
            for a, b, c in self.parents:
                r[b, done] = r[done, b] = c * r[a, done]
                done.append(b)
        elif self.kind == "factor":
            load = np.array(self.loadings)
            r = load @ load.T
            np.fill_diagonal(r, 1.0)
        elif self.kind == "full":
            at = np.tril_indices(self.d, -1)
            r[at] = self.lower
            r = r + r.T - np.eye(self.d)
        return nearest_correlation(r) if self.kind == "full" else r

    def log_density(self, z: np.ndarray) -> np.ndarray:
        return normal_log_density(z, self.matrix())

    def draw(self, noise: np.ndarray) -> np.ndarray:
        """Scores from independent normal numbers, a row each."""
        return noise[:, : self.d] @ np.linalg.cholesky(self.matrix() + 1e-9 * np.eye(self.d)).T

    def width(self) -> int:
        return self.d


def normal_log_density(z: np.ndarray, r: np.ndarray) -> np.ndarray:
    chol = np.linalg.cholesky(r + 1e-6 * np.eye(len(r)))
    y = np.linalg.solve(chol, z.T)
    return -((y * y).sum(0) + 2 * np.log(np.diag(chol)).sum() + len(r) * LOG_2PI) / 2


# --- Pair copulas: logarithms of densities, conditional distributions and their inverses.


def clayton_log(u: np.ndarray, v: np.ndarray, t: float) -> np.ndarray:
    s = u**-t + v**-t - 1
    return np.log1p(t) - (1 + t) * (np.log(u) + np.log(v)) - (2 + 1 / t) * np.log(s)


def frank_log(u: np.ndarray, v: np.ndarray, t: float) -> np.ndarray:
    a, b, c = np.expm1(-t * u), np.expm1(-t * v), np.expm1(-t)
    return np.log(-t * c) - t * (u + v) - 2 * np.log(np.abs(c + a * b))


def gaussian_log(u: np.ndarray, v: np.ndarray, r: float) -> np.ndarray:
    x, y = normal.ppf(u), normal.ppf(v)
    return -np.log1p(-r * r) / 2 - (r * r * (x * x + y * y) - 2 * r * x * y) / (2 * (1 - r * r))


def turned(family: str, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as the unturned family sees them: clayton90 turns the first, clayton270 the second, clayton180 both."""
    return (1 - u if family in ("clayton90", "clayton180") else u), (1 - v if family in ("clayton180", "clayton270") else v)


def pair_log(family: str, t: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The logarithm of a pair copula's density."""
    if family == "independent":
        return np.zeros(len(u))
    if family == "gaussian":
        return gaussian_log(u, v, t)
    if family == "frank":
        return frank_log(u, v, t)
    return clayton_log(*turned(family, u, v), t)


def conditional(family: str, t: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The distribution of u given v."""
    if family == "independent":
        return u
    if family == "gaussian":
        h = normal.cdf((normal.ppf(u) - t * normal.ppf(v)) / np.sqrt(1 - t * t))
    elif family == "frank":
        a, b, c = np.expm1(-t * u), np.expm1(-t * v), np.expm1(-t)
        h = a * np.exp(-t * v) / (c + a * b)
    else:
        x, y = turned(family, u, v)
        h = y ** (-t - 1) * (x**-t + y**-t - 1) ** (-1 - 1 / t)
        h = 1 - h if family in ("clayton90", "clayton180") else h
    return np.clip(h, EDGE, 1 - EDGE)


def conditional_inverse(family: str, t: float, h: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The u whose distribution given v is h."""
    if family == "independent":
        return h
    if family == "gaussian":
        u = normal.cdf(normal.ppf(h) * np.sqrt(1 - t * t) + t * normal.ppf(v))
    elif family == "frank":
        c, e = np.expm1(-t), np.exp(-t * v)
        u = -np.log1p(h * c / (e - h * np.expm1(-t * v))) / t
    else:
        first = family in ("clayton90", "clayton180")
        _, y = turned(family, h, v)
        g = 1 - h if first else h
        x = ((g * y ** (t + 1)) ** (-t / (1 + t)) + 1 - y**-t) ** (-1 / t)
        u = 1 - x if first else x
    return np.clip(u, EDGE, 1 - EDGE)


def pair_candidates() -> list[tuple[str, float]]:
    turns = [(f"clayton{k}", t) for k in ("", "90", "180", "270") for t in CLAYTON]
    return [("independent", 0.0), *(("gaussian", r) for r in GAUSSIAN if r), *turns, *(("frank", t) for t in FRANK)]


def pair_totals(every: list[tuple[str, float]], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The sums of pair_log of all families and parameters; those of normal copulas come from three sums of scores."""
    x, y = normal.ppf(u), normal.ppf(v)
    squares, products, n = float(x @ x + y @ y), float(x @ y), len(u)

    def total(family: str, t: float) -> float:
        if family == "gaussian":
            return -n * np.log1p(-t * t) / 2 - (t * t * squares - 2 * t * products) / (2 * (1 - t * t))
        return float(pair_log(family, t, u, v).sum())

    return np.array([total(f, t) for f, t in every])


@dataclass
class Vine:
    """A vine along an order of columns: level l joins columns l apart, given those between them; further levels are independent."""

    d: int
    order: list
    levels: list = field(default_factory=list)  # a list of (family, parameter) for each level
    kind: str = "vine"

    def conditionals(self, z: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """For the pairs of the next level the left and right sides given what lies between, after so many levels."""
        u = np.clip(normal.cdf(z[:, self.order]), EDGE, 1 - EDGE)
        left, right = u[:, :-1], u[:, 1:]
        for level in self.levels[:upto]:
            # The left side given one more column to its right, and the other way round.
            on = range(len(level))
            given_right = np.column_stack([conditional(*level[k], left[:, k], right[:, k]) for k in on])
            given_left = np.column_stack([conditional(swapped(level[k][0]), level[k][1], right[:, k], left[:, k]) for k in on])
            left, right = given_right[:, :-1], given_left[:, 1:]
        return left, right

    def log_density(self, z: np.ndarray) -> np.ndarray:
        out = -(z * z + LOG_2PI).sum(1) / 2
        for n, level in enumerate(self.levels):
            left, right = self.conditionals(z, n)
            for k, (family, t) in enumerate(level):
                out = out + pair_log(family, t, left[:, k], right[:, k])
        return out

    def draw(self, noise: np.ndarray) -> np.ndarray:
        """Scores from independent normal numbers, column by column along the order."""
        w = np.clip(normal.cdf(noise[:, : self.d]), EDGE, 1 - EDGE)
        depth = len(self.levels)
        # forward[l]: the newest column given the l before it; backward[l]: the one l before the newest given those after it.
        out = [w[:, 0]]
        backward = [w[:, 0]]
        for j in range(1, self.d):
            most = min(j, depth)
            forward = [None] * most + [w[:, j]]
            for n in range(most, 0, -1):
                family, t = self.levels[n - 1][j - n]
                forward[n - 1] = conditional_inverse(swapped(family), t, forward[n], backward[n - 1])
            fresh = [forward[0]]
            for n in range(1, most + 1):
                family, t = self.levels[n - 1][j - n]
                fresh.append(conditional(family, t, backward[n - 1], forward[n - 1]))
            out.append(forward[0])
            backward = fresh
        z = np.empty((len(noise), self.d))
        z[:, self.order] = normal.ppf(np.column_stack(out))
        return z

    def width(self) -> int:
        return self.d


def swapped(family: str) -> str:
    """The family seen from its other side."""
    return {"clayton90": "clayton270", "clayton270": "clayton90"}.get(family, family)


@dataclass
class Mixture:
    """Regimes with means and deviations of their own and one correlation within all of them."""

    d: int
    weights: list
    means: list
    deviations: list
    within: dict  # a Gaussian's fields
    kind: str = "mixture"

    def log_density(self, z: np.ndarray) -> np.ndarray:
        inner = Gaussian(**self.within).matrix()
        parts = [np.log(w) + normal_log_density((z - np.array(m)) / np.array(s), inner) - np.log(s).sum() for w, m, s in zip(self.weights, self.means, self.deviations, strict=True)]
        top = np.max(parts, axis=0)
        return top + np.log(np.exp(np.array(parts) - top).sum(0))

    def draw(self, noise: np.ndarray) -> np.ndarray:
        """Scores whose columns are standard normal again: each goes through its own mixture's distribution."""
        inner = Gaussian(**self.within).draw(noise[:, : self.d])
        at = np.minimum(np.searchsorted(np.cumsum(self.weights), normal.cdf(noise[:, self.d])), len(self.weights) - 1)
        z = np.array(self.means)[at] + np.array(self.deviations)[at] * inner
        u = sum(w * normal.cdf((z - np.array(m)) / np.array(s)) for w, m, s in zip(self.weights, self.means, self.deviations, strict=True))
        return normal.ppf(np.clip(u, EDGE, 1 - EDGE))

    def width(self) -> int:
        return self.d + 1


def from_dict(held: dict):
    """A model back from its fields."""
    return {"vine": Vine, "mixture": Mixture}.get(held["kind"], Gaussian)(**held)


def rounded(model, digits: int = 3):
    """The model with its numbers rounded, as it is stored."""

    def cut(x):
        if isinstance(x, float):
            return round(x, digits)
        if isinstance(x, dict):
            return {k: cut(v) for k, v in x.items()}
        return [cut(v) for v in x] if isinstance(x, (list, tuple)) else x

    return from_dict(cut(asdict(model)))


# --- Fits.


def fit_tree(r: np.ndarray) -> Gaussian:
    """The tree of the greatest mutual information, -ln(1 - r^2) / 2 an edge; columns without any stand alone."""
    weight = -np.log(np.maximum(1 - r * r, 1e-12)) / 2
    edges = [(a, b, float(r[a, b])) for a, b in spanning_tree(weight) if weight[a, b] > 1e-6]
    return Gaussian("tree", len(r), parents=edges)


def fit_factor(r: np.ndarray, rank: int, rounds: int = 25) -> Gaussian:
    """Principal axes of the matrix with its communalities on the diagonal."""
    shared = np.full(len(r), 0.5)
    for _ in range(rounds):
        inner = r.copy()
        np.fill_diagonal(inner, shared)
        values, vectors = np.linalg.eigh(inner)
        load = vectors[:, -rank:] * np.sqrt(np.maximum(values[-rank:], 0))
        shared = np.clip((load * load).sum(1), 0.0, 0.995)
    size = (load * load).sum(1)
    load = load * np.sqrt(np.minimum(1.0, 0.995 / np.maximum(size, 1e-12)))[:, None]
    return Gaussian("factor", len(r), loadings=load.tolist())


def fit_full(r: np.ndarray) -> Gaussian:
    return Gaussian("full", len(r), lower=nearest_correlation(r)[np.tril_indices(len(r), -1)].tolist())


def path_order(r: np.ndarray) -> list[int]:
    """A path through all columns that begins with the strongest pair and goes on, at either end, to the strongest neighbour."""
    d = len(r)
    if d < 2:
        return list(range(d))
    w = np.abs(r) - 2 * np.eye(d)
    a, b = divmod(int(np.argmax(w)), d)
    path = [a, b]
    while len(path) < d:
        rest = [k for k in range(d) if k not in path]
        end, new = max(((e, k) for e in (0, -1) for k in rest), key=lambda x: (w[path[x[0]], x[1]], -x[1]))
        path.insert(0 if end == 0 else len(path), new)
    return path


def fit_vine(df: DataFrame, columns: list[str], r: np.ndarray, depth: int = 2) -> Vine:
    """A vine of so many levels; each level's pairs take the family and parameter of the greatest likelihood, if it beats independence by 2 in all."""
    vine = Vine(len(columns), path_order(r))
    every = pair_candidates()
    for level in range(min(depth, len(columns) - 1)):
        pairs = len(columns) - 1 - level

        def likelihoods(pdf: pd.DataFrame, level=level, pairs=pairs) -> np.ndarray:
            left, right = vine.conditionals(scores_of(pdf, columns), level)
            return np.concatenate([pair_totals(every, left[:, k], right[:, k]) for k in range(pairs)])

        found = array_sums(df, likelihoods, pairs * len(every)).reshape(pairs, len(every))
        best = [int(np.argmax(row)) if row.max() > 2.0 else 0 for row in found]
        vine.levels.append([every[b] for b in best])
    return vine


class Regimes:
    """One mixture's numbers while it is fitted."""

    def __init__(self, r: np.ndarray, k: int):
        d = len(r)
        values, vectors = np.linalg.eigh(r)
        axis = vectors[:, -1] * np.sign(vectors[np.argmax(np.abs(vectors[:, -1])), -1])
        self.k, self.d = k, d
        self.weights = np.full(k, 1 / k)
        self.means = np.outer(normal.ppf((np.arange(k) + 0.5) / k) * np.sqrt(max(values[-1], FLOOR)), axis)
        self.sd = np.full((k, d), max(1 / k, 0.4))
        self.inner = np.eye(d)
        self.size = k * (1 + 2 * d) + d * d

    def moments(self, z: np.ndarray) -> np.ndarray:
        """Sums of responsibilities, of scores and squares by regime, and of products within regimes."""
        logs = np.stack([np.log(self.weights[i]) - (((z - self.means[i]) / self.sd[i]) ** 2).sum(1) / 2 - np.log(self.sd[i]).sum() for i in range(self.k)], axis=1)
        share = np.exp(logs - logs.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        inner = np.zeros((self.d, self.d))
        for i in range(self.k):
            e = (z - self.means[i]) / self.sd[i]
            inner += (e * share[:, i : i + 1]).T @ e
        return np.concatenate((share.sum(0), (share.T @ z).ravel(), (share.T @ (z * z)).ravel(), inner.ravel()))

    def moved(self, s: np.ndarray, n: float) -> float:
        """Take the sums of all rows; how far a mean went."""
        k, d = self.k, self.d
        own = np.maximum(s[:k], 1e-9)
        first, second = s[k : k + k * d].reshape(k, d), s[k + k * d : k + 2 * k * d].reshape(k, d)
        self.inner = s[k + 2 * k * d :].reshape(d, d) / n
        new = first / own[:, None]
        far = float(np.abs(new - self.means).max(initial=0))
        self.means = new
        self.sd = np.sqrt(np.maximum(second / own[:, None] - new * new, FLOOR))
        self.weights = np.maximum(own / n, 1e-6)
        self.weights = self.weights / self.weights.sum()
        return far

    def model(self) -> Mixture:
        scale = np.sqrt(np.maximum(np.diag(self.inner), 1e-9))
        within = asdict(fit_tree(0.98 * self.inner / np.outer(scale, scale) + 0.02 * np.eye(self.d)))
        order = sorted(range(self.k), key=lambda i: (-self.weights[i], self.means[i].tolist()))
        return Mixture(self.d, [float(self.weights[i]) for i in order], [self.means[i].tolist() for i in order], [self.sd[i].tolist() for i in order], within)


def fit_mixtures(df: DataFrame, columns: list[str], r: np.ndarray, numbers: tuple[int, ...], rounds: int = ROUNDS) -> list[Mixture]:
    """A mixture of each number of regimes by expectation and maximisation, and the correlation within its regimes.

    They start spread along the first principal axis, so a fit depends on the
    data alone. A round of all mixtures is one aggregation of responsibilities,
    means, squares and, within the regimes, products.
    """
    fits = [Regimes(r, k) for k in numbers]
    for _ in range(rounds):

        def moments(pdf: pd.DataFrame) -> np.ndarray:
            z = scores_of(pdf, columns)
            return np.concatenate([*(f.moments(z) for f in fits), [len(z)]])

        s = array_sums(df, moments, sum(f.size for f in fits) + 1)
        n, at, far = max(s[-1], 1.0), 0, 0.0
        for f in fits:
            far = max(far, f.moved(s[at : at + f.size], n))
            at += f.size
        if far < 1e-3:
            break
    return [f.model() for f in fits]


def candidates(df: DataFrame, columns: list[str], r: np.ndarray, regimes: tuple[int, ...] = (2, 4), depth: int = 2) -> dict:
    """Models by name: Gaussian ones of the correlation r alone, vines and mixtures fitted to df's scores."""
    d = len(columns)
    out = {"independent": Gaussian("independent", d)}
    if d < 2:
        return out
    out["tree"] = fit_tree(r)
    out |= {f"factor{k}": fit_factor(r, k) for k in (1, 2, 4, 8) if k < d}
    out["full"] = fit_full(r)
    out["vine"] = fit_vine(df, columns, r, depth)
    out |= {f"mixture{k}": m for k, m in zip(regimes, fit_mixtures(df, columns, r, regimes), strict=True)}
    return {n: rounded(m) for n, m in out.items()}


def log_likelihoods(df: DataFrame, columns: list[str], models: dict) -> dict[str, float]:
    """The mean log-likelihood of df's scores under each model, all from one pass; 0 for an empty table."""
    names = list(models)

    def totals(pdf: pd.DataFrame) -> np.ndarray:
        z = scores_of(pdf, columns)
        return np.array([*(models[n].log_density(z).sum() for n in names), len(z)])

    s = array_sums(df, totals, len(names) + 1)
    return {n: float(s[k] / max(s[-1], 1.0)) for k, n in enumerate(names)}


def ranked(df: DataFrame, columns: list[str], held: str, regimes: tuple[int, ...] = (2, 4), depth: int = 2) -> tuple[list[tuple[str, float]], dict]:
    """Candidates fitted on the rows where held is false, in the order of their likelihood on the others, and the models by name."""

    def products(pdf: pd.DataFrame) -> np.ndarray:
        x = np.column_stack([np.ones(len(pdf)), scores_of(pdf, columns)])
        return (x.T @ x).ravel()

    size = len(columns) + 1
    train = df.filter(~F.col(held))
    r = correlation_of(array_sums(train, products, size * size).reshape(size, size))
    models = candidates(train, columns, r, regimes, depth)
    found = log_likelihoods(df.filter(F.col(held)), columns, models)
    return sorted(found.items(), key=lambda x: (-round(x[1], 9), x[0])), models
