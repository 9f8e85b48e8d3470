"""Programs under a budget of bytes: marginals, dependence, a linear and a boosted target model, and noise, put together to fit.

Every component is fitted once, whatever the number of budgets: marginals at the
finest knots (coarser ones are every second knot), all dependence candidates
with their held-out likelihoods, a linear model and trees for each width of a
ladder, with their held-out losses after each tree. A budget then chooses among
them by measured bytes: dependence may take a share, the target model is grown
into the rest, and what is left buys better dependence. One candidate a share
is audited: models fitted to its rows are compared with models of the real rows
on rows that neither saw, and the best retention wins.

Rows are scored once and written; fits are aggregations over them.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtab.functions import normal
from loomtab.operators import dependence, gradient
from loomtab.operators.boosting import LOG_ABS_NORMAL
from loomtab.operators.columns import ordered_levels
from loomtab.operators.dependence import array_sums
from loomtab.operators.program import Feature
from loomtab.operators.ranks import bracketed
from loomtab.session import staged

#: Knots of the finest marginals; coarser ones have every second, fourth or eighth of them.
FINEST = 33
STEPS = (1, 2, 4, 8)
#: The parts of a budget that dependence may take.
SHARES = (0.0, 0.15, 0.35)
#: Trees at most, and rows of a program that an audit fits its models to.
MOST_TREES, AUDITED_ROWS = 12, 20_000
AUDIT_TREES = 6
#: Share of the rows that fits don't see.
HELD_PER_CENT = 15
#: A richer plan has to lower the held-out loss by this part of the null loss.
WORTH = 0.005
RESIDUAL_GRID = np.linspace(-3, 3, 9)
TEMPERATURES = [0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0]
MOST_CLASSES = 32


def short(x, digits: int = 4):
    """Numbers at so many significant digits, whole ones without a point, as they are stored."""
    if isinstance(x, dict):
        return {k: short(v, digits) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [short(v, digits) for v in x]
    if isinstance(x, float):
        y = float(f"{x:.{digits}g}")
        return int(y) if y == int(y) and abs(y) < 1e15 else y
    return x


@dataclass
class Compiled:
    target: str
    labels: list  # of a class target, else empty
    features: list
    model: dict  # dependence
    chosen: list  # features in the linear model
    weights: list  # a row an output: intercept and chosen scores
    trees: dict = field(default_factory=dict)
    low: float = 0.0
    high: float = 0.0
    noise: dict = field(default_factory=dict)  # of a number: coefficients, inputs, lo, hi, knots
    temperature: float = 1.0

    def encode(self) -> bytes:
        return zlib.compress(json.dumps(short(asdict(self)), separators=(",", ":"), ensure_ascii=False).encode(), 9)

    @staticmethod
    def decode(data: bytes) -> Compiled:
        held = json.loads(zlib.decompress(data))
        return Compiled(**held | {"features": [Feature(**f) for f in held["features"]]})

    def scores(self, pdf: pd.DataFrame) -> np.ndarray:
        return np.column_stack([f.scores(pdf[f.name]) for f in self.features]) if self.features else np.zeros((len(pdf), 0))

    def margins(self, z: np.ndarray) -> np.ndarray:
        """A column an output, from scores."""
        x = np.column_stack([np.ones(len(z)), z[:, self.chosen]])
        out = x @ np.array(self.weights, float).T
        if self.trees.get("leaves"):
            names = [str(k) for k in range(z.shape[1])]
            out = out + forest_of(self.trees).of_codes(codes_of(z), names)
        return out

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        m = self.margins(z) / self.temperature
        if m.shape[1] == 1:
            p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
            return np.column_stack([1 - p, p])
        e = np.exp(m - m.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def spread(self, z: np.ndarray) -> np.ndarray:
        c = self.noise["coefficients"]
        return np.clip(np.exp(c[0] + z[:, self.noise["inputs"]] @ np.array(c[1:], float)), self.noise["lo"], self.noise["hi"])

    def rows(self, row: np.ndarray, seed: int) -> dict:
        """Features and target of generated rows, each a function of seed and its number alone."""
        d = len(self.features)
        model = dependence.from_dict(self.model)
        width = model.width()
        z = model.draw(np.column_stack([normal.normal(seed, 1 + j, row) for j in range(width)])) if d else np.zeros((len(row), 0))
        made = {}
        for j, f in enumerate(self.features):
            gone = normal.uniform(seed, 5001 + j, row) < f.missing
            made[f.name] = pd.Series(f.values(z[:, j])).mask(gone, np.nan if f.kind == "number" else None)
        scores = self.scores(pd.DataFrame(made, index=range(len(row))))
        u = normal.uniform(seed, 0, row)
        if self.labels:
            p = np.cumsum(self.probabilities(scores), axis=1)
            made[self.target] = np.array(self.labels, dtype=object)[np.minimum((u[:, None] > p).sum(1), len(self.labels) - 1)]
        else:
            e = np.interp(u, normal.cdf(RESIDUAL_GRID), self.noise["knots"]) * self.spread(scores)
            made[self.target] = np.clip(self.margins(scores)[:, 0] + e, self.low, self.high)
        return made


def codes_of(z: np.ndarray) -> np.ndarray:
    return np.floor(255 * np.clip((z + 3) / 6, 0, 1) + 0.5).astype(int)


def forest_of(held: dict) -> gradient.Trees:
    return gradient.Trees(held["outputs"], held["depth"], held["base"], [str(f) for f in held["features"]], held["thresholds"], held["leaves"])


def predict(df: DataFrame, fitted: Compiled, name: str = "prediction") -> DataFrame:
    """df with the expected target, or the list of the classes' probabilities in the order of the labels."""
    kind = T.ArrayType(T.DoubleType()) if fitted.labels else T.DoubleType()

    def run(frames):
        for pdf in frames:
            z = fitted.scores(pdf)
            yield pdf.assign(**{name: list(fitted.probabilities(z)) if fitted.labels else fitted.margins(z)[:, 0]})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def sample(spark: SparkSession, fitted: Compiled, rows: int, seed: int = 0) -> DataFrame:
    """row_id, features and target of so many generated rows."""
    kinds = [T.StructField(f.name, T.DoubleType() if f.kind == "number" else T.StringType()) for f in fitted.features]
    out = T.StructType([T.StructField("row_id", T.LongType()), *kinds, T.StructField(fitted.target, T.StringType() if fitted.labels else T.DoubleType())])

    def run(frames):
        for pdf in frames:
            row = pdf["row_id"].to_numpy()
            yield pd.DataFrame({"row_id": row, **fitted.rows(row, seed)})

    return spark.range(rows).withColumnRenamed("id", "row_id").mapInPandas(run, out)


class Parts:
    """All components of a table's programs, each fitted when it is first asked for, and kept."""

    def __init__(self, df: DataFrame, target: str, numbers: list[str], categories: list[str], classes: bool = False, seed: int = 0):
        """Rows without a target are left out; a class target may have MOST_CLASSES classes, more are refused."""
        self.spark, self.target, self.seed, self.names = df.sparkSession, target, seed, [*numbers, *categories]
        df = df.select(F.col(target).cast("string" if classes else "double").alias(target), *self.names).filter(F.col(target).isNotNull())
        if not classes:
            df = df.filter(~F.isnan(target))
        self.labels: list[str] = []
        if classes:
            self.labels = [r[target] for r in df.select(target).distinct().orderBy(target).limit(MOST_CLASSES + 1).collect()]
            if len(self.labels) > MOST_CLASSES:
                raise ValueError(f"a target of more than {MOST_CLASSES} classes")
        ends = [] if classes else [F.min(target).alias("low"), F.max(target).alias("high")]
        lost = [F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in self.names]
        found, more = bracketed(df, {c: F.col(c) for c in numbers}, normal.cdf(np.linspace(-3, 3, FINEST)).tolist(), [F.count("*").alias("n"), *ends, *lost])
        n = max(more["n"], 1)
        self.n, self.low, self.high = more["n"], float(more.get("low") or 0.0), float(more.get("high") or 0.0)
        self.features = [Feature(c, "number", more[f"m_{c}"] / n, found[c][1] or [0.0] * FINEST, [], []) for c in numbers]
        y = F.when(F.col(target) == self.labels[0], 1.0).otherwise(0.0) if self.labels else F.col(target) if not classes else F.lit(0.0)
        for c in categories:
            levels = ordered_levels(df.filter(F.col(c).isNotNull()), c, y).orderBy("code").collect()
            counts = np.array([r["n"] for r in levels], float)
            self.features.append(Feature(c, "category", more[f"m_{c}"] / n, [], [r["level"] for r in levels], (np.cumsum(counts) / max(counts.sum(), 1)).round(6).tolist()))
        self.classes = len(self.labels)
        self.outputs = self.classes if self.classes > 2 else 1
        self.z = [f"z{j}" for j in range(len(self.features))]
        held = F.pmod(F.xxhash64(F.lit(seed), target, *self.names), F.lit(100)) < HELD_PER_CENT
        # Dealt anew: files as few as the table's would leave cores idle in all passes to come.
        self.rows = staged(self.scored(df.withColumn("__held", held).repartition(F.xxhash64(target, *self.names))), "scored")
        self.train, self.held = self.rows.filter("not held"), self.rows.filter("held")
        self.made: dict = {}
        self.fits = 0  # components fitted so far

    def scored(self, df: DataFrame) -> DataFrame:
        """The scores of all features, y as a number and held, if df has it."""
        names, score = self.z, self.scorer()

        def run(frames):
            for pdf in frames:
                yield score(pdf)

        return df.mapInPandas(run, ", ".join([*(f"{n} double" for n in names), "y double", "held boolean"]))

    def scorer(self):
        """The function that scores a batch of rows; it holds no session."""
        features, names, target = self.features, self.z, self.target
        at = {c: float(k) for k, c in enumerate(self.labels)}

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            out = {n: f.scores(pdf[f.name]) for n, f in zip(names, features, strict=True)}
            out["y"] = pdf[target].map(at) if at else pdf[target]
            return pd.DataFrame({**out, "held": pdf["__held"] if "__held" in pdf else False}, index=pdf.index)

        return score

    def total(self):
        """The function that adds up make(scores, y), an array of a size, over the rows to fit."""
        train, names = self.train, self.z
        return lambda make, size: summed(train, lambda pdf: make(dependence.scores_of(pdf, names), pdf["y"].to_numpy(dtype=float)), size)

    def once(self, key, make):
        if key not in self.made:
            self.made[key] = make()
            self.fits += 1
        return self.made[key]

    def sums(self) -> np.ndarray:
        """Sums of outer products of (1, scores, outputs' targets) over the rows to fit."""

        def make():
            names, classes, k = self.z, self.classes, 1 + len(self.z) + self.outputs

            def products(pdf: pd.DataFrame) -> np.ndarray:
                x = np.column_stack([np.ones(len(pdf)), dependence.scores_of(pdf, names), targets_of(pdf["y"].to_numpy(), classes)])
                return (x.T @ x).ravel()

            return summed(self.train, products, k * k).reshape(k, k)

        return self.once("sums", make)

    def order(self) -> list[int]:
        """Features by their greatest correlation with an output's target."""
        g, d = self.sums(), len(self.z)
        r = np.abs(dependence.correlation_of(g, 0.0)[:d, d:]).max(1) if d else np.zeros(0)
        return sorted(range(d), key=lambda j: (-round(float(r[j]), 9), j))

    def models(self) -> tuple[list[tuple[str, float]], dict]:
        """Dependence candidates by held-out likelihood, and themselves."""

        def make():
            d = len(self.z)
            r = dependence.correlation_of(self.sums()[: d + 1, : d + 1])
            found = dependence.candidates(self.train, self.z, r)
            likely = dependence.log_likelihoods(self.held, self.z, found)
            return sorted(likely.items(), key=lambda x: (-round(x[1], 6), x[0])), found

        return self.once("models", make)

    def linear(self, s: int) -> tuple[list[int], list[list[float]]]:
        """The s strongest features and the outputs' weights."""

        def make():
            chosen = self.order()[:s]
            at = [0, *(1 + j for j in chosen)]
            g = self.sums()
            n = max(g[0, 0], 1.0)
            pull = 1e-3 * n * np.eye(len(at))
            pull[0, 0] = 1e-9 * n
            if not self.classes:
                w = np.linalg.solve(g[np.ix_(at, at)] + pull, g[at, -1])
                return chosen, [w.tolist()]
            k, p, names, classes = self.outputs, len(at), self.z, self.classes
            w = np.zeros((k, p))
            bound = g[np.ix_(at, at)] / (4 if k == 1 else 2) + pull
            for _ in range(12):
                now = Compiled(self.target, self.labels, self.features, {}, chosen, w.tolist())

                def gradients(pdf: pd.DataFrame, now=now) -> np.ndarray:
                    z = dependence.scores_of(pdf, names)
                    q = now.probabilities(z)
                    miss = targets_of(pdf["y"].to_numpy(), classes) - (q[:, 1:] if k == 1 else q)
                    return (miss.T @ np.column_stack([np.ones(len(z)), z[:, chosen]])).ravel()

                step = np.linalg.solve(bound, (summed(self.train, gradients, k * p).reshape(k, p) - w @ pull).T).T
                w = w + step
                if np.abs(step).max() < 1e-3:
                    break
            return chosen, w.tolist()

        return self.once(("linear", s), make)

    def trees(self, s: int) -> gradient.Trees:
        """Trees on what the linear model of s features leaves; those of all widths grow side by side."""

        def make():
            widths = sorted({s for _, s in plans(len(self.z))})
            starts = [linear_margins(*self.linear(width)) for width in widths]
            names = [str(j) for j in range(len(self.z))]
            return dict(zip(widths, gradient.boost_arrays(self.total(), names, codes_of, starts, self.classes, MOST_TREES, 2), strict=True))

        if not self.z:
            return gradient.Trees(self.outputs, 2, [0.0] * self.outputs)
        return self.once("trees", make)[s]

    def losses(self, s: int) -> list[float]:
        """The held-out loss with the linear model of s features and 0, 1, 2, ... trees; the last entry is the null model's."""

        def make():
            trees = self.trees(s)
            steps = [self.program(s, t) for t in range(len(trees.leaves) + 1)]
            null, names, classes = self.null(), self.z, self.classes

            def totals(pdf: pd.DataFrame) -> np.ndarray:
                z, y = dependence.scores_of(pdf, names), pdf["y"].to_numpy()
                own = [loss_of(p, z, y) for p in steps]
                return np.array([*(x.sum() for x in own), null_loss(null, y, classes).sum(), len(y)])

            found = array_sums(self.held, totals, len(steps) + 2)
            return (found[:-1] / max(found[-1], 1.0)).tolist()

        return self.once(("losses", s), make)

    def null(self) -> list[float]:
        """The mean, or the classes' shares with half a row more each."""
        g = self.sums()
        n = g[0, 0]
        if not self.classes:
            return [float(g[0, -1] / max(n, 1.0))]
        hits = g[0, -self.outputs :] if self.outputs > 1 else np.array([n - g[0, -1], g[0, -1]])
        return ((hits + 0.5) / (hits.sum() + 0.5 * len(hits))).tolist()

    def program(self, s: int, t: int, step: int = 1, model: str = "independent") -> Compiled:
        """The program of these components, without noise and temperature."""
        chosen, weights = self.linear(s)
        features = [Feature(f.name, f.kind, f.missing, f.knots[::step], f.levels, f.cumulative) for f in self.features]
        held = {}
        if t:
            cut = self.trees(s).cut(t)
            held = {"outputs": cut.outputs, "depth": cut.depth, "base": cut.base, "features": [int(f) for f in cut.features], "thresholds": cut.thresholds, "leaves": cut.leaves}
        made = self.models()[1] if model != "independent" else {}
        own = made.get(model) or dependence.Gaussian("independent", len(self.z))
        return Compiled(self.target, self.labels, features, asdict(own), chosen, weights, held, self.low, self.high, placeholder(self.classes, len(chosen)))

    def finished(self, s: int, t: int, step: int, model: str) -> Compiled:
        """The program with its noise, or its temperature, both measured."""
        out = self.program(s, t, step, model)
        if self.classes:
            grid, names, base = TEMPERATURES, self.z, self.program(s, t)

            def totals(pdf: pd.DataFrame) -> np.ndarray:
                z, y = dependence.scores_of(pdf, names), pdf["y"].to_numpy()
                return np.array([loss_of(Compiled(**{**vars(base), "temperature": x}), z, y).sum() for x in grid])

            out.temperature = grid[int(np.argmin(self.once(("temperature", s, t), lambda: array_sums(self.held, totals, len(grid)))))]
        else:
            out.noise = self.once(("noise", s, t), lambda: self.noise(s, t))
        return out

    def noise(self, s: int, t: int) -> dict:
        """sigma(x) = exp(linear form of up to four scores) within a fifth of and four times the deviation, and nine quantiles of residual / sigma."""
        base, inputs, names = self.program(s, t), self.linear(s)[0][:4], self.z

        def residual(frames):
            for pdf in frames:
                z = dependence.scores_of(pdf, names)
                yield pd.DataFrame({"e": pdf["y"].to_numpy() - base.margins(z)[:, 0], **{f"x{k}": z[:, j] for k, j in enumerate(inputs)}})

        rows = staged(self.train.mapInPandas(residual, ", ".join(["e double", *(f"x{k} double" for k in range(len(inputs)))])), "residuals")
        n, square = rows.agg(F.count("*"), F.avg(F.col("e") * F.col("e"))).first()
        sd = max(float(square or 0.0) ** 0.5, 1e-9)
        p = 1 + len(inputs)
        c = np.array([np.log(sd)] + [0.0] * (p - 1))
        if n >= 20 * p:

            def products(pdf: pd.DataFrame) -> np.ndarray:
                x = np.column_stack([np.ones(len(pdf)), *(pdf[f"x{k}"] for k in range(len(inputs))), np.log(np.maximum(np.abs(pdf["e"]), 1e-6 * sd)) - LOG_ABS_NORMAL])
                return (x.T @ x).ravel()

            m = array_sums(rows, products, (p + 1) ** 2).reshape(p + 1, p + 1)
            pull = 1e-2 * n * np.eye(p)
            pull[0, 0] = 0.0
            c = np.linalg.solve(m[:-1, :-1] + pull, m[:-1, -1])
        form = F.lit(float(c[0]))
        for k in range(len(inputs)):
            form = form + F.lit(float(c[1 + k])) * F.col(f"x{k}")
        sigma = F.greatest(F.lit(0.2 * sd), F.least(F.lit(4.0 * sd), F.exp(form)))
        found, more = bracketed(rows, {"e": F.col("e") / sigma}, normal.cdf(RESIDUAL_GRID).tolist(), [F.avg(F.pow(F.col("e") / sigma, 2)).alias("v")])
        scale = max(float(more["v"] or 1.0) ** 0.5, 1e-9)
        c[0] += np.log(scale)
        return {"coefficients": c.tolist(), "inputs": list(inputs), "lo": 0.2 * sd, "hi": 4.0 * sd, "knots": [q / scale for q in found["e"][1] or [0.0] * 9]}

    # --- Audit.

    def audit(self, fitted: Compiled) -> float | None:
        """The least retention over the informative auditing models, null if none is."""

        def make():
            own = Compiled.decode(fitted.encode())
            # The rows that sample gives; they are few whatever the table, so models are fitted to them here.
            made = self.scorer()(pd.DataFrame(own.rows(np.arange(AUDITED_ROWS), self.seed)))
            synthetic, real = audit_losses(self, made), self.once("real audit", lambda: audit_losses(self, self.train))
            null = self.losses(0)[-1]
            kept = [(null - synthetic[k]) / (null - real[k]) for k in real if null - real[k] > 0 and null - real[k] >= 0.01 * abs(null)]
            return min(kept) if kept else None

        return self.once(("audit", fitted.encode()), make)


def summed(rows: DataFrame | pd.DataFrame, make, size: int) -> np.ndarray:
    """array_sums of a table, or of bounded rows in memory."""
    if isinstance(rows, pd.DataFrame):
        return np.asarray(make(rows), float) if len(rows) else np.zeros(size)
    return array_sums(rows, make, size)


def linear_margins(chosen: list[int], weights: list[list[float]]):
    """The margins of a linear model, a function of scores."""
    return lambda z: np.column_stack([np.ones(len(z)), z[:, chosen]]) @ np.array(weights, float).T


def targets_of(y: np.ndarray, classes: int) -> np.ndarray:
    """A column an output: the number, whether it is the second of two classes, or a flag for each class."""
    return (y[:, None] == np.arange(classes)).astype(float) if classes > 2 else y[:, None]


def placeholder(classes: int, inputs: int) -> dict:
    """Noise of the usual length, for programs whose size alone is asked."""
    if classes:
        return {}
    k = min(inputs, 4)
    return {"coefficients": [-1.2345678] * (1 + k), "inputs": list(range(k)), "lo": 1.2345678, "hi": 1.2345678, "knots": [-1.2345678 - 0.0123 * q for q in range(9)]}


def loss_of(program: Compiled, z: np.ndarray, y: np.ndarray) -> np.ndarray:
    if not program.labels:
        return (program.margins(z)[:, 0] - y) ** 2
    return -np.log(np.maximum(program.probabilities(z)[np.arange(len(y)), y.astype(int)], 1e-7))


def null_loss(null: list[float], y: np.ndarray, classes: int) -> np.ndarray:
    return -np.log(np.maximum(np.array(null)[y.astype(int)], 1e-7)) if classes else (y - null[0]) ** 2


def audit_losses(parts: Parts, rows: DataFrame | pd.DataFrame) -> dict[str, float]:
    """The loss on the held-out rows of a linear and of a boosted model fitted to rows, scored ones of a table or in memory."""
    own = Parts.__new__(Parts)
    own.__dict__ = {**parts.__dict__, "rows": rows, "train": rows, "made": {}}
    d = len(parts.z)
    chosen, weights = own.linear(d)
    models = {"linear": Compiled(parts.target, parts.labels, parts.features, {}, chosen, weights)}
    if d:
        trees = gradient.boost_arrays(own.total(), [str(j) for j in range(d)], codes_of, [None], parts.classes, AUDIT_TREES, 2, eta=0.6)[0]
        held = {"outputs": trees.outputs, "depth": trees.depth, "base": trees.base, "features": [int(f) for f in trees.features], "thresholds": trees.thresholds, "leaves": trees.leaves}
        base = [[b] for b in trees.base]
        models["boosted"] = Compiled(parts.target, parts.labels, parts.features, {}, [], base, {**held, "base": [0.0] * trees.outputs})

    columns = parts.z

    def totals(pdf: pd.DataFrame) -> np.ndarray:
        z, y = dependence.scores_of(pdf, columns), pdf["y"].to_numpy()
        return np.array([*(loss_of(m, z, y).sum() for m in models.values()), len(y)])

    found = array_sums(parts.held, totals, len(models) + 1)
    return {k: float(found[i] / max(found[-1], 1.0)) for i, k in enumerate(models)}


# --- Budgets.


def plans(d: int) -> list[tuple[int, int]]:
    """Steps between knots and numbers of features in the linear model, richest first."""
    half = -(-d // 2)
    ladder = [(1, d), (2, d), (2, half), (4, d), (4, half), (4, 1), (8, half), (8, 1), (8, 0)]
    return [p for k, p in enumerate(ladder) if p not in ladder[:k]]


def allocated(parts: Parts, budget: int, share: float) -> tuple[int, int, int, str] | None:
    """features, trees, step and dependence of a program within the budget whose dependence takes its share at most; none if nothing fits."""
    size = lambda *a: len(parts.program(*a).encode())
    ladder = plans(len(parts.z))
    step, s = ladder[-1]
    floor = size(s, 0, step, "independent")
    ranking = [n for n, _ in parts.models()[0]]
    model = next((n for n in ranking if n == "independent" or size(s, 0, step, n) - floor <= share * budget), "independent")
    fitting: list[tuple[float, int, int, int]] = []
    for at, (step, s) in enumerate(ladder):
        if size(s, 0, step, model) > budget:
            continue
        losses, t = parts.losses(s)[:-1], 0
        # Trees as long as they lower the loss and fit.
        for more in range(1, len(losses)):
            if losses[more] < losses[t] and size(s, more, step, model) <= budget:
                t = more
        fitting.append((losses[t], at, s, t))
        if len(fitting) == 3:
            break
    if not fitting:
        return None
    null = parts.losses(0)[-1]
    # The leanest plan, unless a richer one is better by what is worth its bytes.
    best = fitting[-1]
    for plan in reversed(fitting[:-1]):
        if best[0] - plan[0] > WORTH * null:
            best = plan
    _, at, s, t = best
    step = ladder[at][0]
    # What is left buys a likelier dependence, then finer marginals.
    for name in ranking[: ranking.index(model)] if model in ranking else []:
        if size(s, t, step, name) <= budget:
            model = name
            break
    for finer in sorted(x for x in STEPS if x < step):
        if size(s, t, finer, model) <= budget:
            step = finer
            break
    return s, t, step, model


def within(parts: Parts, budget: int) -> list[Compiled]:
    """A finished program for each share, all within the budget."""
    out: list[Compiled] = []
    for share in SHARES:
        plan = allocated(parts, budget, share)
        if plan is None:
            continue
        s, t, step, model = plan
        made = parts.finished(s, t, step, model)
        while len(made.encode()) > budget and t:
            t -= 1
            made = parts.finished(s, t, step, model)
        if len(made.encode()) <= budget and all(made.encode() != x.encode() for x in out):
            out.append(made)
    return out


def fit_levels(df: DataFrame, target: str, numbers: list[str], categories: list[str], budgets: list[int], classes: bool = False, seed: int = 0) -> list[tuple[int, Compiled | None, float | None]]:
    """For each budget, least first, the program of the best audited retention that it allows, and that retention.

    A budget may keep the program of the one before, so retention never falls as
    bytes grow. No program of a budget is larger than it; where nothing fits, or
    the table has no rows with a target, there is none.
    """
    parts = Parts(df, target, numbers, categories, classes, seed)
    out: list[tuple[int, Compiled | None, float | None]] = []
    last: Compiled | None = None
    for budget in sorted(budgets):
        found = within(parts, budget) if parts.n else []
        if last is not None and all(last.encode() != x.encode() for x in found):
            found.append(last)
        # Ties, and tables that no audit is informative about, go to the smaller program.
        judged = [(parts.audit(p), p) for p in found]
        last = max(judged, key=lambda x: (-np.inf if x[0] is None else round(x[0], 9), -len(x[1].encode())))[1] if judged else None
        out.append((budget, last, parts.audit(last) if last is not None else None))
    return out


def fit(df: DataFrame, target: str, numbers: list[str], categories: list[str], budget: int = 4096, classes: bool = False, seed: int = 0) -> Compiled:
    """The program within the budget of the best audited retention."""
    found = fit_levels(df, target, numbers, categories, [budget], classes, seed)[0][1]
    if found is None:
        raise ValueError(f"no program of this table fits {budget} bytes")
    return found
