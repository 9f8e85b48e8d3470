"""Compact programs of a table: fit, account for bytes, sample, predict and audit.

A program holds, for each feature, its scale, its missing share and its
marginal (knots of a number, levels of a category); the correlation of the
features' normal scores; a linear target model and its residuals' quantiles. It
holds no rows. Fitting is aggregations: percentiles and level counts, then two
sums of outer products, made where the rows are. The driver gets matrices whose
size is the square of the number of columns.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtab.functions import normal
from loomtab.operators.columns import ordered_levels
from loomtab.operators.reducers import retention as retained
from loomtab.operators.ranks import bracketed, quantiles

GRID = np.linspace(-3, 3, 17)
RESIDUAL_KNOTS = np.linspace(0.02, 0.98, 9)


@dataclass
class Feature:
    name: str
    kind: str  # number or category
    missing: float
    knots: list  # of a number at the grid's probabilities
    levels: list  # of a category, in the order of their codes
    cumulative: list  # shares of the levels so far

    def grid(self) -> np.ndarray:
        """The normal quantiles that the knots stand at."""
        return np.linspace(-3, 3, len(self.knots))

    def scores(self, values: pd.Series) -> np.ndarray:
        """Normal scores, 0 where a value is missing or unknown."""
        if self.kind == "number":
            x = values.to_numpy(dtype=float, na_value=np.nan)
            z = np.interp(x, np.maximum.accumulate(np.array(self.knots)) + np.arange(len(self.knots)) * 1e-12, self.grid())
        else:
            middle = dict(zip(self.levels, (np.array([0, *self.cumulative[:-1]]) + np.array(self.cumulative)) / 2, strict=True))
            z = normal.ppf(values.map(middle).fillna(0.5).to_numpy(dtype=float))
        return np.where(pd.isna(values), 0.0, np.nan_to_num(z))

    def values(self, z: np.ndarray):
        if self.kind == "number":
            return np.interp(z, self.grid(), self.knots)
        at = np.minimum(np.searchsorted(np.array(self.cumulative), normal.cdf(z)), len(self.levels) - 1)
        return np.array(self.levels, dtype=object)[at]


@dataclass
class Program:
    target: str
    features: list
    mixing: list  # lower triangle of the scores' correlation
    weights: list  # of an intercept and the scores
    residuals: list  # quantiles at RESIDUAL_KNOTS
    low: float
    high: float

    def encode(self) -> bytes:
        return zlib.compress(json.dumps(asdict(self), separators=(",", ":")).encode(), 9)

    @staticmethod
    def decode(data: bytes) -> Program:
        held = json.loads(zlib.decompress(data))
        return Program(**held | {"features": [Feature(**f) for f in held["features"]]})

    def design(self, pdf: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.ones(len(pdf)), *(f.scores(pdf[f.name]) for f in self.features)])


def outer_sums(df: DataFrame, make, size: int) -> np.ndarray:
    """The sum over all rows of make(rows)' make(rows), added up on the executors."""

    def run(frames):
        total = np.zeros((size, size))
        for pdf in frames:
            if len(pdf):
                x = make(pdf)
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(size * size), "value": total.ravel()})

    rows = df.mapInPandas(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    found = np.zeros(size * size)
    for r in rows:
        found[r["at"]] = r["value"]
    return found.reshape(size, size)


def fit(df: DataFrame, target: str, numbers: list[str], categories: list[str], shrink: float = 0.04, ridge: float = 1e-3) -> Program:
    """The program of df's features and numeric target; rows without a target are left out."""
    df = df.select(target, *numbers, *categories).filter(F.col(target).isNotNull())
    knots = {c: q for c, (_, q) in bracketed(df, {c: F.col(c) for c in numbers}, normal.cdf(GRID).tolist())[0].items()}
    summary = df.agg(
        F.count("*").alias("n"), F.min(F.col(target).cast("double")).alias("low"), F.max(F.col(target).cast("double")).alias("high"),
        *(F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in [*numbers, *categories]),
    ).first()
    n = max(summary["n"], 1)
    features = [Feature(c, "number", summary[f"m_{c}"] / n, [round(x, 6) for x in knots.get(c) or [0.0] * len(GRID)], [], []) for c in numbers]
    for c in categories:
        levels = ordered_levels(df.filter(F.col(c).isNotNull()), c, F.col(target).cast("double")).orderBy("code").collect()
        counts = np.array([r["n"] for r in levels], float)
        features.append(Feature(c, "category", summary[f"m_{c}"] / n, [], [r["level"] for r in levels], (np.cumsum(counts) / max(counts.sum(), 1)).round(8).tolist()))
    program = Program(target, features, [], [], [], float(summary["low"] or 0), float(summary["high"] or 0))

    def joined(pdf: pd.DataFrame) -> np.ndarray:
        return np.column_stack([program.design(pdf), pdf[target].astype(float)])

    size = len(features) + 2
    g = outer_sums(df, joined, size)
    sd = np.sqrt(np.maximum(np.diag(g)[1:-1] / n, 1e-12))
    r = (1 - shrink) * g[1:-1, 1:-1] / n / np.outer(sd, sd)
    np.fill_diagonal(r, 1.0)
    values, vectors = np.linalg.eigh(r)
    near = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    near /= np.sqrt(np.outer(np.diag(near), np.diag(near)))
    lower = np.linalg.cholesky(near)
    program.mixing = [[round(float(x), 5) for x in row[: k + 1]] for k, row in enumerate(lower)]
    penalty = np.eye(size - 1) * ridge * n
    penalty[0, 0] = 0
    program.weights = [round(float(x), 6) for x in np.linalg.lstsq(g[:-1, :-1] + penalty, g[:-1, -1], rcond=None)[0]]
    fitted = predict(df, program, "__y").select((F.col(target).cast("double") - F.col("__y")).alias("e"))
    found = quantiles(fitted.select(F.col("e").alias("value")), [], "value", RESIDUAL_KNOTS.tolist()).first()
    program.residuals = [round(x, 6) for x in (found["q"] if found else None) or [0.0] * 9]
    return program


def predict(df: DataFrame, program: Program, name: str = "prediction") -> DataFrame:
    """df with the program's expected target."""
    out = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(frames):
        for pdf in frames:
            yield pdf.assign(**{name: program.design(pdf) @ np.array(program.weights)})

    return df.mapInPandas(run, out)


def sample(spark: SparkSession, program: Program, rows: int, seed: int = 0) -> DataFrame:
    """row_id, features and target of generated rows, each a function of seed and row_id alone."""
    kinds = [T.StructField(f.name, T.DoubleType() if f.kind == "number" else T.StringType()) for f in program.features]
    out = T.StructType([T.StructField("row_id", T.LongType()), *kinds, T.StructField(program.target, T.DoubleType())])

    def run(frames):
        k = len(program.features)
        mixing = np.array([[*row, *[0.0] * (k - len(row))] for row in program.mixing]).reshape(k, k)
        for pdf in frames:
            row = pdf["row_id"].to_numpy()
            z = np.column_stack([normal.normal(seed, 1 + j, row) for j in range(k)]) @ mixing.T
            made, scores = {"row_id": row}, [np.ones(len(row))]
            for j, f in enumerate(program.features):
                gone = normal.uniform(seed, 1001 + j, row) < f.missing
                value = pd.Series(f.values(z[:, j]))
                made[f.name] = value.mask(gone, np.nan if f.kind == "number" else None)
                scores.append(f.scores(made[f.name]))
            noise = np.interp(normal.uniform(seed, 0, row), RESIDUAL_KNOTS, program.residuals)
            made[program.target] = np.clip(np.column_stack(scores) @ np.array(program.weights) + noise, program.low, program.high)
            yield pd.DataFrame(made)

    return spark.range(rows).withColumnRenamed("id", "row_id").mapInPandas(run, out)


def retention(spark: SparkSession, df: DataFrame, key: str, target: str, numbers: list[str], categories: list[str], rows: int = 50_000, seed: int = 0) -> DataFrame:
    """Losses on a fifth of the rows held out by hash: of the mean, of a model of the real rows and of one of generated rows."""
    from loomtab.operators.splits import fold_of

    dealt = df.select(key, target, *numbers, *categories).withColumn("__held", fold_of(F.col(key), 5) == 0)
    train, held = dealt.filter("not __held"), dealt.filter("__held")
    real = fit(train, target, numbers, categories)
    made = fit(sample(spark, real, rows, seed), target, numbers, categories)
    mean = train.agg(F.avg(target)).first()[0]
    both = predict(predict(held, real, "__real"), made, "__made")
    y = F.col(target).cast("double")
    losses = both.agg(F.avg(F.pow(y - F.lit(mean), 2)).alias("null_loss"), F.avg(F.pow(y - F.col("__real"), 2)).alias("real_loss"), F.avg(F.pow(y - F.col("__made"), 2)).alias("synthetic_loss"))
    return losses.select("*", retained(F.col("null_loss"), F.col("real_loss"), F.col("synthetic_loss")).alias("retention"), F.lit(len(real.encode())).alias("program_bytes"))
