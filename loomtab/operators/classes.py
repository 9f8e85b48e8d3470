"""Compact programs with a class for a target: fit, probabilities, samples and retention.

Features are those of a program; the target is a softmax of linear logits of
their normal scores, fitted by multiclass gradient steps whose sums are made
where the rows are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtab.functions import normal
from loomtab.operators import program
from loomtab.operators.reducers import retention
from loomtab.operators.splits import fold_of


@dataclass
class ClassProgram:
    target: str
    body: program.Program  # features and their dependence; its target is the place of the class
    labels: list[str]
    weights: list[list[float]]  # a row for each class: intercept and scores
    temperature: float

    def probabilities(self, pdf: pd.DataFrame) -> np.ndarray:
        z = self.body.design(pdf) @ np.array(self.weights).T / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def sums_of(df: DataFrame, make, size: int) -> np.ndarray:
    """The sum over all rows' batches of make(rows), an array of a fixed size, added up on the executors."""

    def run(frames):
        total = np.zeros(size)
        for pdf in frames:
            if len(pdf):
                total += make(pdf)
        yield pd.DataFrame({"at": np.arange(size), "value": total})

    out = np.zeros(size)
    for r in df.mapInPandas(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def fit(df: DataFrame, target: str, numbers: list[str], categories: list[str], rounds: int = 12, penalty: float = 1e-3, most: int = 256) -> ClassProgram:
    """The program of df's features and class; rows without a class are left out, and more than most classes are refused.

    Each round is one aggregation of gradients and of the bound of the curvature
    of a softmax, half the sums of products, which needs no step length.
    """
    df = df.select(F.col(target).cast("string").alias(target), *numbers, *categories).filter(F.col(target).isNotNull())
    labels = [r[target] for r in df.select(target).distinct().orderBy(target).limit(most + 1).collect()]
    if len(labels) > most:
        raise ValueError(f"a target of more than {most} classes")
    at = {c: k for k, c in enumerate(labels)}
    places = F.create_map(*(F.lit(x) for c, k in at.items() for x in (c, float(k)))) if labels else F.lit(None)
    coded = df.withColumn(target, F.element_at(places, F.col(target)) if labels else F.lit(None).cast("double"))
    body = program.fit(coded, target, numbers, categories)
    found = ClassProgram(target, body, labels, [[0.0] * (1 + len(body.features)) for _ in labels], 1.0)
    k, p = len(labels), 1 + len(body.features)
    if k < 2:
        return found

    def gradient(pdf: pd.DataFrame) -> np.ndarray:
        x, y = body.design(pdf), pdf[target].map(at).to_numpy()
        miss = np.eye(k)[y] - found.probabilities(pdf)
        return np.concatenate(((miss.T @ x).ravel(), (x.T @ x).ravel(), [len(x)]))

    for _ in range(rounds):
        s = sums_of(df, gradient, k * p + p * p + 1)
        g, h, n = s[: k * p].reshape(k, p), s[k * p : -1].reshape(p, p), s[-1]
        w = np.array(found.weights)
        pull = penalty * n * np.eye(p)
        pull[0, 0] = 1e-9 * n
        found.weights = (w + np.linalg.solve(h / 2 + pull, (g - w @ pull).T).T).round(6).tolist()
    grid = np.array([0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0])

    def losses(pdf: pd.DataFrame) -> np.ndarray:
        y = pdf[target].map(at).to_numpy()
        return np.array([-np.log(np.maximum(ClassProgram(target, body, labels, found.weights, float(t)).probabilities(pdf)[np.arange(len(y)), y], 1e-7)).sum() for t in grid])

    found.temperature = float(grid[int(np.argmin(sums_of(df, losses, len(grid))))])
    return found


def predict(df: DataFrame, fitted: ClassProgram, name: str = "probabilities") -> DataFrame:
    """df with the probabilities of the program's classes, in the order of its labels."""
    out = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(frames):
        for pdf in frames:
            yield pdf.assign(**{name: list(fitted.probabilities(pdf))})

    return df.mapInPandas(run, out)


def sample(spark: SparkSession, fitted: ClassProgram, rows: int, seed: int = 0) -> DataFrame:
    """row_id, features and class of generated rows; a class is the greatest of the logits and Gumbel noise, all by seed and row_id."""
    made = program.sample(spark, fitted.body, rows, seed)
    out = T.StructType([T.StructField(fitted.target, T.StringType()) if f.name == fitted.target else f for f in made.schema.fields])

    def run(frames):
        for pdf in frames:
            p = fitted.probabilities(pdf)
            u = np.column_stack([normal.uniform(seed, 2001 + j, pdf["row_id"].to_numpy()) for j in range(len(fitted.labels))])
            drawn = np.argmax(np.log(np.maximum(p, 1e-300)) - np.log(-np.log(u)), axis=1)
            yield pdf.assign(**{fitted.target: np.array(fitted.labels, dtype=object)[drawn]})

    return made.mapInPandas(run, out)


def class_retention(spark: SparkSession, df: DataFrame, key: str, target: str, numbers: list[str], categories: list[str], rows: int = 20_000, seed: int = 0) -> DataFrame:
    """Cross entropies on a fifth of the rows held out by hash: of the class prior, of a model of the real rows and of one of generated rows."""
    dealt = df.select(key, F.col(target).cast("string").alias(target), *numbers, *categories).filter(F.col(target).isNotNull()).withColumn("__held", fold_of(F.col(key), 5) == 0)
    train, held = dealt.filter("not __held"), dealt.filter("__held")
    real = fit(train, target, numbers, categories)
    made = fit(sample(spark, real, rows, seed), target, numbers, categories)
    counts = {r[target]: r["count"] for r in train.groupBy(target).count().collect()}  # a row for each class
    total = sum(counts.values()) + 0.5 * len(counts)
    prior = {c: (n + 0.5) / total for c, n in counts.items()}

    def loss(probability):
        return -F.ln(F.greatest(F.lit(1e-7), F.coalesce(probability, F.lit(1e-7))))

    def own(name: str, labels: list[str]):
        place = F.array_position(F.array(*map(F.lit, labels)), F.col(target)).cast("int")
        return loss(F.get(F.col(name), place - 1))

    both = predict(predict(held, real, "__real"), made, "__made")
    known = F.element_at(F.create_map(*(F.lit(x) for pair in prior.items() for x in pair)), F.col(target))
    losses = both.agg(F.avg(loss(known)).alias("null_loss"), F.avg(own("__real", real.labels)).alias("real_loss"), F.avg(own("__made", made.labels)).alias("synthetic_loss"))
    return losses.withColumn("retention", retention(F.col("null_loss"), F.col("real_loss"), F.col("synthetic_loss")))
