"""Reducers over cells of an evaluation: retention, roll-ups, contrasts and frontiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def retention(null: Column, real: Column, synthetic: Column) -> Column:
    """(null - synthetic) / (null - real) where the real gain is at least 1 % of the null loss, else null."""
    gain = null - real
    return F.when((gain > 0) & (gain >= 0.01 * F.abs(null)), (null - synthetic) / gain)


def robust_minimum(cells: DataFrame, keys: list[str], family: str, value: str) -> DataFrame:
    """Median of each family over its cells, then the least over families."""
    medians = cells.groupBy(*keys, family).agg(F.median(value).alias("m"))
    return medians.groupBy(*keys).agg(F.min("m").alias("robust"), F.min_by(family, F.struct("m", family)).alias("worst_family"))


def hodges_lehmann(values: DataFrame, column: str, key: str) -> DataFrame:
    """Median of the pairwise means, i <= j, of a small table of contrasts."""
    a, b = values.select(F.col(key).alias("i"), F.col(column).alias("x")), values.select(F.col(key).alias("j"), F.col(column).alias("y"))
    return a.join(F.broadcast(b), F.col("i") <= F.col("j")).agg(F.median((F.col("x") + F.col("y")) / 2).alias("shift"), F.count("*").alias("pairs"))


def win_matrix(cells: DataFrame, block: str, method: str, score: str, margin: float) -> DataFrame:
    """For each two methods that share blocks, wins of the first, a tie within the margin counting half."""
    a = cells.select(block, F.col(method).alias("a"), F.col(score).alias("x"))
    b = cells.select(block, F.col(method).alias("b"), F.col(score).alias("y"))
    won = F.when(F.abs(F.col("x") - F.col("y")) <= margin, 0.5).when(F.col("x") > F.col("y"), 1.0).otherwise(0.0)
    return a.join(b, block).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("games"), F.sum(won).alias("wins_a"))


def elo(spark: SparkSession, wins: DataFrame) -> DataFrame:
    """Ratings by a Bradley-Terry fit with a unit normal prior to a matrix of wins, one row for each two methods."""
    rows = wins.collect()  # a row for each two methods
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {n: k for k, n in enumerate(names)}
    theta = np.zeros(len(names))

    def value(t: np.ndarray) -> float:
        d = np.array([t[at[r["a"]]] - t[at[r["b"]]] for r in rows])
        won, games = (np.array([float(r[c]) for r in rows]) for c in ("wins_a", "games"))
        return float(-(t @ t) / 2 + (won * d - games * np.logaddexp(0, d)).sum()) if rows else 0.0

    for _ in range(60):
        g, h = -theta, -np.eye(len(names))
        for r in rows:
            i, j = at[r["a"]], at[r["b"]]
            p = 1 / (1 + np.exp(np.clip(theta[j] - theta[i], -500, 500)))
            g[i] += r["wins_a"] - r["games"] * p
            g[j] -= r["wins_a"] - r["games"] * p
            w = r["games"] * p * (1 - p)
            h[i, i] -= w
            h[j, j] -= w
            h[i, j] += w
            h[j, i] += w
        step, now = np.linalg.solve(h, g), value(theta)
        # Halved until it gains, so that one-sided panels don't throw the ratings about.
        while value(theta - step) < now and np.abs(step).max() > 1e-12:
            step = step / 2
        theta = theta - step
        if np.abs(step).max() < 1e-12:
            break
    ratings = 1500 + 400 / np.log(10) * (theta - theta.mean())
    return spark.createDataFrame([(n, float(round(x, 6))) for n, x in zip(names, ratings, strict=True)], "method string, rating double")


def first_reaching(cells: DataFrame, task: str, budget: str, value: str, level: float) -> DataFrame:
    """Per task the least budget whose best value so far reaches a level, null if none does."""
    return cells.groupBy(task).agg(F.min(F.when(F.col(value) >= level, F.col(budget))).alias("first_budget"), F.max(value).alias("best"))


def cvar(df: DataFrame, group: str, loss: str, tail: float) -> DataFrame:
    """Mean of the losses at or above each group's quantile of 1 - tail."""
    from loomtab.operators.ranks import null_safe, quantiles

    cut = quantiles(df.select(group, F.col(loss).cast("double").alias("value")), [group], "value", [1 - tail]).select(group, F.col("q")[0].alias("cut"))
    return null_safe(df, cut, [group]).filter(F.col(loss) >= F.col("cut")).groupBy(group).agg(F.avg(loss).alias("cvar"), F.count("*").alias("n_tail"))


def leave_one_out(df: DataFrame, group: str, value: str) -> DataFrame:
    """The mean of value without each group, from the groups' sums."""
    sums = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    every = W.partitionBy(F.lit(0))  # a row a group
    return sums.select(group, ((F.sum("s").over(every) - F.col("s")) / F.nullif(F.sum("n").over(every) - F.col("n"), F.lit(0))).alias("mean_without"))
