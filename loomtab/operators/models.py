"""Auditing models on hashed folds, dependence trees and importances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtab.functions.cells import hashed
from loomtab.operators.columns import correlation, gram


#: Rows of a block within which a column is shuffled.
BLOCK_ROWS = 20_000


def ridge(df: DataFrame, terms: dict[str, Column], y: Column, penalty: float = 1e-6) -> dict[str, float]:
    """Weights of terms and an intercept, from one aggregation of sums of products."""
    every = {"one": F.lit(1.0), **terms, "__y": y}
    names = list(every)
    sums = {(r["a"], r["b"]): r["product"] or 0.0 for r in gram(df, every).collect()}
    g = np.array([[sums.get((a, b), sums.get((b, a), 0.0)) for b in names] for a in names])
    n = max(g[0, 0], 1.0)
    pull = np.eye(len(names) - 1) * penalty * n
    pull[0, 0] = 0
    return dict(zip(names[:-1], np.linalg.solve(g[:-1, :-1] + pull, g[:-1, -1]).tolist(), strict=True))


def scored(weights: dict[str, float], terms: dict[str, Column]) -> Column:
    out = F.lit(weights["one"])
    for name, term in terms.items():
        out = out + F.lit(weights[name]) * term
    return out


def out_of_fold(df: DataFrame, terms: dict[str, Column], y: Column, fold: Column, folds: int, name: str = "residual", penalty: float = 1e-6) -> DataFrame:
    """df with the residual of y after a linear model of the rows of all other folds.

    One aggregation has the sums of products of each fold; a model is solved from
    all sums but its fold's, and one projection has the residuals. A row whose y,
    terms or fold is missing has none, and is in no sum.
    """
    every = {"one": F.lit(1.0), **{n: t.cast("double") for n, t in terms.items()}, "__y": y.cast("double")}
    names = list(every)
    whole = fold.isNotNull()
    for c in every.values():
        whole = whole & c.isNotNull()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    own = df.filter(whole).groupBy(fold.cast("int").alias("__fold"))
    sums = np.zeros((folds, len(names), len(names)))
    for r in own.agg(*(F.sum(every[names[i]] * every[names[j]]).alias(f"p{i}_{j}") for i, j in pairs)).collect():  # a row for each fold
        for i, j in pairs:
            sums[r["__fold"], i, j] = sums[r["__fold"], j, i] = r[f"p{i}_{j}"] or 0.0
    out = F.lit(None).cast("double")
    for k in range(folds):
        g = sums.sum(0) - sums[k]
        pull = np.eye(len(names) - 1) * penalty * max(g[0, 0], 1.0)
        pull[0, 0] = 1e-12
        weights = np.linalg.solve(g[:-1, :-1] + pull, g[:-1, -1]).tolist()
        out = F.when(fold == k, y.cast("double") - scored(dict(zip(names[:-1], weights, strict=True)), {n: t.cast("double") for n, t in terms.items()})).otherwise(out)
    return df.withColumn(name, F.when(whole, out))


def permutation_importance(df: DataFrame, key: str, weights: dict[str, float], columns: list[str], y: Column) -> DataFrame:
    """Rise of the mean squared error when a column is shuffled, each within blocks of rows by hash.

    Within a block, rows in the order of one hash take the value of the row
    that follows in the order of another, so no window spans the table.
    """
    blocks = df.count() // BLOCK_ROWS + 1
    base = df.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    terms = {c: F.col(c) for c in columns}
    loss = F.avg(F.pow(y - scored(weights, terms), 2))
    out = None
    for c in columns:
        order = W.partitionBy("__block").orderBy(hashed(F.col(key), c), key)
        ends = W.partitionBy("__block").orderBy(hashed(F.col(key), c), key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        moved = base.withColumn("__moved", F.coalesce(F.lead(c).over(order), F.first(c).over(ends)))
        shuffled = {**terms, c: F.col("__moved")}
        row = moved.agg(F.lit(c).alias("column"), loss.alias("loss"), F.avg(F.pow(y - scored(weights, shuffled), 2)).alias("shuffled_loss"))
        out = row if out is None else out.union(row)
    return out.withColumn("importance", F.col("shuffled_loss") - F.col("loss"))


def grouped_importance(df: DataFrame, key: str, weights: dict[str, float], groups: dict[str, list[str]], y: Column, repeats: int = 2) -> DataFrame:
    """group and importance: the mean rise of the squared error when a group's columns are moved together, over repeats.

    A repeat moves all columns of a group by one permutation, so what they share
    stays together: within blocks by hash, rows in the order of one hash take the
    values of the row that follows in it. All groups and repeats are one pass over
    the rows; no window spans the table.
    """
    blocks = df.count() // BLOCK_ROWS + 1
    columns = sorted({c for cs in groups.values() for c in cs} | {c for c in weights if c != "one"})
    base = df.select(key, y.cast("double").alias("__y"), *columns).withColumn("__block", F.pmod(hashed(F.col(key), "block"), F.lit(blocks)))
    terms = {c: F.col(c) for c in weights if c != "one"}
    rises, moved = [], {}
    for g, cs in groups.items():
        for r in range(repeats):
            order = W.partitionBy("__block").orderBy(hashed(F.col(key), f"{g}{r}"), key)
            whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            own = F.struct(*(F.col(c) for c in cs))
            moved[f"__m{len(moved)}"] = F.coalesce(F.lead(own).over(order), F.first(own).over(whole))
            rises.append((g, F.avg(F.pow(F.col("__y") - scored(weights, terms | {c: F.col(f"__m{len(moved) - 1}")[c] for c in cs if c in terms}), 2))))
    rows = base.withColumns(moved)
    plain = F.avg(F.pow(F.col("__y") - scored(weights, terms), 2))
    every = F.array(*(F.struct(F.lit(g).alias("group"), (rise - plain).alias("rise")) for g, rise in rises))
    return rows.agg(every.alias("all")).select(F.explode("all").alias("r")).groupBy("r.group").agg(F.avg("r.rise").alias("importance"))


def chow_liu(df: DataFrame, columns: list[str], spark: SparkSession) -> DataFrame:
    """Edges of the maximum spanning tree of -ln(1 - r^2) / 2 over the columns' correlations, grown from the first column; a constant column has none."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    found = df.agg(*(correlation(F.col(a), F.col(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs))).first()
    weight = {}
    for k, (a, b) in enumerate(pairs):
        weight[a, b] = weight[b, a] = -0.5 * np.log(max(1 - found[f"r{k}"] ** 2, 1e-12))
    inside, edges = [columns[0]], []
    while len(inside) < len(columns):
        # Ties go to the column that stands first, then to the parent that does.
        a, b = max(((a, b) for a in inside for b in columns if b not in inside), key=lambda e: (weight[e], -columns.index(e[1]), -columns.index(e[0])))
        edges.append((a if weight[a, b] > 1e-6 else None, b, float(round(weight[a, b], 8))))
        inside.append(b)
    return spark.createDataFrame(edges, "parent string, child string, weight double")
