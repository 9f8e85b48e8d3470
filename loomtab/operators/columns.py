"""Profiles, scales, levels and marginals of columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import bracketed, column_quantiles, long_form, quantiles, running_sum

QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each numeric column: rows, missing share, distinct values, moments and quantiles.

    Moments come with the pass that brackets the quantiles; only the number of
    distinct values takes a shuffle of them. A column without values has null
    moments and quantiles, an empty table a missing share of 0.
    """
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(
            F.struct(
               F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.coalesce(1 - F.try_divide(F.count(x), F.count("*")), F.lit(0.0)).alias("missing_share"),
                F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.avg(x).alias("mean_value"), F.var_pop(x).alias("variance"), F.skewness(x).alias("skew"),
            )
        )
    every = {c: F.col(c) for c in columns}
    found, more = bracketed(df, every, QUANTILES, [F.array(*aggs).alias("all")])
    names = ["q05", "q25", "q50", "q75", "q95"]
    kinds = "column string, n_rows long, missing_share double, min_value double, max_value double, mean_value double, variance double, skew double"
    rows = [(*r, *(found[r["column"]][1] or [None] * 5)) for r in more["all"]]
    whole = df.sparkSession.createDataFrame(rows, f"{kinds}, {', '.join(f'{n} double' for n in names)}")
    values = long_form(df, every).filter("value is not null").distinct().groupBy("column").agg(F.count("*").alias("n_distinct"))
    both = whole.join(F.broadcast(values), "column", "left")  # a row for each column
    return both.select(*kinds.replace(" string", "").replace(" long", "").replace(" double", "").split(", "), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), *names)


def robust_scale(df: DataFrame, column: str) -> DataFrame:
    return robust_scales(df, [column]).select("logged", "lo", "hi")


def robust_scales(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, logged, lo, hi, median and missing: the 0.5 % and 99.5 % quantiles, of log(1 + x) if x >= 0 is skewed beyond 2.

    Where both quantiles agree, least and most take their place, and where these
    agree, too, hi is lo + 1. missing tells whether a cell is. One call serves
    all columns.
    """
    every = {c: F.col(c).cast("double") for c in columns}
    stats = F.array(*(F.struct(F.min(x).alias("least"), F.max(x).alias("most"), F.skewness(x).alias("skew"), (F.count_if(x.isNull()) > 0).alias("missing")) for x in every.values()))
    cuts, more = bracketed(df, every, [0.005, 0.5, 0.995], [stats.alias("all")])
    rows = [(c, *m, cuts[c][1] and [cuts[c][1][0], cuts[c][1][2]], cuts[c][1] and cuts[c][1][1]) for c, m in zip(columns, more["all"], strict=True)]
    found = df.sparkSession.createDataFrame(rows, "column string, least double, most double, skew double, missing boolean, q array<double>, median double")
    log = (F.col("least") >= 0) & (F.coalesce("skew", F.lit(0.0)) > 2)
    scale = lambda v: F.when(log, F.log1p(F.greatest(v, F.lit(0.0)))).otherwise(v)
    lo, hi = scale(F.col("q")[0]), scale(F.col("q")[1])
    narrow = hi - lo <= 1e-12 * (1 + F.abs(lo))
    ends = found.select("column", "median", "missing", log.alias("logged"), F.when(narrow, scale(F.col("least"))).otherwise(lo).alias("lo"), F.when(narrow, scale(F.col("most"))).otherwise(hi).alias("hi"))
    return ends.withColumn("hi", F.when(F.col("hi") - F.col("lo") <= 1e-12 * (1 + F.abs("lo")), F.col("lo") + 1).otherwise(F.col("hi")))


def ordered_levels(df: DataFrame, column: str, target: Column, prior: float = 10.0, least: int = 5, most: int = 64, other: str = "__other__") -> DataFrame:
    """Levels in the order of their shrunken target means, rare ones pooled, with codes from 0 to 1."""
    level = df.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"), F.sum(target).alias("s"))
    kept = level.filter(F.col("n") >= least).orderBy(F.desc("n"), "level").limit(most).select("level", F.lit(True).alias("kept"))
    pooled = level.join(F.broadcast(kept), "level", "left").withColumn("level", F.when(F.col("kept"), F.col("level")).otherwise(F.lit(other)))
    pooled = pooled.groupBy("level").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # Only the kept levels and the pool are left, most + 1 rows, so windows over all of them are small.
    every = W.partitionBy(F.lit(0))
    mean = F.try_divide(F.sum("s").over(every), F.sum("n").over(every))
    scored = pooled.withColumn("score", (F.col("s") + prior * mean) / (F.col("n") + prior))
    place = F.row_number().over(every.orderBy("score", "level")) - 1
    size = F.count("*").over(every)
    return scored.select("level", "n", "score", F.coalesce(F.try_divide(place, size - 1), F.lit(0.5)).alias("code"))


def one_hot(df: DataFrame, key: str, column: str, levels: list[str]) -> DataFrame:
    """Rows of key by a count for each level: a conditional sum each, without a shuffle of the rows."""
    return df.groupBy(key).agg(*(F.sum((F.col(column) == x).cast("int")).alias(f"is_{x.lower().replace(' ', '_').replace('-', '_')}") for x in levels))


def discrete_marginal(df: DataFrame, column: str) -> DataFrame:
    """Values with their shares and cumulative shares."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    summed = running_sum(counts, "value", "n", "upto").join(F.broadcast(total))
    return summed.select("value", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("upto") / F.col("total")).alias("cumulative"))


def quantile_knots(df: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    found = quantiles(df.select(F.col(column).alias("value")), [], "value", probabilities)
    return found.select(F.posexplode("q").alias("knot", "value"))


def atoms(df: DataFrame, column: str, share: float = 0.1) -> DataFrame:
    """Values that hold at least a share of all rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(df.agg(F.count("*").alias("total")))).filter(F.col("n") >= share * F.col("total")).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def min_max_card(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least and greatest value, median and number of missing values of each column."""
    aggs = [F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi"), F.count_if(F.col(c).isNull()).alias("n_missing")) for c in columns]
    ends = df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("p")).select("p.*")
    fills = column_quantiles(df, {c: F.col(c) for c in columns}, [0.5])
    return ends.join(F.broadcast(fills), "column", "left").select("column", "lo", "hi", F.col("q")[0].alias("fill"), "n_missing")


def median_and_deviation(df: DataFrame, column: str) -> DataFrame:
    """The median and the median of the absolute deviations from it, both null without values."""
    x = F.col(column).cast("double")
    centre = bracketed(df, {"x": x}, [0.5])[0]["x"][1]
    away = bracketed(df, {"d": F.abs(x - F.lit(centre[0]))}, [0.5])[0]["d"][1] if centre else None
    return df.sparkSession.createDataFrame([(centre and centre[0], away and away[0])], "centre double, mad double")


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Entropy in nats of the joint distribution of columns."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s")).select(F.coalesce(F.ln("t") - F.try_divide("s", "t"), F.lit(0.0)).alias("entropy"))


def binned_information(df: DataFrame, x: str, y: str, bins: int = 8) -> DataFrame:
    """Mutual information of equal-width histograms of two columns."""
    ends = df.agg(*(f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))))
    # A constant column has one bin.
    cut = lambda c: F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(bins * (F.col(c) - F.col(f"lo_{c}")), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)))).cast("int")
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(ends)).groupBy(cut(x).alias("i"), cut(y).alias("j")).agg(F.count("*").alias("n"))
    # bins * bins cells at most are left.
    both = cells.withColumns({"a": F.sum("n").over(W.partitionBy("i")), "b": F.sum("n").over(W.partitionBy("j")), "t": F.sum("n").over(W.partitionBy(F.lit(0)))})
    return both.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("information"))


def correlation(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are present, 0 where one is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.coalesce(F.nanvl(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)), F.lit(0.0))


def descriptors(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: present, zeros and mode_share, the share of its most frequent value among the present ones.

    A sketch of frequent values names the mode, a second pass counts it: no
    column's values are shuffled. A value of less than a thousandth of the rows
    may be missed.
    """
    tops = df.agg(*(F.call_function("approx_top_k", F.col(c).cast("double"), F.lit(1), F.lit(4096)).alias(f"t{k}") for k, c in enumerate(columns))).first()
    modes = [tops[f"t{k}"][0]["item"] if tops[f"t{k}"] else None for k in range(len(columns))]
    x = lambda c: F.col(c).cast("double")
    rows = [F.struct(F.lit(c).alias("column"), F.count(c).alias("present"), F.coalesce(F.try_divide(F.count_if(x(c) == 0), F.count(c)), F.lit(0.0)).alias("zeros"),
                     F.coalesce(F.try_divide(F.count_if(x(c) == F.lit(m)), F.count(c)), F.lit(0.0)).alias("mode_share")) for c, m in zip(columns, modes, strict=True)]
    return df.agg(F.array(*rows).alias("all")).select(F.explode("all").alias("d")).select("d.*")


def spectrum(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """effective_rank, spectral_entropy (of the eigenvalues' shares, 0 to 1), mean and greatest absolute correlation, from one pairwise-complete matrix."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    found = df.agg(F.count("*").alias("n"), *(correlation(F.col(columns[i]), F.col(columns[j])).alias(f"r{i}_{j}") for i, j in pairs)).first()
    r = np.eye(len(columns))
    for i, j in pairs:
        r[i, j] = r[j, i] = found[f"r{i}_{j}"]
    values = np.maximum(np.linalg.eigvalsh(r), 0.0)
    share = values[values > 1e-12] / values.sum() if len(columns) else np.zeros(0)
    h = float(-(share * np.log(share)).sum())
    off = [abs(found[f"r{i}_{j}"]) for i, j in pairs]
    return {"effective_rank": float(np.exp(h)) if len(columns) else 0.0, "spectral_entropy": h / float(np.log(len(columns))) if len(columns) > 1 else 0.0, "mean_correlation": float(np.mean(off)) if off else 0.0, "greatest_correlation": max(off, default=0.0)}


def driver_weights(df: DataFrame, columns: list[str], y: Column) -> DataFrame:
    """column and weight: its squared correlation with y, as a part of all columns'; equal parts where none has any."""
    squares = [F.pow(correlation(F.col(c), y), 2) for c in columns]
    found = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), s.alias("s")) for c, s in zip(columns, squares, strict=True))).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda t, x: t + x["s"])
    return found.select(total.alias("t"), F.explode("all").alias("c")).select("c.column", F.coalesce(F.try_divide(F.col("c.s"), "t"), F.lit(1 / max(len(columns), 1))).alias("weight"))


def gram(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Sums of products of all pairs of columns, a row a pair, in one aggregation."""
    names = list(columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.sum(columns[a].cast("double") * columns[b].cast("double")).alias("product")) for a, b in pairs)).alias("all"))
    return sums.select(F.explode("all").alias("p")).select("p.*")
