"""Assessments of predictions and importances: nominal coverage, rare tails and classes, agreement of importances, bounds over clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions import normal
from loomtab.operators.ranks import bracketed
from loomtab.operators.reducers import retention

#: Half the width of a nominal interval of 95 %, in deviations.
WIDE = 1.959963984540054


def coverage(df: DataFrame, y: Column, prediction: Column, deviation: float) -> DataFrame:
    """n and covered: the share of rows within 1.96 deviations of their prediction; rows that lack either are left out."""
    both = y.isNotNull() & prediction.isNotNull()
    return df.agg(F.count_if(both).alias("n"), F.avg(F.when(both, (F.abs(y - prediction) <= WIDE * deviation).cast("double"))).alias("covered"))


def class_coverage(df: DataFrame, hit: Column, p: Column, least: int = 5) -> DataFrame:
    """bins and covered: of the tenths of predicted probability with enough rows the share whose observed rate is within the 95 % radius of their mean probability."""
    rows = df.select(p.cast("double").alias("p"), hit.cast("double").alias("h")).filter("p is not null and h is not null")
    bins = rows.groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("h").alias("h")).filter(F.col("n") >= least)
    radius = WIDE * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return bins.agg(F.count("*").alias("bins"), F.avg((F.abs(F.col("h") - F.col("p")) <= radius).cast("double")).alias("covered"))  # ten bins


def tail_retention(df: DataFrame, y: str, null: Column, real: Column, synthetic: Column, least: int = 10) -> DataFrame:
    """n, and the mean squared errors and the retention over the rows at or beyond the first and last tenth of y; null with fewer than least rows or no real gain."""
    ends = bracketed(df, {"y": F.col(y)}, [0.1, 0.9])[0]["y"][1] or [None, None]
    lo, hi = (F.lit(e).cast("double") for e in ends)
    rows = df.filter((F.col(y) <= lo) | (F.col(y) >= hi))
    loss = lambda p: F.avg(F.pow(F.col(y) - p, 2))
    found = rows.agg(F.count("*").alias("n"), loss(null).alias("null_loss"), loss(real).alias("real_loss"), loss(synthetic).alias("synthetic_loss"))
    kept = retention(F.col("null_loss"), F.col("real_loss"), F.col("synthetic_loss"))
    return found.withColumn("retention", F.when(F.col("n") >= least, kept))


def rare_class_retention(df: DataFrame, y: str, null: Column, real: Column, synthetic: Column, least: int = 10) -> DataFrame:
    """label, n and the retention over the rows of the rarest class, of losses given for each row; ties to the first label."""
    counts = df.filter(F.col(y).isNotNull()).groupBy(F.col(y).alias("label")).agg(F.count("*").alias("n"), F.avg(null).alias("null_loss"), F.avg(real).alias("real_loss"), F.avg(synthetic).alias("synthetic_loss"))
    rarest = counts.orderBy("n", "label").limit(1)
    kept = retention(F.col("null_loss"), F.col("real_loss"), F.col("synthetic_loss"))
    return rarest.select("label", "n", F.when(F.col("n") >= least, kept).alias("retention"))


def importance_agreement(df: DataFrame, feature: str, real: str, synthetic: str, top: int = 3) -> DataFrame:
    """cosine, overlap of the top features by size, and the share of the real mass whose sign agrees; a row for each feature goes in."""
    place = lambda c: F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.abs(F.col(c))).alias("a"), F.col(feature).alias("f")))), lambda x: x["f"]), 1, top)
    r, s = F.col(real), F.col(synthetic)
    found = df.filter(r.isNotNull() & s.isNotNull()).agg(
        F.try_divide(F.sum(r * s), F.sqrt(F.sum(r * r)) * F.sqrt(F.sum(s * s))).alias("cosine"), F.size(F.array_intersect(place(real), place(synthetic))).alias("both"), F.count("*").alias("n"),
        F.try_divide(F.sum(F.when(F.signum(r) == F.signum(s), F.abs(r)).otherwise(0.0)), F.sum(F.abs(r))).alias("signs"),
    )
    return found.select(F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce(F.try_divide(F.col("both"), F.least(F.col("n"), F.lit(top))), F.lit(0.0)).alias("overlap"), F.coalesce("signs", F.lit(1.0)).alias("signs"))


def student_lower_bound(df: DataFrame, cluster: str, value: str, alpha: float = 0.05) -> DataFrame:
    """clusters, the mean of their means, and its one-sided bound by Student's distribution; no bound with fewer than two clusters.

    A missing cluster is one of its own.
    """
    means = df.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.avg(value).alias("m"))
    found = means.agg(F.count("*").alias("clusters"), F.avg("m").alias("mean_value"), F.stddev_samp("m").alias("sd"))
    n = found.first()["clusters"]
    t = normal.student_lower(alpha, n - 1) if n > 1 else None
    return found.select("clusters", "mean_value", (F.col("mean_value") - F.lit(t).cast("double") * F.col("sd") / F.sqrt(F.col("clusters").cast("double"))).alias("lower"))
