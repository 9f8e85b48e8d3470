"""Two samples side by side: distances, copies, neighbours and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import column_quantiles, running_sum, running_sums


def ks(df: DataFrame, side: Column, column: str) -> DataFrame:
    """The largest distance of the distribution functions of the rows where side holds and where it doesn't."""
    counts = df.groupBy(column).agg(F.sum(side.cast("int")).alias("a"), F.sum((~side).cast("int")).alias("b"))
    both = running_sums(counts, column, {"a": "fa", "b": "fb"}).join(F.broadcast(counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))))
    return both.agg(F.coalesce(F.max(F.abs(F.try_divide("fa", "na") - F.try_divide("fb", "nb"))), F.lit(0.0)).alias("ks"))


def wasserstein(df: DataFrame, side: Column, column: str, probes: int = 64) -> DataFrame:
    """Mean distance of both sides' quantiles over a grid, null if a side is empty."""
    first = F.coalesce(side, F.lit(False))
    found = column_quantiles(df, {"a": F.when(first, F.col(column)), "b": F.when(~first, F.col(column))}, [(k + 0.5) / probes for k in range(probes)])
    both = found.agg(F.max(F.when(F.col("column") == "a", F.col("q"))).alias("a"), F.max(F.when(F.col("column") == "b", F.col("q"))).alias("b"))  # two rows
    return both.select((F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / probes).alias("wasserstein"))


def threshold_errors(df: DataFrame, side: Column, column: str, thresholds: list[float]) -> DataFrame:
    """Relative errors of the counts of rows up to each threshold, one side against the other."""
    aggs = [F.struct(F.lit(float(t)).alias("threshold"), F.avg(F.when(side, (F.col(column) <= t).cast("double"))).alias("p"), F.avg(F.when(~side, (F.col(column) <= t).cast("double"))).alias("q")) for t in thresholds]
    rows = df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("r")).select("r.*")
    return rows.select("threshold", (F.abs(F.col("p") - F.col("q")) / F.greatest("p", F.lit(0.05))).alias("error"))


def calibration(df: DataFrame, p: Column, y: Column, bins: int = 10) -> DataFrame:
    """Bins of p (null ones left out) with the mean forecast, the rate, and the bin's part of the expected calibration error."""
    cells = df.filter(p.isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("forecast"), F.avg(y.cast("double")).alias("rate"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))  # bins rows at most
    return cells.select("bin", "n", "forecast", "rate", (F.col("n") / total * F.abs(F.col("forecast") - F.col("rate"))).alias("gap"))


def exact_copies(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Classes of rows that agree in columns, by digest: the least key and the number."""
    # As JSON, a null is told from any text.
    digest = F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in columns))), 256)
    return df.groupBy(digest.alias("digest")).agg(F.min(key).alias("first_key"), F.count("*").alias("n")).filter("n > 1").select("first_key", "n")


def near_pairs(left: DataFrame, right: DataFrame, a: str, b: str, radius: float) -> DataFrame:
    """Pairs whose values differ by at most radius: rows of the right are put in their own and both neighbouring bands."""
    lhs = left.withColumn("__band", F.floor(F.col(a) / radius))
    rhs = right.withColumn("__band", F.explode(F.array(*(F.floor(F.col(b) / radius) + k for k in (-1, 0, 1)))))
    return lhs.join(rhs, "__band").filter(F.abs(F.col(a) - F.col(b)) <= radius).drop("__band")


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k rows of base nearest to each query by Euclidean distance, ties to the smaller key.

    queries is a stated, bounded set; it is sent to every part of base, and of
    each part and query only k rows go on.
    """
    q = F.broadcast(queries.select(F.col(key).alias("query"), F.col(vector).alias("__q")))
    d = F.sqrt(F.aggregate(F.zip_with("__q", vector, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    pairs = base.join(q, F.col(key) != F.col("query")).select("query", F.col(key).alias("neighbour"), d.alias("distance"))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbour"))).filter(F.col("rank") <= k)


def rank_auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """The chance that a positive row scores above another, ties counting half; one half if a side is empty."""
    counts = df.groupBy(score).agg(F.sum(positive.cast("int")).alias("p"), F.sum((~positive).cast("int")).alias("q"))
    below = running_sum(counts, score, "q", "upto")
    sums = below.agg(F.sum(F.col("p") * (F.col("upto") - F.col("q") + F.col("q") / 2)).alias("wins"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return sums.select(F.coalesce(F.try_divide("wins", F.col("p") * F.col("q")), F.lit(0.5)).alias("auc"))
