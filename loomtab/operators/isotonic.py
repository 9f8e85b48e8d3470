"""Isotonic regression without a task that holds a column: blocks of adjacent violators are pooled in groups, whose borders move."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtab.operators.ranks import dealt_by_range, placed
from loomtab.session import staged

#: Blocks that one task pools.
GROUP_BLOCKS = 50_000


def pooled(pdf: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a group, in order, with each mean at least as large as the one before."""
    out: list[list[float]] = []
    for lo, hi, w, s in zip(pdf["lo"], pdf["hi"], pdf["w"], pdf["s"], strict=True):
        out.append([lo, hi, w, s])
        while len(out) > 1 and out[-2][3] / out[-2][2] > out[-1][3] / out[-1][2]:
            _, hi_, w_, s_ = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = hi_, out[-1][2] + w_, out[-1][3] + s_
    return pd.DataFrame(out, columns=["lo", "hi", "w", "s"])


def isotonic(df: DataFrame, x: Column, y: Column, weight: Column | None = None) -> DataFrame:
    """lo, hi, weight and mean of the blocks of the increasing step function of x that is nearest to y.

    Rows of one x are one point. Pooling adjacent violators in any order ends in
    the same blocks, so groups are pooled apart, and the borders between groups
    lie inside of groups in the next round; two rounds without a change end it.
    Rows whose x, y or weight is missing or not a number, or whose weight isn't
    above 0, are left out.
    """
    w = weight.cast("double") if weight is not None else F.lit(1.0)
    rows = df.select(x.cast("double").alias("lo"), y.cast("double").alias("y"), w.alias("w")).filter("lo is not null and y is not null and w > 0 and not isnan(lo) and not isnan(y) and not isnan(w)")
    points = rows.groupBy("lo").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s")).select("lo", F.col("lo").alias("hi"), "w", "s")
    blocks, still, turn = staged(points, "blocks"), 0, 0
    n = blocks.count()
    while n and still < 2:
        half = GROUP_BLOCKS // 2 * (turn % 2)
        grouped = placed(blocks, "lo").withColumn("g", F.floor((F.col("__place") + half) / GROUP_BLOCKS))
        blocks = staged(grouped.groupBy("g").applyInPandas(lambda pdf: pooled(pdf.sort_values("lo")), "lo double, hi double, w double, s double"), "blocks")
        left = blocks.count()
        # One group held them all: nothing can change any more.
        still, turn = (2 if n <= GROUP_BLOCKS - half else still + 1 if left == n else 0), turn + 1
        n = left
    return blocks.select("lo", "hi", F.col("w").alias("weight"), (F.col("s") / F.col("w")).alias("mean"))


def looked_up(df: DataFrame, x: Column, blocks: DataFrame, name: str) -> DataFrame:
    """df with the blocks' value at x: that of the last block that begins at x or below, of the first one for less; null without x or blocks.

    Rows and blocks are put in order by ranges together; a range that begins
    between blocks takes the value that the ranges before it ended with.
    """
    steps = blocks.select(F.col("lo").alias("__x"), F.lit(0).alias("__kind"), F.col("mean").alias("__v"), F.lit(None).cast(df.schema).alias("__row"))
    rows = df.select(x.cast("double").alias("__x"), F.lit(1).alias("__kind"), F.lit(None).cast("double").alias("__v"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"))
    dealt = dealt_by_range(steps.unionByName(rows), "__x", "__kind")
    own = F.last("__v", True).over(W.partitionBy("__range").orderBy("__x", "__kind").rowsBetween(W.unboundedPreceding, 0))
    ends = dealt.groupBy("__range").agg(F.max_by("__v", F.when(F.col("__kind") == 0, F.col("__x"))).alias("__end"))
    before = ends.select("__range", F.last("__end", True).over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))  # a row for each range
    first = blocks.agg(F.min_by("mean", "lo").alias("__first"))
    found = dealt.withColumn("__own", own).join(F.broadcast(before), "__range").join(F.broadcast(first)).filter("__kind = 1")
    value = F.when(F.col("__x").isNotNull() & ~F.isnan("__x"), F.coalesce("__own", "__before", "__first"))
    return found.select(*(F.col("__row")[c].alias(c) for c in df.columns), value.alias(name))


def isotonic_noise(df: DataFrame, score: Column, residual: Column, least: float = 1e-9) -> DataFrame:
    """lo, hi and sigma: the deviation of residuals as an increasing function of a score."""
    blocks = isotonic(df, score, residual * residual)
    return blocks.select("lo", "hi", F.sqrt(F.greatest("mean", F.lit(least * least))).alias("mean"))
