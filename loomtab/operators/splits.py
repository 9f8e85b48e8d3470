"""Splits, folds and samples that depend on keys alone, never on partitions."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtab.functions.cells import hashed


def fold_of(key: Column, folds: int, seed: str = "") -> Column:
    """A fold by hash; rows of one group share it if key is the group's, and those without a key are in the first."""
    return F.coalesce(F.pmod(hashed(key, seed), F.lit(folds)), F.lit(0))


def row_hash(df: DataFrame, key: str) -> Column:
    """The hash of a row's key; of all its cells where it has no key, so that such rows are dealt out, too."""
    cells = F.concat_ws("\x01", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x02")) for c in df.columns))
    return F.coalesce(hashed(F.col(key)), hashed(cells))


#: Rows that one task orders at most, in the mean.
ORDERED_ROWS = 100_000


def least_hashes(df: DataFrame, key: str, stratum: str, wanted: Column) -> DataFrame:
    """df with ``__in``: whether the row is among the wanted ones (an expression of the stratum's ``__size``) of least hash.

    Hashes are counted by their first bits; only rows of the one bin of a stratum
    in which the border falls are put in order.
    """
    bits = min(24, max(1, (df.count() // ORDERED_ROWS).bit_length()))
    binned = df.withColumn("__hash", row_hash(df, key)).withColumn("__bin", F.shiftright("__hash", 32 - bits))
    counts = binned.groupBy(stratum, "__bin").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(W.partitionBy(stratum).orderBy("__bin"))
    edges = counts.select(stratum, "__bin", "__n", upto.alias("__upto"), F.sum("__n").over(W.partitionBy(stratum)).alias("__size")).withColumn("__wanted", wanted)
    edges = edges.select(F.col(stratum).alias("__stratum"), F.col("__bin").alias("__of"), (F.col("__upto") - F.col("__n")).alias("__before"), "__upto", "__wanted")
    dealt = binned.join(edges, F.col(stratum).eqNullSafe(F.col("__stratum")) & (F.col("__bin") == F.col("__of")))
    whole, border = F.col("__upto") <= F.col("__wanted"), (F.col("__upto") > F.col("__wanted")) & (F.col("__before") < F.col("__wanted"))
    place = F.row_number().over(W.partitionBy(stratum, "__bin").orderBy("__hash", key))
    ordered = dealt.filter(border).withColumn("__in", place + F.col("__before") <= F.col("__wanted"))
    return dealt.filter(~border).withColumn("__in", whole).unionByName(ordered).select(*df.columns, "__in")


def stratified_split(df: DataFrame, key: str, stratum: str, share: float) -> DataFrame:
    """Of each stratum the rounded share of rows with the least hashes go to the test side."""
    return least_hashes(df, key, stratum, F.floor(F.col("__size") * share + 0.5)).withColumnRenamed("__in", "is_test")


def capped(df: DataFrame, key: str, stratum: str, most: int) -> DataFrame:
    """Of each stratum the rows of least hash, at most so many."""
    return least_hashes(df, key, stratum, F.least(F.col("__size"), F.lit(most))).filter("__in").drop("__in")


def fit_validation_split(df: DataFrame, key: str, share: float = 0.15, least: int = 10, most: int = 5000) -> DataFrame:
    """The rows of least hash go to validation: a share of all within limits."""
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.col("__size") * share + 0.5)))
    dealt = least_hashes(df.withColumn("__all", F.lit(0)), key, "__all", n)
    return dealt.withColumnRenamed("__in", "is_validation").drop("__all")


def stratified_folds(df: DataFrame, key: str, stratum: str, folds: int) -> DataFrame:
    """A fold for each row: round robin in hash order within each stratum, the start moved on by the sizes of the strata before."""
    from loomtab.operators.ranks import placed

    # Strata follow one another in that order, so the running place has the offset in it.
    found = placed(df.withColumn("__hash", row_hash(df, key)), stratum, "__hash", key)
    return found.select(*df.columns, F.pmod("__place", F.lit(folds)).cast("int").alias("fold"))


def group_folds(df: DataFrame, group: str, folds: int, name: str = "fold") -> DataFrame:
    """df with a fold that no group crosses: groups take turns in the order of their hashes; rows without a group are one.

    A group's rows are never put together: folds are dealt to the table of
    groups and joined back.
    """
    from loomtab.operators.ranks import null_safe, placed

    groups = df.select(group).distinct().withColumn("__hash", F.coalesce(hashed(F.col(group)), F.lit(-1)))
    dealt = placed(groups, "__hash", group).select(group, F.pmod("__place", F.lit(folds)).cast("int").alias(name))
    return null_safe(df, dealt, [group])


def value_strata(df: DataFrame, value: str, key: str, bins: int = 10, name: str = "stratum") -> DataFrame:
    """df with its bin among bins of equal counts in the order of value and key; rows without a value have none."""
    from loomtab.operators.ranks import placed

    present = df.filter(F.col(value).isNotNull())
    n = present.count()
    found = placed(present, value, key).select(*df.columns, F.call_function("div", F.col("__place") * bins, F.lit(max(n, 1))).cast("int").alias(name))
    return found.unionByName(df.filter(F.col(value).isNull()).withColumn(name, F.lit(None).cast("int")))


def stratified_subsample(df: DataFrame, key: str, stratum: str, seats: int) -> DataFrame:
    """seats rows shared out to the strata by largest remainders, each stratum's by least hash."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    quota = largest_remainder(sizes, stratum, "n", seats).select(F.col(stratum).alias("__quota_of"), F.col("seats").alias("__quota"))
    given = df.join(F.broadcast(quota), F.col(stratum).eqNullSafe(F.col("__quota_of"))).drop("__quota_of")  # a row for each stratum
    order = W.partitionBy(stratum).orderBy(row_hash(df, key), key)
    best = least_hashes(given.select(*df.columns), key, stratum, F.least(F.col("__size"), F.lit(seats))).filter("__in").drop("__in")
    ranked = best.join(F.broadcast(quota), F.col(stratum).eqNullSafe(F.col("__quota_of"))).withColumn("__place", F.row_number().over(order))
    return ranked.filter(F.col("__place") <= F.col("__quota")).select(*df.columns)


def largest_remainder(sizes: DataFrame, stratum: str, n: str, seats: int) -> DataFrame:
    """Seats for the strata in proportion to n, what rounding leaves to the largest remainders. One row a stratum."""
    every = W.partitionBy(F.lit(0))
    exact = F.coalesce(F.try_divide(F.col(n) * seats, F.sum(n).over(every)), F.lit(0.0))
    base = sizes.withColumns({"__base": F.floor(exact), "__rest": exact - F.floor(exact)})
    ranked = base.withColumns({"__left": F.lit(seats) - F.sum("__base").over(every), "__rank": F.row_number().over(every.orderBy(F.desc("__rest"), stratum))})
    return ranked.select(stratum, n, (F.col("__base") + (F.col("__rank") <= F.col("__left")).cast("long")).alias("seats"))


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of least hash."""
    return df.orderBy(row_hash(df, key), key).limit(n)


#: Rows that are compressed together.
CHUNK_ROWS = 1000


def packed_size(rows: list[str]) -> int:
    return len(zlib.compress("\n".join(rows).encode(), 6))


def byte_prefix(df: DataFrame, key: str, budget: int) -> DataFrame:
    """The longest prefix of df, in the order of its rows' hashes, whose chunks take at most budget bytes compressed.

    Chunks of CHUNK_ROWS rows are compressed where they are; their sizes are
    summed up by ranges. Only the chunk in which the border falls is opened
    again, and halved until the last row that fits is known. Null cells count as
    empty ones apart from others; equal rows have an order among themselves by
    their cells.
    """
    from loomtab.operators.ranks import placed, running_sum
    from loomtab.session import staged

    cells = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    rows = placed(df.withColumns({"__hash": row_hash(df, key), "__text": cells}), "__hash", "__text")
    rows = staged(rows.withColumn("__chunk", F.floor(F.col("__place") / CHUNK_ROWS)), "chunks")

    def size(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["__chunk"].iloc[:1], "bytes": packed_size(pdf.sort_values("__place")["__text"].tolist())})

    sizes = rows.select("__chunk", "__place", "__text").groupBy("__chunk").applyInPandas(size, "chunk long, bytes long")
    upto = staged(running_sum(sizes, "chunk", "bytes", "upto"), "sizes")
    fits = upto.filter(F.col("upto") <= budget).agg(F.max("chunk"), F.max("upto")).first()
    last, used = (-1, 0) if fits[0] is None else (fits[0], fits[1])
    border = [r["__text"] for r in rows.filter(F.col("__chunk") == last + 1).orderBy("__place").select("__text").collect()]  # CHUNK_ROWS at most
    low, high = 0, len(border)
    while low < high:
        middle = (low + high + 1) // 2
        if packed_size(border[:middle]) <= budget - used:
            low = middle
        else:
            high = middle - 1
    return rows.filter(F.col("__place") < (last + 1) * CHUNK_ROWS + low).select(*df.columns)


def bootstrap_means(df: DataFrame, key: str, column: str, draws: int) -> DataFrame:
    """The mean of a column in each of draws resamples, each row counting as often as a Poisson(1) draw by hash says.

    Poisson weights need no table of indices and no shuffle of rows.
    """
    # Cumulative Poisson(1) probabilities.
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    def drawn(d: int) -> Column:
        u = hashed(F.concat_ws(":", F.lit(d), F.col(key))) / F.lit(4294967296.0)
        return sum((u >= s).cast("int") for s in steps)

    # All draws in one aggregation: a row isn't copied for each.
    x = F.col(column).cast("double")
    rows = df.filter(x.isNotNull()).select(x.alias("x"), F.array(*(drawn(d) for d in range(draws))).alias("w"))
    sums = rows.agg(*(f(v).alias(f"{n}{d}") for d in range(draws) for n, f, v in (("w", F.sum, F.col("w")[d]), ("s", F.sum, F.col("w")[d] * F.col("x")))))
    made = F.array(*(F.struct(F.lit(d).alias("draw"), F.col(f"w{d}").alias("weight"), F.try_divide(f"s{d}", f"w{d}").alias("mean_value")) for d in range(draws)))
    return sums.select(F.explode(made).alias("m")).select("m.*")
