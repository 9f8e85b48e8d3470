"""Preparation of tables for models: hybrid scalers, category encoders, declared cells, min-max cards and their inverses.

Fits are aggregations; what comes back is a card of bounded size, a row for each
column or level. Cards are applied as projections.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtab.functions import cells
from loomtab.operators.ranks import bracketed, column_quantiles, long_form, quantiles
from loomtab.session import staged

# Probabilities of the scalers' nine knots, and the normal quantiles at them.
QUANTILE_GRID = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
NORMAL_GRID = [-2.32634787, -1.64485363, -1.28155157, -0.67448975, 0.0, 0.67448975, 1.28155157, 1.64485363, 2.32634787]
#: The interquartile range of a standard normal distribution.
NORMAL_IQR = 1.3489795


def fit_scalers(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A row for each column: kind, missing_rate, centre, scale, post_mean, post_std, q (nine quantiles), skew, kurt, weight.

    Kinds are constant (also without values), binary, log (skewed, heavy or
    long-tailed: signed logarithms of robustly scaled distances from the median)
    and robust. Moments and brackets of the quantiles come from one pass over all
    columns, medians of distances from another, moments of logarithms from a third.
    """
    x = {c: F.when(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), e.cast("double")) for c, e in columns.items()}
    moments = F.array(*(F.struct(F.min(e).alias("least"), F.max(e).alias("most"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("sd"), F.skewness(e).alias("skew"), F.kurtosis(e).alias("kurt")) for e in x.values()))
    found, more = bracketed(df, x, QUANTILE_GRID, [F.count("*").alias("rows"), moments.alias("moments")])
    cards = {}
    for c, m in zip(x, more["moments"], strict=True):
        total, q = found[c]
        bare = {"kind": "constant", "missing_rate": 1.0, "centre": 0.0, "scale": 1.0, "post_mean": 0.0, "post_std": 1.0, "q": [0.0] * 9, "skew": 0.0, "kurt": 0.0, "weight": 0.35}
        cards[c] = bare if not total else bare | m.asDict() | {"missing_rate": 1 - total / more["rows"], "q": q, "centre": q[4]}
    # A column's kind needs the median of its distances, and whether it has a third value.
    open_ = [c for c in x if found[c][0] and cards[c]["least"] < cards[c]["most"]]
    third = [F.count_if((x[c] != cards[c]["least"]) & (x[c] != cards[c]["most"])).alias(f"t{k}") for k, c in enumerate(open_)]
    away, levels = bracketed(df, {c: F.abs(x[c] - F.lit(cards[c]["q"][4])) for c in open_}, [0.5], third) if open_ else ({}, {})
    for k, c in enumerate(open_):
        card, q = cards[c], cards[c]["q"]
        card["skew"] = min(max(card["skew"] or 0.0, -50.0), 50.0)
        card["kurt"] = min(max(card["kurt"] or 0.0, -50.0), 200.0)
        iqr, sd = q[5] - q[3], max(card["sd"], 1e-6)
        tail = (q[7] - q[1]) / iqr if iqr > 1e-9 else 1.0
        robust = max(iqr / NORMAL_IQR, away[c][1][0] * 1.4826, card["sd"] * 0.25, 1e-6)
        if not levels[f"t{k}"]:
            card |= {"kind": "binary", "centre": card["mean"], "scale": sd, "weight": 0.0}
        elif abs(card["skew"]) > 1 or card["kurt"] > 4 or tail > 4.2:
            card |= {"kind": "log", "scale": robust}
        else:
            card |= {"kind": "robust", "scale": robust, "post_mean": card["mean"], "post_std": sd, "weight": 0.30}
    logged = [c for c in open_ if cards[c]["kind"] == "log"]
    if logged:
        z = {c: signed_log(x[c], F.lit(cards[c]["centre"]), F.lit(cards[c]["scale"])) for c in logged}
        sums = df.agg(*(f(e).alias(f"{n}{k}") for k, e in enumerate(z.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        for k, c in enumerate(logged):
            cards[c] |= {"post_mean": sums[f"m{k}"], "post_std": max(sums[f"s{k}"], 1e-6)}
    for c in x:
        if cards[c]["kind"] == "constant":
            cards[c] |= {"skew": 0.0, "kurt": 0.0}
    names = ["kind", "missing_rate", "centre", "scale", "post_mean", "post_std", "q", "skew", "kurt", "weight"]
    schema = "column string, kind string, missing_rate double, centre double, scale double, post_mean double, post_std double, q array<double>, skew double, kurt double, weight double"
    return df.sparkSession.createDataFrame([(c, *(cards[c][n] for n in names)) for c in x], schema)


def signed_log(x: Column, centre: Column, scale: Column) -> Column:
    return F.signum(x - centre) * F.log1p(F.abs(x - centre) / scale)


def scaled(x: Column, card: dict) -> Column:
    """The scaler's value of x by a row of its card, 0 where x is missing."""
    q, kind = card["q"], card["kind"]
    lit = lambda v: F.lit(float(v))
    if kind == "constant":
        return F.lit(0.0)
    if kind == "binary":
        return F.coalesce(cells.winsorized((x - lit(card["centre"])) / lit(card["scale"]), -6.0, 6.0), F.lit(0.0))
    base = signed_log(x, lit(card["centre"]), lit(card["scale"])) if kind == "log" else x
    z = (base - lit(card["post_mean"])) / lit(card["post_std"])
    if all(b - a > 1e-12 for a, b in zip(q, q[1:], strict=False)):
        step = max(q[5] - q[3], 1e-9)
        placed = F.when(x < q[0], lit(NORMAL_GRID[0]) + (x - lit(q[0])) / lit(step) * NORMAL_IQR)
        for k in range(8):
            placed = placed.when(x <= q[k + 1], lit(NORMAL_GRID[k]) + (x - lit(q[k])) * lit((NORMAL_GRID[k + 1] - NORMAL_GRID[k]) / (q[k + 1] - q[k])))
        placed = placed.otherwise(lit(NORMAL_GRID[8]) + (x - lit(q[8])) / lit(step) * NORMAL_IQR)
        z = (1 - card["weight"]) * z + card["weight"] * placed
    return F.coalesce(6 * F.tanh(z / 6), F.lit(0.0))


def fit_category(df: DataFrame, column: str, target: Column, least: int = 2, prior: float = 10.0, most: int = 127) -> DataFrame:
    """id, token, encoding and frequency of a category's retained levels; id 0 is the pool of all others and of missing cells.

    Levels stand in the order of their counts; an encoding is the shrunken mean
    of the target and a small term of the level's place. post_mean and post_std
    scale encodings over the rows.
    """
    cell = F.trim(F.col(column))
    base = df.select(F.when(~cells.is_missing(cell), cell).alias("token"), target.cast("double").alias("y"))
    levels = base.groupBy("token").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    kept = levels.filter((F.col("n") >= least) & F.col("token").isNotNull()).orderBy(F.desc("n"), "token").limit(most)
    every = W.partitionBy(F.lit(0))  # most levels at most
    kept = staged(kept.withColumn("id", F.row_number().over(every.orderBy(F.desc("n"), "token"))).select("id", "token", "n", "s"), "levels")
    whole = levels.agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    inside = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kn"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("ks"))
    rest = whole.join(F.broadcast(inside)).select(F.lit(0).alias("id"), F.lit("__other__").alias("token"), (F.col("n") - F.col("kn")).alias("n"), (F.col("s") - F.col("ks")).alias("s"))
    full = rest.unionByName(kept)
    size = F.count("*").over(every)
    place = F.coalesce(F.try_divide(F.col("id") * 0.5, size - 1) - 0.25, F.lit(-0.25))
    mean = F.try_divide(F.sum("s").over(every), F.sum("n").over(every))
    encoded = full.withColumns({"encoding": (F.col("s") + prior * mean) / (F.col("n") + prior) + 0.15 * place, "frequency": F.try_divide("n", F.greatest(F.sum("n").over(every), F.lit(1)))})
    post = F.sum(F.col("encoding") * F.col("frequency")).over(every)
    both = encoded.withColumn("post_mean", post)
    return both.select("id", "token", "n", "encoding", "frequency", "post_mean", F.greatest(F.sqrt(F.greatest(F.sum(F.pow(F.col("encoding") - F.col("post_mean"), 2) * F.col("frequency")).over(every), F.lit(0.0))), F.lit(1e-6)).alias("post_std"))


def encode_category(df: DataFrame, column: str, card: DataFrame, name: str) -> DataFrame:
    """df with the scaled encoding of a category's cell; unknown and missing cells are the pool's."""
    levels = F.broadcast(card.filter("id > 0").select(F.col("token").alias("__token"), "encoding"))  # 127 rows at most
    pool = F.broadcast(card.filter("id = 0").select(F.col("encoding").alias("__pool"), "post_mean", "post_std"))
    joined = df.join(levels, F.trim(F.col(column)) == F.col("__token"), "left").join(pool)
    z = (F.coalesce("encoding", "__pool") - F.col("post_mean")) / F.col("post_std")
    return joined.select(*df.columns, (6 * F.tanh(z / 6)).alias(name))


def fit_target(df: DataFrame, y: Column) -> DataFrame:
    """mean, std, median, iqr, skew and kurt of a numeric target; 0, 1, 0, 1, 0, 0 without values."""
    rows = df.select(y.cast("double").alias("value")).filter("value is not null and not isnan(value)")
    m = rows.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"))
    q = quantiles(rows, [], "value", [0.25, 0.5, 0.75]).select("q")
    c = lambda x, lo, hi: cells.winsorized(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), lo, hi)
    return m.join(F.broadcast(q), how="left").select(
        F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.col("sd").isNull(), 1.0).otherwise(F.greatest("sd", F.lit(1e-6))).alias("std"), F.coalesce(F.col("q")[1], F.lit(0.0)).alias("median"),
        F.when(F.col("q")[1].isNull(), 1.0).otherwise(F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-6))).alias("iqr"), c(F.col("skew"), -50.0, 50.0).alias("skew"), c(F.col("kurt"), -50.0, 200.0).alias("kurt"),
    )


def target_scaled(y: Column, mean: Column, std: Column) -> Column:
    return 8 * F.tanh((y - mean) / std / 8)


def target_unscaled(z: Column, mean: Column, std: Column) -> Column:
    return mean + std * 8 * F.atanh(cells.winsorized(z / 8, -1 + 1e-12, 1 - 1e-12))


def target_classes(df: DataFrame, column: str) -> DataFrame:
    """label, place, n and prior of a target's classes in the order of their text; fewer than 2 or more than 256 are refused when read."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("label")).agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(0))  # a row for each class
    found = counts.withColumns({"place": F.row_number().over(every.orderBy("label")) - 1, "prior": F.col("n") / F.sum("n").over(every), "__k": F.count("*").over(every)})
    return found.withColumn("n", F.when(F.col("__k").between(2, 256), F.col("n")).otherwise(F.raise_error(F.lit("a target needs 2 to 256 classes")).cast("long"))).drop("__k")


def binary_target(df: DataFrame, column: str) -> DataFrame:
    """positive label (1, 1.0, true, else the last in order) and its prior, one half without rows."""
    labels = df.select(F.trim(F.col(column).cast("string")).alias("label")).filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    rank = F.when(F.col("label") == "1", 0).when(F.col("label") == "1.0", 1).when(F.lower("label") == "true", 2).otherwise(3)
    chosen = labels.agg(F.min(F.struct(rank.alias("r"), "label")).alias("a"), F.max("label").alias("last"), F.sum("n").alias("total"))
    positive = chosen.select(F.when(F.col("a.r") < 3, F.col("a.label")).otherwise(F.coalesce("last", F.lit("1"))).alias("positive"), "total")
    both = positive.join(labels, F.col("positive") == F.col("label"), "left")
    return both.select("positive", F.coalesce(F.try_divide("n", "total"), F.lit(0.5)).alias("prior"))


# --- Cards of declared columns: numbers by their range, ordinals by rank, nominals by slots.


def fit_card(df: DataFrame, numbers: list[str], nominals: list[str], most: int = 256, ordinals: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each number (lo, hi, fill, had_missing) and each level of a nominal or ordinal column (level, slot).

    Nominal levels stand in the order of their counts, then of their text; one
    slot more than the levels is for unknown ones. Ordinal levels are given in
    their order; their rows hold the median level's place as fill, the first one's
    without any, for cells that are missing or of no level.
    """
    aggs = [F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi"), (F.count_if(F.col(c).isNull()) > 0).alias("had_missing")) for c in numbers]
    ends = df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("p")).select("p.*")
    fills = column_quantiles(df, {c: F.col(c) for c in numbers}, [0.5]).select("column", F.col("q")[0].alias("fill"))
    ranges = ends.join(F.broadcast(fills), "column", "left").select("column", F.lit("number").alias("kind"), "lo", "hi", "fill", "had_missing", F.lit(None).cast("string").alias("level"), F.lit(None).cast("int").alias("slot"))
    for c in nominals:
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level").limit(most)
        slots = counts.withColumn("slot", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "level")) - 1)  # most rows at most
        none = F.lit(None).cast("double")
        ranges = ranges.union(slots.select(F.lit(c), F.lit("nominal"), none, none, none, F.lit(None).cast("boolean"), "level", "slot"))
    for c, levels in (ordinals or {}).items():
        cell = F.col(c).cast("string")
        found = df.agg(F.array(*(F.count_if(cell == x) for x in levels)).alias("n"), (F.count_if(~F.coalesce(cell.isin(levels), F.lit(False))) > 0).alias("lost")).first()
        upto = np.cumsum(found["n"])
        middle = int(np.searchsorted(upto, upto[-1] / 2)) if len(upto) and upto[-1] else 0
        fill = middle / max(len(levels) - 1, 1)
        rows = [(c, "ordinal", None, None, fill, found["lost"], x, k) for k, x in enumerate(levels)]
        ranges = ranges.union(df.sparkSession.createDataFrame(rows, ranges.schema))
    return ranges


def encoded_number(x: Column, lo: Column, hi: Column, fill: Column) -> Column:
    """The place of x, or of what fills it, between lo and hi: 0 in a constant column; beyond the ends it goes on."""
    return F.coalesce(F.try_divide(F.coalesce(x.cast("double"), fill) - lo, hi - lo), F.lit(0.0))


def apply_card(df: DataFrame, key: str, card: DataFrame) -> DataFrame:
    """key, and for each number its place (and a flag of missing cells where the fit had some), for each nominal column its slots."""
    rows = card.collect()  # a row for each column or level
    out = [F.col(key)]
    levels: dict[str, list] = {}
    for r in sorted((r for r in rows if r["kind"] == "nominal"), key=lambda r: (r["column"], r["slot"])):
        levels.setdefault(r["column"], []).append(r["level"])
    for r in sorted((r for r in rows if r["kind"] == "number"), key=lambda r: r["column"]):
        ends = [F.lit(r[k]).cast("double") for k in ("lo", "hi", "fill")]
        out.append(encoded_number(F.col(r["column"]), *ends).alias(r["column"]))
        if r["had_missing"]:
            out.append(F.col(r["column"]).isNull().cast("double").alias(f"{r['column']}=missing"))
    for c, own in ordinal_levels(rows).items():
        cell = F.col(c).cast("string")
        place = F.coalesce(*(F.when(cell == r["level"], F.lit(r["slot"] / max(len(own) - 1, 1))) for r in own), F.lit(own[0]["fill"]))
        out.append(place.alias(c))
        if own[0]["had_missing"]:
            out.append((~F.coalesce(cell.isin([r["level"] for r in own]), F.lit(False))).cast("double").alias(f"{c}=missing"))
    for c, own in levels.items():
        cell = F.col(c).cast("string")
        out += [F.coalesce(cell == x, F.lit(False)).cast("double").alias(f"{c}={k}") for k, x in enumerate(own)]
        out.append((~F.coalesce(cell.isin(own), F.lit(False))).cast("double").alias(f"{c}=unknown"))
    return df.select(*out)


def ordinal_levels(rows: list) -> dict[str, list]:
    """The card's rows of each ordinal column, in the order of its levels."""
    out: dict[str, list] = {}
    for r in sorted((r for r in rows if r["kind"] == "ordinal"), key=lambda r: (r["column"], r["slot"])):
        out.setdefault(r["column"], []).append(r)
    return out


def invert_card(df: DataFrame, key: str, card: DataFrame) -> DataFrame:
    """key and the raw columns of a table that apply_card encoded.

    Cells with a flag for missing ones, and unknown slots, come back as null.
    Missing cells whose fit had none have no flag and come back as their fill.
    """
    rows = card.collect()  # a row for each column or level
    out, encoded = [F.col(key)], set(df.columns)

    def present(c: str, value: Column) -> Column:
        return F.when(F.col(f"`{c}=missing`") == 0, value) if f"{c}=missing" in encoded else value

    for r in sorted((r for r in rows if r["kind"] == "number"), key=lambda r: r["column"]):
        lo, hi = F.lit(r["lo"]).cast("double"), F.lit(r["hi"]).cast("double")
        out.append(present(r["column"], lo + F.col(r["column"]) * (hi - lo)).alias(r["column"]))
    for c, own in ordinal_levels(rows).items():
        place = F.round(F.col(c) * (len(own) - 1)).cast("int")
        out.append(present(c, F.get(F.array(*(F.lit(r["level"]) for r in own)), place)).alias(c))
    nominal: dict[str, list] = {}
    for r in sorted((r for r in rows if r["kind"] == "nominal"), key=lambda r: (r["column"], r["slot"])):
        nominal.setdefault(r["column"], []).append(r)
    for c, own in nominal.items():
        out.append(F.coalesce(*(F.when(F.col(f"`{c}={r['slot']}`") == 1, r["level"]) for r in own)).alias(c))
    return df.select(*out)


def card_receipt(df: DataFrame, card: DataFrame) -> DataFrame:
    """column, rows, out_of_range, unseen_levels and unexpected_missing of a table against a card."""
    rows = card.collect()
    names = sorted({r["column"] for r in rows})
    aggs = []
    for c in names:
        own = [r for r in rows if r["column"] == c]
        zero = F.lit(0).cast("long")
        if own[0]["kind"] == "number":
            x, lo, hi = F.col(c).cast("double"), own[0]["lo"], own[0]["hi"]
            beyond = F.count_if((x < lo) | (x > hi)) if lo is not None else F.count(x)
            lost = zero if own[0]["had_missing"] else F.count_if(x.isNull())
            aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), beyond.alias("out_of_range"), zero.alias("unseen_levels"), lost.alias("unexpected_missing")))
        else:
            cell = F.col(c).cast("string")
            aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), zero.alias("out_of_range"), F.count_if(cell.isNotNull() & ~cell.isin([r["level"] for r in own])).alias("unseen_levels"), F.count_if(cell.isNull()).alias("unexpected_missing")))
    return df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("r")).select("r.*")


# --- Declared cells and the encoding for models.

# The states of a masked cell.
STATES = ["observed", "missing", "not_applicable", "censored", "refused"]
#: Tokens of the states beyond missing ones.
STATE_TOKENS = {"<na>": "not_applicable", "<censored>": "censored", "<refused>": "refused"}


def cell_state(cell: Column) -> Column:
    state = F.when(cells.is_missing(cell), "missing")
    for token, name in STATE_TOKENS.items():
        state = state.when(F.lower(F.trim(cell)) == token, name)
    return state.otherwise("observed")


def typed(df: DataFrame, numbers: dict[str, tuple[float, float]], levels: dict[str, list[str]]) -> DataFrame:
    """Each declared column as a struct of state and value; an observed cell outside its domain has an error.

    numbers give ranges, levels the allowed texts. Other columns stay.
    """
    out = []
    for c in df.columns:
        cell, state = F.trim(F.col(f"`{c}`")), cell_state(F.col(f"`{c}`"))
        if c in numbers:
            value, (lo, hi) = cells.present_number(cell), numbers[c]
            fails = (state == "observed") & ~F.coalesce((value >= lo) & (value <= hi), F.lit(False))
            out.append(F.struct(state.alias("state"), F.when(state == "observed", value).alias("value"), fails.alias("fails")).alias(c))
        elif c in levels:
            fails = (state == "observed") & ~cell.isin(levels[c])
            out.append(F.struct(state.alias("state"), F.when(state == "observed", cell).alias("value"), fails.alias("fails")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def mixed_counts(df: DataFrame, column: str) -> DataFrame:
    """state, value, n and share of a column's discrete distribution, and the entropy of it, missing states included."""
    state = cell_state(F.col(column))
    counts = df.groupBy(state.alias("state"), F.when(state == "observed", F.trim(F.col(column))).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s")).select("t", F.coalesce(F.ln("t") - F.try_divide("s", "t"), F.lit(0.0)).alias("entropy"))
    return counts.join(F.broadcast(total)).select("state", "value", "n", (F.col("n") / F.col("t")).alias("share"), "entropy")


def model_matrix(df: DataFrame, key: str, numbers: list[str], categories: dict[str, list[str]]) -> DataFrame:
    """key and the columns that learners take: numbers on their robust unit scale with medians for missing cells and a flag where the table has some, categories as one column a level.

    Levels not listed have no column of their own: their rows are 0 in all.
    """
    from loomtab.operators.columns import robust_scales

    cards = {r["column"]: r for r in robust_scales(df, numbers).collect()} if numbers else {}
    out = [F.col(key)]
    for c in numbers:
        card = cards[c]
        x = F.coalesce(F.col(c).cast("double"), F.lit(card["median"]), F.lit(0.0))
        out.append(cells.unit(F.log1p(F.greatest(x, F.lit(0.0))) if card["logged"] else x, F.lit(card["lo"]), F.lit(card["hi"])).alias(c))
        if card["missing"]:
            out.append(F.col(c).isNull().cast("double").alias(f"{c}=__missing__"))
    for c, levels in categories.items():
        out += [F.coalesce(F.col(c) == x, F.lit(False)).cast("double").alias(f"{c}={x}") for x in levels]
    return df.select(*out)


def canonical_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and place: columns in the order of mean, deviation, shares of zeros and ones, share of distinct values, quantiles and their own order.

    Statistics are rounded to nine digits first, so that sums in another order
    don't change places.
    """
    levels = quantiles(long_form(df, {c: F.col(c) for c in columns}), ["column"], "value", [0.05, 0.25, 0.5, 0.75, 0.95])
    aggs = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("j"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), F.try_divide(F.count_if(F.col(c) == 0), F.count("*")).alias("zeros"), F.try_divide(F.count_if(F.col(c) == 1), F.count("*")).alias("ones"), F.count("*").alias("n")) for k, c in enumerate(columns)]
    stats = df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("s")).select("s.*").join(F.broadcast(levels), "column", "left")
    order = [F.round(c, 9) for c in ("mean", "sd", "zeros", "ones")] + [F.round(F.try_divide("levels", "n"), 9), F.transform("q", lambda x: F.round(x, 9)), F.col("j")]
    return stats.select("column", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)) - 1).alias("place"))  # a row for each column


def task_of_target(df: DataFrame, column: str) -> DataFrame:
    """classification if the target has two values at most, all of them 0 or 1, else regression."""
    x = F.col(column).cast("double")
    found = df.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.count_if((x != 0) & (x != 1)).alias("others"), F.count(x).alias("n"))
    return found.select(F.when((F.col("others") == 0) & (F.col("n") > 0), "classification").otherwise("regression").alias("task"))


def anonymous(df: DataFrame, target: str, categories: dict[str, list[str]]) -> DataFrame:
    """Columns renamed to x0, x1, ..., y, and the levels of categories to L0, L1, ... in their order."""
    out = []
    for k, c in enumerate(x for x in df.columns if x != target):
        cell = F.col(f"`{c}`")
        if c in categories:
            named = F.create_map(*(F.lit(v) for i, x in enumerate(categories[c]) for v in (x, f"L{i}"))) if categories[c] else None
            cell = F.element_at(named, cell) if named is not None else F.lit(None).cast("string")
        out.append(cell.alias(f"x{k}"))
    return df.select(*out, F.col(f"`{target}`").alias("y"))


def quantised(x: Column, largest: Column, bits: int) -> Column:
    """The symmetric code of so many bits, 0 where the largest value is 0."""
    levels = (1 << (bits - 1)) - 1
    return F.greatest(F.lit(-levels), F.least(F.lit(levels), F.floor(F.coalesce(F.try_divide(x * levels, largest), F.lit(0.0)) + 0.5))).cast("int")


def signed_plan(df: DataFrame, column: str) -> DataFrame:
    """lo, hi, decimals and distinct values of a number on its signed logarithmic scale."""
    x = F.col(column).cast("double")
    text = F.regexp_replace(F.format_number(x, 6), r"\.?0+$", "")
    return df.agg(F.min(cells.signed_log(x)).alias("lo"), F.max(cells.signed_log(x)).alias("hi"), F.max(cells.decimals_of(text)).alias("decimals"), F.count_distinct(x).alias("levels"))


def level_codes(df: DataFrame, column: str, most: int = 127) -> DataFrame:
    """level and its code (place + 1/2) / levels in the order of the text; too many are refused when read."""
    levels = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("level")).distinct()
    every = W.partitionBy(F.lit(0))
    ranked = levels.withColumns({"__k": F.row_number().over(every.orderBy("level")), "__n": F.count("*").over(every)})
    code = (F.col("__k") - 0.5) / F.col("__n")
    return ranked.select("level", F.when(F.col("__n") <= most, code).otherwise(F.raise_error(F.lit("too many levels")).cast("double")).alias("code"))


def remapped(samples: DataFrame, column: str, levels: dict[str, str], lo: float, hi: float, number: str) -> DataFrame:
    """Samples in another schema: levels by the map, those without one null; a number kept within the schema's range."""
    named = F.create_map(*(F.lit(x) for pair in levels.items() for x in pair))
    return samples.withColumns({column: F.element_at(named, F.col(column)), number: cells.winsorized(F.col(number), lo, hi)})
