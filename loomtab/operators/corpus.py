"""A corpus of tables: fingerprints, strata, lineage and splits that no group crosses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions.cells import hashed
from loomtab.operators.columns import correlation
from loomtab.operators.ranks import column_quantiles
from loomtab.session import staged

#: Parts of a digest that are added up, each a number of 28 bits.
PARTS = 4


def digest_sums(digest: Column, name: str) -> list[Column]:
    """Sums of the parts of a hexadecimal digest: the same for any order of rows."""
    return [F.sum(F.conv(F.substring(digest, 1 + 7 * k, 7), 16, 10).cast("long")).alias(f"{name}{k}") for k in range(PARTS)]


def cell_text(c: Column) -> Column:
    """A cell's text, a null told from any other by its sign."""
    return F.when(c.isNull(), "0").otherwise(F.concat(F.lit("1"), c.cast("string")))


def content_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows and a fingerprint that neither the order of rows nor that of columns changes.

    Columns are put in the order of their own digests (sums of their cells'),
    then rows are digested and summed.
    """
    every = df.agg(*(s for k, c in enumerate(columns) for s in digest_sums(F.md5(cell_text(F.col(c))), f"c{k}_"))).first()
    order = sorted(columns, key=lambda c: tuple(every[f"c{columns.index(c)}_{p}"] or 0 for p in range(PARTS)))
    row = F.md5(F.concat_ws("\x01", *(cell_text(F.col(c)) for c in order)))
    sums = df.agg(F.count("*").alias("n_rows"), *digest_sums(row, "s"))
    return sums.select("n_rows", F.md5(F.concat_ws("|", F.col("n_rows").cast("string"), *(F.coalesce(F.col(f"s{k}"), F.lit(0)).cast("string") for k in range(PARTS)))).alias("fingerprint"))


def near_fingerprint(df: DataFrame, columns: dict[str, Column], target: str) -> DataFrame:
    """A fingerprint that close tables share: nine quantiles a column in 32nds, the power of two over the rows, and correlations with the target in 16ths.

    Columns are on the unit scale.
    """
    q = column_quantiles(df, columns, [k / 8 for k in range(9)]).filter("total > 0")
    sketch = F.concat_ws(",", F.transform("q", lambda x: F.round(32 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).cast("int").cast("string")))
    sketches = q.agg(F.concat_ws(";", F.array_sort(F.collect_list(sketch))).alias("sketches"))  # a row for each column
    others = [c for c in columns if c != target]
    stats = df.agg(F.count("*").alias("n"), F.array(*(F.round(16 * correlation(columns[c], columns[target])).cast("int") for c in others)).alias("r"))
    power = F.ceil(F.log2(F.greatest("n", F.lit(1)).cast("double"))).cast("int").cast("string")
    return stats.join(F.broadcast(sketches)).select(F.concat_ws("|", power, F.lit(str(len(others))), "sketches", F.concat_ws(",", F.transform(F.array_sort("r"), lambda x: x.cast("string")))).alias("near"))


def shape_stratum(rows: Column, features: Column) -> Column:
    return F.concat(F.lit("r"), F.floor(F.log2(F.greatest(rows, F.lit(1)).cast("double"))).cast("string"), F.lit("-p"), F.floor(F.log2(F.greatest(features, F.lit(1)).cast("double"))).cast("string"))


def difficulty_stratum(signal: Column, missing: Column) -> Column:
    """By the strongest correlation with the target and the share of missing cells."""
    level = F.when(signal >= 0.5, "strong").when(signal >= 0.2, "moderate").otherwise("weak")
    return F.concat(level, F.when(missing > 0.05, "-missing").otherwise(""))


def origin(path: Column) -> Column:
    low = F.lower(path)
    return F.when(F.contains(low, F.lit("mirror")), "mirror").when(F.contains(low, F.lit("synthetic")), "synthetic").otherwise("real")


def first_of_each(inventory: DataFrame, key: str, fingerprint: str, group: str) -> DataFrame:
    """inventory with the first key of its fingerprint, whether it is that, and that one's group, which its duplicates inherit.

    A row without a fingerprint is no one's duplicate; null keys come last.
    """
    least = F.min_by(F.struct(key, group), F.struct(F.col(key).isNull(), F.col(key), F.col(group)))
    first = inventory.filter(F.col(fingerprint).isNotNull()).groupBy(fingerprint).agg(least.alias("__f"))
    joined = inventory.join(first, fingerprint, "left").withColumn("__f", F.coalesce("__f", F.struct(key, group)))
    return joined.select(*inventory.columns, F.col("__f")[key].alias("first_key"), F.col(key).eqNullSafe(F.col("__f")[key]).alias("kept"), F.col("__f")[group].alias("lineage"))


def lineage_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """member and root, the least member reachable, for all members of alias edges.

    Each round takes the least root among the neighbours', and then the root's
    root, so a chain takes a number of rounds that grows with its logarithm;
    tables are written between rounds.
    """
    both = staged(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    roots = staged(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")), "roots")
    while True:
        of_y = roots.select(F.col("x").alias("y"), F.col("root").alias("other"))
        near = both.join(of_y, "y").groupBy("x").agg(F.min("other").alias("near"))
        # The least root that a neighbour knows goes to the root itself, too.
        better = roots.join(near, "x").select("x", "root", F.least("root", "near").alias("new"))
        of_root = better.groupBy("root").agg(F.min("new").alias("best")).select(F.col("root").alias("x"), "best")
        told = better.join(of_root, "x", "left").select("x", F.least("new", F.coalesce("best", "new")).alias("root"))
        jumped = told.join(told.select(F.col("x").alias("root"), F.col("root").alias("above")), "root").select("x", F.least("root", "above").alias("root"))
        moved = staged(jumped, "roots")
        if moved.join(roots, ["x", "root"], "left_anti").isEmpty():
            return moved.select(F.col("x").alias("member"), "root")
        roots = moved


def lineage_split(groups: DataFrame, stratum: str, group: str, weight: str, shares: tuple[float, ...] = (0.70, 0.15, 0.15), names: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """stratum, group and split: within a stratum, groups by weight, then hash, each to the split that leaves the least squared deviation from the shares.

    groups has a row for each group. A stratum's groups are dealt in order, by one
    task each; what stands in a table of groups is a row, not its members.
    """
    base = groups.select(stratum, group, F.col(weight).cast("double").alias("__w"), hashed(F.col(group)).alias("__h"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__w", "__h", group], ascending=[False, True, True])
        total = pdf["__w"].sum()
        held, out = [0.0] * len(shares), []
        for w, h in zip(pdf["__w"], pdf["__h"], strict=True):
            costs = [sum((held[j] + (w if j == k else 0.0) - shares[j] * total) ** 2 for j in range(len(shares))) for k in range(len(shares))]
            least = min(costs)
            tied = [k for k, c in enumerate(costs) if c <= least + 1e-9 * max(1.0, least)]
            chosen = tied[int(h) % len(tied)]
            held[chosen] += w
            out.append(names[chosen])
        return pd.DataFrame({stratum: pdf[stratum].to_numpy(), group: pdf[group].to_numpy(), "split": out})

    kinds = dict(groups.dtypes)
    return base.groupBy(stratum).applyInPandas(deal, f"`{stratum}` {kinds[stratum]}, `{group}` {kinds[group]}, split string")


#: Steps of the unit scale in a sketch, steps in a cell, and how many shifted grids of cells are laid over the sketches.
SKETCH_STEPS, CELL_STEPS, GRIDS = 32, 4, 8


def table_sketches(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """A row for each table in a long one: its rows, the power of two above them, and a sketch, nine quantiles of each column in 32nds of the column's range over all tables.

    Quantiles are sketched, so a table of any size takes bounded memory; a column
    without values in a table stands at -1.
    """
    ends = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    marks = [k / 8 for k in range(9)]

    def steps(k: int, c: str) -> Column:
        lo, hi = float(ends[f"lo{k}"] or 0.0), float(ends[f"hi{k}"] or 0.0)
        unit = lambda x: F.round(SKETCH_STEPS * (x - lo) / (hi - lo)).cast("int") if hi > lo else F.lit(0)
        return F.coalesce(F.transform(F.percentile_approx(F.col(c).cast("double"), marks, 2000), unit), F.array(*[F.lit(-1)] * 9))

    made = df.groupBy(table).agg(F.count("*").alias("rows"), F.concat(*(steps(k, c) for k, c in enumerate(columns))).alias("sketch"))
    return made.withColumn("power", F.ceil(F.log2(F.col("rows").cast("double"))).cast("int"))


def near_tables(sketches: DataFrame, table: str, most: float = 1.0) -> DataFrame:
    """Edges (a, b) of tables whose sketches differ by at most so many steps in the mean.

    Sketches fall into the cells of GRIDS grids, each shifted on its own, so that
    near ones share a cell of some grid. A cell's tables are compared with its
    least one only; as a cell's sketches differ by three steps at most, they are
    near to it or to none there. Tables without a name are left out.
    """
    sized = sketches.filter(F.col(table).isNotNull())

    def cell(g: int) -> Column:
        moved = F.transform("sketch", lambda x, i: F.floor((x + F.pmod(F.hash(F.lit(g), i), F.lit(CELL_STEPS))) / CELL_STEPS))
        return F.struct(F.lit(g).alias("grid"), F.xxhash64(moved, F.size("sketch"), "power").alias("cell"))

    shifted = [cell(g) for g in range(GRIDS)]
    celled = sized.select(F.col(table).alias("b"), "sketch", F.explode(F.array(*shifted)).alias("c")).select("b", "sketch", "c.grid", "c.cell")
    # A row for each cell; the least table's sketch goes with it.
    least = celled.groupBy("grid", "cell").agg(F.min_by(F.struct("b", "sketch"), "b").alias("first"), F.count("*").alias("n")).filter("n > 1")
    apart = F.aggregate(F.zip_with("sketch", F.col("first.sketch"), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x) / F.size("sketch")
    met = celled.join(least, ["grid", "cell"]).filter((F.col("b") != F.col("first.b")) & (apart <= most))
    return met.select(F.col("first.b").alias("a"), "b").distinct()


def table_lineages(df: DataFrame, table: str, columns: list[str], most: float = 1.0) -> DataFrame:
    """table, rows and lineage: the least table that a chain of near ones leads to, itself if it has none."""
    sketches = staged(table_sketches(df, table, columns), "sketches")
    roots = lineage_components(near_tables(sketches, table, most), "a", "b")
    named = sketches.join(roots.withColumnRenamed("member", table), table, "left")
    return named.select(table, "rows", F.coalesce("root", table).alias("lineage"))


def validation_halves(groups: DataFrame, group: str) -> DataFrame:
    """groups with part, select or certify: they take turns in the order of their hashes, so that no group is in both."""
    from loomtab.operators.splits import group_folds

    return group_folds(groups, group, 2, "__half").withColumn("part", F.when(F.col("__half") == 0, "select").otherwise("certify")).drop("__half")


def overlapping_rows(train: DataFrame, query: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of query whose digest over the columns is a training row's; a corpus is disjoint if there are none."""
    digest = F.sha2(F.concat_ws("\x01", *(cell_text(F.col(c)) for c in columns)), 256)
    return query.withColumn("__d", digest).join(train.select(digest.alias("__d")).distinct(), "__d", "left_semi").drop("__d")
