"""Ranks, running sums and exact quantiles without ordering a table in one task.

Values are counted first; the counts are dealt by ranges of keys and values, as
many ranges as the session has partitions, and each range is lifted by what the
ranges before it hold. Quantiles are read off the ranges in which their ranks
fall, so no task holds a column's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtab.session import staged

#: Up to so many rows all values are counted; beyond, a sketch of this accuracy brackets each quantile first.
COUNTED_ROWS, ACCURACY = 20_000, 10_000
#: Bracketed values of a column that one task puts in order; more are dealt by ranges.
ORDERED_VALUES = 200_000
#: More brackets than these are looked up in an array; fewer make a chain of comparisons.
MANY_BRACKETS = 24


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, null keys meeting null keys."""
    own = right.select(*(F.col(k).alias(f"__on_{k}") if k in keys else F.col(k) for k in right.columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__on_{k}"))
    return left.join(own, on, how).drop(*(f"__on_{k}" for k in keys))


def dealt_by_range(df: DataFrame, *order: str) -> DataFrame:
    """df in ranges of order, with the range of each row as ``__range``; written, so that all readers see the same ranges."""
    return staged(df.repartitionByRange(*map(F.col, order)).withColumn("__range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: list[str], order: str, names: dict[str, str]) -> DataFrame:
    """df, one row for each keys and order, with the sums of columns up to and including its row within its keys, named by names.

    ``__range`` tells the range of the row.
    """
    dealt = dealt_by_range(df, *keys, order)
    # A row for each range, and one more for each key.
    totals = dealt.groupBy("__range", *keys).agg(*(F.sum(v).alias(f"__{v}") for v in names))
    upto = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__range")
    before = totals.select("__range", *keys, *((F.sum(f"__{v}").over(upto) - F.col(f"__{v}")).alias(f"__{v}") for v in names))
    own = W.partitionBy("__range", *keys).orderBy(order)
    joined = null_safe(dealt, before, ["__range", *keys])
    return joined.withColumns({n: F.sum(v).over(own) + F.col(f"__{v}") for v, n in names.items()}).drop(*(f"__{v}" for v in names))


def running_sums(df: DataFrame, order: str, names: dict[str, str]) -> DataFrame:
    """df, one row for each order, with the sums of columns up to and including its row, named by names."""
    return running(df, [], order, names).drop("__range")


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    return running_sums(df, order, {value: name})


def ranked_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n (rows of that value), upto (rows up to it within keys) and ``__range``; null values are left out."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running(counts, keys, value, {"n": "upto"})


def long_form(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """column and value: a row for each row of df and each of the columns."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), c.cast("double").alias("value")) for n, c in columns.items()))).alias("c")).select("c.*")


def quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """keys, total (present values) and q, the exact quantiles (linear between order statistics), with keys also levels (distinct values).

    Null keys are a group of their own.
    """
    if keys:
        return quantiles_of_ranked(staged(ranked_values(rows, keys, value), "ranked"), keys, value, probabilities)
    return column_quantiles(rows, {"value": F.col(value)}, probabilities).filter("total > 0").drop("column")


def column_quantiles(df: DataFrame, columns: dict[str, Column], probabilities: list[float]) -> DataFrame:
    """A row for each column: its name, total (present values) and q, the exact quantiles, null without values."""
    found, _ = bracketed(df, columns, probabilities)
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in columns], "column string, total long, q array<double>")


def bracketed(df: DataFrame, columns: dict[str, Column], probabilities: list[float], more: list[Column] = ()) -> tuple[dict, dict]:
    """(total, exact quantiles) of each column, and the values of more aggregations, which the first pass makes, too.

    The first pass sketches all columns, which puts each wanted rank between two
    values. The second counts what lies between brackets and the values inside
    them; nothing else is shuffled, so near-unique columns cost no more than
    others. Ranks are looked up among the values inside. A rank that its bracket
    misses, which the sketch's bound rules out, is found by counting all values.
    """
    if not columns:
        return {}, df.agg(*more).first().asDict() if more else {}
    # As columns, so that what is compared with many brackets is computed once a row.
    df = df.withColumns({f"__x{k}": e.cast("double") for k, e in enumerate(columns.values())})
    x = {c: F.col(f"__x{k}") for k, c in enumerate(columns)}
    slack = 2 / ACCURACY
    marks = sorted({min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-slack, slack)})
    sketch = [f for k, e in enumerate(x.values()) for f in (F.count(e).alias(f"__n{k}"), F.percentile_approx(e, marks, ACCURACY).alias(f"__q{k}"))]
    first = df.agg(*sketch, *more).first().asDict()
    totals = {c: first.pop(f"__n{k}") for k, c in enumerate(x)}
    sketches = {c: first.pop(f"__q{k}") for k, c in enumerate(x)}
    wanted, cells, inside = [], [], 0
    for k, (c, e) in enumerate(x.items()):
        n = totals[c]
        if not n:
            continue
        wanted += [(k, r) for r in sorted({r for p in probabilities for r in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))})]
        brackets = [(None, None)] if n <= COUNTED_ROWS else merged(probabilities, dict(zip(marks, sketches[c], strict=True)), slack)
        inside += n if n <= COUNTED_ROWS else int(2 * slack * n * len(brackets))
        cells.append(F.struct(F.lit(k).alias("column"), bracket_of(e, brackets).alias("cell")))
    found = {c: (totals[c], None) for c in columns}
    if not cells:
        return found, first
    counts = df.select(F.explode(F.array(*cells)).alias("c")).select("c.column", "c.cell").filter("cell is not null").groupBy("column", "cell").agg(F.count("*").alias("n"))
    if inside <= ORDERED_VALUES * len(cells):
        summed = counts.withColumn("upto", F.sum("n").over(W.partitionBy("column").orderBy("cell")))
    else:
        summed = running(counts, ["column"], "cell", {"n": "upto"})
    ranks = df.sparkSession.createDataFrame(wanted, "column int, rank long").groupBy("column").agg(F.collect_list("rank").alias("ranks"))  # two for each probability
    near = summed.filter("cell.value is not null").join(F.broadcast(ranks), "column")
    hits = near.select("column", "cell.value", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("rank"))
    at = {(r["column"], r["rank"]): r["value"] for r in hits.collect()}
    for k, c in enumerate(x):
        n = totals[c]
        if n:
            if any((k, r) not in at for j, r in wanted if j == k):
                ranked = staged(ranked_values(df.select(x[c].alias("value")), [], "value"), "ranked")
                found[c] = (n, quantiles_of_ranked(ranked, [], "value", probabilities).first()["q"])
                continue
            ends = [(at[k, int(p * (n - 1))], at[k, min(int(p * (n - 1)) + 1, n - 1)], p * (n - 1) - int(p * (n - 1))) for p in probabilities]
            found[c] = (n, [a + part * (b - a) if a != b else a for a, b, part in ends])
    return found, first


def bracket_of(e: Column, brackets: list[tuple]) -> Column:
    """slot, the number of brackets that end below e, and value, e itself where it lies inside the next one; null without e."""
    none = F.lit(None).cast("double")
    if len(brackets) > MANY_BRACKETS:
        inf = float("inf")
        lows, highs = (F.array(*(F.lit(float(side if b[i] is None else b[i])) for b in brackets)) for i, side in ((0, -inf), (1, inf)))
        # Bound as a lambda's variable, so that they are made once a row.
        slot = F.size(F.filter(highs, lambda h: h < e))
        found = F.transform(F.array(slot), lambda s: F.struct(s.alias("slot"), F.when(e >= F.get(lows, s), e).alias("value")))
        return F.when(e.isNotNull(), found[0])
    cell = F.when(e.isNull(), F.lit(None))
    for at, (low, high) in enumerate(brackets):
        if low is not None:
            cell = cell.when(e < low, F.struct(F.lit(at).alias("slot"), none.alias("value")))
        cell = cell.when(F.lit(True) if high is None else e <= high, F.struct(F.lit(at).alias("slot"), e.alias("value")))
    return cell.otherwise(F.struct(F.lit(len(brackets)).alias("slot"), none.alias("value")))


def merged(probabilities: list[float], sketch: dict[float, float], slack: float) -> list[tuple]:
    """Disjoint brackets in ascending order, open where a probability lies at an end."""
    out: list[tuple] = []
    for p in sorted(probabilities):
        low = None if p - slack <= 0 else sketch[p - slack]
        high = None if p + slack >= 1 else sketch[p + slack]
        if out and (out[-1][1] is None or low is None or low <= out[-1][1]):
            top = None if high is None or out[-1][1] is None else max(high, out[-1][1])
            out[-1] = (out[-1][0], top)
        else:
            out.append((low, high))
    return out


def quantiles_of_ranked(ranked: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    spans = ranked.groupBy(*keys, "__range").agg(F.min(F.col("upto") - F.col("n")).alias("lo"), F.max("upto").alias("hi"), F.count("*").alias("levels"))
    sizes = spans.groupBy(*keys).agg(F.max("hi").alias("total"), F.sum("levels").alias("levels"))
    at = sizes.select(*keys, "total", F.posexplode(F.array(*(F.lit(float(p)) for p in probabilities))).alias("k", "p"))
    at = at.withColumn("h", F.col("p") * (F.col("total") - 1)).withColumn("low", F.floor("h"))
    # Each wanted rank is in one range of its key.
    wanted = at.select(*keys, "k", "h", "low", F.explode(F.array(F.col("low"), F.least(F.col("low") + 1, F.col("total") - 1))).alias("rank"))
    if keys:
        wanted = null_safe(wanted, spans, keys)
    else:
        wanted = wanted.join(F.broadcast(spans))  # a row for each range
    wanted = wanted.filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(*keys, "__range", "k", "h", "low", "rank")
    hits = null_safe(ranked, wanted, [*keys, "__range"]).filter((F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto")))
    x = F.col(value).cast("double")
    ends = hits.groupBy(*keys, "k").agg(F.min(x).alias("a"), F.max(x).alias("b"), F.first(F.col("h") - F.col("low")).alias("part"))
    values = ends.select(*keys, F.struct("k", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("x")).alias("q"))
    if not keys:
        found = values.agg(F.transform(F.array_sort(F.collect_list("q")), lambda s: s["x"]).alias("q"))
        return sizes.join(F.broadcast(found))  # one row each
    found = values.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("q")), lambda s: s["x"]).alias("q"))
    return null_safe(sizes, found, keys)


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value with its number n, the number of rows up to it, and its mid-rank."""
    return ranked_values(df, [], column).drop("__range").withColumn("mid_rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)


def mid_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the average rank of its value among all."""
    return df.join(value_ranks(df, column).select(column, F.col("mid_rank").alias(name)), column)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of the mid-ranks over the rows where both are present, 0 where one is constant.

    Pairs of values are counted once; both columns' ranks come from these counts.
    """
    pairs = staged(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c")), "pairs")

    def ranks(side: str) -> DataFrame:
        counts = pairs.groupBy(side).agg(F.sum("c").alias("n"))
        upto = running_sum(counts, side, "n", "upto")
        # Twice the rank is a whole number, and the mean rank is known: the centred sums below are exact.
        return upto.select(side, (2 * F.col("upto") - F.col("n") + 1).alias(f"r{side}"))

    n = pairs.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"))
    ranked = pairs.join(ranks("x"), "x").join(ranks("y"), "y").join(F.broadcast(n))
    a, b = ((F.col(f"r{s}") - F.col("total") - 1).cast("double") for s in "xy")
    sums = ranked.agg(F.sum(F.col("c") * a * b).alias("ab"), F.sum(F.col("c") * a * a).alias("aa"), F.sum(F.col("c") * b * b).alias("bb"))
    return sums.select(F.coalesce(F.try_divide("ab", F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))), F.lit(0.0)).alias("rho"))


def correlation_ratio(df: DataFrame, group: str, x: str) -> DataFrame:
    """The root of the share of the squared deviations of x that lies between groups."""
    sums = df.filter(F.col(x).isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    whole = sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    off = F.try_divide(F.col("s") * F.col("s"), F.col("n"))
    between, total = F.col("b") - off, F.col("q") - off
    return whole.select(F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(between, total)))).otherwise(0.0).alias("eta"))


def chatterjee_xi(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """1 - n * sum |r_next - r| / (2 * sum l * (n - l)) over rows in the order of x and tie.

    Neighbours across ranges of x are the last row of one and the first of the
    next, so each range is ordered in its own task. Both sums grow with the square
    and the cube of the rows, beyond 64 bits at some millions; they are decimals.
    """
    whole_number = lambda c: c.cast("decimal(19,0)")
    present = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    counted = staged(value_ranks(present, y), "counted")
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"))
    ranked = present.select(x, y, tie).join(counted.select(y, F.col("upto").alias("r"), "n"), y)
    dealt = dealt_by_range(ranked, x, tie).join(F.broadcast(n)).withColumn("l", F.col("n_all") - F.col("r") + F.col("n"))
    steps = dealt.withColumn("step", F.abs(F.lead("r").over(W.partitionBy("__range").orderBy(x, tie)) - F.col("r")))
    inside = steps.groupBy("__range").agg(
        F.sum(whole_number(F.col("step"))).alias("steps"), F.sum(whole_number(F.col("l")) * whole_number(F.col("n_all") - F.col("l"))).alias("bottom"), F.first("n_all").alias("n"),
        F.min_by("r", F.struct(x, tie)).alias("head"), F.max_by("r", F.struct(x, tie)).alias("tail"),
    )
    joined = inside.withColumn("seam", F.abs(F.lead("head").over(W.orderBy("__range")) - F.col("tail")))  # a row for each range
    whole = joined.agg((F.coalesce(F.sum("steps"), F.lit(0)) + F.coalesce(F.sum("seam"), F.lit(0))).alias("s"), F.sum("bottom").alias("b"), F.first("n").alias("n"))
    return whole.select(F.when((F.col("n") >= 3) & (F.col("b") > 0), 1 - F.try_divide(F.col("n").cast("double") * F.col("s").cast("double"), 2 * F.col("b").cast("double"))).otherwise(0.0).alias("xi"))


def normal_scores(df: DataFrame, key: str, column: str) -> DataFrame:
    """key and the van der Waerden score of its value: the normal quantile of mid-rank / (n + 1)."""
    from loomtab.functions.normal import ppf_column

    ranks = staged(value_ranks(df, column), "ranks")
    n = ranks.agg(F.sum("n").alias("total"))
    scores = ranks.join(F.broadcast(n)).select(column, ppf_column(F.col("mid_rank") / (F.col("total") + 1)).alias("score"))
    return df.select(key, column).join(scores, column).select(key, "score")


def rank_uniforms(df: DataFrame, key: str, column: str, edge: float = 1e-4) -> DataFrame:
    """key and mid-rank / (n + 1), cut off at both edges."""
    ranks = staged(value_ranks(df, column), "ranks")
    n = ranks.agg(F.sum("n").alias("total"))
    u = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), F.col("mid_rank") / (F.col("total") + 1)))
    return df.select(key, column).join(ranks.join(F.broadcast(n)).select(column, u.alias("u")), column).select(key, "u")


def midrank_quantiles(df: DataFrame, key: str, column: str) -> DataFrame:
    """key and (mid-rank - 1/2) / n, the middle of the value's step of the distribution function."""
    ranks = staged(value_ranks(df, column), "ranks")
    n = ranks.agg(F.sum("n").alias("total"))
    middle = ranks.join(F.broadcast(n)).select(column, ((F.col("mid_rank") - 0.5) / F.col("total")).alias("q"))
    return df.select(key, column).join(middle, column).select(key, "q")


def percent_ranks(df: DataFrame, key: str, column: str) -> DataFrame:
    """key and (rows below + half of the other equal ones) / (n - 1), one half for a single row."""
    ranks = staged(value_ranks(df, column), "ranks")
    n = ranks.agg(F.sum("n").alias("total"))
    share = F.coalesce(F.try_divide(F.col("upto") - F.col("n") + (F.col("n") - 1) / 2, F.col("total") - 1), F.lit(0.5))
    return df.select(key, column).join(ranks.join(F.broadcast(n)).select(column, share.alias("share")), column).select(key, "share")


def placed(df: DataFrame, *order: str) -> DataFrame:
    """df with ``__place``, from 0, in the order of columns."""
    dealt = dealt_by_range(df, *order)
    totals = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    before = totals.select("__range", (F.sum("n").over(W.orderBy("__range")) - F.col("n")).alias("__before"))  # a row for each range
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(before), "__range").select(*df.columns, (F.col("__before") + own).alias("__place"))


def ordinal_ranks(df: DataFrame, key: str, column: str) -> DataFrame:
    """key and its place, from 0, in the order of column and key."""
    return placed(df.filter(F.col(column).isNotNull()).select(key, column), column, key).select(key, F.col("__place").alias("place"))


def strided(df: DataFrame, order: str, cap: int) -> DataFrame:
    """Rows 0, s, 2s, ... in the order of a column, s the least stride that leaves at most cap of them."""
    n = df.count()
    stride = max(1, -(-n // cap))
    places = ordinal_ranks(df.select(order, F.col(order).alias("__at")), order, "__at") if n else df.select(order, F.lit(0).alias("place"))
    return df.join(places.filter(F.pmod("place", F.lit(stride)) == 0).select(order), order, "left_semi")
