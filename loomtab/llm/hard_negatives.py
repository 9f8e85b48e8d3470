"""Hard negatives by bit-sliced integer products.

Components are integers. Their bit planes are taken most significant first:
after the sign and some planes, a candidate's score is known up to what the
planes to come can add, which is an interval. Each plane halves the intervals,
and a candidate is dropped once its interval lies outside of all that is asked,
or below as many intervals as are wanted. Whoever is left after the last plane
has an exact score.

The same search serves twice: for an anchor's positives (its best of one label)
and for the negatives of each positive (the best of other labels whose scores
lie in a window). Equal vectors of one label are searched once, with their least
ids. Candidates lie in parts and anchors in blocks of a bounded number of
components; a first share of the parts gives each window a limit that the
others start with, so that few of their candidates have to be put together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_counted, ship, stage

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Components in a part of the candidates and in a block of anchors.
PART_CELLS, BLOCK_CELLS = 1 << 22, 1 << 22
#: Anchors whose planes are multiplied together, and the share of candidates below which each goes its own way.
TOGETHER, ALONE = 32, 0.1
#: Least possible limit of a window.
NONE = -(1 << 62)


def usable(df: DataFrame) -> DataFrame:
    """vec_id, label and code (the integer components) of the rows that take part, labels as they count."""
    e, label = F.col("embedding"), F.col("label").cast("long")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.filter(F.col("vec_id").isNotNull() & label.isNotNull() & e.isNotNull() & F.coalesce(sound, F.lit(False)))
    scaled = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    # Scores and all sums on the way have to be long integers.
    largest = F.coalesce(F.array_max(F.transform(scaled, lambda x: F.abs(x))), F.lit(0.0)) + 1
    short = largest * largest * F.size("embedding") < float(1 << 58)
    kept = kept.filter(short)
    relabelled = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return kept.select("vec_id", relabelled.alias("label"), F.transform(scaled, lambda x: F.floor(x)).alias("code"))


def mine(spark: SparkSession, df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by every. For each of an
    anchor's first positives rows of its label, the first negatives rows of
    other labels with a score of least to most per cent of the positive's.
    Higher scores come first, then smaller ids. Rows with a null vec_id, label,
    vector or component, or a component that isn't finite, take no part, nor do
    vectors so long that scores might leave the long integers (components of
    2^18 and more where there are 64); vectors of
    different lengths aren't compared; rows of one vec_id are rows of their own,
    and each of them is an anchor; an empty vector scores 0; other columns are
    ignored; an empty table gives an empty one.
    """
    ship(spark)
    rows = stage(spark, usable(df).withColumns({"row": F.monotonically_increasing_id(), "same": F.xxhash64("label", "code")}), "rows")
    # Of each vector's rows the first ones suffice; salted, so that a frequent vector's rows aren't ordered in one task.
    enough = max(positives, negatives) + 1
    own = ["same", "label", "code"]
    least_ids = rows.withColumn("r", F.row_number().over(W.partitionBy(*own, F.pmod("row", F.lit(64))).orderBy("vec_id", "row"))).filter(F.col("r") <= enough)
    least_ids = least_ids.withColumn("r", F.row_number().over(W.partitionBy(*own).orderBy("vec_id", "row"))).filter(F.col("r") <= enough)
    ids = F.array_sort(F.collect_list(F.struct("vec_id", "row")))
    asking = rows.filter(F.col("vec_id") % every == 0)
    counts = asking.groupBy(*own).agg(F.count("*").alias("n"))
    known = least_ids.groupBy(*own).agg(ids.alias("ids")).join(counts, own, "left")
    known = stage(spark, known.select("*", F.col("ids")[0]["row"].alias("vector"), F.col("ids")[0]["vec_id"].alias("first")), "known")
    cells = known.agg(F.sum(F.size("code")), F.sum(F.when(F.col("n").isNotNull(), F.size("code"))), F.sum("n")).first()
    parts, blocks = (max(1, -(-int(c or 0) // most_cells)) for c, most_cells in ((cells[0], PART_CELLS), (cells[1], BLOCK_CELLS)))
    dealt = known.select("vector", "first", "label", "code", F.size("code").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(parts)).alias("part"))
    asked = known.filter("n is not null").select(F.col("vector").alias("query"), F.col("label").alias("own"), F.col("code").alias("asked"), F.size("code").alias("dim"), F.pmod(F.xxhash64("vector", F.lit(1)), F.lit(blocks)).alias("block"))

    whole = F.array(F.struct(F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"), F.lit(0).cast("long").alias("of")))
    best = search(dealt, asked.withColumn("windows", whole), parts, blocks, positives + 1, True)
    # A vector's rows share their positives' scores; which rows these are differs, as none is its own.
    near = with_ids(best, known).groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    anchors = stage(spark, join_counted(asking, known.filter("n is not null").select(*own, F.col("vector").alias("query"), "n"), own, int(cells[2] or 0)).select("vec_id", "row", "query"), "anchors")
    sized = known.filter("n is not null").select(F.col("vector").alias("query"), "n")
    others = F.flatten(F.transform("near", lambda f: F.transform(F.filter(f["ids"], lambda i: i["row"] != F.col("row")), lambda i: F.struct((-f["score"]).alias("s"), i["vec_id"].alias("id"), i["row"].alias("row")))))
    found = join_counted(anchors, near.join(sized, "query"), ["query"], int(cells[2] or 0)).select("vec_id", "row", "query", F.slice(F.array_sort(others), 1, positives).alias("p"))
    chosen = stage(spark, found, "positives")

    # The positives' scores of a vector, whichever of its rows asks.
    scores = chosen.groupBy("query").agg(F.first(F.transform("p", lambda p: -p["s"])).alias("scores"))
    windows = F.transform(F.array_distinct("scores"), lambda t: F.struct(share(t, least, 99).alias("low"), share(t, most, 0).alias("high"), t.alias("of")))
    windows = F.filter(windows, lambda w: w["low"] <= w["high"])
    worse = search(dealt, asked.join(scores, "query").select(*asked.columns, windows.alias("windows")), parts, blocks, negatives, False)
    each = F.struct((-F.col("score")).alias("s"), F.col("i.vec_id").alias("id"), F.col("i.row").alias("row"))
    listed = with_ids(worse, known).select("query", "of", "score", F.explode("ids").alias("i")).groupBy("query", "of").agg(F.slice(F.array_sort(F.collect_list(each)), 1, negatives).alias("negatives"))
    answers = listed.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("of", "negatives"))).alias("by_score"))
    pairs = join_counted(chosen, answers.join(sized, "query"), ["query"], int(cells[2] or 0)).select("vec_id", "by_score", F.explode("p").alias("p"))
    pairs = pairs.select("vec_id", "p", F.posexplode(F.try_element_at("by_score", -F.col("p.s"))).alias("at", "x"))
    return pairs.select(
        F.col("vec_id").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.col("x.id").alias("negative_id"), (-F.col("p.s")).alias("positive_score"), (-F.col("x.s")).alias("negative_score"),
    )


def share(score: Column, per_cent: int, more: int) -> Column:
    """per_cent of score in whole numbers, rounded down, or up where more is 99."""
    rest = F.pmod(score, F.lit(100))
    return F.call_function("div", score - rest, F.lit(100)) * per_cent + F.call_function("div", rest * per_cent + more, F.lit(100))


def with_ids(found: DataFrame, known: DataFrame) -> DataFrame:
    """found (staged) with the ids of each vector; one may be near to very many queries."""
    counts = found.groupBy("vector").agg(F.count("*").alias("n"))
    return join_counted(found, known.select("vector", "ids").join(counts, "vector"), ["vector"], found.count())


def search(dealt: DataFrame, asked: DataFrame, parts: int, blocks: int, k: int, alike: bool) -> DataFrame:
    """query, of (the score that a window belongs to), vector and score: the first k vectors in each window of a query.

    alike: of the query's own label, else of all others.
    """
    keys = ["dim", "part", "block", *(["label"] if alike else [])]
    asked = asked.withColumn("label", F.col("own")) if alike else asked
    asked = asked.withColumns({n: F.col(f"windows.{n}") for n in ("low", "high", "of")}).drop("windows")

    def work(left, right):
        from loomtab.llm import hard_negatives as h

        return h.block_answers(left, right, k, alike)

    def turn(first: int, last: int, asks: DataFrame) -> DataFrame:
        given = dealt.filter((F.col("part") >= first) & (F.col("part") <= last)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        wanted = asks.withColumn("part", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        pair = given.groupBy(*keys).cogroup(wanted.withColumn("block", F.col("block").cast("int")).groupBy(*keys))
        got = pair.applyInPandas(work, "query long, of long, vector long, first long, score long")
        order = W.partitionBy("query", "of").orderBy(F.desc("score"), "first", "vector")
        return got.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")

    spark = dealt.sparkSession
    asked = asked.withColumn("limits", F.transform("of", lambda _: F.lit(NONE)))
    opening = int(parts**0.5) if parts > 1 else parts
    found = stage(spark, turn(0, opening - 1, asked), "opening")
    if opening < parts:
        limits = found.groupBy("query", "of").agg(F.when(F.count("*") == k, F.min("score")).alias("limit"))
        limits = limits.filter("limit is not null").groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("of", "limit"))).alias("by_of"))
        begun = asked.drop("limits").join(limits, "query", "left").withColumn("limits", F.transform("of", lambda o: F.coalesce(F.try_element_at(F.col("by_of"), o), F.lit(NONE)))).drop("by_of")
        more = found.unionByName(turn(opening, parts - 1, begun))
        order = W.partitionBy("query", "of").orderBy(F.desc("score"), "first", "vector")
        found = stage(spark, more.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r"), "found")
    return found.drop("first")


def block_answers(given: pd.DataFrame, wanted: pd.DataFrame, k: int, alike: bool) -> pd.DataFrame:
    """For each query of a block and each of its windows the first k candidates of a part."""
    out = [np.zeros((5, 0), np.int64)]
    if len(given) and len(wanted):
        sliced = Sliced(np.array(given["code"].tolist(), np.int64).reshape(len(given), -1))
        labels, first, vectors = (given[c].to_numpy(np.int64) for c in ("label", "first", "vector"))
        queries = np.array(wanted["asked"].tolist(), np.int64).reshape(len(wanted), -1)
        for start in range(0, len(wanted), TOGETHER):
            some = wanted.iloc[start : start + TOGETHER]
            windows = [list(zip(*w, strict=True)) for w in zip(some["low"], some["high"], some["limits"], strict=True)]
            allowed = np.ones((len(some), len(given)), bool) if alike else labels[None, :] != some["own"].to_numpy(np.int64)[:, None]
            found = sliced.search(queries[start : start + TOGETHER], windows, allowed, k)
            for query, keys, asked, (at, scores) in zip(some["query"], some["of"], windows, found, strict=True):
                for of, (low, high, limit) in zip(keys, asked, strict=True):
                    within = np.flatnonzero((scores >= max(low, limit)) & (scores <= high))
                    top = within[np.lexsort((vectors[at[within]], first[at[within]], -scores[within]))[:k]]
                    out.append(np.stack([np.full(len(top), query), np.full(len(top), of), vectors[at[top]], first[at[top]], scores[top]]))
    return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["query", "of", "vector", "first", "score"])


class Sliced:
    """Candidates' integer components as bit planes: the sign, then from the most significant down."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.planes = int(np.abs(np.where(codes < 0, ~codes, codes)).max(initial=0)).bit_length()

    def plane(self, p: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Bit p of each component: a matrix of zeros and ones."""
        return ((self.codes[at] >> p) & 1).astype(np.float64)

    def search(self, queries: np.ndarray, windows: list[list[tuple]], allowed: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the candidates that no window lets drop, and their exact scores."""
        # Products of a plane are summed as doubles while they are exact, else as integers.
        exact = float(np.abs(queries).sum(1, dtype=np.float64).max(initial=0)) < 1 << 52
        q = queries.astype(np.float64) if exact else queries
        plus, minus = np.maximum(queries, 0).sum(1), np.minimum(queries, 0).sum(1)
        times = (lambda a, b: (a @ b.T).astype(np.int64)) if exact else (lambda a, b: a @ b.astype(np.int64).T)
        columns = np.flatnonzero(allowed.any(0))
        if not len(columns):
            return [(columns, np.zeros(0, np.int64))] * len(queries)
        alive = allowed[:, columns]
        scores = -times(q, (self.codes[columns] < 0).astype(np.float64)) << self.planes
        p = self.planes
        while True:
            rest = (1 << p) - 1
            for r in range(len(q)):
                alive[r] &= self.standing(scores[r], alive[r], rest * int(minus[r]), rest * int(plus[r]), windows[r], k)
            if p == 0 or alive.mean() < ALONE:
                break
            if (some := alive.any(0)).mean() < 0.5:
                columns, alive, scores = columns[some], alive[:, some], scores[:, some]
            p -= 1
            scores += times(q, self.plane(p, columns)) << p
        return [self.finish(columns[alive[r]], scores[r][alive[r]], q[r : r + 1], p, int(minus[r]), int(plus[r]), windows[r], k, times) for r in range(len(q))]

    def finish(self, at, scores, query, p, minus, plus, windows, k, times):
        """The planes to come for a query's few candidates."""
        while p and len(at):
            p -= 1
            scores = scores + (times(query, self.plane(p, at))[0] << p)
            rest = (1 << p) - 1
            stay = self.standing(scores, np.ones(len(at), bool), rest * minus, rest * plus, windows, k)
            at, scores = at[stay], scores[stay]
        return at, scores

    @staticmethod
    def standing(scores: np.ndarray, alive: np.ndarray, below: int, above: int, windows: list[tuple], k: int) -> np.ndarray:
        """The candidates whose interval may still hold one of a window's first k."""
        stay = np.zeros(len(scores), bool)
        lower, upper = scores + below, scores + above
        for low, high, limit in windows:
            least = max(low, limit)
            sure = lower[alive & (lower >= least) & (upper <= high)]
            if len(sure) >= k:
                least = max(least, int(np.partition(sure, len(sure) - k)[len(sure) - k]))
            stay |= (upper >= least) & (lower <= high)
        return stay
