"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of all pivots by nearness. Each of its
first ``POSTED`` pivots has it in its inverted file, with its order (a byte for
each pivot) and not with its components. A query reads the files of its own
first ``PROBED`` pivots and ranks what it finds there by the footrule distance
of the orders. Only for the best ``RERANKED`` of all files are vectors fetched,
and reranked by the inner product of the original vectors.

Pivots are fitted on a bounded sample; every vector is indexed. Equal vectors
are indexed once, with their least ids, as many as an answer can need. A file
is split into parts of a bounded number of postings, its queries into blocks,
and so are the vectors to rerank, so that no task grows with a file. From a
part a query takes no more than ``SLACK`` times its share of ``RERANKED``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, stage

#: Vectors, those of least hash, from which the pivots are chosen.
MOST_SAMPLED = 8192
#: Postings in a part of an inverted file or vectors in a part to rerank, and queries in a block.
PART_ROWS = 20_000
QUERY_ROWS = 10_000
POSTED, PROBED = 8, 20
#: Vectors that a query reranks, and how far a part may go beyond its share of them.
RERANKED, SLACK = 1200, 3
#: A place in an order takes a byte.
MOST_PIVOTS = 256


def pivots_for(n: int) -> int:
    """The number of pivots: one for 16 vectors, 256 at most."""
    return int(min(MOST_PIVOTS, max(16, n // 16)))


def choose(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows of the sample, each the farthest from those before; then moved to the means of what is nearest to them."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    taken, near = [0], x @ x[0]
    while len(taken) < min(k, len(x)):
        taken.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[taken[-1]])
    centres = x[taken]
    for _ in range(8):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """All pivots for each vector, nearest first, ties to the smaller number."""
    # Scaled by the largest component first, so that no square leaves the range of numbers.
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")


def places(order: np.ndarray) -> np.ndarray:
    """For each vector the place of each pivot in its order."""
    out = np.empty(order.shape, np.uint8)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(order.shape[1], dtype=np.uint8), order.shape), 1)
    return out


def footrule(all_places: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sum over the pivots of how far each stands from its place in the query's order."""
    return np.abs(all_places.astype(np.int16) - own.astype(np.int16)).sum(1, dtype=np.int32)


def usable(df: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return df.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(sound, F.lit(False)))


def search(spark: SparkSession, df: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, its k nearest of the other rows.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows of null vec_id. Vectors of different lengths have no inner
    product: each length has an index of its own. Rows of one vec_id are rows of
    their own, as candidates and as queries. Ties go to the smaller vec_id.
    Other columns are ignored; an empty table gives an empty one.
    """
    ship(spark)
    rows = stage(spark, usable(df).withColumns({"row": F.monotonically_increasing_id(), "same": F.xxhash64("embedding"), "dim": F.size("embedding")}), "vectors")
    found = [of_one_length(spark, rows.filter(F.col("dim") == r["dim"]), every, k) for r in rows.select("dim").distinct().orderBy("dim").collect()]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole


def of_one_length(spark: SparkSession, rows: DataFrame, every: int, k: int) -> DataFrame:
    # Of each vector's rows the least k + 1 suffice; salted, so that a frequent vector's rows aren't ordered in one task.
    salted = W.partitionBy("same", "embedding", F.pmod(F.col("row"), F.lit(64))).orderBy("vec_id", "row")
    least = rows.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1)
    least = least.withColumn("r", F.row_number().over(W.partitionBy("same", "embedding").orderBy("vec_id", "row"))).filter(F.col("r") <= k + 1)
    ids = F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("ids")
    known = stage(spark, least.groupBy("same", "embedding").agg(ids).withColumn("vector", F.col("ids")[0]["row"]), "known")
    n = known.count()
    sample = known.orderBy(F.xxhash64("embedding"), "vector").limit(MOST_SAMPLED).select("embedding").toPandas()["embedding"]
    sample = np.array(sample.tolist(), np.float64)
    centres = choose(sample / np.abs(sample).max(axis=1, keepdims=True), pivots_for(n))

    def order_rows(frames):
        from loomtab.llm import permutation_index as p

        for frame in frames:
            if len(frame):
                got = p.orders(np.array(frame["embedding"].tolist(), np.float64), centres)
                yield pd.DataFrame({"vector": frame["vector"], "places": [x.tobytes() for x in p.places(got)], "near": list(got[:, : p.PROBED].astype(np.int32))})

    asks = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    queries = stage(spark, known.join(asks.select("same", "embedding").distinct(), ["same", "embedding"], "left_semi").select(F.col("vector").alias("query")), "queries")
    placed = stage(spark, known.select("vector", "embedding").mapInPandas(order_rows, "vector long, places binary, near array<int>"), "orders")
    posted = placed.select("vector", "places", F.explode(F.slice("near", 1, POSTED)).alias("pivot"))
    probes = placed.join(queries, F.col("vector") == F.col("query"), "left_semi").select(F.col("vector").alias("query"), F.col("places").alias("own"), "near", F.explode("near").alias("pivot"))

    # The tables of parts and blocks have a row for each pivot, 256 at most.
    parts = posted.groupBy("pivot").agg(F.ceil(F.count("*") / PART_ROWS).cast("long").alias("parts"))
    blocks = probes.groupBy("pivot").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("long").alias("blocks"))
    shape = F.broadcast(stage(spark, parts.join(blocks, "pivot"), "shape"))
    dealt = posted.join(shape, "pivot").withColumns({"part": F.pmod(F.xxhash64("vector"), "parts"), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))}).drop("blocks")
    asking = probes.join(shape, "pivot").withColumns({"block": F.pmod(F.xxhash64("query"), "blocks"), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))}).drop("blocks", "parts")

    def read(key, left, right):
        from loomtab.llm import permutation_index as p

        return p.ranked(left, right, key[0])

    keys = ["pivot", "part", "block"]
    near = dealt.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(read, "query long, vectors binary, apart binary")

    # The best of all files, then their vectors, in parts of a bounded size.
    fetched = -(-n // PART_ROWS)

    def best(pdf):
        from loomtab.llm import permutation_index as p

        return p.nearest_orders(pdf, fetched)

    wanted = stage(spark, near.groupBy("query").applyInPandas(best, "query long, part long, vectors binary"), "wanted")
    turns = -(-wanted.count() // (fetched * QUERY_ROWS)) or 1
    given = known.select("vector", "embedding", F.pmod("vector", F.lit(fetched)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"))
    wanted = wanted.join(known.select(F.col("vector").alias("query"), F.col("embedding").alias("own")), "query").withColumn("turn", F.pmod(F.xxhash64("query"), F.lit(turns)))

    def rerank(left, right):
        from loomtab.llm import permutation_index as p

        return p.answers(left, right, k)

    scored = given.groupBy("part", "turn").cogroup(wanted.groupBy("part", "turn")).applyInPandas(rerank, "query long, vector long, score double")
    # Of a query's vectors the best k + 1 suffice, and some more for ties.
    top = scored.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vector"))), 1, 2 * k + 2).alias("best"))
    found = top.select("query", F.explode("best").alias("b")).select("query", F.col("b.vector").alias("vector"), (-F.col("b.s")).alias("score"))
    named = found.join(known.select("vector", "ids"), "vector").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    # Back to every row that asks: all rows of equal vectors get one answer, each without itself.
    asks = asks.join(known.select("same", "embedding", F.col("vector").alias("query")), ["same", "embedding"]).select("vec_id", "row", "query")
    others = lambda f: F.filter(f["ids"], lambda i: i["row"] != F.col("row"))
    listed = asks.join(named, "query").select(
        F.col("vec_id").alias("query_id"),
        F.flatten(F.transform("found", lambda f: F.transform(others(f), lambda i: F.struct((-f["score"]).alias("s"), i["vec_id"].alias("i"))))).alias("all"),
    )
    ordered = listed.select("query_id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("at", "x"))
    return ordered.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def ranked(postings: pd.DataFrame, asking: pd.DataFrame, pivot: int) -> pd.DataFrame:
    """For each query of a block its nearest of a part of a pivot's file, by footrule distance."""
    out = {"query": [], "vectors": [], "apart": []}
    if len(postings) and len(asking):
        vectors, theirs = postings["vector"].to_numpy(), matrix(postings["places"])
        share = -(-SLACK * RERANKED // (PROBED * int(postings["parts"].iloc[0])))
        by_pivot = np.ascontiguousarray(theirs.T)
        for query, own, order in zip(asking["query"], matrix(asking["own"]), asking["near"], strict=True):
            order = np.asarray(order)
            before = order[: int(np.flatnonzero(order == pivot)[0])]
            near = np.flatnonzero((by_pivot[before] >= POSTED).all(0))  # the rest is in a file that the query reads before
            apart = footrule(theirs[near], own)
            if share < len(near):
                least = np.argpartition(apart, share - 1)[:share]
                near, apart = near[least], apart[least]
            if len(near):
                out["query"].append(query)
                out["vectors"].append(vectors[near].astype("<i8").tobytes())
                out["apart"].append(apart.astype("<i4").tobytes())
    return pd.DataFrame(out).astype({"query": np.int64})


def nearest_orders(pdf: pd.DataFrame, parts: int) -> pd.DataFrame:
    """A query's RERANKED vectors of least footrule distance, by the part that holds them."""
    vectors, apart = np.frombuffer(b"".join(pdf["vectors"]), "<i8"), np.frombuffer(b"".join(pdf["apart"]), "<i4")
    if RERANKED < len(vectors):
        vectors = vectors[np.lexsort((vectors, apart))[:RERANKED]]
    part = vectors % parts
    held = np.unique(part)
    return pd.DataFrame({"query": int(pdf["query"].iloc[0]), "part": held, "vectors": [vectors[part == p].tobytes() for p in held]})


def answers(given: pd.DataFrame, wanted: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best vectors of a part for each query of a block, by inner product."""
    out = {"query": [], "vector": [], "score": []}
    if len(given) and len(wanted):
        given = given.sort_values("vector")
        x, vectors = np.array(given["embedding"].tolist(), np.float64), given["vector"].to_numpy()
        for query, embedding, found in zip(wanted["query"], wanted["own"], wanted["vectors"], strict=True):
            at = np.searchsorted(vectors, np.frombuffer(found, "<i8"))
            scores = (x[at] * np.asarray(embedding, np.float64)).sum(1)
            top = np.lexsort((vectors[at], -scores))[: 2 * k + 2]
            out["query"] += [query] * len(top)
            out["vector"] += vectors[at][top].tolist()
            out["score"] += scores[top].tolist()
    return pd.DataFrame({"query": np.array(out["query"], np.int64), "vector": np.array(out["vector"], np.int64), "score": np.array(out["score"], np.float64)})
