"""Best-fit packing of documents into sequences after a dominance reduction.

Only the number of pieces of each length matters to the plan, and there are at
most ``capacity`` lengths, so the plan is made on the driver from that bounded
histogram, whatever the number of documents. Pieces then find their places by
their rank within their length, in one join with the plan's bounded table.

The reduction takes each length j left, longest first, as Martello and Toth do,
and fixes a set with it for good where that set provably dominates all others
that hold j:

* nothing else fits with j: j alone;
* one piece fills the rest exactly: that pair;
* no two pieces fit with j together: j with the longest that fits;
* no three fit with j together, and the longest that fits is at least as long
  as the longest pair that fits: j with that piece.

What is fixed leaves the instance. This is repeated until nothing can be fixed;
the remainder goes by best fit, longest first.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import stage

CAPACITY = 4096
#: The id that closes each document.
CLOSING_ID = 1
#: Within a length, ranks are counted in parts of about so many pieces, so that no length lands in one task; of a length there are MOST_PARTS at most.
PART_PIECES, MOST_PARTS = 5_000, 100_000


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sets to fix for good, as (times, [(length, copies)]); counts[s], the pieces of length s, shrinks by them."""
    fixed = []

    def most(limit: int) -> int:
        """The longest length left up to limit, 0 if none is."""
        found = np.flatnonzero(counts[1 : limit + 1]) if limit > 0 else ()
        return int(found[-1]) + 1 if len(found) else 0

    def fix(times: int, *lengths: int) -> None:
        sizes = sorted(set(lengths), reverse=True)
        for s in sizes:
            counts[s] -= times * lengths.count(s)
        fixed.append((times, [(s, lengths.count(s)) for s in sizes]))

    def settle(j: int) -> bool:
        """Fix sets with j, if one dominates; whether it did."""
        counts[j] -= 1  # one j is set aside while its partners are sought
        room = capacity - j
        i = most(room)
        if i == 0:
            counts[j] += 1
            fix(int(counts[j]) if 2 * j > capacity else 1, j)
            return True
        small = np.flatnonzero(counts)[:3]
        small = np.repeat(small, np.minimum(counts[small], 3))[:3].tolist() + [capacity, capacity]
        alone, three = sum(small[:2]) > room, sum(small[:3]) <= room
        pair = 0
        if i != room and not alone and not three:  # the longest two that fit with j together
            sizes = np.flatnonzero(counts[: room + 1])
            for a in sizes[::-1].tolist():
                if 2 * a < pair:
                    break
                counts[a] -= 1
                b = most(min(a, room - a))
                counts[a] += 1
                pair = max(pair, a + b if b else 0)
        counts[j] += 1
        if i == room or alone or (not three and i >= pair):
            # The set dominates to the last copy: others only get fewer meanwhile.
            fix(int(counts[j]) // 2 if i == j else int(min(counts[j], counts[i])), j, i)
            return True
        return False

    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while counts[j] and settle(j):
                again = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, of all that counts holds, as (times, [(length, copies)])."""
    open_: dict[int, list[tuple[int, tuple]]] = {}  # room -> [(times, contents)]
    rooms = np.zeros(capacity + 1, np.int64)  # sequences with that room

    def put(room: int, times: int, contents: tuple) -> None:
        open_.setdefault(room, []).append((times, contents))
        rooms[room] += times

    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            found = np.flatnonzero(rooms[s:])
            if len(found):
                room = int(found[0]) + s
                times, contents = open_[room].pop()
                rooms[room] -= times
            else:
                room, contents = capacity, ()
                times = -(-left // (capacity // s))
            each = min(room // s, left)  # the fullest that takes a piece stays the fullest until it takes no more
            full = min(times, left // each)
            if times > full:
                rest = left - full * each
                if rest:
                    put(room - rest * s, 1, (*contents, (s, rest)))
                    left -= rest
                if (idle := times - full - (rest > 0)) and contents:
                    put(room, idle, contents)
            if full:
                put(room - each * s, full, (*contents, (s, each)))
                left -= full * each
        counts[s] = 0
    return [(times, list(contents)) for groups in open_.values() for times, contents in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces: rows of length, first rank, ranks, first sequence, copies in each sequence, offset.

    The piece of this length with rank first + k stands in sequence
    first_sequence + k // copies, from offset + (k % copies) * length.
    """
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        if not 1 <= s <= capacity:
            raise ValueError(f"no piece of length {s} fits a sequence of {capacity}")
        left[s] = n
    groups = reduce_by_dominance(left, capacity)
    groups += best_fit(left, capacity)
    rank, rows, first = dict.fromkeys(counts, 0), [], 0
    for times, contents in groups:
        offset = 0
        for s, copies in contents:
            rows.append((s, rank[s], times * copies, first, copies, offset))
            rank[s] += times * copies
            offset += s * copies
        first += times
    return rows


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row and, with with_ids, the ids of each piece of each document.

    row numbers the pieces, which equal rows of docs don't share.
    """
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def row(_, ids):
        ids = ids + closing
        made = []
        for k, at in enumerate(range(0, len(ids), 4 * capacity)):
            own = ids[at : at + 4 * capacity]
            made.append((k, at // 4, len(own) // 4, crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else [])))
        return made

    cut = bpe.encoded(docs, tokenizer, "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids, row, ["doc_id"])
    return cut.withColumn("row", F.monotonically_increasing_id())


def assign(spark: SparkSession, cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset, without row. cut is read more than once: stage it first.

    The driver gets one row for each length, which capacity bounds. Ranks are
    counted within (length, part), parts by the piece's row number, and lifted by
    the number of pieces in the parts before.
    """
    lengths = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    counts = {r["length"]: r["n"] for r in lengths}
    parts = spark.createDataFrame([(s, min(MOST_PARTS, -(-n // PART_PIECES))) for s, n in counts.items()], "length long, parts long")
    dealt = cut.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    by_part = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    places = spark.createDataFrame(plan(counts, capacity), "length long, first long, ranks long, sequence long, copies long, at long")
    ranked = dealt.withColumn("own", F.row_number().over(W.partitionBy("length", "part").orderBy("row")) - F.lit(1))
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own"))
    k = F.col("rank") - F.col("p.first")
    found = ranked.alias("r").join(F.broadcast(places).alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("p.first")) & (k < F.col("p.ranks")))
    sequence = (F.col("p.sequence") + F.floor(k / F.col("p.copies")).cast("long")).alias("sequence_id")
    offset = (F.col("p.at") + F.pmod(k, F.col("p.copies")) * F.col("r.length")).alias("offset")
    return found.select(*(F.col(f"r.{c}") for c in cut.columns if c != "row"), sequence, offset)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text) with their places in sequences of at most capacity tokens.

    A null text counts as an empty one, whose only token is the closing id.
    Equal rows are packed one by one; a null doc_id is kept; other columns of
    docs are ignored, whatever their names; an empty table gives an empty one.
    """
    cut = stage(spark, pieces(docs, tokenizer, capacity, with_ids), "pieces")
    return assign(spark, cut, capacity)
