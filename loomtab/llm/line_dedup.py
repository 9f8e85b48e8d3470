"""Removal of repeated runs of lines by winnowing over the lines' hashes.

A unit is a line, or a sentence where a line has several; it keeps what
separates it from the next, so units joined give the text. A window is as few
units as hold ``RUN_WORDS`` words, counted from its first unit on or from its
last one back. Winnowing selects of each window the unit of least hash, the
first of equal ones: neighbouring windows mostly select the same one, so a text
has few of these fingerprints, and only they are stored and counted. Hashes
order longer units first: these are selected by more windows, and fewer of them
stand in texts that share nothing else. Each unit of a repeated run of that many
words or more lies in a window inside the run, and equal windows select equal
units at the same place: so a run that stands twice, in one text or in two, has
a fingerprint that stands twice, for certain.

A fingerprint is stored with the hashes of the windows that selected it. Where
all that meet have the same windows, the later ones repeat the first and go as a
whole; else their windows are compared one by one: each occurrence of a window
that isn't the first of all documents is deleted. No partner has to be chosen,
and none is missed; the texts aren't read again.

Everything is DataFrame operations. Texts meet only the runs to delete; what is
joined and counted are hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, boxed, discard, join_counted, let, stage, unboxed

#: Runs of fewer words stay; all runs of as many are found.
RUN_WORDS = 30


#: Marks the ends of units in texts that don't hold it.
END = "\x01"
SPACES = " \t\n\x0b\x0c\r"


def units(text: Column) -> Column:
    """The units of a text; joined, they give it back. A unit ends after a line feed, or after a stop and a blank."""
    whole = F.coalesce(text, F.lit(""))
    marked = whole
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + END))
    # Plain replacements take a fraction of the time of looking behind at each character.
    return F.when(F.contains(whole, F.lit(END)), F.split(whole, r"(?<=\n)|(?<=[.!?] )")).otherwise(F.split(marked, END))


def odd(text: Column) -> Column:
    """Whether a unit may have blanks at its ends besides those that end it, or other than single spaces inside."""
    found = (F.contains(text, F.lit(x)) for x in ("  ", " \n", "\n ", "\t", "\x0b", "\x0c", "\r", END))
    return reduce(lambda a, b: a | b, found, F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" ")))


def bare(text: Column, is_odd: Column) -> Column:
    """The units with a word, without the blanks at their ends."""
    marked = F.replace(text, F.lit("\n"), F.lit(END))
    for end in ". ", "! ", "? ":
        marked = F.replace(marked, F.lit(end), F.lit(end[0] + END))
    stripped = F.transform(units(text), lambda u: F.btrim(u, F.lit(SPACES)))
    return F.array_remove(F.when(is_odd, stripped).otherwise(F.split(marked, END)), "")


def counted(parts: Column, is_odd: Column) -> Column:
    """The numbers of words of these units, RUN_WORDS at most."""
    split = lambda u: F.size(F.split(u, f"[{BLANKS}]+"))
    # A unit that isn't odd has a word more than blanks.
    count = lambda u: (F.octet_length(u) - F.octet_length(F.replace(u, F.lit(" "), F.lit(""))) + 1)
    capped = lambda words: lambda u: F.least(words(u), F.lit(RUN_WORDS))
    return F.when(is_odd, F.transform(parts, capped(split))).otherwise(F.transform(parts, capped(count)))


#: Bits of a number of words, and of a number of units in a window.
BITS = RUN_WORDS.bit_length()
MASK = (1 << BITS) - 1


def ranked(parts: Column, words: Column) -> Column:
    """The units' hashes, below their words, of which many come first."""

    def of(u: Column, i: Column) -> Column:
        rank = F.lit((1 << BITS - 1) - 2).cast("long") - F.get(words, i)
        return F.shiftleft(rank, 64 - BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(u), BITS))

    return F.transform(parts, of)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, and of all units with a word the hashes by which they are selected."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = let(odd(text), lambda o: let(bare(text, o), lambda p: let(counted(p, o), lambda n: ranked(p, n))))
    return docs.select("doc_id", found.alias("hashes"))


#: Sums are made in blocks of so many units: an array that grows unit by unit is copied each time.
BLOCK_BITS = 5


def begun(words: Column) -> Column:
    """How many words stand before each unit."""
    grow = lambda sums, more: F.array_append(sums, F.element_at(sums, -1) + more)
    nothing = F.array(F.lit(0))
    places = F.sequence(F.lit(0), F.greatest(F.shiftright(F.size(words) - 1, BLOCK_BITS), F.lit(0)))
    blocks = F.transform(places, lambda b: F.aggregate(F.slice(words, F.shiftleft(b, BLOCK_BITS) + 1, F.lit(1 << BLOCK_BITS)), nothing, grow))

    def whole(blocks: Column, before: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda x, b: F.transform(F.slice(x, 1, F.size(x) - 1), lambda n: n + F.get(before, b))))

    return let(blocks, lambda x: let(F.aggregate(x, nothing, lambda sums, own: grow(sums, F.element_at(own, -1))), lambda before: whole(x, before)))


def reaches(words: Column) -> Column:
    """The last units of the windows counted from each first unit on, as far as there are such windows."""
    # A unit's number for each of its words: the window ends in the unit of its last word.
    owners = F.flatten(F.transform(words, lambda n, i: F.array_repeat(i, n)))
    return let(owners, lambda u: F.array_compact(F.transform(begun(words), lambda n: F.get(u, n + (RUN_WORDS - 1)))))


def windows(parts: Column, hashes: Column, reached: Column) -> Column:
    """All windows, by first and last unit: first, and gram.

    Windows of a first unit end where RUN_WORDS words are reached, or in a later
    unit from which back no unit after the first has to be in it. gram has a
    hash of the units, and lowest the numbers of units in the window before the
    selected one and after it.
    """

    def gram(first: Column, last: Column) -> Column:
        size = last - first
        # A unit that is a window of its own needs a second hash; in longer windows several hashes would have to agree by chance.
        other = lambda w: F.when(size == 0, F.xxhash64(F.lit(1), F.get(parts, first))).otherwise(F.xxhash64(w))
        place = lambda w: (F.array_position(w, F.array_min(w)) - 1) * MASK + size
        return let(F.slice(hashes, first + 1, size + 1), lambda w: F.shiftleft(other(w), 2 * BITS) + place(w))

    def of(last: Column, first: Column) -> Column:
        most = F.greatest(last, F.coalesce(F.get(reached, first + 1), F.size(hashes)) - 1)
        return F.transform(F.sequence(last, most), lambda end: F.struct(first.alias("first"), gram(first, end).alias("gram")))

    return F.flatten(F.transform(reached, of))


def before(gram: Column) -> Column:
    return F.shiftright(gram, BITS).bitwiseAND(MASK).cast("int")


def after(gram: Column) -> Column:
    return gram.bitwiseAND(MASK).cast("int")


def selected(parts: Column, hashes: Column, found: Column) -> Column:
    """The selected units, each with all windows that selected it: at, hash, first, last, grams."""
    # Both ends of the windows never go back, and so neither does the selected unit.
    at = lambda w: w["first"] + before(w["gram"])
    ats = F.transform(found, at)

    def of(starts: Column, own: Column) -> Column:
        def row(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(found))
            place = F.get(own, start)
            return F.struct(
                place.alias("at"),
                F.get(hashes, place).alias("hash"),
                F.get(found, start)["first"].alias("first"),
                (place + after(F.get(found, end - 1)["gram"])).alias("last"),
                F.slice(found, start + 1, end - start)["gram"].alias("grams"),
            )

        return F.transform(starts, row)

    starts = lambda own: F.array_compact(F.transform(own, lambda x, k: F.when(~x.eqNullSafe(F.get(own, k - 1)), k)))
    return let(ats, lambda own: let(starts(own), lambda s: of(s, own)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each unit that winnowing selects: doc_id, same (the text's hash), at, hash, and the windows that selected it.

    Units are counted without those that have no word. first and last are the
    units that these windows cover, grams the windows, and all a hash of them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def made(p: Column, n: Column, h: Column) -> Column:
        return let(reaches(n), lambda r: let(windows(p, h, r), lambda w: selected(p, h, w)))

    found = let(odd(text), lambda o: let(bare(text, o), lambda p: let(counted(p, o), lambda n: let(ranked(p, n), lambda h: made(p, n, h)))))
    # A plain explode would have its array made twice, once to tell whether it is empty.
    rows = docs.select("doc_id", F.xxhash64("text").alias("same"), F.explode_outer(found).alias("f")).filter(F.col("f").isNotNull())
    return rows.select("doc_id", "same", "f.*").withColumn("all", F.xxhash64("grams"))


def extended(met: DataFrame) -> DataFrame:
    """doc_id, same, hash, and the windows that selected these fingerprints: gram, first and last unit."""
    each = met.select("doc_id", "same", "hash", "at", F.explode("grams").alias("gram"))
    return each.select("doc_id", "same", "hash", "gram", (F.col("at") - before(F.col("gram"))).alias("first"), (F.col("at") + after(F.col("gram"))).alias("last"))


def standing(rows: DataFrame) -> Column:
    """Where a row stands among all documents' units: by doc_id, then text, then first unit."""
    if rows.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return F.struct("doc_id", "same", "first")
    # A number has a place of its own size in a hash table, so that nothing is sorted. Texts of one doc_id are told apart by 30 bits.
    place = F.shiftleft(F.col("same").bitwiseAND((1 << 30) - 1), 30).bitwiseOR(F.col("first").cast("long"))
    return F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + place.cast("decimal(19,0)")


def runs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, same and the runs (array of first and last unit, of those with a word) to delete, for each document that has any."""
    # Documents are told apart by doc_id and the hash of their text; equal rows are one document.
    known = docs.filter("doc_id is not null")
    found = stage(spark, fingerprints(known), "fingerprints")

    # Fingerprints that stand more than once, and where first; those of equal rows, too, which come to nothing below.
    alike = (F.min("all") == F.max("all")).alias("alike")
    marks = stage(spark, found.groupBy("hash").agg(F.count("*").alias("n"), alike, F.min(standing(found)).alias("e")).filter("n > 1"), "marks")
    met = stage(spark, join_counted(found, marks, ["hash"], found.count()), "met")
    parts = ["doc_id", "same", "first", "last"]
    whole = met.filter(F.col("alike") & (standing(met) != F.col("e"))).select(*parts)

    # Where windows differ, of each all occurrences but the first go.
    grams = stage(spark, extended(met.filter("not alike")), "grams")
    firsts = grams.groupBy("hash", "gram").agg(F.count("*").alias("n"), F.min(standing(grams)).alias("e")).filter("n > 1")
    again = join_counted(grams, stage(spark, firsts, "firsts"), ["hash", "gram"], grams.count())
    gone = whole.union(again.filter(standing(again) != F.col("e")).select(*parts))

    # Windows that overlap or follow one another are one run.
    by = W.partitionBy("doc_id", "same").orderBy("first", "last")
    reach = F.max("last").over(by.rowsBetween(W.unboundedPreceding, -1))
    parted = gone.withColumn("starts", F.when(F.col("first") <= reach + 1, 0).otherwise(1))
    run = parted.withColumn("run", F.sum("starts").over(by)).groupBy("doc_id", "same", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    cut = stage(spark, run.groupBy("doc_id", "same").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    for done in (found, met, grams):
        discard(spark, done)
    return cut


def drop_runs(spark: SparkSession, docs: DataFrame, count: str | None = None) -> DataFrame:
    """docs, all columns as they are, with the later runs cut out of text; with count, the number of units removed in a last column of that name.

    A null text stays null and an empty one empty; a row of null doc_id is left
    as it is and is no other's source. Equal rows lose the same runs (the row
    itself isn't its own repeat). Columns of any other name are handed on; an
    empty table gives an empty one; texts of any length are read whole.
    """
    cut = shortened(spark, docs)
    return cut.select(*unboxed(docs, "row", F.col("text")), *([F.col("removed").alias(count)] if count else []))


def shortened(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """row (the columns but text), text without the later runs, and removed, the number of units cut."""
    # The runs have no bound, so they are never broadcast.
    found = runs(spark, docs.select("doc_id", "text")).select(F.col("doc_id").alias("of_id"), F.col("same").alias("of_text"), "runs")
    source = docs.select("text", boxed(docs).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("same"))
    joined = source.join(found.hint("merge"), (F.col("id") == F.col("of_id")) & (F.col("same") == F.col("of_text")), "left")

    def left(parts: Column, is_odd: Column) -> Column:
        """The units outside the runs; those without a word between two of a run go with it."""
        # Of a text that isn't odd, these are line feeds and what the split leaves at the end.
        place = lambda worded: lambda u, i: F.when(worded(u), i)
        slow, fast = place(lambda u: F.btrim(u, F.lit(SPACES)) != ""), place(lambda u: ~u.isin("", "\n"))
        worded = F.array_compact(F.when(is_odd, F.transform(parts, slow)).otherwise(F.transform(parts, fast)))
        places = let(worded, lambda w: F.transform(F.array_sort("runs"), lambda r: F.struct(F.get(w, r["first"]).alias("first"), F.get(w, r["last"]).alias("last"))))

        def kept(cuts: Column) -> Column:
            """What stands before each of the runs, which lie apart and in order, and after the last one."""
            start = lambda k: F.coalesce(F.get(cuts, k - 1)["last"] + 1, F.lit(0))
            end = lambda k: F.coalesce(F.get(cuts, k)["first"], F.size(parts))
            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda k: F.slice(parts, start(k) + 1, end(k) - start(k))))

        return let(places, kept)

    def made(parts: Column) -> Column:
        return let(left(parts, odd(F.col("text"))), lambda l: F.struct(F.array_join(l, "").alias("text"), (F.size(parts) - F.size(l)).cast("long").alias("removed")))

    cut = joined.withColumn("cut", F.when(F.col("runs").isNotNull(), let(units(F.col("text")), made)))
    return cut.select("row", F.when(F.col("cut").isNotNull(), F.col("cut.text")).otherwise(F.col("text")).alias("text"), F.coalesce("cut.removed", F.lit(0).cast("long")).alias("removed"))


def keep(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """drop_runs without the rows whose text it has emptied of words: they only repeat others."""
    cut = shortened(spark, docs).filter((F.col("removed") == 0) | F.col("text").rlike(f"[^{BLANKS}]"))
    return cut.select(*unboxed(docs, "row", F.col("text")))
