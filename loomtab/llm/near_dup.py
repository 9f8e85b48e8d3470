"""Near-duplicate classes by min-max hashing of word shingles.

Each permutation of the shingle hashes gives two values, its minimum and its
maximum, so 64 permutations make 128 values. Both agree for two sets with the
probability of their Jaccard similarity. 32 bands of four values make buckets.

Sets, not rows, are the nodes: rows of equal sets share one digest and are never
paired. Each bucket compares its members with a pivot, the member that meets
most others over all bands; what the confirmed links join is one component.
Members of a pivot's buckets that are then still in different components are
compared with each other in blocks of bounded size, which return only links.
No step has a cap. Signatures screen the pairs with pivots: one whose values
agree in under ``threshold`` less ``SLACK`` is dropped (five standard
deviations). Links are confirmed on the full sets.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import boxed, join_counted, ship, stage, unboxed

PERMUTATIONS = 64
BAND_ROWS = 4
#: Five standard deviations of the share of agreeing values, at a similarity of 0.8.
SLACK = 5 * (0.8 * 0.2 / (2 * PERMUTATIONS)) ** 0.5
#: Bytes of sets, and sets, in a block of the comparison inside a pivot's buckets; the memory of a pair of blocks is bounded by both.
BLOCK_BYTES = 4 << 20
BLOCK_SETS = 1_500
#: Words whose hashes a worker keeps before it starts afresh.
CACHE_ENTRIES = 200_000
#: Shingles hashed at once, which bounds memory for texts of any length.
CHUNK = 4096


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = xxh3_64_intdigest(word)
        if len(self) < CACHE_ENTRIES:
            self[word] = value
        return value


_words = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finaliser of murmur3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z in lower case.

    A text with fewer words has its whole sequence as the only shingle; one
    without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) >= CACHE_ENTRIES:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    own = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        own = mixed(own * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(own)


def signature(hashes: np.ndarray) -> np.ndarray:
    """32-bit minima, then maxima, of a non-empty set under each permutation."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1 << 62, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1 << 62, size=PERMUTATIONS, dtype=np.uint64)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(hashes), CHUNK):
        part = ((hashes[i : i + CHUNK, None] * a + b) >> np.uint64(32)).astype(np.uint32)
        low, high = np.minimum(low, part.min(0)), np.maximum(high, part.max(0))
    return np.concatenate((low, high))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, same (the text's hash), n_shingles, digest of the set (null if it is empty) and its signature, for each row."""
    ship(docs.sparkSession)

    def run(batches):
        from loomtab.llm import near_dup as nd

        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                counts, digests, signs = [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    s = nd.shingle_set(text or b"", width)
                    counts.append(len(s))
                    digests.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signs.append(nd.signature(s).astype("<u4").tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("same"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "same", "n_shingles", "digest", "sign"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("same"), "text").mapInArrow(run, f"doc_id {kind}, same long, n_shingles long, digest binary, sign binary")


def banded(classes: DataFrame) -> DataFrame:
    """digest, n, sign and the key of one bucket a row, for all bands of each class."""

    def run(batches):
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), "<u4").reshape(len(batch), -1)
            bands = signs.shape[1] // BAND_ROWS
            values = np.zeros((len(batch), bands), np.uint64)
            for k in range(BAND_ROWS):
                values = mixed(values + signs[:, k::BAND_ROWS][:, :bands].astype(np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            keys = pa.array(values.view(np.int64).ravel())
            rows = pa.array(np.repeat(np.arange(len(batch)), bands))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(rows), keys], names=["node", "bucket"])

    return classes.select("node", "sign").mapInArrow(run, "node long, bucket long")


def screened(pairs: DataFrame, nodes: DataFrame, least: float, sizes: float | None = None) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share of at least least; with sizes, whose sizes allow that similarity."""

    def run(batches):
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(len(batch), -1) for c in ("sign_a", "sign_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= least))

    sides = {s: nodes.select(F.col("node").alias(s), F.col("sign").alias(f"sign_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab"}
    joined = pairs.join(sides["a"], "a").join(sides["b"], "b")
    if sizes:
        joined = joined.filter(F.least("n_a", "n_b") >= sizes * F.greatest("n_a", "n_b") - 1e-9)
    return joined.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    for s in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(s), F.col("set").alias(f"set_{s}")), s)
    return pairs.select("a", "b", "set_a", "set_b")


def confirmed(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) with denominator * intersection >= numerator * union on the full sets."""

    def run(batches):
        for batch in batches:
            kept = []
            for k, (x, y) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                if denominator * common >= numerator * (len(x) + len(y) - common):
                    kept.append(k)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return with_sets(pairs, sets).mapInArrow(run, "a long, b long")


def linked_in(sets: list[np.ndarray], roots: np.ndarray, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), i < j, of the sets that are linked and have different roots."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Two linked sets share one of the rarest elements of each: those beyond the first ceil(share x size) - 1 of its others.
    order = np.lexsort((element, often[element], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    least = -(-numerator * sizes // denominator)
    early = order[place < (sizes - least + 1)[owner[order]]]
    able = np.zeros(len(sets), bool)
    able[owner[early[often[element[early]] > 1]]] = True
    kept = np.flatnonzero(able)
    if len(kept) < 2:
        return kept[:0], kept[:0]
    own = able[owner] & (often[element] > 1)
    row, (_, column) = (np.cumsum(able) - 1)[owner[own]], np.unique(element[own], return_inverse=True)
    common = np.zeros((len(kept), len(kept)), np.float32)
    for at in range(0, int(column.max()) + 1, CHUNK):
        part = (column >= at) & (column < at + CHUNK)
        dense = np.zeros((len(kept), CHUNK), np.float32)
        dense[row[part], column[part] - at] = 1
        common += dense @ dense.T
    size, root = sizes[kept].astype(np.float32), roots[kept]
    found = denominator * common >= numerator * (size[:, None] + size[None, :] - common)
    found &= root[:, None] != root[None, :]
    i, j = np.nonzero(np.triu(found, 1))
    return kept[i], kept[j]


def linked_apart(groups: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) of nodes of one group (group, node, root) with different roots, compared in pairs of blocks."""
    full = groups.join(sets, "node")
    blocks = full.groupBy("group").agg(F.ceil(F.greatest(F.sum(F.length("set")) / BLOCK_BYTES, F.count("*") / BLOCK_SETS)).cast("long").alias("blocks"))
    dealt = full.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def run(pdf):
        import pandas as pd

        from loomtab.llm import near_dup as nd

        i, j = nd.linked_in([np.frombuffer(x, "<u8") for x in pdf["set"]], pdf["root"].to_numpy(), numerator, denominator)
        nodes = pdf["node"].to_numpy()
        return pd.DataFrame({"a": np.minimum(nodes[i], nodes[j]), "b": np.maximum(nodes[i], nodes[j])})

    return dealt.select("group", "i", "j", "node", "root", "set").groupBy("group", "i", "j").applyInPandas(run, "a long, b long").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node and its root, the least node reachable, for all nodes of links (a, b).

    Each round moves every link to the least neighbours of its ends, the
    large-star and small-star steps, until no link moves; tables are written
    between rounds.
    """
    links = stage(spark, links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # Large star: larger neighbours of a node go to the least of it and its neighbours.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stage(spark, large, "large")
        # Small star: smaller neighbours of a node, and itself, go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        moved = stage(spark, small, "small")
        if moved.join(links, ["a", "b"], "left_anti").isEmpty() and links.join(moved, ["a", "b"], "left_anti").isEmpty():
            return moved.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links = moved


def classes(spark: SparkSession, docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, same, n_shingles, digest) of docs, and digest, root and n (rows) for all sets of any row.

    root is the least doc_id of the class that links of numerator / denominator
    or more reach. A row without words, or with a null text, has no digest.
    """
    rows = stage(spark, sketches(docs, width), "sketches")
    threshold = numerator / denominator
    sets = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sign").alias("sign"), F.count("*").alias("rows"))
    # A node is named by 63 bits of its digest; among n sets, some two share a name with a chance of n * n / 2^64.
    sets = sets.withColumn("node", F.shiftrightunsigned(F.xxhash64("digest"), 1))
    nodes = stage(spark, sets, "nodes")

    buckets = banded(nodes)
    crowd = buckets.groupBy("bucket").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    met = stage(spark, buckets.join(crowd, "bucket", "left_semi"), "buckets")
    of_nodes = nodes.select("node", F.col("least").alias("doc_id"))

    def set_of(wanted: DataFrame) -> DataFrame:
        """node and its full set, read again from one row of the documents for each."""
        texts = docs.select("doc_id", "text").join(of_nodes.join(wanted, "node", "left_semi"), "doc_id")

        def run(batches):
            from loomtab.llm import near_dup as nd

            for batch in batches:
                found = [nd.shingle_set(t or b"", width).astype("<u8").tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary()), pa.array([blake2b(x, digest_size=16).digest() for x in found], pa.binary())], names=["node", "set", "digest"])

        own = texts.select("node", "text").mapInArrow(run, "node long, set binary, digest binary")
        # Rows of one doc_id may differ in text: the digest tells which is meant.
        return own.join(nodes.select("node", "digest"), ["node", "digest"]).dropDuplicates(["node"]).select("node", "set")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()

    crowds = met.groupBy("bucket").agg(F.count("*").alias("crowd"))
    known = met.join(met.join(crowds, "bucket").groupBy("node").agg(F.sum("crowd").alias("fame")), "node")
    pivots = stage(spark, known.groupBy("bucket").agg(F.max_by("node", F.struct("fame", "node")).alias("pivot"), F.count("*").alias("crowd")), "pivots")
    stars = met.join(pivots, "bucket").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    likely = stage(spark, screened(stars, nodes, threshold - SLACK, threshold), "likely")
    links = stage(spark, confirmed(likely, set_of(ends(likely)), numerator, denominator), "confirmed")
    roots = components(spark, links)

    # Buckets of three and more may hold links that no pivot has. Where all are in one component, there are none left.
    placed = met.join(pivots.filter("crowd > 2"), "bucket").select(F.col("pivot").alias("group"), "node").distinct()
    placed = stage(spark, placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    apart = placed.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("group")
    open_ = stage(spark, placed.join(apart, "group", "left_semi"), "open")
    if not open_.isEmpty():
        late = stage(spark, linked_apart(open_, set_of(open_.select("node").distinct()), numerator, denominator), "late")
        if not late.isEmpty():
            roots = components(spark, links.union(late))

    grouped = nodes.select("node", "digest", "least", "rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component"))
    return rows.drop("sign"), grouped.join(named, "root").select("digest", F.col("component").alias("root"), F.col("rows").alias("n"))


def labelled(spark: SparkSession, docs: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """doc_id, same, n_shingles, component_id and kept of each row of docs."""
    rows, roots = classes(spark, docs, width, numerator, denominator)
    full, bare = rows.filter("digest is not null"), rows.filter("digest is null")
    joined = join_counted(full, stage(spark, roots, "roots"), ["digest"], rows.count())
    names = ["doc_id", "same", "n_shingles"]
    both = joined.select(*names, F.coalesce("root", "doc_id").alias("component_id")).union(bare.select(*names, "doc_id"))
    return both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def label(spark: SparkSession, docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text).

    A text without words, or a null one, has an empty set and is linked with
    nothing: its component is its own doc_id. Rows of a null doc_id have a null
    component, unless others share their set, and aren't kept. Equal rows get equal results. Other columns of
    docs, whatever their names, are ignored; an empty table gives an empty one;
    texts of any length are read whole.
    """
    return labelled(spark, docs.select("doc_id", "text"), width, numerator, denominator).drop("same")


def keep(spark: SparkSession, docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """The rows of docs, all columns as they are, of the document that stays of each class.

    Rows are told apart by doc_id and text, so of two texts of one doc_id the one
    that is linked with a kept document goes only if its class has another, smaller
    doc_id; equal rows stay or go together. A row of null doc_id goes if its
    class has a document of an id, and stays otherwise.
    """
    labels = labelled(spark, docs.select("doc_id", "text"), width, numerator, denominator)
    gone = labels.filter(F.col("component_id").isNotNull() & ~F.col("kept")).select(F.col("doc_id").alias("of_id"), F.col("same").alias("of_text")).distinct()
    source = docs.select("text", boxed(docs).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("same"))
    left = source.join(gone, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("same") == F.col("of_text")), "left_anti")
    return left.select(*unboxed(docs, "row", F.col("text")))
