"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words and pairs of neighbouring words are hashed into 2^18 weights. A text's
features are its distinct hashes, each of the value 1 / sqrt(their number), so
a score is a sparse dot product. Training visits a bounded sample of labelled
rows (``MOST_TRAINING_ROWS``, those of least hash) in a fixed order; scoring
reads every text whole.

One fold of the training rows is set apart to choose the regularisation
(``STRENGTHS``), and to move the bias so that ``THRESHOLD`` cuts where good and
bad texts are best told apart there while ``KEPT_SHARE`` of the good ones stay.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stage
from .near_dup import CACHE_ENTRIES, _words, mixed

BITS = 18
MOST_TRAINING_ROWS = 8_000
#: Features of all training rows together, 64 MB of them: rows beyond are no examples.
MOST_TRAINING_FEATURES = 16_000_000
EPOCHS = 4
ALPHA, BETA = 2.0, 1.0
#: L1 and L2 to choose from.
STRENGTHS = ((0.0005, 0.05), (0.005, 0.2), (0.02, 1.0))
#: Of the rows that aren't held out, those of this remainder choose, for as many passes over the others.
FOLDS, CHOOSING, CHOOSING_EPOCHS = 5, 1, 2
THRESHOLD = 0.3
KEPT_SHARE = 0.98
#: Rows of each label that the choosing fold needs.
LEAST_CHOOSING = 20


def features(text: bytes) -> np.ndarray:
    """Distinct hashes of the words and pairs of words of a text, sorted."""
    if len(_words) >= CACHE_ENTRIES:
        _words.clear()
    words = text.split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    pairs = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
    return np.unique(np.concatenate((h, pairs)) >> np.uint64(64 - BITS)).astype(np.int32)


def margin(weights: np.ndarray, bias: float, found: np.ndarray) -> float:
    return bias + float(weights[found].sum(dtype=np.float64)) / max(1.0, len(found) ** 0.5)


def score_of(m: float) -> float:
    return float(1 / (1 + np.exp(-min(max(m, -500.0), 500.0))))


def train(rows: list[tuple[np.ndarray, int]], l1: float, l2: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after so many passes of FTRL-proximal updates over (features, label)."""
    size = (1 << BITS) + 1  # the last is the bias, which isn't regularised
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(7)

    def weights(at) -> np.ndarray:
        own = np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + l2))
        own[-1] = -z[-1] * ALPHA / (BETA + np.sqrt(n[-1]))
        return own

    for _ in range(epochs):
        for k in order.permutation(len(rows)).tolist():
            found, label = rows[k]
            at = np.append(found, size - 1)
            value = np.append(np.full(len(found), 1 / max(1.0, len(found) ** 0.5)), 1.0)
            own = weights(at)
            g = (score_of(float(own @ value)) - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * own
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1].astype(np.float32), float(w[-1])


def chosen(rows: list[tuple[np.ndarray, int]], choosing: list[tuple[np.ndarray, int]]) -> tuple[float, float, float]:
    """L1, L2 and the margin at which to cut, by what models of rows say of the choosing rows."""
    labels = np.array([y for _, y in choosing])
    if min(labels.sum(), len(labels) - labels.sum()) < LEAST_CHOOSING or not rows:
        return *STRENGTHS[0], float(np.log(THRESHOLD / (1 - THRESHOLD)))
    best = None
    for l1, l2 in STRENGTHS:
        weights, bias = train(rows, l1, l2, CHOOSING_EPOCHS)
        margins = np.array([margin(weights, bias, f) for f, _ in choosing])
        loss = float(np.logaddexp(0, np.where(labels == 1, -margins, margins)).mean())
        if best is None or loss < best[0]:
            best = loss, l1, l2, margins
    _, l1, l2, margins = best
    levels = np.unique(margins)
    cuts = np.concatenate(([levels[0] - 1], (levels[1:] + levels[:-1]) / 2))
    kept = 1 - np.searchsorted(np.sort(margins[labels == 1]), cuts) / labels.sum()
    passed = 1 - np.searchsorted(np.sort(margins[labels == 0]), cuts) / (len(labels) - labels.sum())
    return l1, l2, float(cuts[np.argmax(np.where(kept >= KEPT_SHARE, kept - passed, -1))])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from the labelled rows that aren't held out.

    A row is held out if the remainder of its id's CRC-32 is 0. Labels other
    than 0 and 1, and null ids, are no examples; a document with several labels
    is an example of each, and so is each text of an id, once. Without examples
    all weights are 0, and all scores one half. The driver gets the features of
    MOST_TRAINING_ROWS rows at most, those of least hash, and no more than
    MOST_TRAINING_FEATURES.
    """
    ship(spark)
    usable = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    usable = usable.filter(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).distinct()
    usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(MOST_TRAINING_ROWS)

    def run(batches):
        from loomtab.llm import quality_classifier as q

        for batch in batches:
            found = [q.features(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("label"), batch.column("key"), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())],
                names=["doc_id", "label", "key", "n", "found"],
            )

    examples = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").withColumn("key", F.xxhash64("doc_id", "label", "text"))
    keys = examples.select("key").distinct().orderBy("key").limit(MOST_TRAINING_ROWS)
    examples = examples.join(F.broadcast(keys), "key", "left_semi").select("doc_id", "label", "key", "text")
    made = stage(spark, examples.mapInArrow(run, "doc_id string, label int, key long, n long, found binary").dropDuplicates(["key"]), "examples")
    sizes = sorted((r["key"], r["n"]) for r in made.select("key", "n").collect())
    within = np.cumsum([n for _, n in sizes]) <= MOST_TRAINING_FEATURES
    if not within.any():
        return np.zeros(1 << BITS, np.float32), 0.0
    got = made.filter(F.col("key") <= sizes[int(within.sum()) - 1][0]).select("doc_id", "label", "key", "found").collect()
    got.sort(key=lambda r: r["key"])
    rows = [(crc32(r["doc_id"].encode()) % FOLDS, np.frombuffer(bytes(r["found"]), np.int32), r["label"]) for r in got]
    l1, l2, cut = chosen([r[1:] for r in rows if r[0] != CHOOSING], [r[1:] for r in rows if r[0] == CHOOSING])
    weights, bias = train([r[1:] for r in rows], l1, l2)
    return weights, bias - cut + float(np.log(THRESHOLD / (1 - THRESHOLD)))


def score(spark: SparkSession, docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    A null text counts as an empty one, scored by the bias alone; equal rows
    get equal scores; a row of null doc_id isn't held out; other columns are
    ignored; an empty table gives an empty one.
    """
    ship(spark)
    held = spark.sparkContext.broadcast(weights)  # 2^18 numbers, whatever the input

    def run(batches):
        from loomtab.llm import quality_classifier as q

        w = held.value
        for batch in batches:
            scores = [q.score_of(q.margin(w, bias, q.features(t or b""))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            out = [crc32(str(i).encode()) % FOLDS == 0 if i is not None else False for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
