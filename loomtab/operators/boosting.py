"""Conditional models fitted by aggregations: logistic and multiclass regression, oblivious boosted trees, noise and temperature.

Rows never leave the executors. A Newton step is one sum of outer products; a
tree's level is one count by leaf, feature and code, whose size is bounded by
leaves x features x 256.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions import normal
from loomtab.operators.columns import correlation, gram
from loomtab.operators.ranks import bracketed, quantiles
from loomtab.session import staged

LEVELS = 256
#: Spread of the logarithm of an absolute normal deviate: its mean.
LOG_ABS_NORMAL = -0.635181422730739
RESIDUAL_GRID = np.linspace(-3, 3, 9)


def linear(weights: list[float], terms: list[Column]) -> Column:
    """The intercept, first of the weights, and the weighted terms."""
    out = F.lit(float(weights[0]))
    for w, t in zip(weights[1:], terms, strict=True):
        out = out + F.lit(float(w)) * t
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))))


def logistic_step(df: DataFrame, terms: list[Column], y: Column, weights: list[float], penalty: float = 1e-3) -> list[float]:
    """Weights after one Newton step, from one aggregation of weighted sums of products."""
    p = sigmoid(linear(weights, terms))
    w = p * (1 - p)
    every = [F.lit(1.0), *terms]
    k = len(every)
    sums = df.agg(
        F.count("*").alias("n"), *(F.sum(w * every[i] * every[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum((y.cast("double") - p) * every[i]).alias(f"g{i}") for i in range(k))
    ).first()
    if not sums["n"]:
        return weights
    h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    g = np.array([sums[f"g{i}"] or 0.0 for i in range(k)])
    pull = penalty * sums["n"] * np.eye(k)
    pull[0, 0] = 1e-9
    now = np.array(weights)
    step = np.linalg.lstsq(h + pull, g - np.diag(pull) * now, rcond=None)[0]
    return (now + step).tolist()


def logistic(df: DataFrame, terms: list[Column], y: Column, penalty: float = 1e-3, rounds: int = 25, close: float = 1e-8) -> list[float]:
    """Weights of a logistic regression by Newton steps until none moves."""
    weights = [0.0] * (len(terms) + 1)
    for _ in range(rounds):
        new = logistic_step(df, terms, y, weights, penalty)
        moved = max(abs(a - b) for a, b in zip(new, weights, strict=True))
        weights = new
        if moved < close:
            break
    return weights


def one_against_rest(df: DataFrame, terms: list[Column], y: Column, classes: list[str]) -> dict[str, list[float]]:
    """A logistic regression for each class."""
    return {c: logistic(df, terms, y == c) for c in classes}


def class_probabilities(models: dict[str, list[float]], terms: list[Column], temperature: float = 1.0, least: float = 1e-4) -> Column:
    """A map of classes to probabilities: softmax of the logits over the temperature, each at least least before they are scaled to one."""
    logits = {c: linear(w, terms) / temperature for c, w in models.items()}
    top = F.greatest(*logits.values()) if len(logits) > 1 else next(iter(logits.values()))
    parts = F.array(*(F.exp(x - top) for x in logits.values()))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    scaled = F.transform(F.array(parts), lambda a: F.transform(a, lambda x: F.greatest(F.lit(least), x / total(a))))[0]
    shared = F.transform(F.array(scaled), lambda a: F.transform(a, lambda x: x / total(a)))[0]
    return F.map_from_arrays(F.array(*map(F.lit, logits)), shared)


def cross_entropy(probabilities: Column, y: Column, clip: float = 1e-7) -> Column:
    return -F.ln(F.greatest(F.lit(clip), F.coalesce(F.element_at(probabilities, y), F.lit(clip))))


def class_prior(df: DataFrame, y: Column) -> DataFrame:
    """label and its share with half a row added to each class."""
    counts = df.groupBy(y.alias("label")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return counts.join(F.broadcast(whole)).select("label", ((F.col("n") + 0.5) / (F.col("t") + 0.5 * F.col("k"))).alias("prior"))


# --- Oblivious boosted trees.


@dataclass
class Forest:
    depth: int
    base: float
    features: list[str] = field(default_factory=list)  # depth of them for each tree
    thresholds: list[int] = field(default_factory=list)
    leaves: list[list[float]] = field(default_factory=list)

    def leaf(self, tree: int) -> Column:
        out = F.lit(0)
        for k in range(self.depth):
            at = tree * self.depth + k
            out = out + F.when(F.col(self.features[at]) > self.thresholds[at], 1 << k).otherwise(0)
        return out

    def output(self) -> Column:
        """The sum of the trees' leaf values, in the columns of codes."""
        out = F.lit(self.base)
        for t, values in enumerate(self.leaves):
            out = out + F.get(F.array(*(F.lit(float(v)) for v in values)), self.leaf(t))
        return out


def histogram(df: DataFrame, leaf: Column, codes: list[str], g: Column, h: Column) -> DataFrame:
    """leaf, feature, code, and the sums of both derivatives and rows: the table that a level's split is chosen from."""
    rows = df.select(leaf.alias("leaf"), g.alias("g"), h.alias("h"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("int").alias("code")) for c in codes))).alias("f"))
    return rows.groupBy("leaf", F.col("f.feature").alias("feature"), F.col("f.code").alias("code")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def best_split(counts: DataFrame, penalty: float = 1.0, least: int = 20) -> DataFrame:
    """feature, code and gain of the split (code or less to one side) that all leaves of a level share.

    Each side has to hold at least least rows of all leaves together; ties go to
    the first feature, then the least code. Only codes that occur are borders.
    """
    from pyspark.sql import Window as W

    # All leaves meet at each border: a leaf without rows of that code has the sums of the code before.
    borders = counts.select("feature", "code").distinct().join(F.broadcast(counts.select("leaf").distinct()))
    full = borders.join(counts, ["feature", "code", "leaf"], "left").fillna(0.0, ["g", "h"]).fillna(0, ["n"])
    upto = W.partitionBy("feature", "leaf").orderBy("code")
    every = W.partitionBy("feature", "leaf")
    sums = full.select("feature", "code", "leaf", *(F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"), *(F.sum(c).over(every).alias(f"{c}t") for c in "ghn"))
    left, right = F.col("gl") * F.col("gl") / (F.col("hl") + penalty), F.pow(F.col("gt") - F.col("gl"), 2) / (F.col("ht") - F.col("hl") + penalty)
    gains = sums.groupBy("feature", "code").agg(F.sum(left + right).alias("gain"), F.sum("nl").alias("nl"), F.sum("nt").alias("nt"))
    able = gains.filter((F.col("nl") >= least) & (F.col("nt") - F.col("nl") >= least))
    return able.orderBy(F.desc(F.round("gain", 9)), "feature", "code").limit(1).select("feature", "code", "gain")


def boost(df: DataFrame, codes: list[str], y: str, binary: bool = False, trees: int = 8, depth: int = 2, eta: float = 0.3, penalty: float = 1.0, least: int = 20, hold: Column | None = None, patience: int = 3) -> Forest:
    """A forest of oblivious trees by Newton boosting on columns of codes from 0 to 255.

    The rows where hold is true only say when to stop: after patience trees
    without a lower loss, those beyond the best one are dropped. An empty table,
    or one of too few rows for any split, gives a forest of its mean.
    """
    held = F.coalesce(hold, F.lit(False)) if hold is not None else F.lit(False)
    rows = staged(df.select(*codes, F.col(y).cast("double").alias("__y"), held.alias("__held")).filter(F.col("__y").isNotNull()), "rows")
    train = rows.filter("not __held")
    mean = train.agg(F.avg("__y").alias("m")).first()["m"]
    mean = 0.0 if mean is None else float(mean)
    if binary:
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        mean = float(np.log(mean / (1 - mean)))
    forest = Forest(depth, mean)
    best, best_size = None, 0
    for t in range(trees):
        f = forest.output()
        p = sigmoid(f)
        g, h = (p - F.col("__y"), p * (1 - p)) if binary else (f - F.col("__y"), F.lit(1.0))
        current = train.select(*codes, g.alias("__g"), h.alias("__h"))
        leaf = F.lit(0)
        for k in range(depth):
            found = best_split(histogram(current, leaf, codes, F.col("__g"), F.col("__h")), penalty, least).first()
            feature, code = (found["feature"], int(found["code"])) if found else (codes[0], LEVELS - 1)
            forest.features.append(feature)
            forest.thresholds.append(code)
            leaf = leaf + F.when(F.col(feature) > code, 1 << k).otherwise(0)
        sums = {r["leaf"]: (r["g"], r["h"]) for r in current.groupBy(leaf.alias("leaf")).agg(F.sum("__g").alias("g"), F.sum("__h").alias("h")).collect()}
        forest.leaves.append([-eta * sums[j][0] / (sums[j][1] + penalty) if j in sums else 0.0 for j in range(1 << depth)])
        if hold is not None:
            f, target = forest.output(), F.col("__y")
            loss = F.log1p(F.exp(-F.abs(f))) + F.greatest(f, F.lit(0.0)) - target * f if binary else F.pow(f - target, 2)
            now = rows.filter("__held").agg(F.avg(loss).alias("l")).first()["l"]
            if now is not None and (best is None or now < best - 1e-12):
                best, best_size = now, t + 1
            elif now is not None and t + 1 - best_size >= patience:
                break
    if hold is not None and best is not None:
        forest.features, forest.thresholds, forest.leaves = forest.features[: best_size * depth], forest.thresholds[: best_size * depth], forest.leaves[:best_size]
    return forest


# --- Noise.


def noise_scale(df: DataFrame, residual: str, inputs: list[str], penalty: float = 1e-2) -> dict:
    """sigma(x) = exp(linear form of up to four inputs), within a fifth of and four times the deviation, and nine knots of standardised residuals.

    With fewer than 20 rows a coefficient, the deviation alone.
    """
    inputs = inputs[:4]
    r = F.col(residual).cast("double")
    whole = df.agg(F.count(r).alias("n"), F.avg(r * r).alias("v")).first()
    n, sd = whole["n"] or 0, max((whole["v"] or 0.0) ** 0.5, 1e-9)
    k = 1 + len(inputs)
    coefficients = [float(np.log(sd))] + [0.0] * (k - 1)
    if n >= 20 * k:
        terms = {"one": F.lit(1.0), **{c: F.col(c).cast("double") for c in inputs}, "__t": F.ln(F.greatest(F.abs(r), F.lit(1e-6 * sd))) - LOG_ABS_NORMAL}
        names = list(terms)
        sums = {(x["a"], x["b"]): x["product"] or 0.0 for x in gram(df.filter(r.isNotNull()), terms).collect()}
        m = np.array([[sums.get((a, b), sums.get((b, a), 0.0)) for b in names] for a in names])
        pull = penalty * n * np.eye(k)
        pull[0, 0] = 0.0
        coefficients = np.linalg.solve(m[:-1, :-1] + pull, m[:-1, -1]).tolist()
    lo, hi = 0.2 * sd, 4.0 * sd
    sigma = F.greatest(F.lit(lo), F.least(F.lit(hi), F.exp(linear(coefficients, [F.col(c).cast("double") for c in inputs]))))
    spread = df.agg(F.avg(F.pow(r / sigma, 2)).alias("v")).first()["v"]
    scale = max((spread or 1.0) ** 0.5, 1e-9)
    coefficients[0] += float(np.log(scale))
    grid = normal.cdf(RESIDUAL_GRID).tolist()
    q = quantiles(df.select((r / sigma / scale).alias("value")), [], "value", grid).first()
    return {"coefficients": coefficients, "lo": lo, "hi": hi, "knots": q["q"] if q and q["q"] else RESIDUAL_GRID.tolist()}


def temperatures(df: DataFrame, logit: Column, y: Column, grid: list[float]) -> DataFrame:
    """temperature and the mean log loss of logits divided by it, for a grid, in one aggregation; the least is the fitted one."""
    yy = y.cast("double")
    losses = [F.struct(F.lit(float(t)).alias("temperature"), F.avg(F.log1p(F.exp(-F.abs(logit / t))) + F.greatest(logit / t, F.lit(0.0)) - yy * logit / t).alias("loss")) for t in grid]
    return df.agg(F.array(*losses).alias("all")).select(F.explode("all").alias("t")).select("t.*")


def cumulative_noise(df: DataFrame, key: str, p: Column) -> DataFrame:
    """key and the drawn class of a binary probability by the key's hash: the same in any engine and partition."""
    from loomtab.functions.cells import hashed

    return df.select(key, (hashed(F.col(key), "draw") / F.lit(4294967296.0) < p).alias("drawn"))


# --- Screening.


def associations(df: DataFrame, features: dict[str, Column], y: Column) -> DataFrame:
    """feature, rho and place: features by absolute correlation of mid-ranks with the target, ties in the features' order."""
    from pyspark.sql import Window as W

    from loomtab.operators.ranks import spearman

    out = None
    for j, (n, c) in enumerate(features.items()):
        row = spearman(df.select(c.cast("double").alias("a"), y.cast("double").alias("b")), "a", "b").select(F.lit(n).alias("feature"), F.lit(j).alias("j"), "rho")
        out = row if out is None else out.union(row)
    return out.select("feature", "rho", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.abs("rho"), 9)), "j")) - 1).alias("place"))  # a row for each feature


def association(df: DataFrame, features: dict[str, Column], y: Column, key: str) -> DataFrame:
    """feature, rho, xi and strength, the greater of |rho| and xi, 0 at least.

    It is 0 with fewer than five pairs, and for a constant feature, whose xi is
    that of the key that breaks its ties.
    """
    from loomtab.operators.ranks import chatterjee_xi, spearman

    out = None
    for n, c in features.items():
        pairs = df.select(c.cast("double").alias("a"), y.cast("double").alias("b"), F.col(key).alias("k"))
        counts = pairs.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("pairs"), (F.min("a") < F.max("a")).alias("varies"))
        row = spearman(pairs, "a", "b").join(F.broadcast(chatterjee_xi(pairs, "a", "b", "k"))).join(F.broadcast(counts))  # a row each
        row = row.select(F.lit(n).alias("feature"), "rho", "xi", F.when((F.col("pairs") >= 5) & F.col("varies"), F.greatest(F.abs("rho"), F.col("xi"), F.lit(0.0))).otherwise(0.0).alias("strength"))
        out = row if out is None else out.union(row)
    return out


def class_association(df: DataFrame, features: dict[str, Column], label: Column) -> DataFrame:
    """feature and eta, the correlation ratio of its mid-ranks by class."""
    from loomtab.operators.ranks import correlation_ratio, mid_ranks

    out = None
    for n, c in features.items():
        ranked = mid_ranks(df.select(c.cast("double").alias("a"), label.alias("label")).filter("a is not null and label is not null"), "a", "r")
        row = correlation_ratio(ranked, "label", "r").select(F.lit(n).alias("feature"), "eta")
        out = row if out is None else out.union(row)
    return out


def correlation_pairs(df: DataFrame, columns: dict[str, Column], deviations: dict[str, float] | None = None, least: int = 10) -> DataFrame:
    """a, b, n and r of all pairs over the rows where both are present, divided by given deviations' product, within 0.995; 0 with fewer than least rows."""
    names = list(columns)
    pairs = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = columns[a].cast("double"), columns[b].cast("double")
            both = x.isNotNull() & y.isNotNull()
            r = correlation(x, y) / F.lit((deviations or {}).get(a, 1.0) * (deviations or {}).get(b, 1.0))
            pairs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("n"), F.when(F.count_if(both) >= least, F.greatest(F.lit(-0.995), F.least(F.lit(0.995), r))).otherwise(0.0).alias("r")))
    return df.agg(F.array(*pairs).alias("all")).select(F.explode("all").alias("p")).select("p.*")


def interaction_gains(df: DataFrame, columns: list[str], y: Column, fold: Column, folds: int = 4) -> DataFrame:
    """a, b and gain: how much less the cell means of two columns' median splits err on each held-out fold than the fold's mean."""
    cut = {c: q[0] if q else 0.0 for c, (_, q) in bracketed(df, {c: F.col(c) for c in columns}, [0.5])[0].items()}
    rows = staged(df.select(fold.alias("fold"), y.cast("double").alias("y"), *((F.col(c) > cut[c]).alias(c) for c in columns)), "rows")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = rows.select("fold", "y", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.concat(F.col(a).cast("string"), F.col(b).cast("string")).alias("cell")) for a, b in pairs))).alias("p"))
    sums = staged(cells.groupBy("fold", "p.a", "p.b", "p.cell").agg(F.sum("y").alias("s"), F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("q")), "sums")
    from pyspark.sql import Window as W

    every, own = W.partitionBy("a", "b", "cell"), W.partitionBy("a", "b", "fold")
    whole = W.partitionBy("a", "b")
    # The means come from the other folds' sums.
    base = F.try_divide(F.sum("s").over(whole) - F.sum("s").over(own), F.sum("n").over(whole) - F.sum("n").over(own))
    mean = F.coalesce(F.try_divide(F.sum("s").over(every) - F.col("s"), F.sum("n").over(every) - F.col("n")), base)
    error = lambda m: F.col("q") - 2 * m * F.col("s") + m * m * F.col("n")
    judged = sums.select("a", "b", error(base).alias("null_error"), error(mean).alias("error"))
    return judged.groupBy("a", "b").agg((1 - F.try_divide(F.sum("error"), F.sum("null_error"))).alias("gain"))
