"""Boosted oblivious trees for a number, two classes or many, from one histogram table a level.

A level of a tree is one aggregation: for each leaf, feature and code the sums
of both derivatives of all outputs. Its size, leaves x features x codes x
outputs, doesn't grow with rows; the driver chooses the split from it and reads
the leaves' values off the last level. Nothing is written between trees: outputs
are expressions of the codes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of a feature.
LEVELS = 256
#: Cells of a level's histograms that one pass of boost_arrays sums; more are summed feature by feature.
MOST_CELLS = 2_000_000


@dataclass
class Trees:
    """Trees that share their splits among all outputs; leaves hold a value for each output."""

    outputs: int
    depth: int
    base: list[float]
    features: list[str] = field(default_factory=list)  # depth of them for each tree
    thresholds: list[int] = field(default_factory=list)
    leaves: list[list[list[float]]] = field(default_factory=list)  # tree, leaf, output

    def cut(self, trees: int) -> Trees:
        """The first trees alone."""
        at = trees * self.depth
        return Trees(self.outputs, self.depth, self.base, self.features[:at], self.thresholds[:at], self.leaves[:trees])

    def leaf(self, tree: int) -> Column:
        out = F.lit(0)
        for k in range(self.depth):
            at = tree * self.depth + k
            out = out + F.when(F.col(self.features[at]) > self.thresholds[at], 1 << k).otherwise(0)
        return out

    def margins(self) -> list[Column]:
        """A column for each output, over columns of codes."""
        out = [F.lit(float(b)) for b in self.base]
        for t, values in enumerate(self.leaves):
            leaf = self.leaf(t)
            out = [m + F.get(F.array(*(F.lit(float(v[k])) for v in values)), leaf) for k, m in enumerate(out)]
        return out

    def of_codes(self, codes: np.ndarray, names: list[str]) -> np.ndarray:
        """The same over an array of codes, a column for each name."""
        at = {n: k for k, n in enumerate(names)}
        out = np.tile(np.array(self.base, float), (len(codes), 1))
        for t, values in enumerate(self.leaves):
            leaf = np.zeros(len(codes), int)
            for k in range(self.depth):
                leaf |= (codes[:, at[self.features[t * self.depth + k]]] > self.thresholds[t * self.depth + k]).astype(int) << k
            out += np.array(values)[leaf]
        return out


def softmax(margins: list[Column]) -> list[Column]:
    if len(margins) == 1:
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), margins[0]))))
        return [p]
    top = F.greatest(*margins)
    parts = [F.exp(m - top) for m in margins]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [p / total for p in parts]


def derivatives(margins: list[Column], y: Column, classes: int) -> tuple[list[Column], list[Column]]:
    """First and second derivatives of the loss by each output: squared error without classes, else the log loss of y, a class's number."""
    if not classes:
        return [margins[0] - y], [F.lit(1.0)]
    p = softmax(margins)
    hit = [(y == (1 if classes == 2 else k)).cast("double") for k in range(len(p))]
    return [a - b for a, b in zip(p, hit, strict=True)], [a * (1 - a) for a in p]


def loss(margins: list[Column], y: Column, classes: int) -> Column:
    if not classes:
        return F.pow(margins[0] - y, 2)
    p = softmax(margins)
    own = F.when(y == 1, p[0]).otherwise(1 - p[0]) if classes == 2 else F.get(F.array(*p), y.cast("int"))
    return -F.ln(F.greatest(own, F.lit(1e-7)))


def mean_loss(df: DataFrame, trees: Trees, y: str, classes: int = 0) -> float | None:
    """The mean loss of the trees over df, whose columns are codes and y."""
    scored = df.select(F.col(y).cast("double").alias("__y"), *(m.alias(f"__m{k}") for k, m in enumerate(trees.margins()))).filter("__y is not null")
    return scored.agg(F.avg(loss([F.col(f"__m{k}") for k in range(trees.outputs)], F.col("__y"), classes))).first()[0]


def histogram(df: DataFrame, leaf: Column, codes: list[str], g: list[Column], h: list[Column]) -> DataFrame:
    """leaf, feature, code, n, and g and h, the sums of both derivatives by output."""
    return histograms(df, codes, [(leaf, g, h)]).drop("model")


def histograms(df: DataFrame, codes: list[str], models: list[tuple[Column, list[Column], list[Column]]]) -> DataFrame:
    """The histograms of several models, each with leaves and derivatives of its own, by model."""
    outputs = len(models[0][1])
    own = [F.struct(F.lit(m).alias("model"), leaf.alias("leaf"), *(x.cast("double").alias(f"g{k}") for k, x in enumerate(g)), *(x.cast("double").alias(f"h{k}") for k, x in enumerate(h))) for m, (leaf, g, h) in enumerate(models)]
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("int").alias("code")) for c in codes))
    rows = df.select(F.explode(F.array(*own)).alias("m"), cells.alias("cells")).select("m.*", F.explode("cells").alias("f"))
    each = lambda n: F.array(*(F.sum(f"{n}{k}") for k in range(outputs))).alias(n)
    return rows.groupBy("model", "leaf", F.col("f.feature").alias("feature"), F.col("f.code").alias("code")).agg(F.count("*").alias("n"), each("g"), each("h"))


def tables_of(counts: DataFrame, codes: list[str], models: int, leaves: int, outputs: int) -> np.ndarray:
    """Collected histograms as an array: model, leaf, feature, code, and n, the outputs' g and h."""
    at = {c: k for k, c in enumerate(codes)}
    out = np.zeros((models, leaves, len(codes), LEVELS, 1 + 2 * outputs))
    for r in counts.collect():  # models x leaves x features x codes
        out[r["model"], r["leaf"], at[r["feature"]], min(max(r["code"], 0), LEVELS - 1)] = [r["n"], *r["g"], *r["h"]]
    return out


def best_split(table: np.ndarray, penalty: float, least: int) -> tuple[int, int, float] | None:
    """feature, code and gain of the split (code or less to one side) that all leaves share; ties to the first feature, then the least code."""
    outputs = (table.shape[-1] - 1) // 2
    left = np.cumsum(table, axis=2)
    right = left[:, :, -1:] - left
    part = lambda s: (s[..., 1 : 1 + outputs] ** 2 / (s[..., 1 + outputs :] + penalty)).sum((0, -1))
    gain = part(left) + part(right)
    able = (left[..., 0].sum(0) >= least) & (right[..., 0].sum(0) >= least)
    if not able.any():
        return None
    gain = np.where(able, np.round(gain, 9), -np.inf)
    feature, code = divmod(int(np.argmax(gain)), LEVELS)
    return feature, code, float(gain[feature, code])


def boost(df: DataFrame, codes: list[str], y: str, classes: int = 0, trees: int = 12, depth: int = 2, eta: float = 0.3, penalty: float = 1.0, least: int = 20, hold: Column | None = None, patience: int = 3, start: list[Column] | None = None) -> Trees:
    """Trees by Newton boosting of y, a number, or the number of one of so many classes.

    start has a margin for each output that the trees add to, such as a linear
    model's. The rows where hold is true only say when to stop: after patience
    trees without a lower loss, those beyond the best number go. Rows without y
    are left out; an empty table, or one of too few rows for any split, gives no
    trees, only the base.
    """
    return boost_many(df, codes, y, [start], classes, trees, depth, eta, penalty, least, hold, patience)[0]


def boost_many(df: DataFrame, codes: list[str], y: str, starts: list[list[Column] | None], classes: int = 0, trees: int = 12, depth: int = 2, eta: float = 0.3, penalty: float = 1.0, least: int = 20, hold: Column | None = None, patience: int = 3) -> list[Trees]:
    """Trees for each of the starts, grown side by side: a level of all models is one aggregation."""
    outputs = classes if classes > 2 else 1
    target = F.col(y).cast("double")
    rows = df.filter(target.isNotNull())
    held = F.coalesce(hold, F.lit(False)) if hold is not None else F.lit(False)
    train = rows.filter(~held)
    base = [0.0] * outputs
    if any(s is None for s in starts):
        shares = train.agg(F.avg(target), *(F.avg((target == (1 if classes == 2 else k)).cast("double")) for k in range(outputs))).first()
        if not classes:
            base = [float(shares[0] or 0.0)]
        else:
            p = [min(max(s if s is not None else 0.5, 1e-6), 1 - 1e-6) for s in shares[1:]]
            base = [float(np.log(x / (1 - x))) for x in p] if classes == 2 else [float(np.log(x)) for x in p]
    found = [Trees(outputs, depth, base if s is None else [0.0] * outputs) for s in starts]

    def margins(m: int) -> list[Column]:
        return [a + b for a, b in zip(found[m].margins(), starts[m] or [F.lit(0.0)] * outputs, strict=True)]

    def marked(df: DataFrame, which: list[int]) -> tuple[DataFrame, list[list[Column]]]:
        """df with the margins of models as columns, so that what is made of them doesn't hold them many times over."""
        made = {f"__m{m}_{k}": x for m in which for k, x in enumerate(margins(m))}
        return df.select(*codes, target.alias("__y"), *(x.alias(n) for n, x in made.items())), [[F.col(f"__m{m}_{k}") for k in range(outputs)] for m in which]

    def losses(which: list[int]) -> list[float | None]:
        scored, own = marked(rows.filter(held), which)
        return list(scored.agg(*(F.avg(loss(x, F.col("__y"), classes)) for x in own)).first())

    going = list(range(len(starts)))
    best, sizes = (losses(going), [0] * len(starts)) if hold is not None else ([None] * len(starts), [0] * len(starts))
    for t in range(trees):
        scored, own = marked(train, going)
        slopes = [derivatives(x, F.col("__y"), classes) for x in own]
        leaves, children = [F.lit(0) for _ in going], [None] * len(going)
        for k in range(depth):
            tables = tables_of(histograms(scored, codes, [(leaf, g, h) for leaf, (g, h) in zip(leaves, slopes, strict=True)]), codes, len(going), 1 << k, outputs)
            for i, m in enumerate(going):
                split = best_split(tables[i], penalty, least)
                feature, code = split[:2] if split else (0, LEVELS - 1)
                found[m].features.append(codes[feature])
                found[m].thresholds.append(code)
                leaves[i] = leaves[i] + F.when(F.col(codes[feature]) > code, 1 << k).otherwise(0)
                left = tables[i][:, feature, : code + 1].sum(1)
                children[i] = np.concatenate((left, tables[i][:, feature].sum(1) - left))
        for i, m in enumerate(going):
            found[m].leaves.append((-eta * children[i][:, 1 : 1 + outputs] / (children[i][:, 1 + outputs :] + penalty)).tolist())
        # A tree without a split ends its model.
        ended = {m for m in going if all(c == LEVELS - 1 for c in found[m].thresholds[-depth:])}
        for m in ended:
            found[m] = found[m].cut(t)
        going = [m for m in going if m not in ended]
        if hold is not None and going:
            for m, now in zip(going, losses(going), strict=True):
                if now is not None and (best[m] is None or now < best[m] - 1e-12):
                    best[m], sizes[m] = now, t + 1
            going = [m for m in going if best[m] is None or t + 1 - sizes[m] < patience]
        if not going:
            break
    return [x.cut(min(sizes[m], len(x.leaves))) if hold is not None and best[m] is not None else x for m, x in enumerate(found)]


def array_derivatives(margins: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """derivatives over arrays, a column for each output."""
    if not classes:
        return margins - y[:, None], np.ones_like(margins)
    if classes == 2:
        p, hit = 1 / (1 + np.exp(-np.clip(margins, -500, 500))), y[:, None] == 1
    else:
        e = np.exp(margins - margins.max(1, keepdims=True))
        p, hit = e / e.sum(1, keepdims=True), y[:, None] == np.arange(classes)
    return p - hit, p * (1 - p)


def boost_arrays(
    total: Callable[[Callable, int], np.ndarray], names: list[str], codes: Callable[[np.ndarray], np.ndarray], starts: list[Callable[[np.ndarray], np.ndarray] | None], classes: int = 0, trees: int = 12, depth: int = 2, eta: float = 0.3,
    penalty: float = 1.0, least: int = 20,
) -> list[Trees]:
    """boost_many where histograms are made from arrays: total(make, size) adds up make(scores, y) over all rows, and codes gives a column of codes for each name.

    Trees are looked up in arrays, so a level costs the same however many trees
    there are; as expressions they are compiled anew, and longer, for each level.
    """
    outputs, d = classes if classes > 2 else 1, len(names)
    base = [0.0] * outputs
    if any(s is None for s in starts):
        wanted = np.array([1]) if classes == 2 else np.arange(outputs)
        hits = lambda z, y: np.concatenate(([len(y)], (y[:, None] == wanted).sum(0) if classes else [y.sum()]))
        n, *shares = total(hits, 1 + outputs)
        p = [float(x / n) if n else 0.5 if classes else 0.0 for x in shares]
        if classes:
            p = [min(max(x, 1e-6), 1 - 1e-6) for x in p]
            p = [float(np.log(x / (1 - x))) for x in p] if classes == 2 else [float(np.log(x)) for x in p]
        base = p
    found = [Trees(outputs, depth, base if s is None else [0.0] * outputs) for s in starts]
    wide = 1 + 2 * outputs

    def tables(going: list[int], k: int, features: range) -> np.ndarray:
        """Histograms of features at level k of the tree that grows: model, leaf, feature, code, and n, the outputs' g and h."""
        grown = [(starts[m], found[m].cut(len(found[m].leaves)), found[m].features[len(found[m].leaves) * depth :], found[m].thresholds[len(found[m].leaves) * depth :]) for m in going]
        shape = (len(going), len(features), (1 << k) * LEVELS, wide)
        at = {n: j for j, n in enumerate(names)}

        def make(z: np.ndarray, y: np.ndarray) -> np.ndarray:
            c, out = codes(z), np.empty(shape)
            for i, (start, forest, own, cuts) in enumerate(grown):
                margins = forest.of_codes(c, names)
                g, h = array_derivatives(margins if start is None else margins + start(z), y, classes)
                leaf = np.zeros(len(z), int)
                for b, (name, cut) in enumerate(zip(own, cuts, strict=True)):
                    leaf |= (c[:, at[name]] > cut).astype(int) << b
                for f, j in enumerate(features):
                    cell = leaf * LEVELS + c[:, j]
                    out[i, f] = np.column_stack([np.bincount(cell, w, shape[2]) for w in (None, *g.T, *h.T)])
            return out.ravel()

        flat = total(make, int(np.prod(shape)))
        return flat.reshape(len(going), len(features), 1 << k, LEVELS, wide).transpose(0, 2, 1, 3, 4)

    going = list(range(len(starts)))
    for t in range(trees):
        children = {}
        for k in range(depth):
            step = max(1, MOST_CELLS // (len(going) * (1 << k) * LEVELS * wide))
            table = np.concatenate([tables(going, k, range(j, min(j + step, d))) for j in range(0, d, step)], axis=2)
            for i, m in enumerate(going):
                split = best_split(table[i], penalty, least)
                feature, code = split[:2] if split else (0, LEVELS - 1)
                found[m].features.append(names[feature])
                found[m].thresholds.append(code)
                left = table[i][:, feature, : code + 1].sum(1)
                children[m] = np.concatenate((left, table[i][:, feature].sum(1) - left))
        for m in going:
            found[m].leaves.append((-eta * children[m][:, 1 : 1 + outputs] / (children[m][:, 1 + outputs :] + penalty)).tolist())
        # A tree without a split ends its model.
        ended = {m for m in going if all(c == LEVELS - 1 for c in found[m].thresholds[-depth:])}
        for m in ended:
            found[m] = found[m].cut(t)
        going = [m for m in going if m not in ended]
        if not going:
            break
    return found
