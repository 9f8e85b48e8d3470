"""A panel of small fixed models: each one's gain over the mean on held-out folds tells the shape of a table.

Members are bases of expressions. Their sums of products by fold come from one
aggregation for each member; a fold's model is solved from the other folds' sums
on the driver, whose matrices have the size of the basis. Held-out errors come
from the same sums: no rows are scored twice.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.operators.ranks import long_form, quantiles
from loomtab.session import staged

#: Penalties to choose from, by a fifth of the training folds' rows.
PENALTIES = [1e-4, 1e-2, 1.0]
FOLDS = 5
#: The panel's members in order, each with its family.
PANEL = {
    "lin": "additive", "log": "additive", "sqrt": "additive", "pow": "additive", "sat": "additive", "abs": "additive", "hinge": "additive", "step": "additive", "periodic": "additive", "bump": "additive", "rows": "additive",
    "pairs": "interaction", "rff": "kernel", "missing": "missingness", "best1": "dominance", "stump": "tree", "otree3": "tree", "gbdt": "tree", "knn1": "local", "knn16": "local", "net": "neural", "lin_quarter": "curve", "gbdt_quarter": "curve",
}
HINGES, STEPS, WAVES = 7, 15, 64
#: Rows of least hash that stand for all in the members that compare rows with rows.
LOCAL_ROWS = 2_000


def basis(name: str, x: list[Column], missing: list[Column], knots: dict[int, list[float]], ranks: list[Column], seed: int = 7) -> list[Column] | None:
    """The terms of a member that is linear in them, beside the intercept; null for members that aren't."""
    own: list[Column] = list(x)
    shapes = {
        "log": lambda v: [F.asinh(v)], "sqrt": lambda v: [F.signum(v) * F.sqrt(F.abs(v))], "pow": lambda v: [v * v, v * v * v / 3], "sat": lambda v: [F.tanh(v), F.tanh(v / 3)], "abs": lambda v: [F.abs(v)],
        "bump": lambda v: [F.exp(-0.5 * (v - c) * (v - c)) for c in (-1.0, 0.0, 1.0)],
    }
    if name in ("lin", "lin_quarter"):
        return own
    if name in shapes:
        return own + [t for v in x for t in shapes[name](v)]
    if name == "hinge":
        return own + [F.greatest(v - F.lit(q), F.lit(0.0)) for j, v in enumerate(x) for q in knots[j][:HINGES]]
    if name == "step":
        return own + [(v > F.lit(q)).cast("double") for j, v in enumerate(x) for q in knots[j][HINGES:]]
    if name == "periodic":
        return own + [f(F.lit(k * math.pi) * (2 * r - 1)) for r in ranks for k in (1, 2, 3) for f in (F.sin, F.cos)]
    if name == "rows":
        n = len(x)
        total = sum(x[1:], x[0])
        mean = total / n
        squares = sum((v * v for v in x[1:]), x[0] * x[0])
        off = sum(((v - mean) * (v - mean) for v in x[1:]), (x[0] - mean) * (x[0] - mean))
        ends = [F.least(*x), F.greatest(*x)] if n > 1 else [x[0], x[0]]
        return own + [mean, total, sum((F.abs(v) for v in x[1:]), F.abs(x[0])), F.sqrt(squares), F.sqrt(off / n), *ends]
    if name == "pairs":
        return own + [a * b for i, a in enumerate(x[:8]) for b in x[i + 1 : 8]]
    if name == "missing":
        return missing or None
    if name == "rff":
        rng = np.random.default_rng(seed)
        out = []
        for _ in range(WAVES):
            w, phase = rng.normal(size=len(x)) / math.sqrt(len(x)), rng.uniform(0, 2 * math.pi)
            out.append(F.cos(sum((F.lit(float(a)) * v for a, v in zip(w[1:], x[1:], strict=True)), F.lit(float(w[0])) * x[0]) + F.lit(float(phase))) * math.sqrt(2 / WAVES))
        return out
    return None


def solve(g: np.ndarray, penalty: float) -> np.ndarray:
    """Weights from the sums of products of intercept, terms and target; the intercept has no penalty."""
    k = len(g) - 1
    scale = np.sqrt(np.maximum(np.diag(g)[:k] / max(g[0, 0], 1.0), 1e-12))
    pull = penalty * g[0, 0] * np.diag(scale**2)
    pull[0, 0] = 0.0
    return np.linalg.lstsq(g[:k, :k] + pull + 1e-10 * g[0, 0] * np.eye(k), g[:k, k], rcond=None)[0]


def squared_error(g: np.ndarray, w: np.ndarray) -> float:
    """The sum of squared errors of weights over the rows that the sums are of."""
    full = np.append(w, -1.0)
    return float(max(full @ g @ full, 0.0))


def fold_sums(df: DataFrame, terms: list[Column], y: Column, fold: Column, parts: int) -> np.ndarray:
    """For each fold and inner part the matrix of sums of products of intercept, terms and target; one aggregation."""
    every = [F.lit(1.0), *terms, y]
    k = len(every)
    rows = df.select(fold.cast("int").alias("fold"), F.array(*(c.cast("double") for c in every)).alias("v"))

    def run(frames):
        import pandas as pd

        total = np.zeros((FOLDS * parts, k, k))
        for pdf in frames:
            if len(pdf):
                v = np.array(pdf["v"].tolist())
                v = np.where(np.isfinite(v), v, 0.0)
                for f in range(FOLDS * parts):
                    own = v[(pdf["fold"] == f).to_numpy()]
                    total[f] += own.T @ own
        yield pd.DataFrame({"at": np.arange(total.size), "value": total.ravel()})

    out = np.zeros(FOLDS * parts * k * k)
    for r in rows.mapInPandas(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(FOLDS, parts, k, k)


def gains_from_sums(sums: np.ndarray) -> list[tuple[float, float]]:
    """For each fold the squared errors of the mean and of the model fitted on the other folds, the penalty chosen by inner part 0."""
    out = []
    for f in range(FOLDS):
        others = [k for k in range(FOLDS) if k != f]
        train = sums[others]
        inner, check, whole = train[:, 1:].sum((0, 1)), train[:, 0].sum(0), train.sum((0, 1))
        held = sums[f].sum(0)
        if whole[0, 0] < 2 or held[0, 0] < 1:
            continue
        penalty = min(PENALTIES, key=lambda p: squared_error(check, solve(inner, p))) if inner[0, 0] >= 2 and check[0, 0] >= 1 else PENALTIES[1]
        mean = np.zeros(len(whole) - 1)
        mean[0] = whole[0, -1] / whole[0, 0]
        out.append((squared_error(held, mean), squared_error(held, solve(whole, penalty))))
    return out


def signature(spark: SparkSession, df: DataFrame, key: str, numbers: list[str], target: str, members: list[str] | None = None, seed: int = 7) -> DataFrame:
    """member, family, gain and error: the mean over folds of 1 - error / error of the mean, and its standard error; null where a member doesn't apply.

    Numbers are standardised, missing cells stand at the mean. Rows without a
    target are left out. knn members and net are fitted on LOCAL_ROWS rows of
    least hash of the training folds.
    """
    members = list(PANEL) if members is None else members
    return summary(spark, panel_errors(df, key, numbers, target, members, seed))


def class_signature(spark: SparkSession, df: DataFrame, key: str, numbers: list[str], target: str, members: list[str] | None = None, seed: int = 7, most: int = 32) -> DataFrame:
    """signature for a class: members predict a flag for each class, and their errors are summed over the classes, as those of the shares are.

    More than most classes are refused; rows without a class are left out.
    """
    members = list(PANEL) if members is None else members
    rows = df.filter(F.col(target).isNotNull())
    labels = [r[0] for r in rows.select(F.col(target).cast("string")).distinct().orderBy(target).limit(most + 1).collect()]
    if len(labels) > most:
        raise ValueError(f"a target of more than {most} classes")
    whole: dict[str, np.ndarray] = {}
    for label in labels:
        flagged = rows.select(key, *numbers, (F.col(target).cast("string") == label).cast("double").alias("__flag"))
        for m, errors in panel_errors(flagged, key, numbers, "__flag", members, seed).items():
            whole[m] = whole.get(m, 0.0) + np.array(errors, float).reshape(-1, 2)
    return summary(spark, {m: [tuple(e) for e in whole[m]] if m in whole else [] for m in members})


def summary(spark: SparkSession, errors: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """A row for each member from its folds' errors of the mean and its own."""
    out = []
    for m, found in errors.items():
        shares = [1 - e / n for n, e in found if n > 0]
        if shares:
            out.append((m, PANEL[m], float(np.mean(shares)), float(np.std(shares, ddof=1) / math.sqrt(len(shares))) if len(shares) > 1 else None))
        else:
            out.append((m, PANEL[m], None, None))
    return spark.createDataFrame(out, "member string, family string, gain double, error double")


def panel_errors(df: DataFrame, key: str, numbers: list[str], target: str, members: list[str], seed: int) -> dict[str, list[tuple[float, float]]]:
    """For each member and fold the held-out squared error of the mean, and the member's."""
    from loomtab.operators.splits import fold_of

    rows = df.filter(F.col(target).isNotNull()).select(key, *numbers, F.col(target).cast("double").alias("__y"))
    stats = rows.agg(*(f(c).alias(f"{n}{j}") for j, c in enumerate(numbers) for n, f in (("m", F.avg), ("s", F.stddev_pop))), *(F.count_if(F.col(c).isNull()).alias(f"l{j}") for j, c in enumerate(numbers))).first()
    scaled = [F.coalesce((F.col(c).cast("double") - F.lit(stats[f"m{j}"] or 0.0)) / F.lit(stats[f"s{j}"] or 1.0), F.lit(0.0)).alias(f"x{j}") for j, c in enumerate(numbers)]
    lost = [F.col(c).isNull().cast("double").alias(f"n{j}") for j, c in enumerate(numbers)]
    inner = F.pmod(fold_of(F.col(key), 20, "inner"), F.lit(20))
    base = staged(rows.select(key, "__y", *scaled, *lost, fold_of(F.col(key), FOLDS, "fold").alias("__fold"), inner.alias("__inner")), "standard")
    x, missing = [F.col(f"x{j}") for j in range(len(numbers))], [F.col(f"n{j}") for j in range(len(numbers)) if stats[f"l{j}"]]
    grid = [k / (HINGES + 1) for k in range(1, HINGES + 1)] + [k / (STEPS + 1) for k in range(1, STEPS + 1)] + [k / 255 for k in range(256)]
    found = {r["column"]: r["q"] for r in quantiles(long_form(base, {str(j): c for j, c in enumerate(x)}), ["column"], "value", grid).collect()}
    knots = {j: found[str(j)][: HINGES + STEPS] for j in range(len(numbers))}
    levels = {j: found[str(j)][HINGES + STEPS :] for j in range(len(numbers))}
    place = [below(levels[j], x[j]) / 256 for j in range(len(numbers))]
    y, fold = F.col("__y"), F.col("__fold") * 20 + F.col("__inner")
    linear_gains: dict[str, list[tuple[float, float]]] = {}
    for m in members:
        terms = basis(m, x, missing, knots, place, seed)
        if m == "best1":
            single = [gains_from_sums(merged(fold_sums(base, [v], y, fold, 20))) for v in x]
            linear_gains[m] = max(single, key=lambda s: sum(1 - e / n for n, e in s if n > 0)) if single else []
        elif terms is not None:
            sums = fold_sums(base, terms, y, fold, 20)
            # A quarter of the training rows: five of the inner twentieths.
            linear_gains[m] = quarter(sums) if m == "lin_quarter" else gains_from_sums(merged(sums))
        elif m in ("stump", "otree3", "gbdt", "gbdt_quarter"):
            linear_gains[m] = tree_gains(base, x, levels, m)
        elif m in ("knn1", "knn16", "net"):
            linear_gains[m] = local_gains(base, key, len(numbers), m, seed)
        else:
            linear_gains[m] = []
    return linear_gains


def below(levels: list[float], x: Column) -> Column:
    """How many of 256 levels x is above."""
    return F.size(F.filter(F.array(*map(F.lit, levels)), lambda q: q < x)).cast("int")


def merged(sums: np.ndarray) -> np.ndarray:
    """Twentieths to fifths."""
    return np.stack([sums[:, k::5].sum(1) for k in range(5)], axis=1)


def quarter(sums: np.ndarray) -> list[tuple[float, float]]:
    """Gains of models that see a quarter of the training rows, on all held-out ones."""
    small = merged(sums[:, :5])
    out = []
    for f in range(FOLDS):
        others = [k for k in range(FOLDS) if k != f]
        whole, held = small[others].sum((0, 1)), sums[f].sum(0)
        if whole[0, 0] < 2 or held[0, 0] < 1:
            continue
        mean = np.zeros(len(whole) - 1)
        mean[0] = whole[0, -1] / whole[0, 0]
        out.append((squared_error(held, mean), squared_error(held, solve(whole, PENALTIES[1]))))
    return out


def tree_gains(base: DataFrame, x: list[Column], levels: dict[int, list[float]], member: str) -> list[tuple[float, float]]:
    """Errors of oblivious trees on 256-level codes, fold by fold."""
    from loomtab.operators.boosting import boost

    coded = staged(base.select("__y", "__fold", "__inner", *(below(levels[j], x[j]).alias(f"c{j}") for j in range(len(x)))), "codes")
    codes = [f"c{j}" for j in range(len(x))]
    trees, depth, eta = {"stump": (1, 1, 1.0), "otree3": (1, 3, 1.0), "gbdt": (6, 3, 0.4), "gbdt_quarter": (6, 3, 0.4)}[member]
    out = []
    for f in range(FOLDS):
        train = coded.filter(F.col("__fold") != f)
        if member == "gbdt_quarter":
            train = train.filter("__inner < 5")
        forest = boost(train, codes, "__y", trees=trees, depth=depth, eta=eta, least=10)
        mean = train.agg(F.avg("__y").alias("m")).first()["m"]
        r = coded.filter(F.col("__fold") == f).agg(F.sum(F.pow(F.col("__y") - F.lit(mean or 0.0), 2)).alias("n"), F.sum(F.pow(F.col("__y") - forest.output(), 2)).alias("e")).first()
        if r["n"] is not None:
            out.append((r["n"], r["e"]))
    return out


def local_gains(base: DataFrame, key: str, width: int, member: str, seed: int) -> list[tuple[float, float]]:
    """Errors on all held-out rows of models of LOCAL_ROWS training rows: neighbours' means, or a small net with a closed-form readout."""
    from loomtab.functions.cells import hashed

    names = [f"x{j}" for j in range(width)]
    out = []
    for f in range(FOLDS):
        kept = base.filter(F.col("__fold") != f).orderBy(hashed(F.col(key)), key).limit(LOCAL_ROWS).select("__y", *names).toPandas()
        if len(kept) < 2:
            continue
        a, t = kept[names].to_numpy(float), kept["__y"].to_numpy(float)
        rng = np.random.default_rng(seed)
        hidden, shift = rng.normal(size=(width, 32)), rng.uniform(-2, 2, 32)
        design = np.column_stack((np.ones(len(a)), a, np.tanh(a @ hidden + shift)))
        readout = np.linalg.solve(design.T @ design + 1e-2 * len(a) * np.eye(design.shape[1]), design.T @ t)
        near = 1 if member == "knn1" else min(16, len(a))

        def run(frames, a=a, t=t, hidden=hidden, shift=shift, readout=readout, near=near):
            import pandas as pd

            mean, errors = t.mean(), np.zeros(2)
            for pdf in frames:
                for at in range(0, len(pdf), 1024):
                    part = pdf.iloc[at : at + 1024]
                    b, y = part[names].to_numpy(float), part["__y"].to_numpy(float)
                    if member == "net":
                        p = np.column_stack((np.ones(len(b)), b, np.tanh(b @ hidden + shift))) @ readout
                    else:
                        d = (b * b).sum(1)[:, None] + (a * a).sum(1)[None, :] - 2 * b @ a.T
                        p = t[np.argpartition(d, near - 1, axis=1)[:, :near]].mean(1)
                    errors += [((y - mean) ** 2).sum(), ((y - p) ** 2).sum()]
            yield pd.DataFrame({"n": [errors[0]], "e": [errors[1]]})

        r = base.filter(F.col("__fold") == f).select("__y", *names).mapInPandas(run, "n double, e double").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).first()
        if r["n"]:
            out.append((r["n"], r["e"]))
    return out


def contrasts(panel: DataFrame) -> DataFrame:
    """name and value: differences of members' gains from the linear one, and of the trees, neighbours and curves among themselves."""
    wide = panel.agg(*(F.max(F.when(F.col("member") == m, F.col("gain"))).alias(m) for m in PANEL))
    over = [(f"{m} - lin", m, "lin") for m in PANEL if m not in ("lin", "lin_quarter", "gbdt_quarter", "knn1", "stump")]
    pairs = [*over, ("gbdt - stump", "gbdt", "stump"), ("knn16 - knn1", "knn16", "knn1"), ("lin - lin_quarter", "lin", "lin_quarter"), ("gbdt - gbdt_quarter", "gbdt", "gbdt_quarter")]
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), (F.col(a) - F.col(b)).alias("value")) for n, a, b in pairs))).alias("c")).select("c.*")


def coordinates(panel: DataFrame, rows: int, features: int, classes: int, target: tuple[float, float, float]) -> DataFrame:
    """place, name, value and known: 96 numbers that stand for a table, 0 and unknown where a member has none.

    23 gains, their 23 standard errors and 23 mid-rank shares, the 18 contrasts
    of members with the linear one, three statistics of the target, three flags
    of the task, and the scaled numbers of classes (0 for a number), rows and
    features.
    """
    held = {r["member"]: r for r in panel.collect()}  # a row for each member
    gains = {m: held[m]["gain"] if m in held else None for m in PANEL}
    known = [g for g in gains.values() if g is not None]
    share = lambda g: None if g is None else (sum(x < g for x in known) + 0.5 * sum(x == g for x in known)) / len(known)
    over = [m for m in PANEL if m not in ("lin", "lin_quarter", "gbdt_quarter", "knn1", "stump")]
    linear = gains["lin"]
    out: list[tuple[str, float | None]] = [(f"gain {m}", g) for m, g in gains.items()]
    out += [(f"error {m}", held[m]["error"] if m in held else None) for m in PANEL]
    out += [(f"share {m}", share(g)) for m, g in gains.items()]
    out += [(f"{m} - lin", None if gains[m] is None or linear is None else gains[m] - linear) for m in over]
    out += list(zip(("target mean", "target deviation", "target skew"), target, strict=True))
    out += [("regression", float(classes == 0)), ("binary", float(classes == 2)), ("multiclass", float(classes > 2))]
    out += [("classes", math.log2(classes) / 6 if classes > 0 else 0.0), ("rows", math.log10(max(rows, 1)) / 6), ("features", math.log2(max(features, 1)) / 12)]
    table = [(k, n, 0.0 if v is None or math.isnan(v) else float(v), v is not None and not math.isnan(v)) for k, (n, v) in enumerate(out)]
    return panel.sparkSession.createDataFrame(table, "place int, name string, value double, known boolean")


def merged_bundles(bundles: DataFrame, scope: str, table: str, version: str, complete: str) -> DataFrame:
    """The last complete row of each table within its scope; tables without one are left out.

    Rows of different scopes never take each other's place; of equal versions the
    greatest row stands. Missing scopes and tables are ones of their own.
    """
    rest = [c for c in bundles.columns if c not in (scope, table)]
    last = bundles.filter(F.coalesce(F.col(complete), F.lit(False))).groupBy(scope, table).agg(F.max(F.struct(F.col(version).alias("__v"), *(F.col(f"`{c}`") for c in rest))).alias("__last"))
    return last.select(*(F.col(c) if c in (scope, table) else F.col("__last")[c].alias(c) for c in bundles.columns))
