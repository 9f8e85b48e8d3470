"""Auditing families, two-sample classifiers, regimes and the budget frontier."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.operators import program
from loomtab.operators.reducers import retention

FAMILIES = {
    "linear": lambda y: LinearRegression(featuresCol="__x", labelCol=y, predictionCol="__p", regParam=1e-3),
    "boosted": lambda y: GBTRegressor(featuresCol="__x", labelCol=y, predictionCol="__p", maxDepth=4, maxIter=10, seed=7),
}


def imputed(df: DataFrame, features: list[str], fills: dict[str, float]) -> DataFrame:
    """Rows with a vector of features: missing ones stand at their fill, with a flag for each feature."""
    kept = df.select(*df.columns, *(F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(f"__f_{c}") for c in features), *(F.col(c).isNull().cast("double").alias(f"__n_{c}") for c in features))
    return VectorAssembler(inputCols=[f"__{k}_{c}" for k in "fn" for c in features], outputCol="__x").transform(kept)


def medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Medians of the present values, 0 without any."""
    from loomtab.operators.ranks import bracketed

    found, _ = bracketed(df, {c: F.col(c) for c in features}, [0.5])
    return {c: float(q[0]) if q else 0.0 for c, (_, q) in found.items()}


def family_losses(real: DataFrame, synthetic: DataFrame, test: DataFrame, features: list[str], y: str) -> DataFrame:
    """A row a family: its loss on the test rows after real rows and after synthetic rows, and the retention."""
    mean = real.agg(F.avg(y)).first()[0]
    fills, out = {k: medians(df, features) for k, df in (("real", real), ("synthetic", synthetic))}, None
    for name, make in FAMILIES.items():
        scored = {k: make(y).fit(imputed(df, features, fills[k])).transform(imputed(test, features, fills[k])) for k, df in (("real", real), ("synthetic", synthetic))}
        sums = [s.agg(F.avg(F.pow(F.col(y) - F.col("__p"), 2)).alias(f"{k}_loss"), F.avg(F.pow(F.col(y) - F.lit(mean), 2)).alias(f"null_{k}")) for k, s in scored.items()]
        row = sums[0].join(sums[1]).select(F.lit(name).alias("family"), F.col("null_real").alias("null_loss"), "real_loss", "synthetic_loss")
        out = row if out is None else out.union(row)
    return out.withColumn("retention", retention(F.col("null_loss"), F.col("real_loss"), F.col("synthetic_loss")))


def class_losses(real: DataFrame, synthetic: DataFrame, test: DataFrame, features: list[str], y: str, classes: int) -> DataFrame:
    """A row a family: log losses on the test rows, whose y is a class's number, after real and after synthetic rows, and the retention.

    The linear family has a logistic regression for each class, scaled to one;
    the boosted one has trees for all classes on 64 codes by quantiles of the real
    rows, and stops early on a hash of a fifth of its rows. Missing features stand
    at the real medians. Losses of the prior have half a row more a class.
    """
    from loomtab.operators import boosting, gradient
    from loomtab.operators.ranks import bracketed
    from loomtab.session import staged

    found, _ = bracketed(real, {c: F.col(c) for c in features}, [k / 64 for k in range(1, 64)] + [0.5])
    cuts = {c: sorted(set(q[:-1])) if q else [] for c, (_, q) in found.items()}
    fills = {c: q[-1] if q else 0.0 for c, (_, q) in found.items()}
    scale = {c: max(cuts[c][-1] - cuts[c][0], 1e-9) if cuts[c] else 1.0 for c in features}

    def prepared(df: DataFrame) -> DataFrame:
        x = {c: F.coalesce(F.col(c).cast("double"), F.lit(fills[c])) for c in features}
        code = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts[c])), lambda q: q < x[c])) if cuts[c] else F.lit(0)
        held = F.pmod(F.xxhash64(*features, y), F.lit(5)) == 0
        return staged(df.filter(F.col(y).isNotNull()).select(F.col(y).cast("int").alias("y"), *(code(c).alias(f"c{k}") for k, c in enumerate(features)), *(((x[c] - fills[c]) / scale[c]).alias(f"x{k}") for k, c in enumerate(features)), held.alias("held")), "audited")

    sides = {"real": prepared(real), "synthetic": prepared(synthetic)}
    judged = prepared(test)
    codes, terms = [f"c{k}" for k in range(len(features))], [F.col(f"x{k}") for k in range(len(features))]
    counts = {r["y"]: r["count"] for r in sides["real"].groupBy("y").count().collect()}  # a row for each class
    total = sum(counts.values()) + 0.5 * classes
    prior = F.get(F.array(*(F.lit((counts.get(k, 0) + 0.5) / total) for k in range(classes))), F.col("y"))
    null = judged.agg(F.avg(-F.ln(prior))).first()[0]
    rows = []
    for family in ("linear", "boosted"):
        losses = {}
        for side, df in sides.items():
            if family == "boosted":
                trees = gradient.boost(df, codes, "y", classes, trees=12, hold=F.col("held"))
                losses[side] = gradient.mean_loss(judged, trees, "y", classes)
            else:
                made = {k: boosting.logistic(df, terms, F.col("y") == k, close=1e-4) for k in range(classes)}
                p = F.array(*(boosting.sigmoid(boosting.linear(w, terms)) for w in made.values()))
                marked = judged.select("y", p.alias("p")).select("y", F.get("p", F.col("y")).alias("own"), F.aggregate("p", F.lit(0.0), lambda s, v: s + v).alias("all"))
                losses[side] = marked.agg(F.avg(-F.ln(F.greatest(F.lit(1e-7), F.try_divide("own", "all"))))).first()[0]
        rows.append((family, null, losses["real"], losses["synthetic"]))
    out = real.sparkSession.createDataFrame(rows, "family string, null_loss double, real_loss double, synthetic_loss double")
    return out.withColumn("retention", retention(F.col("null_loss"), F.col("real_loss"), F.col("synthetic_loss")))


def c2st(a: DataFrame, b: DataFrame, features: list[str]) -> float:
    """How well a logistic regression tells two samples apart on the half that it hasn't seen, as an area under the curve."""
    both = a.select(*features).withColumn("__y", F.lit(1.0)).union(b.select(*features).withColumn("__y", F.lit(0.0)))
    dealt = imputed(both, features, medians(both, features)).withColumn("__half", F.pmod(F.xxhash64(*features, "__y"), F.lit(2)))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1e-3).fit(dealt.filter("__half = 0"))
    return BinaryClassificationEvaluator(labelCol="__y").evaluate(model.transform(dealt.filter("__half = 1")))


def regimes(spark: SparkSession, df: DataFrame, features: list[str], k: int, rounds: int = 20, key: str | None = None) -> DataFrame:
    """Weight, means and deviations of each of k regimes of independent normal numbers, by expectation and maximisation.

    The start depends on the data alone: means at the quantiles of the first
    feature. Each round is one aggregation, so partitions change only the last
    digits. Rows with a missing feature are left out; fewer than k rows give
    fewer regimes.
    """
    from loomtab.operators.ranks import quantiles
    from loomtab.session import staged

    rows = staged(df.select(*(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features))).dropna(), "regimes")
    d = len(features)
    first = rows.agg(F.count("*").alias("n"), *(F.avg(f"x{j}").alias(f"m{j}") for j in range(d)), *(F.stddev_pop(f"x{j}").alias(f"s{j}") for j in range(d))).first()
    k = min(k, first["n"])
    out = "regime int, weight double, mean array<double>, deviation array<double>"
    if not k:
        return spark.createDataFrame([], out)
    starts = quantiles(rows.select(F.col("x0").alias("value")), [], "value", [(i + 0.5) / k for i in range(k)]).first()["q"]
    floor = [max((first[f"s{j}"] or 0.0) * 1e-3, 1e-9) for j in range(d)]
    weight = [1 / k] * k
    mean = [[starts[i], *(first[f"m{j}"] for j in range(1, d))] for i in range(k)]
    sd = [[max(first[f"s{j}"] or 0.0, floor[j]) / (k if j == 0 else 1) or floor[j] for j in range(d)] for i in range(k)]
    for _ in range(rounds):
        logs = []
        for i in range(k):
            z = F.lit(math.log(max(weight[i], 1e-300)))
            for j in range(d):
                z = z - F.pow((F.col(f"x{j}") - mean[i][j]) / sd[i][j], 2) / 2 - math.log(sd[i][j])
            logs.append(z)
        top = F.greatest(*logs) if k > 1 else logs[0]
        shares = rows.select("*", top.alias("top"), *(z.alias(f"l{i}") for i, z in enumerate(logs))).select("*", *(F.exp(F.col(f"l{i}") - F.col("top")).alias(f"e{i}") for i in range(k)))
        total = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
        r = [F.col(f"e{i}") / total for i in range(k)]
        sums = shares.agg(*(F.sum(r[i]).alias(f"r{i}") for i in range(k)), *(F.sum(r[i] * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(d)), *(F.sum(r[i] * F.pow(F.col(f"x{j}") - mean[i][j], 2)).alias(f"b{i}_{j}") for i in range(k) for j in range(d))).first()
        for i in range(k):
            own = max(sums[f"r{i}"], 1e-12)
            weight[i] = own / first["n"]
            for j in range(d):
                new = sums[f"a{i}_{j}"] / own
                sd[i][j] = max(math.sqrt(max(sums[f"b{i}_{j}"] / own - (new - mean[i][j]) ** 2, 0.0)), floor[j])
                mean[i][j] = new
    rows_out = sorted(((w, m, s) for w, m, s in zip(weight, mean, sd, strict=True)), key=lambda t: (-t[0], t[1]))
    return spark.createDataFrame([(i, float(w), [float(v) for v in m], [float(v) for v in s]) for i, (w, m, s) in enumerate(rows_out)], out)


def frontier(spark: SparkSession, df: DataFrame, key: str, target: str, numbers: list[str], categories: list[str], budgets: list[int], level: float = 0.9) -> DataFrame:
    """A row a budget of bytes: the program with most features that fits, its retention, and whether it is the first to reach a level."""
    rows, reached = [], False
    ladder = [(numbers[: max(0, n - len(categories))], categories[:n]) for n in range(len(numbers) + len(categories), 0, -1)]
    known = {}
    for budget in sorted(budgets):
        for chosen in ladder:
            own = str(chosen)
            if own not in known:
                known[own] = program.retention(spark, df, key, target, *chosen, rows=20_000).first()
            if known[own]["program_bytes"] <= budget:
                r = known[own]["retention"]
                rows.append((budget, known[own]["program_bytes"], r, not reached and r is not None and r >= level))
                reached = reached or (r is not None and r >= level)
                break
        else:
            rows.append((budget, None, None, False))
    return spark.createDataFrame(rows, "budget long, program_bytes long, retention double, is_first boolean")
