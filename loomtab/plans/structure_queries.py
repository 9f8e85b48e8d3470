"""Queries of dependence, additive and isotonic models, budgets, paired resamples, marginals and table lineage, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtab.functions import strict_json
from loomtab.operators import additive, assessment, auditors, boosting, columns, compiled, corpus, dependence, gradient, isotonic, landmarks, ledger, marginals, models, prepare, ranks, splits
from loomtab.operators.splits import fold_of
from loomtab.plans.catalogue import HEX, query, rounded
from loomtab.plans.measures import _weight
from loomtab.session import load, staged

# --- Dependence.

_U, _V = "(l_quantity / 51)", "(l_discount * 9 + 0.05)"


def _clayton(t: float, u: str, v: str) -> str:
    return f"ln(1 + {t}::DOUBLE) - (1 + {t}::DOUBLE) * (ln({u}) + ln({v})) - (2 + 1 / {t}::DOUBLE) * ln(pow({u}, -{t}::DOUBLE) + pow({v}, -{t}::DOUBLE) - 1)"


def _frank(t: float, u: str, v: str) -> str:
    a, b, c = (f"(exp(-{t}::DOUBLE * {x}) - 1)" for x in (u, v, "1"))
    return f"ln(-{t}::DOUBLE * {c}) - {t}::DOUBLE * ({u} + {v}) - 2 * ln(abs({c} + {a} * {b}))"


_PAIRS = [("clayton", 0.7), ("clayton90", 0.7), ("clayton180", 1.5), ("clayton270", 1.5), ("frank", 2.5), ("frank", 6.0)]
_TURNED = {"clayton": (_U, _V), "clayton90": (f"(1 - {_U})", _V), "clayton180": (f"(1 - {_U})", f"(1 - {_V})"), "clayton270": (_U, f"(1 - {_V})")}


@query(
    " UNION ALL ".join(
        f"SELECT '{f}' AS family, {t}::DOUBLE AS parameter, round(avg({_frank(t, _U, _V) if f == 'frank' else _clayton(t, *_TURNED[f])}), 8) AS log_density, count(*)::BIGINT AS n FROM lineitem" for f, t in _PAIRS
    )
)
def pair_copula_likelihoods(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 51).alias("u"), (F.col("l_discount") * 9 + 0.05).alias("v"))

    def totals(pdf):
        u, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
        return [*(dependence.pair_log(f, t, u, v).sum() for f, t in _PAIRS), len(u)]

    s = dependence.array_sums(rows, totals, len(_PAIRS) + 1)
    return spark.createDataFrame([(f, t, round(float(s[k] / s[-1]), 8), int(s[-1])) for k, (f, t) in enumerate(_PAIRS)], "family string, parameter double, log_density double, n long")


_Z = ["(l_quantity - 25.5) / 14.4", "(l_extendedprice - 52950) / 30000 + (l_quantity - 25.5) / 20", "(l_discount - 0.05) / 0.03"]


def scores(spark, sf_dir):
    """Three columns of lineitem as scores, and whether a row is held out."""
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return load(spark, sf_dir, "lineitem").select(*(F.expr(z).cast("double").alias(f"z{k}") for k, z in enumerate(_Z)), (fold_of(key, 5) == 0).alias("held"))


@query(
    f"""WITH z AS (SELECT {", ".join(f"{z} AS z{k}" for k, z in enumerate(_Z))} FROM lineitem), c AS (SELECT 0.6::DOUBLE AS r)
SELECT 'tree' AS model, round(avg(-(z0 * z0 + z2 * z2 + pow(z1 - r * z0, 2) / (1 - r * r + 0.0) + ln(1 - r * r) + 3 * ln(2 * pi())) / 2), 4) AS log_density FROM z, c
UNION ALL SELECT 'independent', round(avg(-(z0 * z0 + z1 * z1 + z2 * z2 + 3 * ln(2 * pi())) / 2), 4) FROM z"""
)
def gaussian_likelihoods(spark, sf_dir):
    given = {"independent": dependence.Gaussian("independent", 3), "tree": dependence.Gaussian("tree", 3, parents=[(0, 1, 0.6)])}
    found = dependence.log_likelihoods(scores(spark, sf_dir), ["z0", "z1", "z2"], given)
    return spark.createDataFrame([(n, round(x, 4)) for n, x in found.items()], "model string, log_density double")


@query()
def dependence_ranking(spark, sf_dir):
    """Candidates of three columns' dependence by the likelihood of held-out rows."""
    ranking, _ = dependence.ranked(staged(scores(spark, sf_dir), "scores"), ["z0", "z1", "z2"], "held")
    return spark.createDataFrame([(n, k, round(x, 5)) for k, (n, x) in enumerate(ranking)], "model string, place int, log_likelihood double")


# --- Budgets.


@query()
def budget_levels(spark, sf_dir):
    """Programs of orders for four budgets: their bytes, dependence, trees and audited retention."""
    orders = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.month("o_orderdate").cast("double")
    value = F.log1p(F.col("o_totalprice")) / 4 + F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1.0).otherwise(0.0) + F.pow((month - 6) / 6, 2) + F.col("c_acctbal") / 10000
    rows = orders.select(value.alias("y"), month.alias("month"), "c_acctbal", "o_totalprice", "o_orderpriority", "c_mktsegment")
    found = compiled.fit_levels(rows, "y", ["month", "c_acctbal", "o_totalprice"], ["o_orderpriority", "c_mktsegment"], [512, 1024, 2048, 4096])
    out = [(b, p and len(p.encode()), p and p.model["kind"], p and len(p.trees.get("leaves", [])), r) for b, p, r in found]
    return rounded(spark.createDataFrame(out, "budget int, bytes int, dependence string, trees int, retention double"), 6)


# --- Target models.

_CODES = "floor(l_quantity / 4)::INTEGER AS a, floor(l_discount * 100)::INTEGER AS b, l_linenumber AS c, l_extendedprice / 10000 + l_quantity / 10 * (1 + l_linenumber % 2) AS y"


def coded(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_quantity") / 4).cast("int").alias("a"), F.floor(F.col("l_discount") * 100).cast("int").alias("b"), F.col("l_linenumber").alias("c"),
        (F.col("l_extendedprice") / 10000 + F.col("l_quantity") / 10 * (1 + F.col("l_linenumber") % 2)).alias("y"),
    )


def _cycle(feature: str, left: str) -> str:
    """A feature's centred shrunken means of what is left, a row a code."""
    return f"(SELECT {feature}, v - sum(n * v) OVER () / sum(n) OVER () AS v FROM (SELECT {feature}, count(*) AS n, sum({left}) / (count(*) + 5) AS v FROM t GROUP BY 1))"


@query(
    f"""WITH r AS (SELECT {_CODES} FROM lineitem), t AS (SELECT *, (SELECT avg(y) FROM r) AS base FROM r), fa AS {_cycle("a", "y - base")},
ta AS (SELECT t.*, fa.v AS va FROM t JOIN fa USING (a)), fb AS {_cycle("b", "y - base - va").replace("FROM t ", "FROM ta ")}, tb AS (SELECT ta.*, fb.v AS vb FROM ta JOIN fb USING (b)), fc AS {_cycle("c", "y - base - va - vb").replace("FROM t ", "FROM tb ")}
SELECT 'a' AS feature, a AS code, round(v, 6) AS value FROM fa UNION ALL SELECT 'b', b, round(v, 6) FROM fb UNION ALL SELECT 'c', c, round(v, 6) FROM fc"""
)
def additive_cycle(spark, sf_dir):
    """Main effects after one cycle of backfitting."""
    n, s, rows, total = additive.meetings(coded(spark, sf_dir), ["a", "b", "c"], F.col("y"), 16)
    _, f = additive.backfitted(n, s, rows, total, cycles=1)
    return spark.createDataFrame([("abc"[j], k, round(float(f[j, k]), 6)) for j in range(3) for k in range(16) if n[j, k, j, k]], "feature string, code int, value double")


@query()
def additive_fit(spark, sf_dir):
    """Squared errors of the mean, of main effects and of main effects with two pairs, and the pairs chosen."""
    rows = staged(coded(spark, sf_dir), "coded")
    plain = additive.fit(rows, ["a", "b", "c"], F.col("y"), 16)
    paired = additive.fit(rows, ["a", "b", "c"], F.col("y"), 16, pairs=2)
    error = lambda m: F.avg(F.pow(F.col("y") - m, 2))
    losses = rows.agg(error(F.lit(plain.base)).alias("null_loss"), error(plain.output()).alias("main_loss"), error(paired.output()).alias("pair_loss"))
    return rounded(losses.withColumn("pairs", F.lit(",".join(sorted(a + b for a, b in paired.pairs)))))


@query(
    f"""WITH t AS (SELECT unnest(['a', 'b']) AS feature, unnest([a, b]) AS x, y - 5 AS r FROM (SELECT {_CODES} FROM lineitem))
SELECT feature, floor(x / 2)::BIGINT AS bin, count(*)::BIGINT AS n, sum(x)::DOUBLE AS x, sum(x * x)::DOUBLE AS xx, round(sum(r), 4) AS r, round(sum(r * x), 4) AS rx FROM t GROUP BY 1, 2"""
)
def hinge_sums(spark, sf_dir):
    return rounded(additive.knot_sums(coded(spark, sf_dir), ["a", "b"], F.col("y") - 5, 2.0), 4)


@query()
def hinge_fit(spark, sf_dir):
    """The hinges that price and quantity ask for, and their errors."""
    rows = staged(coded(spark, sf_dir).withColumn("y", F.col("y") + F.greatest(F.lit(0.0), F.col("a") - 6.0)), "coded")
    model = additive.fit_hinges(rows, ["a", "b", "c"], F.col("y"), 1.0, 5)
    return rounded(rows.agg(F.var_pop("y").alias("null_loss"), F.avg(F.pow(F.col("y") - model.output(), 2)).alias("loss")).withColumn("hinges", F.lit(len(model.terms))))


_FLAGS = {"A": 0, "N": 1, "R": 2}
_P = [0.25, 0.5, 0.25]


@query(
    f"""WITH t AS (SELECT (l_linenumber > 3)::INTEGER AS leaf, unnest(['a', 'b']) AS feature, unnest([a, b]) AS code, k FROM (SELECT {_CODES}, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS k FROM lineitem))
SELECT leaf, feature, code, count(*)::BIGINT AS n, {", ".join(f"round(sum({p}::DOUBLE - (k = {i})::INTEGER), 5) AS g{i}, round(sum({p}::DOUBLE * (1 - {p}::DOUBLE)), 5) AS h{i}" for i, p in enumerate(_P))} FROM t GROUP BY 1, 2, 3"""
)
def class_histogram(spark, sf_dir):
    """A level's table of both derivatives of three classes' log loss."""
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = load(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 4).cast("int").alias("a"), F.floor(F.col("l_discount") * 100).cast("int").alias("b"), "l_linenumber", y.alias("y"))
    g, h = gradient.derivatives([F.lit(0.0), F.ln(F.lit(2.0)), F.lit(0.0)], F.col("y"), 3)
    found = gradient.histogram(rows, (F.col("l_linenumber") > 3).cast("int"), ["a", "b"], g, h)
    return found.select("leaf", "feature", "code", "n", *(F.round(F.col(c)[k], 5).alias(f"{c}{k}") for k in range(3) for c in "gh"))


@query()
def class_boosting(spark, sf_dir):
    """Log losses on held-out rows: of the prior and of trees for three classes that stop early."""
    score = F.col("l_quantity") / 10 + F.col("l_discount") * 30 + (F.col("l_partkey") % 7) / 2
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = load(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_quantity") * 5).cast("int").alias("a"), F.floor(F.col("l_discount") * 1000).cast("int").alias("b"), F.when(score > 7, 2).when(score > 4.5, 1).otherwise(0).alias("y"), (fold_of(key, 5) == 0).alias("held")
    )
    rows = staged(rows, "coded")
    trees = gradient.boost(rows, ["a", "b"], "y", 3, trees=8, hold=F.col("held"))
    held = rows.filter("held")
    losses = [gradient.mean_loss(held, trees.cut(t), "y", 3) for t in (0, len(trees.leaves))]
    return rounded(spark.createDataFrame([(*losses, len(trees.leaves))], "null_loss double, loss double, trees int"))


_OOF = f"(SELECT o_orderkey AS k, {HEX.format('o_orderkey')} % 4 AS fold, month(o_orderdate) / 12.0::DOUBLE AS x, o_totalprice / 100000 AS y FROM orders)"


@query(
    f"""WITH s AS (SELECT fold, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy FROM {_OOF} GROUP BY 1), w AS (SELECT sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM s),
o AS (SELECT fold, w.n - s.n AS n, w.x - s.x AS x, w.y - s.y AS y, w.xx - s.xx + 1e-6::DOUBLE * (w.n - s.n) AS xx, w.xy - s.xy AS xy FROM s, w), b AS (SELECT fold, (n * xy - x * y) / (n * xx - x * x) AS slope, (xx * y - x * xy) / (n * xx - x * x) AS start FROM o)
SELECT k AS o_orderkey, round(y - start - slope * x, 6) AS residual FROM {_OOF} JOIN b USING (fold)"""
)
def out_of_fold_residuals(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", (F.month("o_orderdate") / 12).alias("x"), (F.col("o_totalprice") / 100000).alias("y"))
    return rounded(models.out_of_fold(orders, {"x": F.col("x")}, F.col("y"), fold_of(F.col("o_orderkey"), 4), 4).select("o_orderkey", "residual"))


# --- Isotonic regression.


@query(
    """WITH p AS (SELECT l_quantity AS x, count(*) AS w, sum(l_discount + l_quantity * l_quantity / 100000 - (l_quantity > 30)::INTEGER * 0.01) AS s FROM lineitem GROUP BY 1), c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS w, sum(s) OVER (ORDER BY x) AS s FROM p),
z AS (SELECT i, w, s FROM c UNION ALL SELECT 0, 0, 0), m AS (SELECT a.i AS a, b.i AS b, (b.s - a.s) / (b.w - a.w) AS v FROM z a JOIN z b ON a.i < b.i), l AS (SELECT i, a, min(v) AS v FROM c JOIN m ON a < i AND b >= i GROUP BY 1, 2)
SELECT x AS l_quantity, round(max(v), 8) AS value FROM c JOIN l USING (i) GROUP BY 1"""
)
def isotonic_values(spark, sf_dir):
    """The increasing function of quantity nearest to a noisy one, at each quantity."""
    y = F.col("l_discount") + F.col("l_quantity") * F.col("l_quantity") / 100000 - F.when(F.col("l_quantity") > 30, 0.01).otherwise(0.0)
    items = load(spark, sf_dir, "lineitem")
    blocks = staged(isotonic.isotonic(items, F.col("l_quantity"), y), "blocks")
    return rounded(isotonic.looked_up(items.select("l_quantity").distinct(), F.col("l_quantity"), blocks, "value"), 8)


# --- Evidence.

_LOSSES = "(SELECT l_suppkey % 64 AS block, pow(l_quantity - 25, 2) AS nul, pow(l_quantity - 25, 2) / 4 AS rea, pow(l_quantity - 25, 2) / 3 + l_tax AS a, pow(l_quantity - 25, 2) / 3 + l_discount AS b FROM lineitem)"


def paired(spark, sf_dir):
    far = F.pow(F.col("l_quantity") - 25, 2)
    return load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 64).alias("block"), far.alias("nul"), (far / 4).alias("rea"), (far / 3 + F.col("l_tax")).alias("a"), (far / 3 + F.col("l_discount")).alias("b"))


@query(
    f"""WITH c AS (SELECT block, sum(nul) AS n, sum(rea) AS r, sum(a) AS a, sum(b) AS b FROM {_LOSSES} GROUP BY 1), s AS (SELECT d, sum({_weight("p", "block")} * n) AS n, sum({_weight("p", "block")} * r) AS r, sum({_weight("p", "block")} * a) AS a, sum({_weight("p", "block")} * b) AS b FROM c, range(60) t(d) GROUP BY 1)
SELECT d::INTEGER AS draw, round((n - a) / (n - r), 8) AS retention_a, round((n - b) / (n - r), 8) AS retention_b, round((n - a) / (n - r) - (n - b) / (n - r), 8) AS difference FROM s"""
)
def paired_draws(spark, sf_dir):
    return rounded(ledger.paired_draws(paired(spark, sf_dir), F.col("block"), "nul", "rea", "a", "b", 60), 8)


@query(
    f"""WITH c AS (SELECT block, sum(nul) AS n, sum(rea) AS r, sum(a) AS a, sum(b) AS b FROM {_LOSSES} GROUP BY 1), s AS (SELECT d, sum({_weight("p", "block")} * n) AS n, sum({_weight("p", "block")} * r) AS r, sum({_weight("p", "block")} * a) AS a, sum({_weight("p", "block")} * b) AS b FROM c, range(200) t(d) GROUP BY 1),
q AS (SELECT quantile_cont((b - a) / (n - r), 0.025) AS lower, quantile_cont((b - a) / (n - r), 0.975) AS upper, avg(CASE WHEN b > a THEN 1.0 WHEN b = a THEN 0.5 ELSE 0.0 END) AS wins FROM s)
SELECT round((SELECT (avg(b) - avg(a)) / (avg(nul) - avg(rea)) FROM {_LOSSES}), 8) AS difference, round(lower, 8) AS lower, round(upper, 8) AS upper, wins::DOUBLE AS wins FROM q"""
)
def paired_interval(spark, sf_dir):
    return rounded(ledger.paired_interval(paired(spark, sf_dir), F.col("block"), "nul", "rea", "a", "b", 200), 8)


# --- Marginals and descriptors.

_CDF = "(x * x * (6 - 8 * x + 3 * x * x))"


@query(f"SELECT c_custkey, round(CASE WHEN x <= 0 THEN 0.0 WHEN x >= 1 THEN 1.0 ELSE {_CDF} END, 9) AS probability FROM (SELECT c_custkey, (c_acctbal + 500) / 10000 AS x FROM customer)")
def beta_probabilities(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_acctbal") + 500) / 10000).alias("x"))
    return rows.select("c_custkey", F.round(marginals.beta_cdf(F.col("x"), 2.0, 3.0), 9).alias("probability"))


_SQUARES = "(SELECT sqrt((c_acctbal + 1000) / 11000) AS x FROM customer)"


@query(
    f"""WITH c AS (SELECT x, count(*) AS n FROM {_SQUARES} GROUP BY 1), r AS (SELECT x, n, sum(n) OVER (ORDER BY x) AS upto, sum(n) OVER () AS t FROM c), s AS (SELECT avg(x) AS m, var_pop(x) AS v FROM {_SQUARES})
SELECT round(max(greatest(abs({_CDF} - upto / t), abs({_CDF} - (upto - n) / t))), 8) AS distance, round(any_value(m * (m * (1 - m) / v - 1)), 6) AS a, round(any_value((1 - m) * (m * (1 - m) / v - 1)), 6) AS b FROM r, s"""
)
def beta_fit(spark, sf_dir):
    """The distance of a column from a given beta distribution, and the parameters of the one with its moments."""
    rows = load(spark, sf_dir, "customer").select(F.sqrt((F.col("c_acctbal") + 1000) / 11000).alias("x"))
    s = rows.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).first()
    a, b = marginals.beta_moments(s["m"], s["v"])
    return spark.createDataFrame([(round(marginals.beta_distance(rows, "x", 2.0, 3.0), 8), round(a, 6), round(b, 6))], "distance double, a double, b double")


_DESCRIBED = ["l_quantity", "l_discount", "l_linenumber"]


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c})::BIGINT AS present, round(avg(({c} = 0)::INTEGER), 8) AS zeros, round((SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})) / count({c}), 8) AS mode_share FROM lineitem""" for c in _DESCRIBED
    )
)
def column_descriptors(spark, sf_dir):
    return rounded(columns.descriptors(load(spark, sf_dir, "lineitem"), _DESCRIBED), 8)


@query(
    """WITH s AS (SELECT pow(corr(l_quantity, y), 2) AS q, pow(corr(l_discount, y), 2) AS d, pow(corr(l_tax, y), 2) AS t FROM (SELECT *, l_quantity / 20 + l_discount * 10 + l_extendedprice / 100000 AS y FROM lineitem))
SELECT 'l_quantity' AS "column", round(q / (q + d + t), 8) AS weight FROM s UNION ALL SELECT 'l_discount', round(d / (q + d + t), 8) FROM s UNION ALL SELECT 'l_tax', round(t / (q + d + t), 8) FROM s"""
)
def driver_weights(spark, sf_dir):
    y = F.col("l_quantity") / 20 + F.col("l_discount") * 10 + F.col("l_extendedprice") / 100000
    return rounded(columns.driver_weights(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], y), 8)


@query(
    """WITH c AS (SELECT corr(l_quantity, l_quantity * 900 + l_extendedprice) AS r FROM lineitem), s AS (SELECT (1 + abs(r)) / 2 AS p, (1 - abs(r)) / 2 AS q, abs(r) AS r FROM c)
SELECT round(exp(-p * ln(p) - q * ln(q)), 6) AS effective_rank, round((-p * ln(p) - q * ln(q)) / ln(2), 6) AS spectral_entropy, round(r, 6) AS mean_correlation, round(r, 6) AS greatest_correlation FROM s"""
)
def table_spectrum(spark, sf_dir):
    """The eigenvalues of two correlated columns, 1 + r and 1 - r, as shares."""
    items = load(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_quantity") * 900 + F.col("l_extendedprice")).alias("price"))
    found = columns.spectrum(items, ["l_quantity", "price"])
    return spark.createDataFrame([tuple(round(v, 6) for v in found.values())], ", ".join(f"{n} double" for n in found))


# --- Corpora of tables.


@query()
def table_lineages(spark, sf_dir):
    """Suppliers' order lines as tables: near ones, by their quantiles, share a lineage."""
    items = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("table"), "l_quantity", "l_extendedprice", "l_discount")
    return corpus.table_lineages(items, "table", ["l_quantity", "l_extendedprice", "l_discount"], 0.75)


@query()
def byte_prefix(spark, sf_dir):
    """The orders that fit a budget of compressed bytes, a tenth of a kilobyte for each hundred of them."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return splits.byte_prefix(orders, "o_orderkey", orders.count())


# --- Assessments.

_PREDICTED = "(SELECT l_extendedprice / 1000 AS y, 50 + l_quantity / 10 AS p, l_discount * 9 + 0.05 AS q, (l_tax * 12 < l_discount * 9 + 0.05)::INTEGER AS h, l_returnflag FROM lineitem)"


def predicted(spark, sf_dir):
    q = F.col("l_discount") * 9 + 0.05
    return load(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), (50 + F.col("l_quantity") / 10).alias("p"), q.alias("q"), (F.col("l_tax") * 12 < q).cast("int").alias("h"), "l_returnflag")


@query(f"SELECT count(*)::BIGINT AS n, round(avg((abs(y - p) <= {assessment.WIDE}::DOUBLE * 25)::INTEGER), 8) AS covered FROM {_PREDICTED}")
def nominal_coverage(spark, sf_dir):
    return rounded(assessment.coverage(predicted(spark, sf_dir), F.col("y"), F.col("p"), 25.0), 8)


@query(
    f"""WITH b AS (SELECT least(9, floor(q * 10)) AS b, count(*) AS n, avg(q) AS p, avg(h) AS h FROM {_PREDICTED} GROUP BY 1 HAVING count(*) >= 5)
SELECT count(*)::BIGINT AS bins, round(avg((abs(h - p) <= {assessment.WIDE}::DOUBLE * sqrt(p * (1 - p) / n))::INTEGER), 8) AS covered FROM b"""
)
def class_coverage(spark, sf_dir):
    return rounded(assessment.class_coverage(predicted(spark, sf_dir), F.col("h"), F.col("q")), 8)


@query(
    f"""WITH e AS (SELECT quantile_cont(y, [0.1, 0.9]) AS ends FROM {_PREDICTED}), l AS (SELECT count(*) AS n, avg(pow(y - 53, 2)) AS n0, avg(pow(y - (y + 53) / 2, 2)) AS r, avg(pow(y - (y + 2 * p) / 3, 2)) AS s FROM {_PREDICTED}, e WHERE y <= ends[1] OR y >= ends[2])
SELECT n::BIGINT AS n, round(n0, 5) AS null_loss, round(r, 5) AS real_loss, round(s, 5) AS synthetic_loss, round((n0 - s) / (n0 - r), 5) AS retention FROM l"""
)
def tail_retention(spark, sf_dir):
    y, p = F.col("y"), F.col("p")
    return rounded(assessment.tail_retention(predicted(spark, sf_dir), "y", F.lit(53.0), (y + 53) / 2, (y + 2 * p) / 3), 5)


@query(f"WITH c AS (SELECT l_returnflag AS label, count(*) AS n, avg(q) AS n0, avg(q) / 2 AS r, avg(q) / 2 + avg(p) / 1000 AS s FROM {_PREDICTED} GROUP BY 1 ORDER BY n, label LIMIT 1) SELECT label, n::BIGINT AS n, round((n0 - s) / (n0 - r), 8) AS retention FROM c")
def rare_class_retention(spark, sf_dir):
    q, p = F.col("q"), F.col("p")
    return rounded(assessment.rare_class_retention(predicted(spark, sf_dir), "l_returnflag", q, q / 2, q / 2 + p / 1000), 8)


@query(
    """WITH c AS (SELECT l_suppkey AS f, avg(l_discount) - 0.05 AS r, avg(l_tax) - 0.04 AS s FROM lineitem GROUP BY 1), a AS (SELECT f, r, s, row_number() OVER (ORDER BY abs(r) DESC, f) AS i, row_number() OVER (ORDER BY abs(s) DESC, f) AS j FROM c)
SELECT round(sum(r * s) / sqrt(sum(r * r) * sum(s * s)), 7) AS cosine, count(*) FILTER (i <= 20 AND j <= 20) / least(20, count(*)) AS overlap, round(sum(CASE WHEN sign(r) = sign(s) THEN abs(r) ELSE 0 END) / sum(abs(r)), 7) AS signs FROM a"""
)
def importance_agreement(spark, sf_dir):
    means = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("f")).agg((F.avg("l_discount") - 0.05).alias("r"), (F.avg("l_tax") - 0.04).alias("s"))
    return rounded(assessment.importance_agreement(means, "f", "r", "s", 20), 7)


@query("WITH c AS (SELECT l_linenumber, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1) SELECT count(*)::BIGINT AS clusters, round(avg(m), 5) AS mean_value, round(avg(m) - 1.943180280515303::DOUBLE * stddev_samp(m) / sqrt(count(*)), 5) AS lower FROM c")
def student_bound(spark, sf_dir):
    """Seven clusters: the quantile of six degrees of freedom."""
    return rounded(assessment.student_lower_bound(load(spark, sf_dir, "lineitem"), "l_linenumber", "l_extendedprice"), 5)


_W = {"one": 1.0, "quantity": 0.05, "price": 0.02, "discount": 3.0}
_MOVED = "(SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS k, l_quantity AS quantity, l_extendedprice / 1000 AS price, l_discount AS discount, 1 + l_quantity / 20 + l_extendedprice / 50000 + l_discount * 3 + l_tax AS y FROM lineitem)"


def _lead(column: str, tag: str) -> str:
    order = f"PARTITION BY b ORDER BY {HEX.format(f'({chr(39)}{tag}{chr(39)} || k)')}, k"
    return f"coalesce(lead({column}) OVER ({order}), first_value({column}) OVER ({order}))"


@query(
    f"""WITH t AS (SELECT *, {HEX.format("('block' || k)")} % ((SELECT count(*) FROM lineitem) // 20000 + 1) AS b FROM {_MOVED}),
m AS (SELECT *, {", ".join(f"{_lead(c, f'both{r}')} AS {c}_{r}" for c in ("quantity", "price") for r in (0, 1))}, {", ".join(f"{_lead('discount', f'rate{r}')} AS discount_{r}" for r in (0, 1))} FROM t),
e AS (SELECT avg(pow(y - 1 - 0.05 * quantity - 0.02 * price - 3 * discount, 2)) AS e, {", ".join(f"avg(pow(y - 1 - 0.05 * quantity_{r} - 0.02 * price_{r} - 3 * discount, 2)) AS b{r}, avg(pow(y - 1 - 0.05 * quantity - 0.02 * price - 3 * discount_{r}, 2)) AS d{r}" for r in (0, 1))} FROM m)
SELECT 'both' AS "group", round((b0 + b1) / 2 - e, 6) AS importance FROM e UNION ALL SELECT 'rate', round((d0 + d1) / 2 - e, 6) FROM e"""
)
def grouped_importance(spark, sf_dir):
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k")
    y = 1 + F.col("l_quantity") / 20 + F.col("l_extendedprice") / 50000 + F.col("l_discount") * 3 + F.col("l_tax")
    rows = load(spark, sf_dir, "lineitem").select(key, F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_discount").alias("discount"), y.alias("y"))
    return rounded(models.grouped_importance(rows, "k", _W, {"both": ["quantity", "price"], "rate": ["discount"]}, F.col("y")))


@query()
def class_auditors(spark, sf_dir):
    """Two families' log losses after the training rows and after a tenth of them."""
    score = F.col("l_quantity") / 10 + F.col("l_discount") * 30 + (F.col("l_partkey") % 7) / 2
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = load(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", F.when(score > 7, 2).when(score > 4.5, 1).otherwise(0).alias("y"), fold_of(key, 10).alias("fold"))
    train = rows.filter("fold > 1")
    return rounded(auditors.class_losses(train, train.filter("fold = 2"), rows.filter("fold < 2"), ["l_quantity", "l_discount"], "y", 3))


# --- Splits, ranks, associations, JSON.


@query(f"WITH g AS (SELECT o_custkey, ((row_number() OVER (ORDER BY {HEX.format('o_custkey')}, o_custkey) - 1) % 5)::INTEGER AS fold FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, fold FROM orders JOIN g USING (o_custkey)")
def group_folds(spark, sf_dir):
    return splits.group_folds(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5).select("o_orderkey", "fold")


@query("SELECT o_orderkey, (((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 10) // (SELECT count(*) FROM orders))::INTEGER AS stratum FROM orders")
def value_strata(spark, sf_dir):
    return splits.value_strata(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "stratum")


@query(f"SELECT p_brand, CASE WHEN (row_number() OVER (ORDER BY {HEX.format('p_brand')}, p_brand) - 1) % 2 = 0 THEN 'select' ELSE 'certify' END AS part FROM (SELECT DISTINCT p_brand FROM part)")
def validation_halves(spark, sf_dir):
    return corpus.validation_halves(load(spark, sf_dir, "part").select("p_brand").distinct(), "p_brand")


@query("SELECT p_partkey, (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 - 0.5) / count(*) OVER () AS q FROM part")
def midrank_quantiles(spark, sf_dir):
    return ranks.midrank_quantiles(load(spark, sf_dir, "part"), "p_partkey", "p_size")


_MID = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@query(
    f"""WITH t AS (SELECT p_size AS a, p_retailprice + p_size * 5 AS b, p_partkey AS k FROM part), r AS (SELECT corr(x, y) AS rho FROM (SELECT {_MID.format(c="a")} AS x, {_MID.format(c="b")} AS y FROM t)),
o AS (SELECT a, k, count(*) OVER (ORDER BY b) AS r, count(*) OVER (ORDER BY b DESC) AS l, count(*) OVER () AS n FROM t), s AS (SELECT abs(lead(r) OVER (ORDER BY a, k) - r) AS d, l, n FROM o), x AS (SELECT 1 - any_value(n) * sum(d) / (2 * sum(l * (n - l))) AS xi FROM s)
SELECT 'size' AS feature, round(rho, 8) AS rho, round(xi, 8) AS xi, round(greatest(abs(rho), xi, 0), 8) AS strength FROM r, x"""
)
def association_strength(spark, sf_dir):
    return rounded(boosting.association(load(spark, sf_dir, "part"), {"size": F.col("p_size")}, F.col("p_retailprice") + F.col("p_size") * 5, "p_partkey"), 8)


@query(
    f"""WITH t AS (SELECT p_brand, {_MID.format(c="p_size")} AS r FROM part), m AS (SELECT p_brand, count(*) AS n, avg(r) AS m FROM t GROUP BY 1), w AS (SELECT avg(r) AS m, sum(r * r) - count(*) * avg(r) * avg(r) AS q FROM t)
SELECT 'size' AS feature, round(sqrt(sum(n * pow(m.m - w.m, 2)) / any_value(q)), 8) AS eta FROM m, w"""
)
def class_association(spark, sf_dir):
    return rounded(boosting.class_association(load(spark, sf_dir, "part"), {"size": F.col("p_size")}, F.col("p_brand")), 8)


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN json(props)::VARCHAR END AS canonical FROM events")
def canonical_json(spark, sf_dir):
    """Properties with a name that stands twice aren't strict."""
    props = F.when(F.col("event_id") % 7 != 0, F.col("props")).otherwise(F.concat(F.lit('{"k":1,'), F.substring("props", 2, 1000)))
    return load(spark, sf_dir, "events").select("event_id", strict_json.canonical(props).alias("canonical"))


_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]


def declared_orders(spark, sf_dir):
    """Orders with numbers, a nominal column with missing cells and an ordinal one whose first level isn't declared."""
    return load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))


@query(
    f"""WITH l AS (SELECT unnest({_ORDER}) AS level, unnest(range(4)) AS slot), c AS (SELECT slot, level, sum(n) OVER (ORDER BY slot) AS upto, sum(n) OVER () AS t FROM (SELECT slot, level, (SELECT count(*) FROM orders WHERE o_orderpriority = level) AS n FROM l)),
f AS (SELECT min(slot) AS m FROM c WHERE upto >= t / 2) SELECT o_orderkey, round(coalesce(slot, m) / 3, 8) AS place, (slot IS NULL)::INTEGER::DOUBLE AS missing FROM orders LEFT JOIN l ON o_orderpriority = level, f"""
)
def ordinal_card(spark, sf_dir):
    rows = declared_orders(spark, sf_dir)
    card = prepare.fit_card(rows, ["price"], ["status"], ordinals={"priority": _ORDER})
    return prepare.apply_card(rows, "o_orderkey", card).select("o_orderkey", F.round("priority", 8).alias("place"), F.col("`priority=missing`").alias("missing"))


@query(
    f"""SELECT o_orderkey, round(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END, 3) AS price, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderpriority IN ({", ".join(f"'{x}'" for x in _ORDER)}) THEN o_orderpriority END AS priority FROM orders"""
)
def card_round_trip(spark, sf_dir):
    """Encoded by a card and back again."""
    rows = declared_orders(spark, sf_dir)
    card = staged(prepare.fit_card(rows, ["price"], ["status"], ordinals={"priority": _ORDER}), "card")
    back = prepare.invert_card(prepare.apply_card(rows, "o_orderkey", card), "o_orderkey", card)
    return back.select("o_orderkey", F.round("price", 3).alias("price"), "status", "priority")


@query(
    """SELECT o_orderstatus AS scope, o_custkey % 500 AS t, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS value FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2"""
)
def bundle_merge(spark, sf_dir):
    """The last complete row of each table and scope."""
    orders = load(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderstatus").alias("scope"), (F.col("o_custkey") % 500).alias("t"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("value"), (F.col("o_orderpriority") != "5-LOW").alias("complete"))
    return landmarks.merged_bundles(rows, "scope", "t", "version", "complete").drop("complete")


@query()
def landmark_coordinates(spark, sf_dir):
    """The coordinates of lineitem by the members that take one aggregation each."""
    y = F.sin(F.col("l_quantity") / 8) + F.col("l_discount") * 5
    items = load(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), "l_quantity", "l_discount", y.alias("y"))
    panel = landmarks.signature(spark, items, "key", ["l_quantity", "l_discount"], "y", ["lin", "log", "hinge", "step", "pairs"])
    s = items.agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"), F.skewness("y").alias("skew")).first()
    return rounded(landmarks.coordinates(panel, s["n"], 2, 0, (s["m"], s["sd"], s["skew"])))


@query()
def class_landmarks(spark, sf_dir):
    """The panel's members that take one aggregation each, for three classes."""
    score = F.col("l_quantity") / 10 + F.col("l_discount") * 30 + (F.col("l_partkey") % 7) / 2
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")
    items = load(spark, sf_dir, "lineitem").select(key, "l_quantity", "l_discount", F.when(score > 7, "high").when(score > 4.5, "middle").otherwise("low").alias("class"))
    return rounded(landmarks.class_signature(spark, items, "key", ["l_quantity", "l_discount"], "class", ["lin", "hinge", "pairs"]))
