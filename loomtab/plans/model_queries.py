"""Queries of conditional models, screening and the landmark panel, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtab.operators import boosting, landmarks
from loomtab.operators.reducers import retention
from loomtab.operators.splits import fold_of
from loomtab.plans.catalogue import HEX, query, rounded
from loomtab.session import load


@query(
    """WITH t AS (SELECT l_quantity / 50 AS x, (l_extendedprice > 60000 + 300 * l_quantity)::INTEGER AS y FROM lineitem), s AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS xx, sum(y - 0.5) AS gy, sum((y - 0.5) * x) AS gxy FROM t),
h AS (SELECT n / 4 + 1e-9::DOUBLE AS a, sx / 4 AS b, xx / 4 + 0.001::DOUBLE * n AS c, gy, gxy FROM s) SELECT round((c * gy - b * gxy) / (a * c - b * b), 7) AS intercept, round((a * gxy - b * gy) / (a * c - b * b), 7) AS slope FROM h"""
)
def logistic_step(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")
    w = boosting.logistic_step(items, [F.col("l_quantity") / 50], F.col("l_extendedprice") > 60000 + 300 * F.col("l_quantity"), [0.0, 0.0])
    return spark.createDataFrame([(round(w[0], 7), round(w[1], 7))], "intercept double, slope double")


@query()
def logistic_fit(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")
    w = boosting.logistic(items, [F.col("l_quantity") / 50, F.col("l_discount") * 10], F.col("l_extendedprice") > 60000 + 300 * F.col("l_quantity"))
    return spark.createDataFrame([(k, round(x, 6)) for k, x in enumerate(w)], "term int, weight double")


_MODELS = {"A": [0.2, 1.0, -0.5], "N": [0.1, -0.4, 0.3], "R": [0.0, 0.2, 0.2]}
_LOGITS = {c: f"({w[0]} + {w[1]} * l_quantity / 50 + ({w[2]}) * l_discount * 10) / 1.5" for c, w in _MODELS.items()}
_SOFT = {c: f"exp(({e})::DOUBLE)" for c, e in _LOGITS.items()}
_SUM = " + ".join(_SOFT.values())


@query(
    f"""SELECT l_returnflag AS label, count(*)::BIGINT AS n, {", ".join(f"round(avg({e} / ({_SUM})), 7) AS p_{c.lower()}" for c, e in _SOFT.items())},
round(avg(-ln(CASE l_returnflag {" ".join(f"WHEN '{c}' THEN {e} / ({_SUM})" for c, e in _SOFT.items())} END)), 7) AS loss FROM lineitem GROUP BY 1"""
)
def class_probabilities(spark, sf_dir):
    p = boosting.class_probabilities(_MODELS, [F.col("l_quantity") / 50, F.col("l_discount") * 10], 1.5)
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), p.alias("p"))
    means = [F.avg(F.element_at("p", F.lit(c))).alias(f"p_{c.lower()}") for c in _MODELS]
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n"), *means, F.avg(boosting.cross_entropy(F.col("p"), F.col("label"))).alias("loss")), 7)


def _prior(where: str) -> str:
    return f"(SELECT l_linenumber AS k, l_returnflag AS label, (count(*) + 0.5) / (sum(count(*)) OVER (PARTITION BY l_linenumber) + 0.5 * count(*) OVER (PARTITION BY l_linenumber)) AS p FROM flags WHERE {where} GROUP BY 1, 2)"


@query(
    f"""WITH flags AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 AND l_orderkey % 4 <> 0 THEN 'N' ELSE l_returnflag END AS l_returnflag FROM lineitem),
null_ AS (SELECT l_returnflag AS label, (count(*) + 0.5) / (sum(count(*)) OVER () + 0.5 * count(*) OVER ()) AS p FROM flags WHERE l_orderkey % 5 <> 0 GROUP BY 1),
l AS (SELECT avg(-ln(coalesce(n.p, 1e-7))) AS n, avg(-ln(coalesce(r.p, 1e-7))) AS r, avg(-ln(coalesce(s.p, 1e-7))) AS s FROM flags t LEFT JOIN null_ n ON n.label = l_returnflag LEFT JOIN {_prior("l_orderkey % 5 <> 0")} r ON r.k = l_linenumber AND r.label = l_returnflag
LEFT JOIN {_prior("l_orderkey % 5 <> 0 AND l_orderkey % 7 = 0")} s ON s.k = l_linenumber AND s.label = l_returnflag WHERE l_orderkey % 5 = 0) SELECT round(n, 8) AS null_loss, round(r, 8) AS real_loss, round(s, 8) AS synthetic_loss, round((n - s) / (n - r), 6) AS retention FROM l"""
)
def class_retention(spark, sf_dir):
    """Cross entropies on held-out rows: of the prior, of class shares by line number of all training rows, and of a seventh of them."""
    items = load(spark, sf_dir, "lineitem")
    label = F.when((F.col("l_linenumber") % 3 == 0) & (F.col("l_orderkey") % 4 != 0), "N").otherwise(F.col("l_returnflag"))
    rows = items.select("l_orderkey", F.col("l_linenumber").alias("k"), label.alias("label"))
    train, held = rows.filter("l_orderkey % 5 <> 0"), rows.filter("l_orderkey % 5 = 0")

    def shares(df, name: str):
        counts = df.groupBy("k", "label").agg(F.count("*").alias("n"))
        whole = counts.groupBy("k").agg(F.sum("n").alias("t"), F.count("*").alias("c"))
        return counts.join(whole, "k").select("k", "label", ((F.col("n") + 0.5) / (F.col("t") + 0.5 * F.col("c"))).alias(name))

    prior = boosting.class_prior(train, F.col("label"))
    both = held.join(F.broadcast(prior), "label", "left").join(shares(train, "real"), ["k", "label"], "left").join(shares(train.filter("l_orderkey % 7 = 0"), "synthetic"), ["k", "label"], "left")
    # A class that a side hasn't seen has the least probability.
    loss = lambda p: F.avg(-F.ln(F.coalesce(p, F.lit(1e-7))))
    losses = both.agg(loss("prior").alias("null_loss"), loss("real").alias("real_loss"), loss("synthetic").alias("synthetic_loss"))
    r = retention(F.col("null_loss"), F.col("real_loss"), F.col("synthetic_loss"))
    return losses.select(*(F.round(c, 8).alias(c) for c in ("null_loss", "real_loss", "synthetic_loss")), F.round(r, 6).alias("retention"))


_CODED = "(SELECT floor(l_quantity * 5)::INTEGER AS quantity, floor(l_discount * 1000)::INTEGER AS discount, l_linenumber * 30 AS line, l_extendedprice / 10000 + l_quantity / 10 * (1 + l_linenumber % 2) AS y, (l_linenumber > 3)::INTEGER AS leaf FROM lineitem)"


def coded(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_quantity") * 5).cast("int").alias("quantity"), F.floor(F.col("l_discount") * 1000).cast("int").alias("discount"), (F.col("l_linenumber") * 30).alias("line"),
        (F.col("l_extendedprice") / 10000 + F.col("l_quantity") / 10 * (1 + F.col("l_linenumber") % 2)).alias("y"), (F.col("l_linenumber") > 3).cast("int").alias("leaf"),
    )


_LONG = f"(SELECT leaf, unnest(['quantity', 'discount', 'line']) AS feature, unnest([quantity, discount, line]) AS code, 5 - y AS g, 1.0 AS h FROM {_CODED})"


@query(f"SELECT leaf, feature, code, round(sum(g), 5) AS g, sum(h)::DOUBLE AS h, count(*)::BIGINT AS n FROM {_LONG} GROUP BY 1, 2, 3")
def boosting_histogram(spark, sf_dir):
    return rounded(boosting.histogram(coded(spark, sf_dir), F.col("leaf"), ["quantity", "discount", "line"], 5 - F.col("y"), F.lit(1.0)), 5)


@query(
    f"""WITH c AS (SELECT leaf, feature, code, sum(g) AS g, count(*)::DOUBLE AS n FROM {_LONG} GROUP BY 1, 2, 3), b AS (SELECT DISTINCT feature, code FROM c), l AS (SELECT DISTINCT leaf FROM c),
f AS (SELECT b.feature, b.code, l.leaf, coalesce(c.g, 0) AS g, coalesce(c.n, 0) AS n FROM b CROSS JOIN l LEFT JOIN c ON c.feature = b.feature AND c.code = b.code AND c.leaf = l.leaf),
s AS (SELECT feature, code, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY feature, leaf) AS gt, sum(n) OVER (PARTITION BY feature, leaf) AS nt FROM f WINDOW w AS (PARTITION BY feature, leaf ORDER BY code)),
g AS (SELECT feature, code, sum(gl * gl / (nl + 1) + pow(gt - gl, 2) / (nt - nl + 1)) AS gain, sum(nl) AS nl, sum(nt) AS nt FROM s GROUP BY 1, 2)
SELECT feature, code, round(gain, 3) AS gain FROM g WHERE nl >= 20 AND nt - nl >= 20 ORDER BY round(gain, 9) DESC, feature, code LIMIT 1"""
)
def boosting_split(spark, sf_dir):
    return rounded(boosting.best_split(boosting.histogram(coded(spark, sf_dir), F.col("leaf"), ["quantity", "discount", "line"], 5 - F.col("y"), F.lit(1.0))), 3)


@query()
def boosted_forest(spark, sf_dir):
    rows = coded(spark, sf_dir).withColumn("held", F.pmod(F.xxhash64("quantity", "discount", "y"), F.lit(5)) == 0)
    forest = boosting.boost(rows, ["quantity", "discount", "line"], "y", trees=3, depth=2, hold=F.col("held"))
    mean = rows.agg(F.avg("y").alias("m"))
    return rounded(rows.filter("held").join(F.broadcast(mean)).agg(F.avg(F.pow(F.col("y") - F.col("m"), 2)).alias("null_loss"), F.avg(F.pow(F.col("y") - forest.output(), 2)).alias("loss")))


_RESIDUAL = "(SELECT l_quantity / 50 AS x, (l_discount - 0.05) * (1 + l_quantity / 50) AS r FROM lineitem)"


@query(
    f"""WITH t AS (SELECT x, r, (SELECT sqrt(avg(r * r)) FROM {_RESIDUAL}) AS sd FROM {_RESIDUAL}), u AS (SELECT x, r, sd, ln(greatest(abs(r), 1e-6::DOUBLE * sd)) + 0.635181422730739::DOUBLE AS t FROM t),
s AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) * 1.0 + 0.01::DOUBLE * count(*) AS xx, sum(t) AS st, sum(x * t) AS xt FROM u), c AS (SELECT (xx * st - sx * xt) / (n * xx - sx * sx) AS a, (n * xt - sx * st) / (n * xx - sx * sx) AS b FROM s),
v AS (SELECT sqrt(avg(pow(r / greatest(0.2::DOUBLE * sd, least(4 * sd, exp(a + b * x))), 2))) AS scale FROM u, c) SELECT round(a + ln(scale), 6) AS intercept, round(b, 6) AS slope FROM c, v"""
)
def noise_scale(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("x"), ((F.col("l_discount") - 0.05) * (1 + F.col("l_quantity") / 50)).alias("r"))
    c = boosting.noise_scale(rows, "r", ["x"])["coefficients"]
    return spark.createDataFrame([(round(c[0], 6), round(c[1], 6))], "intercept double, slope double")


_TEMPERATURES = [0.25, 0.5, 1.0, 2.0, 4.0]


@query(
    f"""WITH t AS (SELECT (l_quantity - 25) / 5 AS z, (l_extendedprice > 50000)::INTEGER AS y FROM lineitem) SELECT t::DOUBLE AS temperature, round(avg(ln(1 + exp(-abs(z / t))) + greatest(z / t, 0) - y * z / t), 8) AS loss FROM t, unnest({_TEMPERATURES}) u(t) GROUP BY 1"""
)
def temperature_grid(spark, sf_dir):
    return rounded(boosting.temperatures(load(spark, sf_dir, "lineitem"), (F.col("l_quantity") - 25) / 5, F.col("l_extendedprice") > 50000, _TEMPERATURES), 8)


@query(f"SELECT o_orderkey, {HEX.format(chr(40) + chr(39) + 'draw' + chr(39) + ' || o_orderkey' + chr(41))} / 4294967296.0::DOUBLE < o_totalprice / 500000 AS drawn FROM orders")
def drawn_classes(spark, sf_dir):
    return boosting.cumulative_noise(load(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice") / 500000)


_MID = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
_SCREENED = {"quantity": "l_quantity", "discount": "l_discount", "line": "l_linenumber"}
_YY = "(l_extendedprice / 1000 + 2 * l_quantity)"


@query(
    "WITH r AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS feature, {j} AS j, (SELECT corr(a, b) FROM (SELECT {_MID.format(c=e)} AS a, {_MID.format(c=_YY)} AS b FROM lineitem)) AS rho" for j, (n, e) in enumerate(_SCREENED.items()))
    + ") SELECT feature, round(rho, 8) AS rho, (row_number() OVER (ORDER BY round(abs(rho), 9) DESC, j) - 1)::INTEGER AS place FROM r"
)
def screened_features(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")
    return rounded(boosting.associations(items, {n: F.col(e) for n, e in _SCREENED.items()}, F.col("l_extendedprice") / 1000 + 2 * F.col("l_quantity")), 8)


_PAIRED = {"quantity": "CASE WHEN l_linenumber <> 3 THEN l_quantity END", "price": "CASE WHEN l_linenumber <> 5 THEN l_extendedprice + 500 * l_quantity END", "discount": "l_discount"}


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (({_PAIRED[a]}) IS NOT NULL AND ({_PAIRED[b]}) IS NOT NULL)::BIGINT AS n, round(greatest(-0.995, least(0.995, corr({_PAIRED[a]}, {_PAIRED[b]}) / (0.9::DOUBLE * 0.9::DOUBLE))), 8) AS r FROM lineitem"
        for a, b in (("quantity", "price"), ("quantity", "discount"), ("price", "discount"))
    )
)
def latent_correlations(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")
    return rounded(boosting.correlation_pairs(items, {n: F.expr(e) for n, e in _PAIRED.items()}, dict.fromkeys(_PAIRED, 0.9)), 8)


_SPLIT = f"(SELECT {HEX.format('l_orderkey')} % 4 AS fold, l_extendedprice / 1000 + CASE WHEN (l_quantity > 25) = (l_discount > 0.05) THEN 40 ELSE 0 END AS y, l_quantity > (SELECT median(l_quantity) FROM lineitem) AS quantity, l_discount > (SELECT median(l_discount) FROM lineitem) AS discount, l_tax > (SELECT median(l_tax) FROM lineitem) AS tax FROM lineitem)"


@query(
    f"""WITH r AS (SELECT * FROM {_SPLIT}), c AS (SELECT fold, y, unnest(['quantity', 'quantity', 'discount']) AS a, unnest(['discount', 'tax', 'tax']) AS b, unnest([quantity::VARCHAR || discount::VARCHAR, quantity::VARCHAR || tax::VARCHAR, discount::VARCHAR || tax::VARCHAR]) AS cell FROM r),
s AS (SELECT fold, a, b, cell, sum(y) AS s, count(*) AS n, sum(y * y) AS q FROM c GROUP BY 1, 2, 3, 4),
m AS (SELECT *, (sum(s) OVER (PARTITION BY a, b) - sum(s) OVER (PARTITION BY a, b, fold)) / nullif(sum(n) OVER (PARTITION BY a, b) - sum(n) OVER (PARTITION BY a, b, fold), 0) AS base, (sum(s) OVER (PARTITION BY a, b, cell) - s) / nullif(sum(n) OVER (PARTITION BY a, b, cell) - n, 0) AS own FROM s)
SELECT a, b, round(1 - sum(q - 2 * coalesce(own, base) * s + pow(coalesce(own, base), 2) * n) / sum(q - 2 * base * s + base * base * n), 7) AS gain FROM m GROUP BY 1, 2"""
)
def interaction_screen(spark, sf_dir):
    y = F.col("l_extendedprice") / 1000 + F.when((F.col("l_quantity") > 25) == (F.col("l_discount") > 0.05), 40).otherwise(0)
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), y.alias("y"))
    return rounded(boosting.interaction_gains(items, ["quantity", "discount", "tax"], F.col("y"), fold_of(F.col("l_orderkey"), 4)), 7)


@query()
def landmark_panel(spark, sf_dir):
    """The members that are linear in their bases, over all of lineitem."""
    y = F.sin(F.col("l_quantity") / 8) + F.col("l_discount") * 5 + (F.col("l_quantity") - 25) * F.col("l_discount") / 5
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")
    items = load(spark, sf_dir, "lineitem").select(key, "l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("l_discount"), y.alias("y"))
    members = [m for m, family in landmarks.PANEL.items() if family in ("additive", "interaction", "kernel", "missingness", "dominance") or m == "lin_quarter"]
    return rounded(landmarks.signature(spark, items, "key", ["l_quantity", "l_discount"], "y", members))


def flagged(spark, sf_dir):
    """lineitem with a class that its numbers tell in part."""
    score = F.col("l_quantity") / 10 + F.col("l_discount") * 30 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0) + (F.col("l_partkey") % 7) / 2
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")
    return load(spark, sf_dir, "lineitem").select(key, "l_quantity", "l_discount", "l_linestatus", F.when(score > 7, "high").when(score > 4.5, "middle").otherwise("low").alias("class"))


@query()
def class_program_retention(spark, sf_dir):
    from loomtab.operators import classes

    return rounded(classes.class_retention(spark, flagged(spark, sf_dir), "key", "class", ["l_quantity", "l_discount"], ["l_linestatus"]))


@query(
    """SELECT 'l_linenumber' AS "column", 'uint16' AS storage UNION ALL SELECT 'is_return', 'bits' UNION ALL SELECT 'l_discount', 'grid' UNION ALL SELECT 'l_extendedprice', 'float64'"""
)
def storage_plan(spark, sf_dir):
    from loomtab.sources import files

    items = load(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("is_return"), "l_discount", "l_extendedprice")
    return files.storage_plan(items)
