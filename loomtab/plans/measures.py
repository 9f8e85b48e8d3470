"""Queries of evidence over a ledger of evaluations made from lineitem, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtab.operators import ledger
from loomtab.plans.catalogue import HEX, query, rounded
from loomtab.session import in_file_order, load

#: A cell: method, configuration, dataset, seed, its bytes and its retention (null where it failed).
LEDGER = """(SELECT l_returnflag AS method, l_linenumber AS config, l_suppkey % 12 AS dataset, l_partkey % 3 AS seed, (200 * l_linenumber + 5 * (l_suppkey % 12))::BIGINT AS bytes,
CASE WHEN (l_suppkey + l_partkey) % 37 <> 0 THEN l_discount * 12 - 0.1 END AS robust, l_tax * 10 AS null_loss, l_tax * 4 AS real_loss, l_tax * 4 + l_discount AS synthetic_loss, l_linestatus AS status FROM lineitem)"""


def cells(spark, sf_dir):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("config"), (supp % 12).alias("dataset"), (part % 3).alias("seed"), (200 * F.col("l_linenumber") + 5 * (supp % 12)).cast("long").alias("bytes"),
        F.when((supp + part) % 37 != 0, F.col("l_discount") * 12 - 0.1).alias("robust"), (F.col("l_tax") * 10).alias("null_loss"), (F.col("l_tax") * 4).alias("real_loss"), (F.col("l_tax") * 4 + F.col("l_discount")).alias("synthetic_loss"),
        F.col("l_linestatus").alias("status"),
    )


@query(f"WITH m AS (SELECT method, config, avg(null_loss) AS n, avg(real_loss) AS r, avg(synthetic_loss) AS s, count(*) AS c FROM {LEDGER} GROUP BY 1, 2) SELECT method, config, c::BIGINT AS n, round(s - r, 8) AS gap, round((s - r) / n, 8) AS null_gap, round((n - s) / (n - r), 8) AS retention FROM m")
def paired_loss_summary(spark, sf_dir):
    found = ledger.loss_summary(cells(spark, sf_dir), ["method", "config"], "null_loss", "real_loss", "synthetic_loss")
    return rounded(found.select("method", "config", "n", "gap", "null_gap", "retention"), 8)


@query(f"SELECT method, round(avg(h), 8) AS harm, count(*) FILTER (h > 0)::BIGINT AS harmed, count(*) FILTER (h < 0)::BIGINT AS helped FROM (SELECT method, round(synthetic_loss - (0.9::DOUBLE * real_loss + 0.1::DOUBLE * null_loss), 9) AS h FROM {LEDGER}) GROUP BY 1")
def query_harm(spark, sf_dir):
    h = F.round(ledger.query_harm(F.col("null_loss"), F.col("real_loss"), F.col("synthetic_loss")), 9)
    return rounded(cells(spark, sf_dir).select("method", h.alias("h")).groupBy("method").agg(F.avg("h").alias("harm"), F.count_if(F.col("h") > 0).alias("harmed"), F.count_if(F.col("h") < 0).alias("helped")), 8)


_DRIVERS = "(SELECT l_returnflag AS method, l_linenumber AS feature, round(avg(l_discount), 3) AS r, round(avg(l_tax), 3) AS s FROM lineitem GROUP BY 1, 2)"


def drivers(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("feature")).agg(F.round(F.avg("l_discount"), 3).alias("r"), F.round(F.avg("l_tax"), 3).alias("s"))


@query(
    f"""WITH p AS (SELECT a.method, sign(a.r - b.r) AS r, sign(a.s - b.s) AS s FROM {_DRIVERS} a JOIN {_DRIVERS} b ON a.method = b.method AND a.feature < b.feature)
SELECT method, count(*) FILTER (r <> 0)::BIGINT AS informative_pairs, count(*)::BIGINT AS total_pairs, round(avg(CASE WHEN r = s THEN 1.0 WHEN s = 0 THEN 0.5 ELSE 0.0 END) FILTER (r <> 0), 8) AS informative,
round(avg(CASE WHEN r = s THEN 1.0 WHEN r = 0 OR s = 0 THEN 0.5 ELSE 0.0 END), 8) AS agreement FROM p GROUP BY 1"""
)
def rank_agreement(spark, sf_dir):
    return rounded(ledger.informative_ranks(drivers(spark, sf_dir), "method", "feature", "r", "s"), 8)


@query(f"SELECT method, round(sum(CASE WHEN sign(r - 0.05) = sign(s - 0.04) THEN abs(r - 0.05) ELSE 0 END) / sum(abs(r - 0.05)), 8) AS sign FROM {_DRIVERS} GROUP BY 1")
def sign_agreement(spark, sf_dir):
    shifted = drivers(spark, sf_dir).select("method", (F.col("r") - 0.05).alias("r"), (F.col("s") - 0.04).alias("s"))
    return rounded(ledger.sign_agreement(shifted, "method", "r", "s"), 8)


@query(
    """WITH c AS (SELECT l_returnflag AS g, l_linestatus AS a, l_linenumber AS b, avg(l_discount) AS r, avg(l_discount) + avg(l_tax) / 2 AS s FROM lineitem GROUP BY 1, 2, 3),
d AS (SELECT g, r - avg(r) OVER (PARTITION BY g, a) - avg(r) OVER (PARTITION BY g, b) + avg(r) OVER (PARTITION BY g) AS r, s - avg(s) OVER (PARTITION BY g, a) - avg(s) OVER (PARTITION BY g, b) + avg(s) OVER (PARTITION BY g) AS s FROM c)
SELECT g, round(coalesce(sum(r * s) / nullif(sqrt(sum(r * r) * sum(s * s)), 0), 0), 5) AS interaction FROM d GROUP BY 1"""
)
def interaction_agreement(spark, sf_dir):
    means = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("a"), F.col("l_linenumber").alias("b")).agg(F.avg("l_discount").alias("r"), (F.avg("l_discount") + F.avg("l_tax") / 2).alias("s"))
    return rounded(ledger.interaction_agreement(means, "g", "a", "b", "r", "s"), 5)


@query(
    """WITH c AS (SELECT l_returnflag AS g, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), s AS (SELECT g, x, w / sum(w) OVER (PARTITION BY g) AS w, (sum(w) OVER (PARTITION BY g ORDER BY x DESC) - w) / sum(w) OVER (PARTITION BY g) AS b FROM c)
SELECT g AS l_returnflag, round(sum(x * greatest(0.0, least(w, 0.1 - b))) / 0.1, 3) AS cvar FROM s GROUP BY 1"""
)
def weighted_cvar(spark, sf_dir):
    return rounded(ledger.weighted_cvar(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity", 0.9), 3)


_BUDGETS = [256, 512, 1024, 2048]


@query(
    f"""WITH f AS (SELECT method, config, b, median(CASE WHEN robust IS NOT NULL AND bytes <= b THEN least(1.0, greatest(0.0, robust)) ELSE 0.0 END) AS m FROM {LEDGER}, unnest({_BUDGETS}) t(b) GROUP BY 1, 2, 3),
v AS (SELECT method, b, max(m) AS v FROM f GROUP BY 1, 2), s AS (SELECT method, b, v, ln(b) AS x, lag(v) OVER w AS pv, lag(ln(b)) OVER w AS px FROM v WINDOW w AS (PARTITION BY method ORDER BY b))
SELECT method, round(100 * sum((x - px) * (v + pv) / 2) / (max(x) - min(x)), 6) AS btr_auc, min(b) FILTER (v >= 0.9)::INTEGER AS t90_budget FROM s GROUP BY 1"""
)
def btr_auc(spark, sf_dir):
    return rounded(ledger.btr_auc(cells(spark, sf_dir), "method", "config", "seed", "bytes", "robust", _BUDGETS))


@query(
    f"""WITH c AS (SELECT dataset, config, max((coalesce(robust, 0) >= 1.05)::INTEGER) AS q, min(bytes) FILTER (coalesce(robust, 0) >= 1.05 AND bytes <= 1000) AS b FROM {LEDGER} GROUP BY 1, 2),
m AS (SELECT *, q = 0 AND coalesce(max(q) OVER (PARTITION BY dataset ORDER BY config ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS broken FROM c)
SELECT r.dataset, min(b)::BIGINT AS minimum_bytes, coalesce(bool_or(broken), false) AS non_monotone FROM (SELECT unnest(range(15)) AS dataset) r LEFT JOIN m ON r.dataset = m.dataset GROUP BY 1"""
)
def roster_frontier(spark, sf_dir):
    trials = cells(spark, sf_dir).withColumn("qualified", F.coalesce("robust", F.lit(0.0)) >= 1.05)
    return ledger.roster_frontier(spark.range(15).select(F.col("id").alias("dataset")), trials, "dataset", "config", "bytes", "qualified", 1000)


@query(
    """WITH s AS (SELECT l_suppkey AS artifact, l_partkey % 50 AS digest, (l_partkey % 50) * 3 + 7 AS bytes, 1 + l_suppkey % 4 AS users FROM lineitem WHERE l_linenumber <= 7), o AS (SELECT artifact, digest, max(bytes) AS bytes, max(users) AS users, count(*) AS copies FROM s GROUP BY 1, 2),
h AS (SELECT digest, count(*) AS holders FROM o GROUP BY 1) SELECT artifact, sum(bytes * copies)::BIGINT AS all_bytes, sum(bytes)::BIGINT AS own_bytes, round(sum(bytes / holders) / max(users), 6) AS charged_bytes FROM o JOIN h USING (digest) GROUP BY 1"""
)
def artifact_charges(spark, sf_dir):
    d = F.col("l_partkey") % 50
    sections = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("artifact"), d.alias("digest"), (d * 3 + 7).alias("bytes"), (1 + F.col("l_suppkey") % 4).alias("users"))
    return rounded(ledger.charges(sections, "artifact", "digest", "bytes", "users"))


_CHOICES = "(SELECT l_suppkey AS g, l_linenumber AS c, round(avg(l_tax), 2) AS v, avg(l_discount) AS t FROM lineitem GROUP BY 1, 2)"


@query(
    f"""WITH m AS (SELECT g, min(v) AS mv, min(t) AS best FROM {_CHOICES} GROUP BY 1), x AS (SELECT g, count(*) FILTER (v = mv) AS ties, arg_min(c, c) FILTER (v = mv) AS chosen, arg_min(t, c) FILTER (v = mv) AS ct, min(c) FILTER (t = best) AS real_best, min(best) AS best FROM {_CHOICES} JOIN m USING (g) GROUP BY 1)
SELECT g, ties > 1 AS tied, CASE WHEN ties = 1 THEN chosen END AS chosen, real_best, CASE WHEN ties = 1 THEN round(ct - best, 8) END AS regret FROM x"""
)
def choice_regret(spark, sf_dir):
    rows = in_file_order(load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("c"), "l_tax", "l_discount"))
    means = ledger.ordered_means(rows, ["g", "c"], ["__file", "__row"], {"l_tax": "v", "l_discount": "t"})
    found = means.withColumn("v", F.round("v", 2))
    return rounded(ledger.choice_regret(found, "g", "c", "v", "t"), 8)


@query(
    """WITH w AS (SELECT l_linenumber AS k, count(*) FILTER (l_discount > l_tax) AS a, count(*) FILTER (l_discount < l_tax) AS b FROM lineitem GROUP BY 1), t AS (SELECT k, a, b, unnest(range(0, least(a, b) + 1)) AS i FROM w)
SELECT k, a::BIGINT AS wins, b::BIGINT AS losses, round(least(1.0, 2 * sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2)))), 8) AS p FROM t GROUP BY 1, 2, 3"""
)
def sign_tests(spark, sf_dir):
    won = load(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.count_if(F.col("l_discount") > F.col("l_tax")).alias("wins"), F.count_if(F.col("l_discount") < F.col("l_tax")).alias("losses"))
    return won.withColumn("p", F.round(ledger.sign_test(F.col("wins"), F.col("losses")), 8))


def _weight(salt: str, key: str) -> str:
    u = f"{HEX.format(chr(40) + chr(39) + salt + ':' + chr(39) + ' || d || ' + chr(39) + ':' + chr(39) + ' || ' + key + chr(41))} / 4294967296.0::DOUBLE"
    return "(" + " + ".join(f"(({u}) >= {p})::INTEGER" for p in ledger.POISSON) + ")"


_CROSSED = f"""c AS (SELECT method, dataset, seed, sum(synthetic_loss) AS s, count(*) AS n FROM {LEDGER} GROUP BY 1, 2, 3),
b AS (SELECT d, method, sum({_weight("f", "dataset")} * {_weight("s", "seed")} * s) / nullif(sum({_weight("f", "dataset")} * {_weight("s", "seed")} * n), 0) AS mean FROM c, range(40) t(d) GROUP BY 1, 2)"""


@query(f"WITH {_CROSSED} SELECT d::INTEGER AS draw, method, round(mean, 8) AS mean FROM b")
def crossed_bootstrap(spark, sf_dir):
    return rounded(ledger.crossed_bootstrap(cells(spark, sf_dir), ["method"], "dataset", "seed", "synthetic_loss", 40), 8)


@query(
    f"""WITH {_CROSSED}, m AS (SELECT method, avg(synthetic_loss) AS v FROM {LEDGER} GROUP BY 1), s AS (SELECT method, stddev_samp(mean - v) AS sd FROM b JOIN m USING (method) GROUP BY 1),
t AS (SELECT d, max(abs((mean - v) / sd)) AS t FROM b JOIN m USING (method) JOIN s USING (method) GROUP BY 1), q AS (SELECT quantile_cont(t, 0.95) AS c FROM t)
SELECT method, round(v, 6) AS mean_value, round(v - c * sd, 6) AS lower, round(v + c * sd, 6) AS upper FROM m JOIN s USING (method), q"""
)
def simultaneous_bounds(spark, sf_dir):
    return rounded(ledger.simultaneous_bounds(cells(spark, sf_dir), "method", "dataset", "seed", "synthetic_loss", 40))


@query(
    f"""WITH v AS (SELECT s_nationkey AS k, avg(s_acctbal) AS v FROM supplier GROUP BY 1), a AS (SELECT list(v ORDER BY k) AS a, count(*) AS n, median(v) AS centre FROM v),
p AS (SELECT d, a[1 + {HEX.format("(d || ':' || j)")} % n] AS x FROM a, range(50) t(d), unnest(range(n)) u(j)), m AS (SELECT d, median(x) AS m FROM p GROUP BY 1)
SELECT round(any_value(centre), 6) AS centre, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM m, a"""
)
def median_interval(spark, sf_dir):
    means = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("v"))
    return rounded(ledger.median_interval(means, "k", "v", 50))


_TERMS = {"utility": 0.3, "drivers": 0.25, "distribution": 0.2, "structure": 0.15, "compactness": 0.1}


@query(
    """WITH t AS (SELECT l_suppkey, avg(l_discount) * 10 AS u, avg(l_tax) * 10 AS d, avg(l_quantity) / 50 AS f, avg((l_returnflag = 'R')::INTEGER) AS s, least(1.0, 100 / count(*)) AS c, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN n >= 5 THEN round(exp(0.3::DOUBLE * ln(greatest(u, 1e-6)) + 0.25::DOUBLE * ln(greatest(d, 1e-6)) + 0.2::DOUBLE * ln(greatest(f, 1e-6)) + 0.15::DOUBLE * ln(greatest(s, 1e-6)) + 0.1::DOUBLE * ln(greatest(c, 1e-6))), 6) END AS score, round(u - 0.03::DOUBLE * log2(n * 16 / 1000), 6) AS corrected FROM t"""
)
def composite_fitness(spark, sf_dir):
    terms = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        (F.avg("l_discount") * 10).alias("utility"), (F.avg("l_tax") * 10).alias("drivers"), (F.avg("l_quantity") / 50).alias("distribution"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("structure"),
        F.least(F.lit(1.0), 100 / F.count("*")).alias("compactness"), F.count("*").alias("n"),
    )
    return terms.select("l_suppkey", F.round(ledger.composite(terms, _TERMS, [F.col("n") >= 5]), 6).alias("score"), F.round(ledger.byte_corrected(F.col("utility"), F.col("n") * 16, F.lit(1000.0)), 6).alias("corrected"))


@query(
    f"""WITH v AS (SELECT row_number() OVER (ORDER BY c_custkey, c_acctbal) - 1 AS place, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () + 0.3 AS x, count(*) OVER () AS m FROM customer),
p AS (SELECT d, n, {HEX.format("(d || ':' || n || ':' || i)")} % (SELECT count(*) FROM customer) AS place FROM range(200) a(d), (SELECT unnest([10, 40]) AS n), unnest(range(1, n + 1)) t(i)), x AS (SELECT d, n, x FROM p JOIN v USING (place)),
t AS (SELECT d, n, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t FROM x GROUP BY 1, 2) SELECT n, round(avg((t > 1.96)::INTEGER), 8) AS power FROM t GROUP BY 1"""
)
def power_simulation(spark, sf_dir):
    return rounded(ledger.power_simulation(load(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", [10, 40], 0.3, 200), 8)


@query("SELECT l_suppkey, round(low, 6) AS low, round(high, 6) AS high, round(low - high, 6) AS discrepancy FROM (SELECT l_suppkey, avg(l_discount) FILTER (l_linestatus = 'F') AS low, avg(l_discount) FILTER (l_linestatus = 'O') AS high FROM lineitem GROUP BY 1) WHERE low IS NOT NULL AND high IS NOT NULL")
def fidelity_pairs(spark, sf_dir):
    return rounded(ledger.fidelity_pairs(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_linestatus", "F", "O", "l_discount"))


@query(
    f"""WITH w AS (SELECT status, config, dataset, avg(synthetic_loss) FILTER (method = 'A') AS x, avg(synthetic_loss) FILTER (method = 'R') AS y FROM {LEDGER} GROUP BY 1, 2, 3)
SELECT status, config, count(*)::BIGINT AS cells, round(avg(x - y), 7) AS difference, round(stddev_samp(x - y) / sqrt(count(*)), 7) AS error, round(avg((x - y > 0)::INTEGER), 8) AS wins FROM w WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY CUBE (status, config)"""
)
def paired_cells(spark, sf_dir):
    found = ledger.paired_cells(cells(spark, sf_dir), ["status", "config"], "dataset", "method", "A", "R", "synthetic_loss")
    return found.select("status", "config", "cells", F.round("difference", 7).alias("difference"), F.round("error", 7).alias("error"), F.round("wins", 8).alias("wins"))
