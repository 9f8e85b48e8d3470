"""More queries of the catalogue: intake, set operations, moments, evidence and models."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtab.functions import cells
from loomtab.operators import models, splits
from loomtab.plans.catalogue import HEX, query, rounded
from loomtab.session import load
from loomtab.sources import files


@query(
    """SELECT 'o_orderstatus' AS "column", 'category' AS kind, count(*)::BIGINT AS present, 0::BIGINT AS numbers, count(DISTINCT o_orderstatus)::BIGINT AS levels FROM orders
UNION ALL SELECT 'o_totalprice', 'number', count(*), count(*), count(DISTINCT o_totalprice) FROM orders
UNION ALL SELECT 'clerk', 'dropped', count(*), 0, count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'gap', 'number', count(*) FILTER (o_orderkey % 3 <> 0), count(*) FILTER (o_orderkey % 3 <> 0), count(DISTINCT CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END) FROM orders"""
)
def infer_schema(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    text = orders.select("o_orderstatus", F.col("o_totalprice").cast("string").alias("o_totalprice"), F.concat(F.lit("clerk "), "o_orderkey").alias("clerk"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(" N/A ")).otherwise(F.col("o_custkey").cast("string")).alias("gap"))
    return files.infer(text, "o_orderstatus").select("column", "kind", "present", "numbers", "levels")


@query("SELECT o_orderkey, round(epoch_us(o_orderdate) / 86400000000, 6) AS days, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_days(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(cells.days(F.col("o_orderdate")), 6).alias("days"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 8) AS signed_log FROM customer")
def signed_log(spark, sf_dir):
    return rounded(load(spark, sf_dir, "customer").select("c_custkey", cells.signed_log(F.col("c_acctbal")).alias("signed_log")), 8)


@query("SELECT median(abs(l_quantity - m)) AS mad, median(l_quantity) AS centre FROM lineitem, (SELECT median(l_quantity) AS m FROM lineitem)")
def median_absolute_deviation(spark, sf_dir):
    from loomtab.operators.columns import median_and_deviation

    return median_and_deviation(load(spark, sf_dir, "lineitem"), "l_quantity").select("mad", "centre")


@query("SELECT round(avg(pow(z, 3)), 4) AS skew, round(avg(pow(z, 4)) - 3, 4) AS excess FROM (SELECT (l_extendedprice - m) / s AS z FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem))")
def shape_moments(spark, sf_dir):
    return rounded(load(spark, sf_dir, "lineitem").agg(F.skewness("l_extendedprice").alias("skew"), F.kurtosis("l_extendedprice").alias("excess")), 4)


@query("SELECT round((2 * sum(k * x) / (max(n) * sum(x))) - (max(n) + 1) / max(n), 8) AS gini FROM (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS k, count(*) OVER () AS n FROM orders)")
def gini(spark, sf_dir):
    from loomtab.operators.ranks import value_ranks

    counted = value_ranks(load(spark, sf_dir, "orders"), "o_totalprice")
    sums = counted.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mid_rank") * F.col("o_totalprice")).alias("k"), F.sum(F.col("n") * F.col("o_totalprice")).alias("s"))
    return rounded(sums.select((2 * F.col("k") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini")), 8)


@query("SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def feature_intersection(spark, sf_dir):
    a = load(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"))
    return a.intersect(load(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT n_nationkey AS nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def roster_except(spark, sf_dir):
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey")).subtract(load(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT 'customer' AS side, c_nationkey AS nationkey, count(*)::BIGINT AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def union_sides(spark, sf_dir):
    a = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n")).withColumn("side", F.lit("customer"))
    return a.unionByName(load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n")).withColumn("side", F.lit("supplier")))


@query(
    f"SELECT count(*)::BIGINT AS n_rows, sum({HEX.format('(o_orderkey || chr(1) || o_orderstatus || chr(1) || o_orderpriority)')})::BIGINT AS fingerprint FROM orders"
)
def content_fingerprint(spark, sf_dir):
    """The same for any order of rows: hashes are added up."""
    row = F.concat_ws("\x01", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return load(spark, sf_dir, "orders").agg(F.count("*").alias("n_rows"), F.sum(cells.hashed(row)).alias("fingerprint"))


@query(
    f"SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HEX.format('o_orderkey')}, o_orderkey) AS k FROM orders) WHERE k <= 50"
)
def capped_strata(spark, sf_dir):
    return splits.capped(load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), "o_orderkey", "o_orderstatus", 50)


@query("SELECT event_type, (date_diff('day', DATE '2024-01-01', ts::DATE) // 7)::BIGINT AS block, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_users FROM events GROUP BY 1, 2")
def time_block_folds(spark, sf_dir):
    block = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7)
    return load(spark, sf_dir, "events").groupBy("event_type", block.cast("long").alias("block")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(
    """WITH g AS (SELECT p_type, p_brand, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1, 2), f AS (SELECT CASE WHEN n >= 10 THEN p_brand ELSE 'other' END AS p_brand, p_type, n, m FROM g)
SELECT p_brand, count(*)::BIGINT AS n_cells, round(sum(n * m) / sum(n), 6) AS mean_value FROM f GROUP BY 1"""
)
def kpi_folding(spark, sf_dir):
    """Cells with too few rows are folded into one profile before the second roll-up."""
    first = load(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("m"))
    folded = first.withColumn("p_brand", F.when(F.col("n") >= 10, F.col("p_brand")).otherwise("other"))
    return rounded(folded.groupBy("p_brand").agg(F.count("*").alias("n_cells"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean_value")))


@query(
    """WITH c AS (SELECT s_nationkey AS k, s_suppkey AS a, s_acctbal AS score, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
SELECT k AS nationkey, arg_min(a, r) AS chosen, round(max(score) - arg_min(score, r), 6) AS regret FROM c GROUP BY 1"""
)
def selection_regret(spark, sf_dir):
    found = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.min("s_suppkey").alias("chosen"), (F.max("s_acctbal") - F.min_by("s_acctbal", "s_suppkey")).alias("regret"))
    return rounded(found)


@query(
    """WITH r AS (SELECT l_shipdate::DATE AS d, count(*) AS n FROM lineitem GROUP BY 1)
SELECT d::VARCHAR AS d, n::BIGINT AS n, (n - lag(n) OVER (ORDER BY d))::BIGINT AS step, max(n) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)::BIGINT AS best FROM r"""
)
def adjacent_steps(spark, sf_dir):
    days = load(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(F.count("*").alias("n"))
    order = W.orderBy("d")  # a row a day
    return days.select(F.col("d").cast("string").alias("d"), "n", (F.col("n") - F.lag("n").over(order)).alias("step"), F.max("n").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("best"))


@query(
    """WITH a AS (SELECT l_returnflag AS c, count(*) / sum(count(*)) OVER () AS p FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT l_returnflag AS c, count(*) / sum(count(*)) OVER () AS q FROM lineitem WHERE l_orderkey % 2 <> 0 GROUP BY 1)
SELECT round(1 - sum(abs(p - q)) / 2, 8) AS mass FROM a JOIN b USING (c)"""
)
def mass_agreement(spark, sf_dir):
    side = F.col("l_orderkey") % 2 == 0
    counts = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    every = W.partitionBy(F.lit(0))  # a row a class
    both = counts.select((F.col("a") / F.sum("a").over(every)).alias("p"), (F.col("b") / F.sum("b").over(every)).alias("q"))
    return rounded(both.agg((1 - F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("mass")), 8)


@query(
    """SELECT l_returnflag, round(avg(x), 6) AS mean_value, round(avg(x) - 1.6448536269514722 * stddev_samp(x) / sqrt(count(*)), 6) AS lower FROM (SELECT l_returnflag, l_suppkey, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2) GROUP BY 1"""
)
def clustered_lower_bound(spark, sf_dir):
    means = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_extendedprice").alias("x"))
    return rounded(means.groupBy("l_returnflag").agg(F.avg("x").alias("mean_value"), (F.avg("x") - 1.6448536269514722 * F.stddev_samp("x") / F.sqrt(F.count("*"))).alias("lower")))


@query(
    """SELECT round(avg(CASE WHEN p >= 0.5 THEN y ELSE 1 - y END), 8) AS accuracy, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) AS log_loss, round(avg(pow(p - y, 2)), 8) AS brier
FROM (SELECT greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, l_quantity / 51)) AS p, (l_returnflag = 'N')::INTEGER AS y FROM lineitem)"""
)
def classification_losses(spark, sf_dir):
    p, y = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("l_quantity") / 51)), (F.col("l_returnflag") == "N").cast("int")
    df = load(spark, sf_dir, "lineitem").select(p.alias("p"), y.alias("y"))
    return rounded(df.agg(F.avg(F.when(F.col("p") >= 0.5, F.col("y")).otherwise(1 - F.col("y"))).alias("accuracy"), F.avg(-(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p")))).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier")), 8)


@query("SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def csv_round_trip(spark, sf_dir):
    """Cells written to CSV and read under the intake's rules give the table back."""
    from loomtab.session import scratch

    path = scratch(spark, "csv")
    files.write_csv(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    back = files.read_cells(spark, path)
    return back.filter(cells.present_number(F.col("c_acctbal")).isNotNull()).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query()
def permutation_importance(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("key"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    y, names = F.col("l_extendedprice") / 1000 + F.col("l_quantity"), ["l_quantity", "l_discount", "l_tax"]
    weights = models.ridge(items, {c: F.col(c) for c in names}, y)
    return rounded(models.permutation_importance(items, "key", weights, names, y))


@query()
def chow_liu_tree(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").withColumn("total", F.col("l_quantity") + F.col("l_extendedprice") / 2000)
    return models.chow_liu(items, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "total"], spark)


@query(
    f"SELECT {HEX.format('l_suppkey')} % 4 AS fold, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, count(*)::BIGINT AS n FROM lineitem GROUP BY 1"
)
def fold_slopes(spark, sf_dir):
    fold = splits.fold_of(F.col("l_suppkey"), 4).alias("fold")
    return rounded(load(spark, sf_dir, "lineitem").groupBy(fold).agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"), F.count("*").alias("n")), 5)


@query()
def auditor_families(spark, sf_dir):
    from loomtab.operators import auditors, program
    from loomtab.plans.catalogue import lineitem_features

    rows = lineitem_features(spark, sf_dir).withColumn("y", F.col("y").cast("double"))
    held = splits.fold_of(F.col("l_orderkey"), 5) == 0
    train, test = rows.filter(~held), rows.filter(held)
    made = program.sample(spark, program.fit(train, "y", ["l_quantity", "l_discount"], ["l_returnflag"]), 20_000)
    return auditors.family_losses(train, made, test, ["l_quantity", "l_discount"], "y")


@query()
def two_sample_classifier(spark, sf_dir):
    from loomtab.operators import auditors

    items, side = load(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 2 == 0
    auc = auditors.c2st(items.filter(side), items.filter(~side), ["l_quantity", "l_extendedprice", "l_discount"])
    return spark.createDataFrame([(round(float(auc), 6),)], "auc double")


@query()
def gaussian_regimes(spark, sf_dir):
    from loomtab.operators import auditors

    scaled = load(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("price"), (F.col("o_custkey") / 1000).alias("customer"))
    return auditors.regimes(spark, scaled, ["price", "customer"], 3)


@query()
def budget_frontier(spark, sf_dir):
    from loomtab.operators import auditors
    from loomtab.plans.catalogue import lineitem_features

    return auditors.frontier(spark, lineitem_features(spark, sf_dir), "l_orderkey", "y", ["l_quantity", "l_discount"], ["l_returnflag"], [256, 512, 1024, 4096])
