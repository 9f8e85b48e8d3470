"""The queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.functions import cells
from loomtab.operators import columns, compare, ranks, reducers, splits
from loomtab.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HEX = "('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT"
#: lineitem in two halves by its order key.
def side():
    return F.col("l_orderkey") % 2 == 0



@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*)::BIGINT AS n_rows, round(1 - count({c}) / count(*), 6) AS missing_share, count(DISTINCT {c})::BIGINT AS n_distinct,
round(min({c}), 6) AS min_value, round(max({c}), 6) AS max_value, round(avg({c}), 4) AS mean_value, round(var_pop({c}), 4) AS variance,
round((SELECT avg(pow({c} - m, 3)) / pow(var_pop({c}), 1.5) FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)), 5) AS skew,
round(quantile_cont({c}, 0.05), 6) AS q05, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(quantile_cont({c}, 0.95), 6) AS q95 FROM lineitem"""
        for c in NUMERIC
    )
)
def column_profile(spark, sf_dir):
    found = columns.profile(load(spark, sf_dir, "lineitem"), NUMERIC)
    return found.withColumns({"mean_value": F.round("mean_value", 4), "variance": F.round("variance", 4), "skew": F.round("skew", 5), **{c: F.round(c, 6) for c in ("missing_share", "min_value", "max_value", "q05", "q25", "q50", "q75", "q95")}})


@query(
    """SELECT count(*)::BIGINT AS n_cells, count(*) FILTER (k IS NULL)::BIGINT AS n_missing, count(*) FILTER (TRY_CAST(k AS DOUBLE) IS NOT NULL)::BIGINT AS n_numbers,
round(count(*) FILTER (TRY_CAST(k AS DOUBLE) IS NOT NULL) / count(k), 6) AS number_share FROM (SELECT json_extract_string(props, '$.k') AS k FROM events)"""
)
def missing_and_parse_rate(spark, sf_dir):
    cell = F.get_json_object("props", "$.k")
    number = cells.present_number(cell)
    df = load(spark, sf_dir, "events").select(cell.alias("cell"), number.alias("number"), cells.is_missing(cell).alias("missing"))
    return rounded(df.agg(F.count("*").alias("n_cells"), F.count_if("missing").alias("n_missing"), F.count("number").alias("n_numbers"), (F.count("number") / F.count_if(~F.col("missing"))).alias("number_share")))


@query(
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.005) AS lo, quantile_cont(o_totalprice, 0.995) AS hi FROM orders)
SELECT o_orderkey, round(greatest(0.0, least(1.0, (o_totalprice - lo) / (hi - lo))), 6) AS u, greatest(0, least(255, floor(round(greatest(0.0, least(1.0, (o_totalprice - lo) / (hi - lo))), 6) * 255 + 0.5)))::INTEGER AS code FROM orders, q"""
)
def robust_unit_scale(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    card = columns.robust_scale(orders, "o_totalprice")
    scaled = orders.join(F.broadcast(card)).select("o_orderkey", F.round(cells.unit(F.when(F.col("logged"), F.log1p("o_totalprice")).otherwise(F.col("o_totalprice")), F.col("lo"), F.col("hi")), 6).alias("u"))
    return scaled.withColumn("code", cells.code256(F.col("u")))


LEVELS_SQL = """WITH l AS (SELECT {c} AS level, count(*) AS n, sum({t}) AS s FROM {f} GROUP BY 1),
k AS (SELECT level FROM l WHERE n >= {least} ORDER BY n DESC, level LIMIT {most}),
p AS (SELECT CASE WHEN level IN (SELECT level FROM k) THEN level ELSE '__other__' END AS level, sum(n)::BIGINT AS n, sum(s) AS s FROM l GROUP BY 1),
m AS (SELECT sum(s) / sum(n) AS m FROM p), s AS (SELECT level, n, (s + 10 * m) / (n + 10) AS score FROM p, m)
SELECT level, n, round(score, 6) AS score, round(CASE WHEN count(*) OVER () > 1 THEN (row_number() OVER (ORDER BY score, level) - 1) / (count(*) OVER () - 1) ELSE 0.5 END, 6) AS code FROM s"""


@query(LEVELS_SQL.format(c="p_brand", t="p_retailprice", f="part", least=5, most=64))
def target_ordered_levels(spark, sf_dir):
    return rounded(columns.ordered_levels(load(spark, sf_dir, "part"), "p_brand", F.col("p_retailprice")))


@query(LEVELS_SQL.format(c="p_type", t="p_size", f="part", least=5, most=4))
def rare_level_pooling(spark, sf_dir):
    return rounded(columns.ordered_levels(load(spark, sf_dir, "part"), "p_type", F.col("p_size").cast("double"), most=4))


@query(
    "SELECT o_orderpriority, "
    + ", ".join(f"sum((o_orderstatus = '{s}')::INTEGER)::BIGINT AS is_{s.lower()}" for s in "FOP")
    + " FROM orders GROUP BY 1"
)
def onehot_pivot(spark, sf_dir):
    return columns.one_hot(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


MID = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@query(f"SELECT round(corr(a, b), 8) AS rho FROM (SELECT {MID.format(c='l_quantity')} AS a, {MID.format(c='l_extendedprice')} AS b FROM lineitem)")
def mid_rank_spearman(spark, sf_dir):
    return rounded(ranks.spearman(load(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 8)


@query("SELECT p_size, count(*)::BIGINT AS n, round(avg(r), 6) AS mid_rank FROM (SELECT p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS r FROM part) GROUP BY 1")
def mid_ranks(spark, sf_dir):
    return rounded(ranks.value_ranks(load(spark, sf_dir, "part"), "p_size").select("p_size", "n", "mid_rank"))


@query(
    """WITH r AS (SELECT o_totalprice AS x, o_orderkey AS k, count(*) OVER (ORDER BY d) AS r, count(*) OVER (ORDER BY d DESC) AS l, count(*) OVER () AS n
FROM (SELECT *, epoch_us(o_orderdate)::DOUBLE AS d FROM orders)),
s AS (SELECT *, abs(lead(r) OVER (ORDER BY x, k) - r) AS step FROM r)
SELECT round(1 - max(n) * sum(step) / (2 * sum(l * (n - l))), 8) AS xi FROM s"""
)
def chatterjee_xi(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double").alias("d"))
    return rounded(ranks.chatterjee_xi(orders, "o_totalprice", "d", "o_orderkey"), 8)


@query(
    """SELECT round(sqrt(sum(n * pow(m - g, 2)) / max(t)), 8) AS eta FROM (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1),
(SELECT avg(l_extendedprice) AS g, var_pop(l_extendedprice) * count(*) AS t FROM lineitem)"""
)
def correlation_ratio(spark, sf_dir):
    return rounded(ranks.correlation_ratio(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"), 8)


@query(
    """WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem),
n AS (SELECT least(7, floor(8 * (l_quantity - a) / (b - a))) AS i, least(7, floor(8 * (l_extendedprice - c) / (d - c))) AS j, count(*) AS n FROM lineitem, e GROUP BY 1, 2),
m AS (SELECT n, sum(n) OVER (PARTITION BY i) AS x, sum(n) OVER (PARTITION BY j) AS y, sum(n) OVER () AS t FROM n)
SELECT round(sum(n / t * ln(n * t / (x * y))), 8) AS information FROM m"""
)
def binned_mi(spark, sf_dir):
    return rounded(columns.binned_information(load(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 8)


@query("SELECT round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 8) AS entropy FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus)")
def entropy(spark, sf_dir):
    return rounded(columns.entropy(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]), 8)


@query("SELECT p_size AS value, n::BIGINT AS n, round(n / sum(n) OVER (), 8) AS share, round(sum(n) OVER (ORDER BY p_size) / sum(n) OVER (), 8) AS cumulative FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1)")
def discrete_marginal(spark, sf_dir):
    return rounded(columns.discrete_marginal(load(spark, sf_dir, "part"), "p_size"), 8)


#: Normal distribution function at nine points from -3 to 3.
KNOTS = [0.0013498980316301, 0.0122244726550447, 0.0668072012688581, 0.2266273523768682, 0.5, 0.7733726476231317, 0.9331927987311419, 0.9877755273449553, 0.9986501019683699]


@query(f"SELECT (unnest(range(9)))::INTEGER AS knot, round(unnest(quantile_cont(l_extendedprice, {KNOTS})), 5) AS value FROM lineitem")
def quantile_knots(spark, sf_dir):
    return rounded(columns.quantile_knots(load(spark, sf_dir, "lineitem"), "l_extendedprice", KNOTS), 5)


@query("SELECT l_discount AS value, n::BIGINT AS n, round(n / t, 8) AS share FROM (SELECT l_discount, count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem GROUP BY 1) WHERE n >= 0.09 * t")
def atoms(spark, sf_dir):
    return rounded(columns.atoms(load(spark, sf_dir, "lineitem"), "l_discount", 0.09), 8)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min({e})::DOUBLE AS lo, max({e})::DOUBLE AS hi, round(median({e}), 6) AS fill, count(*) FILTER ({e} IS NULL)::BIGINT AS n_missing FROM lineitem"
        for c, e in (("quantity", "CASE WHEN l_linenumber <> 3 THEN l_quantity END"), ("price", "l_extendedprice"))
    )
)
def min_max_card(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"), F.col("l_extendedprice").alias("price"))
    return rounded(columns.min_max_card(df, ["quantity", "price"]))


@query(
    """WITH c AS (SELECT l_extendedprice AS v, sum((l_orderkey % 2 = 0)::INTEGER) AS a, sum((l_orderkey % 2 <> 0)::INTEGER) AS b FROM lineitem GROUP BY 1),
f AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM c) SELECT round(max(abs(fa - fb)), 8) AS ks FROM f"""
)
def ks_two_sample(spark, sf_dir):
    return rounded(compare.ks(load(spark, sf_dir, "lineitem"), side(), "l_extendedprice"), 8)


_GRID = [(k + 0.5) / 64 for k in range(64)]


@query(
    f"""SELECT round(avg(abs(x - y)), 5) AS wasserstein FROM (SELECT unnest(quantile_cont(l_extendedprice, {_GRID}) FILTER (l_orderkey % 2 = 0)) AS x,
unnest(quantile_cont(l_extendedprice, {_GRID}) FILTER (l_orderkey % 2 <> 0)) AS y FROM lineitem)"""
)
def wasserstein_grid(spark, sf_dir):
    return rounded(compare.wasserstein(load(spark, sf_dir, "lineitem"), side(), "l_extendedprice"), 5)


@query(
    " UNION ALL ".join(
        f"SELECT {t}.0::DOUBLE AS threshold, round(abs(p - q) / greatest(p, 0.05), 8) AS error FROM (SELECT avg((l_quantity <= {t})::INTEGER) FILTER (l_orderkey % 2 = 0) AS p, avg((l_quantity <= {t})::INTEGER) FILTER (l_orderkey % 2 <> 0) AS q FROM lineitem)"
        for t in range(5, 50, 5)
    )
)
def threshold_query_error(spark, sf_dir):
    return rounded(compare.threshold_errors(load(spark, sf_dir, "lineitem"), side(), "l_quantity", list(range(5, 50, 5))), 8)


@query(
    """SELECT bin, n, round(f, 8) AS forecast, round(r, 8) AS rate, round(n / sum(n) OVER () * abs(f - r), 8) AS gap FROM (SELECT least(9, floor(p * 10))::INTEGER AS bin, count(*)::BIGINT AS n, avg(p) AS f, avg(y) AS r
FROM (SELECT l_quantity / 50 AS p, (l_returnflag = 'N')::INTEGER AS y FROM lineitem) GROUP BY 1)"""
)
def ece_bins(spark, sf_dir):
    return rounded(compare.calibration(load(spark, sf_dir, "lineitem"), F.col("l_quantity") / 50, F.col("l_returnflag") == "N"), 8)


@query("SELECT min(doc_id) AS first_key, count(*)::BIGINT AS n FROM documents GROUP BY text, lang HAVING count(*) > 1")
def exact_dup(spark, sf_dir):
    return compare.exact_copies(load(spark, sf_dir, "documents"), "doc_id", ["text", "lang"])


@query(
    "SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))::BIGINT AS n_overlap, count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))::BIGINT AS n_apart FROM lineitem"
)
def row_overlap_semi_anti(spark, sf_dir):
    items, done = load(spark, sf_dir, "lineitem").select("l_orderkey"), load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    found = items.join(done, "l_orderkey", "left_semi").agg(F.count("*").alias("n_overlap")).join(items.join(done, "l_orderkey", "left_anti").agg(F.count("*").alias("n_apart")))
    return found.select((F.col("n_overlap") + F.col("n_apart")).alias("n_rows"), "n_overlap", "n_apart")


@query("SELECT c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal), 6) AS distance FROM customer JOIN supplier ON abs(c_acctbal - s_acctbal) <= 2.5")
def near_copy_band_join(spark, sf_dir):
    pairs = compare.near_pairs(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "c_acctbal", "s_acctbal", 2.5)
    return pairs.select("c_custkey", "s_suppkey", F.round(F.abs(F.col("c_acctbal") - F.col("s_acctbal")), 6).alias("distance"))


@query(
    """SELECT query, neighbour, distance, rank FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(d, 6) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id)::INTEGER AS rank
FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) a JOIN embeddings b ON a.vec_id <> b.vec_id, LATERAL (SELECT list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d)) WHERE rank <= 5"""
)
def knn_topk(spark, sf_dir):
    base = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    first = base.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")  # a query a label
    found = compare.nearest(base.join(F.broadcast(first), "vec_id"), base, "vec_id", "embedding", 5)
    return rounded(found.select("query", "neighbour", "distance", "rank"))


@query(
    """WITH c AS (SELECT l_quantity AS v, sum((l_returnflag = 'R')::INTEGER) AS p, sum((l_returnflag <> 'R')::INTEGER) AS q FROM lineitem GROUP BY 1),
b AS (SELECT p, q, sum(q) OVER (ORDER BY v) - q AS below FROM c) SELECT round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 8) AS auc FROM b"""
)
def membership_auc(spark, sf_dir):
    return rounded(compare.rank_auc(load(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", "l_quantity"), 8)


@query(
    f"""SELECT o_orderpriority, is_test, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {HEX.format("o_orderkey")}, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.2 + 0.5) AS is_test FROM orders) GROUP BY 1, 2"""
)
def stratified_split(spark, sf_dir):
    split = splits.stratified_split(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 0.2)
    return split.groupBy("o_orderpriority", "is_test").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"SELECT {HEX.format('o_orderkey')} % 5 AS fold, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean_value FROM orders GROUP BY 1")
def hash_folds(spark, sf_dir):
    return rounded(load(spark, sf_dir, "orders").groupBy(splits.fold_of(F.col("o_orderkey"), 5).alias("fold")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_value")), 4)


@query(f"SELECT {HEX.format('o_custkey')} % 5 AS fold, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS n_groups FROM orders GROUP BY 1")
def group_folds_no_cross(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(splits.fold_of(F.col("o_custkey"), 5).alias("fold")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_groups"))


@query(
    """WITH s AS (SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY 1), b AS (SELECT *, n * 100 / sum(n) OVER () AS e FROM s),
r AS (SELECT *, floor(e) AS f, row_number() OVER (ORDER BY e - floor(e) DESC, c_mktsegment) AS k, 100 - sum(floor(e)) OVER () AS rest FROM b)
SELECT c_mktsegment, n, (f + (k <= rest)::INTEGER)::BIGINT AS seats FROM r"""
)
def largest_remainder(spark, sf_dir):
    sizes = load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return splits.largest_remainder(sizes, "c_mktsegment", "n", 100)


@query(f"SELECT o_orderkey, {HEX.format('o_orderkey')} AS hash FROM orders ORDER BY hash, o_orderkey LIMIT 128")
def hash_sample(spark, sf_dir):
    return splits.hash_sample(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 128).withColumn("hash", cells.hashed(F.col("o_orderkey")))


_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


@query(
    f"""WITH u AS (SELECT d::INTEGER AS draw, c_acctbal AS x, {HEX.format("(d || ':' || c_custkey)")} / 4294967296.0::DOUBLE AS u FROM customer, range(20) t(d)),
w AS (SELECT draw, x, {" + ".join(f"(u >= {p})::INTEGER" for p in _POISSON)} AS w FROM u)
SELECT draw, sum(w)::BIGINT AS weight, round(sum(w * x) / sum(w), 5) AS mean_value FROM w GROUP BY 1"""
)
def bootstrap_means(spark, sf_dir):
    return rounded(splits.bootstrap_means(load(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", 20), 5)


@query(
    "SELECT n_name, count(s_suppkey)::BIGINT AS n_found, CASE WHEN count(s_suppkey) = 0 THEN 'missing' WHEN count(s_suppkey) < 4 THEN 'partial' ELSE 'complete' END AS status FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1"
)
def roster_left_join_status(spark, sf_dir):
    found = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    joined = load(spark, sf_dir, "nation").join(found, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n_found"))
    return joined.withColumn("status", F.when(F.col("n_found") == 0, "missing").when(F.col("n_found") < 4, "partial").otherwise("complete"))


@query(
    "SELECT l_returnflag, round(median(m), 6) AS median_of_medians, count(*)::BIGINT AS n_groups FROM (SELECT l_returnflag, l_suppkey, median(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1"
)
def two_level_median_rollup(spark, sf_dir):
    inner = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.median("l_extendedprice").alias("m"))
    return rounded(inner.groupBy("l_returnflag").agg(F.median("m").alias("median_of_medians"), F.count("*").alias("n_groups")))


@query(
    "SELECT l_returnflag, round(min(m), 6) AS robust, arg_min(l_linenumber, m) AS worst_family FROM (SELECT l_returnflag, l_linenumber, median(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1"
)
def robust_min(spark, sf_dir):
    return rounded(reducers.robust_minimum(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", "l_extendedprice"))


WINS_SQL = """WITH c AS (SELECT c_nationkey AS b, c_mktsegment AS m, avg(c_acctbal) AS s FROM customer GROUP BY 1, 2)
SELECT x.m AS a, y.m AS b, count(*)::BIGINT AS games, sum(CASE WHEN abs(x.s - y.s) <= 100 THEN 0.5 WHEN x.s > y.s THEN 1.0 ELSE 0.0 END)::DOUBLE AS wins_a FROM c x JOIN c y ON x.b = y.b AND x.m < y.m GROUP BY 1, 2"""


@query(WINS_SQL)
def pairwise_win_matrix(spark, sf_dir):
    cells_ = load(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("score"))
    return reducers.win_matrix(cells_, "c_nationkey", "c_mktsegment", "score", 100.0)


@query()
def elo_ratings(spark, sf_dir):
    return reducers.elo(spark, pairwise_win_matrix(spark, sf_dir))


@query(
    "SELECT l_suppkey, min(CASE WHEN l_extendedprice >= 50000 THEN l_quantity END) AS first_budget, max(l_extendedprice) AS best FROM lineitem GROUP BY 1"
)
def frontier_first_budget(spark, sf_dir):
    return reducers.first_reaching(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice", 50000.0)


@query(
    "WITH d AS (SELECT s_nationkey AS k, avg(s_acctbal) AS x FROM supplier GROUP BY 1) SELECT round(median((a.x + b.x) / 2), 6) AS shift, count(*)::BIGINT AS pairs FROM d a JOIN d b ON a.k <= b.k"
)
def walsh_hodges_lehmann(spark, sf_dir):
    means = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("x"))
    return rounded(reducers.hodges_lehmann(means, "x", "s_nationkey"))


_TERMS = {"one": "1.0", "quantity": "l_quantity", "discount": "l_discount", "price": "l_extendedprice / 1000"}


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum(({_TERMS[a]}) * ({_TERMS[b]})), 2)::DOUBLE AS product FROM lineitem" for i, a in enumerate(_TERMS) for b in list(_TERMS)[i:]))
def gram_matrix(spark, sf_dir):
    return rounded(columns.gram(load(spark, sf_dir, "lineitem"), {k: F.expr(e) for k, e in _TERMS.items()}), 2)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def ols_simple(spark, sf_dir):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 8).alias("r2"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_kpi(spark, sf_dir):
    return rounded(load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total")), 2)


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(
    "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS cvar, count(*)::BIGINT AS n_tail FROM (SELECT *, quantile_cont(l_extendedprice, 0.9) OVER (PARTITION BY l_returnflag) AS cut FROM lineitem) WHERE l_extendedprice >= cut GROUP BY 1"
)
def tail_cvar(spark, sf_dir):
    return rounded(reducers.cvar(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 0.1), 4)


@query("SELECT c_mktsegment, round((sum(s) OVER () - s) / (sum(n) OVER () - n), 6) AS mean_without FROM (SELECT c_mktsegment, sum(c_acctbal) AS s, count(*) AS n FROM customer GROUP BY 1)")
def leave_one_group_out(spark, sf_dir):
    return rounded(reducers.leave_one_out(load(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal"))


@query(
    """WITH t AS (SELECT l_quantity, l_quantity + l_extendedprice / 2000 AS l_extendedprice, l_orderkey % 5 = 0 AS q, (l_orderkey // 5) % 2 = 0 AS synthetic FROM lineitem), g AS (SELECT avg(l_extendedprice) AS m FROM t WHERE NOT q),
r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM t WHERE NOT q),
s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM t WHERE NOT q AND synthetic),
l AS (SELECT avg(pow(l_extendedprice - m, 2)) AS n, avg(pow(l_extendedprice - r.a * l_quantity - r.b, 2)) AS r, avg(pow(l_extendedprice - s.a * l_quantity - s.b, 2)) AS s FROM t, g, r, s WHERE q)
SELECT round((n - s) / (n - r), 6) AS retention FROM l"""
)
def linear_retention(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_quantity") + F.col("l_extendedprice") / 2000).alias("l_extendedprice"), (F.col("l_orderkey") % 5 == 0).alias("q"), (F.floor(F.col("l_orderkey") / 5) % 2 == 0).alias("synthetic"))
    y, x, train, half = F.col("l_extendedprice"), F.col("l_quantity"), ~F.col("q"), ~F.col("q") & F.col("synthetic")
    at = lambda c, v: F.when(c, v)
    fits = rows.agg(F.avg(at(train, y)).alias("m"), F.regr_slope(at(train, y), at(train, x)).alias("ra"), F.regr_intercept(at(train, y), at(train, x)).alias("rb"), F.regr_slope(at(half, y), at(half, x)).alias("sa"), F.regr_intercept(at(half, y), at(half, x)).alias("sb"))
    losses = rows.filter("q").join(F.broadcast(fits)).agg(F.avg(F.pow(y - F.col("m"), 2)).alias("n"), F.avg(F.pow(y - F.col("ra") * x - F.col("rb"), 2)).alias("r"), F.avg(F.pow(y - F.col("sa") * x - F.col("sb"), 2)).alias("s"))
    return rounded(losses.select(reducers.retention(F.col("n"), F.col("r"), F.col("s")).alias("retention")))


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_days(spark, sf_dir):
    from loomtab.streaming import windows

    return rounded(windows.tumbling(load(spark, sf_dir, "events"), "1 day"), 4)


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, count(*)::BIGINT AS n FROM s GROUP BY user_id, k"""
)
def user_sessions(spark, sf_dir):
    from loomtab.streaming import windows

    return windows.sessions(load(spark, sf_dir, "events"), "6 hours")


def lineitem_features(spark, sf_dir):
    y = F.col("l_extendedprice") / 1000 + F.when(F.col("l_returnflag") == "N", 5).otherwise(0)
    held = F.when(F.col("l_linenumber") != 3, F.col("l_discount"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", held.alias("l_discount"), "l_returnflag", (F.col("l_quantity") / 2 + y).alias("y"))


@query()
def sample_program(spark, sf_dir):
    from loomtab.operators import program

    fitted = program.fit(lineitem_features(spark, sf_dir), "y", ["l_quantity", "l_discount"], ["l_returnflag"])
    return program.sample(spark, program.Program.decode(fitted.encode()), 10_000)


@query()
def predict_program(spark, sf_dir):
    from loomtab.operators import program

    rows = lineitem_features(spark, sf_dir)
    return program.predict(rows, program.fit(rows, "y", ["l_quantity", "l_discount"], ["l_returnflag"])).select("l_orderkey", "y", "prediction")


@query()
def program_retention(spark, sf_dir):
    from loomtab.operators import program

    return program.retention(spark, lineitem_features(spark, sf_dir), "l_orderkey", "y", ["l_quantity", "l_discount"], ["l_returnflag"])
