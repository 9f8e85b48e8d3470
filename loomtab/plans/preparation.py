"""Queries of table preparation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtab.functions import cells
from loomtab.operators import prepare, ranks
from loomtab.plans.catalogue import query, rounded
from loomtab.session import load

_GRID = str(prepare.QUANTILE_GRID)


def _scaler_sql(table: str, column: str) -> str:
    """One row: the card of a column."""
    return f"""(WITH x AS (SELECT ({column})::DOUBLE AS v FROM {table}), m AS (SELECT count(v) AS n, count(*) AS t, count(DISTINCT v) AS levels, avg(v) AS mean, stddev_pop(v) AS sd, quantile_cont(v, {_GRID}) AS q FROM x),
k AS (SELECT coalesce(avg(pow((v - mean) / nullif(sd, 0), 3)), 0) AS skew, coalesce(avg(pow((v - mean) / nullif(sd, 0), 4)) - 3, 0) AS kurt, median(abs(v - q[5])) AS mad FROM x, m),
s AS (SELECT *, greatest((q[6] - q[4]) / {prepare.NORMAL_IQR}, mad * 1.4826, sd * 0.25, 1e-6) AS robust, CASE WHEN levels <= 1 THEN 'constant' WHEN levels = 2 THEN 'binary'
  WHEN abs(skew) > 1 OR kurt > 4 OR (q[6] - q[4] > 1e-9 AND (q[8] - q[2]) / (q[6] - q[4]) > 4.2) THEN 'log' ELSE 'robust' END AS kind FROM m, k),
l AS (SELECT avg(sign(v - q[5]) * ln(1 + abs(v - q[5]) / robust)) AS lm, stddev_pop(sign(v - q[5]) * ln(1 + abs(v - q[5]) / robust)) AS ls FROM x, s)
SELECT '{column}' AS "column", kind, 1 - n / t AS missing_rate, CASE kind WHEN 'binary' THEN mean ELSE q[5] END AS centre, CASE kind WHEN 'constant' THEN 1 WHEN 'binary' THEN greatest(sd, 1e-6) ELSE robust END AS scale,
CASE kind WHEN 'log' THEN lm WHEN 'robust' THEN mean ELSE 0 END AS post_mean, CASE kind WHEN 'log' THEN greatest(ls, 1e-6) WHEN 'robust' THEN greatest(sd, 1e-6) ELSE 1 END AS post_std, q, CASE kind WHEN 'log' THEN 0.35 WHEN 'robust' THEN 0.3 WHEN 'constant' THEN 0.35 ELSE 0 END AS weight FROM s, l)"""


_SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_extendedprice * l_extendedprice * l_extendedprice / 1e9", "l_linenumber // 4 * 1.0", "0.0 * l_tax"]


def scaler_columns():
    price = F.col("l_extendedprice")
    made = [F.col("l_quantity"), price, F.col("l_discount"), price * price * price / 1e9, F.floor(F.col("l_linenumber") / 4) * 1.0, 0.0 * F.col("l_tax")]
    return dict(zip(_SCALED, made, strict=True))


@query(f"""SELECT "column", kind, round(missing_rate, 8) AS missing_rate, round(centre, 6) AS centre, round(scale, 5) AS scale, round(post_mean, 5) AS post_mean, round(post_std, 5) AS post_std FROM ({" UNION ALL ".join(f"SELECT * FROM {_scaler_sql('lineitem', c)}" for c in _SCALED)})""")
def numeric_scaler_card(spark, sf_dir):
    found = prepare.fit_scalers(load(spark, sf_dir, "lineitem"), scaler_columns())
    return found.select("column", "kind", F.round("missing_rate", 8).alias("missing_rate"), F.round("centre", 6).alias("centre"), *(F.round(c, 5).alias(c) for c in ("scale", "post_mean", "post_std")))


def _placed_sql() -> str:
    g, q = prepare.NORMAL_GRID, "q[{}]"
    parts = [f"WHEN v < q[1] THEN {g[0]} + (v - q[1]) / greatest(q[6] - q[4], 1e-9) * {prepare.NORMAL_IQR}"]
    parts += [f"WHEN v <= {q.format(k + 2)} THEN {g[k]} + (v - {q.format(k + 1)}) * ({g[k + 1]} - ({g[k]})) / ({q.format(k + 2)} - {q.format(k + 1)})" for k in range(8)]
    return f"CASE {' '.join(parts)} ELSE {g[8]} + (v - q[9]) / greatest(q[6] - q[4], 1e-9) * {prepare.NORMAL_IQR} END"


@query(
    f"""WITH c AS (SELECT * FROM {_scaler_sql("orders", "o_totalprice * o_totalprice / 1e6")}), x AS (SELECT o_orderkey, o_totalprice * o_totalprice / 1e6 AS v FROM orders)
SELECT o_orderkey, round(6 * tanh(((1 - weight) * ((CASE kind WHEN 'log' THEN sign(v - centre) * ln(1 + abs(v - centre) / scale) ELSE v END) - post_mean) / post_std + weight * ({_placed_sql()})) / 6), 5) AS z FROM x, c"""
)
def numeric_scaler_transform(spark, sf_dir):
    x = F.col("o_totalprice") * F.col("o_totalprice") / 1e6
    orders = load(spark, sf_dir, "orders")
    card = prepare.fit_scalers(orders, {"x": x}).first()
    return rounded(orders.select("o_orderkey", prepare.scaled(x, card.asDict()).alias("z")), 5)


_CATEGORY = """WITH l AS (SELECT p_brand AS token, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, token) AS id FROM l WHERE n >= {least} ORDER BY n DESC, token LIMIT 127),
f AS (SELECT id, token, n, s FROM k UNION ALL SELECT 0, '__other__', (SELECT sum(n) FROM l) - coalesce((SELECT sum(n) FROM k), 0), (SELECT sum(s) FROM l) - coalesce((SELECT sum(s) FROM k), 0)),
e AS (SELECT *, (s + 10 * (sum(s) OVER () / sum(n) OVER ())) / (n + 10) + 0.15 * coalesce(id * 0.5 / nullif(count(*) OVER () - 1, 0) - 0.25, -0.25) AS encoding, n / sum(n) OVER () AS frequency FROM f),
m AS (SELECT sum(encoding * frequency) AS post_mean FROM e), d AS (SELECT greatest(sqrt(sum(pow(encoding - post_mean, 2) * frequency)), 1e-6) AS post_std, any_value(post_mean) AS post_mean FROM e, m)"""


@query(_CATEGORY.format(least=20) + " SELECT id::INTEGER AS id, token, n::BIGINT AS n, round(encoding, 6) AS encoding, round(frequency, 8) AS frequency, round(post_mean, 6) AS post_mean, round(post_std, 5) AS post_std FROM e, d")
def category_encoder_card(spark, sf_dir):
    found = prepare.fit_category(load(spark, sf_dir, "part"), "p_brand", F.col("p_retailprice"), least=20)
    return found.select("id", "token", "n", F.round("encoding", 6).alias("encoding"), F.round("frequency", 8).alias("frequency"), F.round("post_mean", 6).alias("post_mean"), F.round("post_std", 5).alias("post_std"))


@query(_CATEGORY.format(least=20) + " SELECT p_partkey, round(6 * tanh((coalesce(k.encoding, o.encoding) - post_mean) / post_std / 6), 5) AS z FROM part LEFT JOIN (SELECT * FROM e WHERE id > 0) k ON p_brand = k.token, (SELECT encoding FROM e WHERE id = 0) o, d")
def category_encoder_transform(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    card = prepare.staged(prepare.fit_category(part, "p_brand", F.col("p_retailprice"), least=20), "card")
    return rounded(prepare.encode_category(part.select("p_partkey", "p_brand"), "p_brand", card, "z").drop("p_brand"), 5)


_TARGET = "WITH m AS (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders)"


@query(_TARGET + " SELECT round(mean, 4) AS mean, round(std, 4) AS std, round(median, 4) AS median, round(iqr, 4) AS iqr FROM m")
def target_scaler_card(spark, sf_dir):
    return rounded(prepare.fit_target(load(spark, sf_dir, "orders"), F.col("o_totalprice")).select("mean", "std", "median", "iqr"), 4)


@query(_TARGET + " SELECT o_orderkey, round(8 * tanh((o_totalprice - mean) / std / 8), 6) AS z, round(o_totalprice, 3) AS back FROM orders, m")
def target_scaler_round_trip(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    card = F.broadcast(prepare.fit_target(orders, F.col("o_totalprice")).select("mean", "std"))
    made = orders.join(card).withColumn("z", prepare.target_scaled(F.col("o_totalprice"), F.col("mean"), F.col("std")))
    return made.select("o_orderkey", F.round("z", 6).alias("z"), F.round(prepare.target_unscaled(F.col("z"), F.col("mean"), F.col("std")), 3).alias("back"))


@query("SELECT o_orderpriority AS label, (row_number() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS place, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 8) AS prior FROM orders GROUP BY 1")
def target_classes(spark, sf_dir):
    return rounded(prepare.target_classes(load(spark, sf_dir, "orders"), "o_orderpriority"), 8)


@query("SELECT '1' AS positive, round(avg((l_linenumber = 1)::INTEGER), 8) AS prior FROM lineitem")
def binary_target(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 1, "1").otherwise("0").alias("y"))
    return rounded(prepare.binary_target(items, "y"), 8)


_FIT = "(SELECT *, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity FROM lineitem WHERE l_orderkey % 2 = 0)"
_SLOTS = f"(SELECT l_returnflag AS level, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS slot FROM {_FIT} GROUP BY 1)"
_ENDS = f"(SELECT min(quantity) AS a, max(quantity) AS b, median(quantity) AS f, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM {_FIT})"


def card_rows(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")
    return items.select(key, "l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"), "l_extendedprice", "l_returnflag")


def fitted_card(rows):
    return prepare.staged(prepare.fit_card(rows.filter("l_orderkey % 2 = 0"), ["quantity", "l_extendedprice"], ["l_returnflag"]), "card")


@query(
    f"""SELECT 'quantity' AS "column", 'number' AS kind, round(a, 6) AS lo, round(b, 6) AS hi, round(f, 6) AS fill, true AS had_missing, NULL::VARCHAR AS level, NULL::INTEGER AS slot FROM {_ENDS}
UNION ALL SELECT 'l_extendedprice', 'number', round(c, 6), round(d, 6), round((SELECT median(l_extendedprice) FROM {_FIT}), 6), false, NULL, NULL FROM {_ENDS} UNION ALL SELECT 'l_returnflag', 'nominal', NULL, NULL, NULL, NULL, level, slot::INTEGER FROM {_SLOTS}"""
)
def declared_card(spark, sf_dir):
    return rounded(fitted_card(card_rows(spark, sf_dir)))


@query(
    f"""SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS key, round((coalesce(CASE WHEN l_linenumber <> 3 THEN l_quantity END, f) - a) / (b - a), 6) AS quantity, (l_linenumber = 3)::INTEGER::DOUBLE AS quantity_missing,
round((l_extendedprice - c) / (d - c), 6) AS price, coalesce(s.slot, (SELECT count(*) FROM {_SLOTS}))::INTEGER AS slot FROM lineitem LEFT JOIN {_SLOTS} s ON l_returnflag = s.level, {_ENDS}"""
)
def declared_card_apply(spark, sf_dir):
    rows = card_rows(spark, sf_dir)
    encoded = prepare.apply_card(rows, "key", fitted_card(rows))
    slots = [c for c in encoded.columns if c.startswith("l_returnflag=")]
    slot = sum(F.col(f"`{c}`") * k for k, c in enumerate(slots)).cast("int")
    return encoded.select("key", F.round("quantity", 6).alias("quantity"), F.col("`quantity=missing`").alias("quantity_missing"), F.round("l_extendedprice", 6).alias("price"), slot.alias("slot"))


@query(
    f"""SELECT 'quantity' AS "column", count(*)::BIGINT AS rows, count(*) FILTER (l_linenumber <> 3 AND (l_quantity * 2 < a OR l_quantity * 2 > b))::BIGINT AS out_of_range, 0::BIGINT AS unseen_levels, 0::BIGINT AS unexpected_missing FROM lineitem, {_ENDS}
UNION ALL SELECT 'l_extendedprice', count(*), count(*) FILTER (l_linenumber <> 5 AND (l_extendedprice < c OR l_extendedprice > d)), 0, count(*) FILTER (l_linenumber = 5) FROM lineitem, {_ENDS}
UNION ALL SELECT 'l_returnflag', count(*), 0, count(*) FILTER (l_linenumber = 2), 0 FROM lineitem"""
)
def declared_card_receipt(spark, sf_dir):
    """Against rows with doubled quantities, prices that are missing, and a level that the fit hasn't seen."""
    rows = card_rows(spark, sf_dir)
    line = F.split("key", ":")[1].cast("int")
    other = rows.select((F.col("quantity") * 2).alias("quantity"), F.when(line != 5, F.col("l_extendedprice")).alias("l_extendedprice"), F.when(line == 2, "Z").otherwise(F.col("l_returnflag")).alias("l_returnflag"))
    return prepare.card_receipt(other, fitted_card(rows))


@query(f"SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS key, round(l_extendedprice, 4) AS back FROM lineitem, {_ENDS}")
def declared_card_inverse(spark, sf_dir):
    rows = card_rows(spark, sf_dir)
    card = fitted_card(rows)
    ends = card.filter(F.col("column") == "l_extendedprice").first()
    encoded = prepare.apply_card(rows, "key", card)
    return encoded.select("key", F.round(cells.from_unit(F.col("l_extendedprice"), F.lit(ends["lo"]), F.lit(ends["hi"])), 4).alias("back"))


@query(
    """WITH c AS (SELECT CASE o_orderkey % 7 WHEN 0 THEN ' N/A ' WHEN 1 THEN '<censored>' WHEN 2 THEN '<NA>' WHEN 3 THEN '999999999' ELSE o_totalprice::VARCHAR END AS cell FROM orders)
SELECT CASE WHEN cell = ' N/A ' THEN 'missing' WHEN cell = '<censored>' THEN 'censored' WHEN cell = '<NA>' THEN 'not_applicable' ELSE 'observed' END AS state, (cell = '999999999') AS fails, count(*)::BIGINT AS n,
round(sum(CASE WHEN cell NOT IN (' N/A ', '<censored>', '<NA>') THEN cell::DOUBLE END), 2) AS total FROM c GROUP BY 1, 2"""
)
def typed_cells(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    rows = load(spark, sf_dir, "orders").select(F.when(k == 0, " N/A ").when(k == 1, "<censored>").when(k == 2, "<NA>").when(k == 3, "999999999").otherwise(F.col("o_totalprice").cast("string")).alias("cell"))
    found = prepare.typed(rows, {"cell": (0.0, 1e8)}, {}).select("cell.*")
    return found.groupBy("state", "fails").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    """WITH c AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'censored' ELSE 'observed' END AS state, CASE WHEN o_orderkey % 5 > 1 THEN o_orderstatus END AS value, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT state, value, n::BIGINT AS n, round(n / sum(n) OVER (), 8) AS share, round(ln(sum(n) OVER ()) - sum(n * ln(n)) OVER () / sum(n) OVER (), 8) AS entropy FROM c"""
)
def mixed_distribution(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    rows = load(spark, sf_dir, "orders").select(F.when(k == 0, "?").when(k == 1, "<censored>").otherwise(F.col("o_orderstatus")).alias("cell"))
    return rounded(prepare.mixed_counts(rows, "cell"), 8)


@query(
    """WITH c AS (SELECT *, CASE WHEN o_custkey % 4 <> 0 THEN o_totalprice END AS price FROM orders), q AS (SELECT quantile_cont(price, 0.005) AS lo, quantile_cont(price, 0.995) AS hi, median(price) AS m FROM c)
SELECT o_orderkey, round(greatest(0.0, least(1.0, (coalesce(price, m) - lo) / (hi - lo))), 6) AS price, (price IS NULL)::INTEGER::DOUBLE AS price_missing, (o_orderstatus = 'F')::INTEGER::DOUBLE AS status_f, (o_orderstatus = 'O')::INTEGER::DOUBLE AS status_o FROM c, q"""
)
def learner_matrix(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice")))
    made = prepare.model_matrix(rows, "o_orderkey", ["price"], {"o_orderstatus": ["F", "O"]})
    return made.select("o_orderkey", F.round("price", 6).alias("price"), F.col("`price=__missing__`").alias("price_missing"), F.col("`o_orderstatus=F`").alias("status_f"), F.col("`o_orderstatus=O`").alias("status_o"))


@query("SELECT unnest(['l_discount', 'l_quantity', 'l_extendedprice', 'l_tax']) AS \"column\", unnest([1, 2, 3, 0])::INTEGER AS place")
def canonical_feature_order(spark, sf_dir):
    """Means put the columns in this order at any size of the tables."""
    return prepare.canonical_order(load(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax", "l_discount"])


@query("SELECT 'regression' AS price_task, 'classification' AS flag_task")
def target_task(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")
    price = prepare.task_of_target(items, "l_extendedprice").select(F.col("task").alias("price_task"))
    flag = items.select((F.col("l_returnflag") == "R").cast("int").alias("y"))
    return price.join(F.broadcast(prepare.task_of_target(flag, "y").select(F.col("task").alias("flag_task"))))


@query("SELECT x0, x1, y FROM (SELECT o_custkey AS x0, CASE o_orderstatus WHEN 'F' THEN 'L0' WHEN 'O' THEN 'L1' WHEN 'P' THEN 'L2' END AS x1, o_totalprice AS y FROM orders)")
def anonymised(spark, sf_dir):
    return prepare.anonymous(load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice"), "o_totalprice", {"o_orderstatus": ["F", "O", "P"]})


@query(
    """WITH m AS (SELECT max(abs(c_acctbal)) AS m FROM customer) SELECT c_custkey, greatest(-7, least(7, floor(c_acctbal * 7 / m + 0.5)))::INTEGER AS code4, greatest(-127, least(127, floor(c_acctbal * 127 / m + 0.5)))::INTEGER AS code8 FROM customer, m"""
)
def quantised_codes(spark, sf_dir):
    customers = load(spark, sf_dir, "customer")
    largest = F.broadcast(customers.agg(F.max(F.abs("c_acctbal")).alias("m")))
    x, m = F.col("c_acctbal"), F.col("m")
    return customers.join(largest).select("c_custkey", prepare.quantised(x, m, 4).alias("code4"), prepare.quantised(x, m, 8).alias("code8"))


@query("SELECT round(min(sign(c_acctbal) * ln(1 + abs(c_acctbal))), 8) AS lo, round(max(sign(c_acctbal) * ln(1 + abs(c_acctbal))), 8) AS hi, 2 AS decimals, count(DISTINCT c_acctbal)::BIGINT AS levels FROM customer")
def signed_log_plan(spark, sf_dir):
    return rounded(prepare.signed_plan(load(spark, sf_dir, "customer"), "c_acctbal"), 8)


@query("WITH l AS (SELECT DISTINCT p_type AS level FROM part) SELECT level, round((row_number() OVER (ORDER BY level) - 0.5) / count(*) OVER (), 8) AS code FROM l")
def level_codes(spark, sf_dir):
    return rounded(prepare.level_codes(load(spark, sf_dir, "part"), "p_type"), 8)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS o_orderstatus, greatest(1000.0, least(100000.0, o_totalprice)) AS o_totalprice FROM orders")
def remapped_samples(spark, sf_dir):
    return prepare.remapped(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", {"F": "done", "O": "open"}, 1000.0, 100000.0, "o_totalprice")


@query(
    """SELECT o_orderkey, regexp_replace(regexp_replace(printf('%.6f', o_totalprice), '0+$', ''), '\\.$', '') AS text, o_orderkey::VARCHAR AS whole, strftime(o_orderdate, '%Y-%m-%d') AS day, round(epoch_us(o_orderdate) / 86400000000, 6) AS days,
length(regexp_extract(regexp_replace(regexp_replace(printf('%.6f', o_totalprice), '0+$', ''), '\\.$', ''), '\\.([0-9]*)$', 1))::INTEGER AS decimals FROM orders"""
)
def cell_formats(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").withColumn("text", cells.format_number(F.col("o_totalprice")))
    days = cells.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return orders.select("o_orderkey", "text", cells.format_number(F.col("o_orderkey").cast("double")).alias("whole"), cells.format_date(days).alias("day"), F.round(days, 6).alias("days"), cells.decimals_of(F.col("text")).alias("decimals"))


@query(
    """WITH q AS (SELECT quantile_cont(c_acctbal, 0.005) AS lo, quantile_cont(c_acctbal, 0.995) AS hi FROM customer) SELECT c_custkey, round(greatest(lo, least(hi, c_acctbal)), 4) AS winsorized, round(sign(c_acctbal) * pow(abs(c_acctbal), 0.5), 6) AS root,
round(ln(u / (1 - u)), 6) AS logit FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, (c_acctbal - lo) / (hi - lo))) AS u FROM customer, q)"""
)
def column_transforms(spark, sf_dir):
    customers = load(spark, sf_dir, "customer")
    lo, hi = ranks.quantiles(customers.select(F.col("c_acctbal").alias("value")), [], "value", [0.005, 0.995]).first()["q"]
    x = F.col("c_acctbal")
    u = cells.unit(x, F.lit(lo), F.lit(hi))
    return customers.select("c_custkey", F.round(cells.winsorized(x, lo, hi), 4).alias("winsorized"), F.round(cells.power(x, 0.5), 6).alias("root"), F.round(cells.logit(u), 6).alias("logit"))
