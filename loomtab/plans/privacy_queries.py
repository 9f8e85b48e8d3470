"""Queries of copies, neighbours, geometry and corpora, with their SQL."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from loomtab.operators import corpus, privacy, ranks
from loomtab.plans.catalogue import HEX, query, rounded
from loomtab.session import load


@query(
    """WITH l AS (SELECT c_custkey, c_acctbal / 10000 AS x, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey / 25 END AS y FROM customer), r AS (SELECT o_orderkey, o_totalprice / 50000 AS x, CASE WHEN o_orderkey % 4 <> 0 THEN (o_custkey % 25) / 25 END AS y FROM orders)
SELECT c_custkey, o_orderkey, round(sqrt((pow(l.x - r.x, 2) + coalesce(pow(l.y - r.y, 2), 0)) / 3), 8) AS distance FROM l JOIN r ON (l.y IS NULL) = (r.y IS NULL) AND abs(l.x - r.x) <= 0.0018 AND pow(l.x - r.x, 2) + coalesce(pow(l.y - r.y, 2), 0) <= 0.000001::DOUBLE * 3"""
)
def near_copies(spark, sf_dir):
    left = load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("x"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey") / 25).alias("y"))
    right = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 50000).alias("x"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_custkey") % 25) / 25).alias("y"))
    return rounded(privacy.near_copies(left, right, "c_custkey", "o_orderkey", ["x", "y"]), 8)


def _people(modulus: str) -> str:
    return f"(SELECT c_custkey AS k, c_acctbal / 10000 AS x, c_nationkey / 25 AS y, c_mktsegment AS s FROM customer WHERE {modulus})"


def people(spark, sf_dir, modulus: str):
    return load(spark, sf_dir, "customer").filter(modulus).select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 10000).alias("x"), (F.col("c_nationkey") / 25).alias("y"), F.col("c_mktsegment").alias("s"))


def _asked(source: str) -> str:
    return f"(SELECT * FROM {source} ORDER BY {HEX.format('k')}, k LIMIT {privacy.QUERIES})"


def _near(asked: str, base: str, k: int = 1) -> str:
    return f"(SELECT * FROM (SELECT a.k, b.k AS neighbour, b.s AS guess, a.s AS truth, d, row_number() OVER (PARTITION BY a.k ORDER BY d, b.k) AS r FROM {asked} a, {base} b, LATERAL (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d)) WHERE r <= {k})"


_TRAIN, _TEST, _MADE = (_people(f"c_custkey % 3 = {k}") for k in range(3))
_SIDES = [f"c_custkey % 3 = {k}" for k in range(3)]


@query(f"SELECT round(avg(CASE WHEN a.d < b.d THEN 1.0 WHEN a.d = b.d THEN 0.5 ELSE 0.0 END), 6) AS auc FROM {_near(_asked(_TRAIN), _MADE)} a, {_near(_asked(_TEST), _MADE)} b")
def neighbour_membership(spark, sf_dir):
    return rounded(privacy.membership_auc(*(people(spark, sf_dir, m) for m in _SIDES), "k", ["x", "y"]))


@query(
    f"""WITH u AS (SELECT s FROM {_MADE} GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 1) SELECT round(avg((truth = guess)::INTEGER), 8) AS attack, round(avg((truth = u.s)::INTEGER), 8) AS baseline,
round(avg((truth = guess)::INTEGER) - avg((truth = u.s)::INTEGER), 8) AS advantage FROM {_near(_asked(_TRAIN), _MADE)}, u"""
)
def attribute_inference(spark, sf_dir):
    return rounded(privacy.attribute_advantage(people(spark, sf_dir, _SIDES[0]), people(spark, sf_dir, _SIDES[2]), "k", ["x", "y"], "s"), 8)


@query(
    f"""WITH w AS (SELECT k, max(d) FILTER (r = 1) AS d1, max(d) FILTER (r = 2) AS d2 FROM {_near(_asked(_MADE), _TRAIN, 2)} GROUP BY 1)
SELECT round(median(d1), 8) AS dcr, round(median(coalesce(d1 / nullif(d2, 0), 1)), 8) AS nndr, count(*) FILTER (d1 = 0)::BIGINT AS copies FROM w"""
)
def closest_records(spark, sf_dir):
    return rounded(privacy.closeness(people(spark, sf_dir, _SIDES[0]), people(spark, sf_dir, _SIDES[2]), "k", ["x", "y"]), 8)


@query()
def sample_geometry(spark, sf_dir):
    return rounded(privacy.geometry(spark, people(spark, sf_dir, _SIDES[0]), people(spark, sf_dir, _SIDES[2]), "k", ["x", "y"]))


_UNITS = "(SELECT l_orderkey % 2 = 0 AS side, CASE WHEN l_linenumber <> 3 THEN l_quantity / 50 END AS quantity, l_discount * 10 AS discount FROM lineitem)"


def _errors(c: str) -> str:
    parts = [f"abs(avg(({c} IS NOT NULL)::INTEGER) FILTER (side) - avg(({c} IS NOT NULL)::INTEGER) FILTER (NOT side))"]
    for k in range(1, 10):
        share = f"avg(({c} <= {k / 10}::DOUBLE)::INTEGER) FILTER ({{}})"
        parts.append(f"abs({share.format('side')} - {share.format('NOT side')}) / greatest({share.format('side')}, 0.05)")
    return f"SELECT unnest([{', '.join(parts)}]) AS e FROM {_UNITS}"


@query(f"SELECT round(list_sort(list(e))[ceil(0.95 * count(*))::INTEGER], 8) AS p95 FROM ({_errors('quantity')} UNION ALL {_errors('discount')})")
def count_query_p95(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2 == 0).alias("side"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"))
    return rounded(privacy.p95_error(privacy.count_query_errors(rows, F.col("side"), ["quantity", "discount"])), 8)


_FEATURES = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax", "part": "l_partkey", "supplier": "l_suppkey", "line": "l_linenumber", "order": "l_orderkey % 97"}
_Y = "(l_extendedprice / 1000 + l_quantity)"
_CORR = " UNION ALL ".join(f"SELECT '{n}' AS feature, round(corr({e}, {_Y}) FILTER (l_orderkey % 2 = 0), 9) AS r, round(corr({e}, {_Y}) FILTER (l_orderkey % 2 <> 0), 9) AS s, count(*) FILTER (l_orderkey % 2 = 0) AS n, count(*) FILTER (l_orderkey % 2 <> 0) AS m FROM lineitem" for n, e in _FEATURES.items())


def correlations(spark, sf_dir):
    items, side = load(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 2 == 0
    y = F.col("l_extendedprice") / 1000 + F.col("l_quantity")
    at = lambda c, v: F.when(c, v).cast("double")
    rows = [F.struct(F.lit(n).alias("feature"), F.round(F.corr(at(side, F.expr(e)), at(side, y)), 9).alias("r"), F.round(F.corr(at(~side, F.expr(e)), at(~side, y)), 9).alias("s"), F.count_if(side).alias("n"), F.count_if(~side).alias("m")) for n, e in _FEATURES.items()]
    return items.agg(F.array(*rows).alias("all")).select(F.explode("all").alias("c")).select("c.*")


@query(f"SELECT round(avg((abs(s) > 1.96 / sqrt(m - 3))::INTEGER) FILTER (abs(r) <= 1 / sqrt(n - 3)), 8) AS type_i, count(*) FILTER (abs(r) <= 1 / sqrt(n - 3))::BIGINT AS features FROM ({_CORR})")
def false_rejections(spark, sf_dir):
    return rounded(privacy.false_rejections(correlations(spark, sf_dir), "r", "s", "n", "m"), 8)


@query(f"WITH p AS (SELECT row_number() OVER (ORDER BY abs(r) DESC, feature) <= 5 AS a, row_number() OVER (ORDER BY abs(s) DESC, feature) <= 5 AS b FROM ({_CORR})) SELECT count(*) FILTER (a AND b) / 5 AS overlap, 5 AS k FROM p")
def driver_overlap(spark, sf_dir):
    return privacy.driver_overlap(correlations(spark, sf_dir), "feature", "r", "s")


_UNIT = {"quantity": "l_quantity / 50", "discount": "l_discount * 10", "price": "l_extendedprice * (1 + (l_orderkey % 2) * 0.2) / 130000"}
_PROBES = str([(k + 0.5) / 64 for k in range(64)])


@query(
    "WITH w AS ("
    + " UNION ALL ".join(
        f"SELECT list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) / 64 AS w, r - s AS d FROM (SELECT quantile_cont({e}, {_PROBES}) FILTER (l_orderkey % 2 = 0) AS a, quantile_cont({e}, {_PROBES}) FILTER (l_orderkey % 2 <> 0) AS b, corr({e}, {_Y}) FILTER (l_orderkey % 2 = 0) AS r, corr({e}, {_Y}) FILTER (l_orderkey % 2 <> 0) AS s FROM lineitem)"
        for e in _UNIT.values()
    )
    + ") SELECT round(m, 7) AS marginal, round(d, 7) AS dependence, round(0.55::DOUBLE * m + 0.45::DOUBLE * d, 7) AS joint FROM (SELECT avg(1 - least(w / 0.25::DOUBLE, 1)) AS m, avg(1 - least(abs(d) / 1.5::DOUBLE, 1)) AS d FROM w)"
)
def distribution_fidelity(spark, sf_dir):
    """Wasserstein distances of columns on the unit scale, and differences of their correlations, between two halves."""
    from loomtab.operators.columns import correlation
    from loomtab.operators.compare import wasserstein

    side, y, out = F.col("l_orderkey") % 2 == 0, F.col("l_extendedprice") / 1000 + F.col("l_quantity"), None
    items = load(spark, sf_dir, "lineitem").select("*", *(F.expr(e).cast("double").alias(n) for n, e in _UNIT.items()))
    for n in _UNIT:
        both = items.agg((correlation(F.when(side, F.col(n)), y) - correlation(F.when(~side, F.col(n)), y)).alias("difference"))
        row = wasserstein(items, side, n).join(F.broadcast(both))  # a row each
        out = row if out is None else out.union(row)
    return rounded(privacy.distribution_fidelity(out, "wasserstein", "difference"), 7)


def _cell(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '0' ELSE '1' || {c}::VARCHAR END"


_ROW = "md5(" + " || chr(1) || ".join(_cell(c) for c in ("{0}", "{1}", "{2}")) + ")"


def _fingerprint_sql(source: str, columns: list[str]) -> str:
    """The columns' order is found among all orders by their digests."""
    digest = {c: ", ".join(f"sum(('0x' || substr(md5({_cell(c)}), {1 + 7 * k}, 7))::BIGINT)" for k in range(corpus.PARTS)) for c in columns}
    cases = " ".join(f"WHEN d{a} <= d{b} AND d{b} <= d{c} THEN {k}" for k, (a, b, c) in enumerate(permutations(range(3))))
    rows = "CASE o.o " + " ".join(f"WHEN {k} THEN {_ROW.format(*(columns[i] for i in p))}" for k, p in enumerate(permutations(range(3)))) + " END"
    lists = ", ".join(f"[{digest[c]}] AS d{k}" for k, c in enumerate(columns))
    sums = " || '|' || ".join(f"sum(('0x' || substr(h, {1 + 7 * k}, 7))::BIGINT)::VARCHAR" for k in range(corpus.PARTS))
    return f"WITH s AS (SELECT * FROM {source}), d AS (SELECT {lists} FROM s), o AS (SELECT CASE {cases} END AS o FROM d), r AS (SELECT {rows} AS h FROM s, o) SELECT count(*)::BIGINT AS n_rows, md5(count(*)::VARCHAR || '|' || {sums}) AS fingerprint FROM r"


@query(_fingerprint_sql("(SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS st, o_orderpriority FROM orders)", ["o_orderkey", "st", "o_orderpriority"]))
def table_fingerprint(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("st"), "o_orderpriority")
    return corpus.content_fingerprint(rows, ["o_orderpriority", "o_orderkey", "st"])


_NEAR = {"quantity": "l_quantity / 50", "discount": "l_discount * 10", "price": "l_extendedprice / 200000"}


@query(
    f"""WITH q AS ({" UNION ALL ".join(f"SELECT list_transform(quantile_cont({e}, {[k / 8 for k in range(9)]}), lambda x: round(32 * greatest(0, least(1, x)))::INTEGER) AS q FROM lineitem" for e in _NEAR.values())}),
r AS (SELECT count(*) AS n, list_sort([round(16 * corr(l_quantity / 50, l_extendedprice / 200000))::INTEGER, round(16 * corr(l_discount * 10, l_extendedprice / 200000))::INTEGER]) AS r FROM lineitem)
SELECT any_value(ceil(log2(n))::INTEGER)::VARCHAR || '|2|' || string_agg(array_to_string(q, ','), ';' ORDER BY array_to_string(q, ',')) || '|' || any_value(array_to_string(r, ',')) AS near FROM q, r"""
)
def near_table_fingerprint(spark, sf_dir):
    return corpus.near_fingerprint(load(spark, sf_dir, "lineitem"), {n: F.expr(e) for n, e in _NEAR.items()}, "price")


@query(
    """WITH t AS (SELECT l_suppkey, count(*) AS n, 4 + l_suppkey % 9 AS p, abs(coalesce(corr(l_quantity, l_extendedprice), 0)) AS s, avg((l_linenumber = 3)::INTEGER) AS m FROM lineitem GROUP BY 1)
SELECT l_suppkey, 'r' || floor(log2(n))::INTEGER || '-p' || floor(log2(p))::INTEGER AS shape, CASE WHEN round(s, 9) >= 0.5 THEN 'strong' WHEN round(s, 9) >= 0.2 THEN 'moderate' ELSE 'weak' END || CASE WHEN m > 0.05 THEN '-missing' ELSE '' END AS difficulty, CASE WHEN l_suppkey % 3 = 0 THEN 'synthetic' ELSE 'real' END AS origin FROM t"""
)
def corpus_strata(spark, sf_dir):
    k = F.col("l_suppkey")
    t = load(spark, sf_dir, "lineitem").groupBy(k).agg(F.count("*").alias("n"), F.abs(F.coalesce(F.corr("l_quantity", "l_extendedprice"), F.lit(0.0))).alias("s"), F.avg((F.col("l_linenumber") == 3).cast("int")).alias("m"))
    return t.select(k, corpus.shape_stratum(F.col("n"), 4 + k % 9).alias("shape"), corpus.difficulty_stratum(F.round("s", 9), F.col("m")).alias("difficulty"), corpus.origin(F.when(k % 3 == 0, "/data/Synthetic/a").otherwise("/data/b")).alias("origin"))


@query(
    """WITH i AS (SELECT doc_id, md5(coalesce(text, '')) AS fp, source AS grp FROM documents), f AS (SELECT fp, min(doc_id) AS first_key, arg_min(grp, doc_id) AS lineage FROM i GROUP BY 1)
SELECT doc_id, first_key, doc_id = first_key AS kept, lineage FROM i JOIN f USING (fp)"""
)
def inventory_dedup(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("fp"), F.col("source").alias("grp"))
    return corpus.first_of_each(docs, "doc_id", "fp", "grp").select("doc_id", "first_key", "kept", "lineage")


@query(
    """WITH RECURSIVE e AS (SELECT s_suppkey AS x, (s_suppkey * 7) % 83 AS y FROM supplier UNION SELECT (s_suppkey * 7) % 83, s_suppkey FROM supplier), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS member, least(x, min(y)) AS root FROM r GROUP BY x"""
)
def lineage_components(spark, sf_dir):
    edges = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), ((F.col("s_suppkey") * 7) % 83).alias("b"))
    return corpus.lineage_components(edges, "a", "b")


@query()
def lineage_split(spark, sf_dir):
    groups = load(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").alias("family")).agg(F.count("*").alias("weight"))
    return corpus.lineage_split(groups, "stratum", "family", "weight")


@query("SELECT count(*)::BIGINT AS n FROM (SELECT l_quantity, l_discount, l_tax FROM lineitem WHERE l_orderkey % 5 = 0) q WHERE EXISTS (SELECT 1 FROM lineitem t WHERE t.l_orderkey % 5 <> 0 AND t.l_quantity = q.l_quantity AND t.l_discount = q.l_discount AND t.l_tax = q.l_tax)")
def overlapping_rows(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    held = F.col("l_orderkey") % 5 == 0
    return corpus.overlapping_rows(items.filter(~held), items.filter(held), ["l_quantity", "l_discount", "l_tax"]).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, rank() OVER (ORDER BY o_totalprice, o_orderkey)::BIGINT - 1 AS place, round((less + 0.5 * (same - 1)) / (n - 1), 8) AS share, round((less + (same + 1) / 2) / (n + 1), 8) AS u FROM (SELECT *, rank() OVER (ORDER BY o_totalprice) - 1 AS less, count(*) OVER (PARTITION BY o_totalprice) AS same, count(*) OVER () AS n FROM orders)")
def rank_forms(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    share, u = ranks.percent_ranks(orders, "k", "o_totalprice"), ranks.rank_uniforms(orders, "k", "o_totalprice", 0.0)
    return rounded(ranks.ordinal_ranks(orders, "k", "o_totalprice").join(share, "k").join(u, "k"), 8)


@query("WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, o_orderkey, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE k % greatest(1, ceil(n / 700)::BIGINT) = 0")
def strided_rows(spark, sf_dir):
    return ranks.strided(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 700)


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority, {HEX.format('o_orderkey')}, o_orderkey) - 1 AS k FROM orders) SELECT o_orderkey, (k % 5)::INTEGER AS fold FROM r")
def stratified_folds(spark, sf_dir):
    from loomtab.operators import splits

    return splits.stratified_folds(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 5).select("o_orderkey", "fold")


@query(
    f"""WITH s AS (SELECT o_orderpriority AS p, count(*) AS n, count(*) * 300 / sum(count(*)) OVER () AS e FROM orders GROUP BY 1), q AS (SELECT p, floor(e) + (row_number() OVER (ORDER BY e - floor(e) DESC, p) <= 300 - sum(floor(e)) OVER ())::INTEGER AS q FROM s)
SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {HEX.format('o_orderkey')}, o_orderkey) AS k FROM orders) JOIN q ON p = o_orderpriority WHERE k <= q"""
)
def stratified_subsample(spark, sf_dir):
    from loomtab.operators import splits

    return splits.stratified_subsample(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 300).select("o_orderkey")


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {HEX.format('o_orderkey')}, o_orderkey) <= greatest(10, least(5000, floor(count(*) OVER () * 0.15 + 0.5))) AS is_validation FROM orders")
def fit_validation_split(spark, sf_dir):
    from loomtab.operators import splits

    return splits.fit_validation_split(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
