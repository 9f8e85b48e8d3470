"""Assessments, folds of groups, strata, associations and strict JSON on small cases with nulls, ties and empty tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtab.functions import strict_json
from loomtab.operators import assessment, auditors, boosting, corpus, landmarks, ledger, models, privacy, ranks, splits


@pytest.mark.parametrize(("text", "want"), [
    ('{"b": 1, "a": [1, 2.50, null]}', '{"a":[1,2.5,null],"b":1}'), ('{"a":1,"a":2}', None), ('{"x":{"a":1,"a":1}}', None), ("NaN", None), ('{"a":-Infinity}', None), ("[1,]", None), ("1 2", None), ("", None), (None, None),
    ('"\\u00e9\\n"', '"é\\n"'), (" true ", "true"), ("1e400", None), ("[" * 100_000, None),
])
def test_strict_json(text, want):
    assert strict_json.canonical_text(text) == want


def test_coverage_of_numbers_and_classes(spark):
    rng = np.random.default_rng(0)
    n = 4000
    p = rng.random(n)
    df = spark.createDataFrame(pd.DataFrame({"y": rng.normal(size=n), "p": p, "h": (rng.random(n) < p) * 1.0, "o": (rng.random(n) < p * p) * 1.0})).union(spark.createDataFrame([(None, None, None, None)], "y double, p double, h double, o double"))
    r = assessment.coverage(df, F.col("y"), F.lit(0.0), 1.0).first()
    assert r["n"] == n and abs(r["covered"] - 0.95) < 0.01
    assert assessment.class_coverage(df, F.col("h"), F.col("p")).first()["covered"] >= 0.8 > 0.4 > assessment.class_coverage(df, F.col("o"), F.col("p")).first()["covered"]
    empty = df.filter("false")
    assert assessment.coverage(empty, F.col("y"), F.lit(0.0), 1.0).first()["covered"] is None and assessment.class_coverage(empty, F.col("h"), F.col("p")).first()["bins"] == 0
    few = assessment.tail_retention(df.limit(20), "y", F.lit(0.0), F.col("y"), F.col("y")).first()
    assert few["n"] < 10 and few["retention"] is None
    assert assessment.tail_retention(df, "y", F.lit(0.0), F.col("y"), F.col("y") / 2).first()["retention"] == pytest.approx(0.75)
    assert assessment.rare_class_retention(empty, "o", F.lit(1.0), F.lit(0.0), F.lit(0.0)).count() == 0


def test_importances_and_bounds(spark):
    df = spark.createDataFrame([("a", 3.0, 3.0), ("b", 2.0, 0.1), ("c", -1.0, 1.0), ("d", 0.5, 2.0), ("e", None, 9.0)], "f string, r double, s double")
    got = assessment.importance_agreement(df, "f", "r", "s", 2).first()
    assert got["overlap"] == 0.5 and got["signs"] == pytest.approx(5.5 / 6.5) and got["cosine"] == pytest.approx((9 + 0.2 - 1 + 1) / math.sqrt(14.25 * 14.01))
    flat = assessment.importance_agreement(df.withColumn("r", F.lit(0.0)), "f", "r", "s").first()
    assert flat["cosine"] == 0.0 and flat["signs"] == 1.0
    values = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0), (None, 6.0), ("c", None)], "c string, v double")
    bound = assessment.student_lower_bound(values, "c", "v").first()
    assert bound["clusters"] == 3 and bound["lower"] == pytest.approx(4.0 - 2.919985580 * 2.0 / math.sqrt(3), abs=1e-6)
    assert assessment.student_lower_bound(values.filter("c = 'a'"), "c", "v").first()["lower"] is None
    assert ledger.power_simulation(values.withColumn("v", F.lit(1.0)), "c", "v", [5], 0.0, 10).first()["power"] == 0.0


def test_grouped_importance_moves_shared_columns_together(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(3000), "a": x, "b": x, "c": rng.normal(size=3000), "y": x}))
    w = {"one": 0.0, "a": 2.0, "b": -1.0, "c": 0.0}
    for size in (20_000, 500):
        monkeypatch.setattr(models, "BLOCK_ROWS", size)
        got = {r["group"]: r["importance"] for r in models.grouped_importance(df, "k", w, {"ab": ["a", "b"], "a": ["a"], "c": ["c"]}, F.col("y"), 3).collect()}
        # Moved together, copies of one column keep the model at 2a - b = a of another row.
        assert got["ab"] == pytest.approx(2.0, abs=0.25) and got["a"] == pytest.approx(8.0, abs=0.8) and got["c"] == 0.0


def test_no_group_crosses_folds_and_strata_are_even(spark):
    df = spark.createDataFrame([(k, f"g{k % 13}" if k % 7 else None, float(k % 10) if k % 6 else None) for k in range(300)], "k long, g string, v double")
    dealt = splits.group_folds(df, "g", 4)
    assert dealt.count() == 300 and dealt.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n <> 1").isEmpty()
    sizes = [r["n"] for r in dealt.select("g", "fold").distinct().groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1
    binned = splits.value_strata(df, "v", "k", 5)
    counts = {r["stratum"]: r["count"] for r in binned.groupBy("stratum").count().collect()}
    assert counts == {None: 50} | dict.fromkeys(range(5), 50)
    assert splits.value_strata(df.filter("false"), "v", "k").count() == 0
    halves = corpus.validation_halves(df.select("g").distinct(), "g")
    assert sorted(r["count"] for r in halves.groupBy("part").count().collect()) == [7, 7]


def test_associations_see_curves_and_classes(spark):
    x = np.linspace(-1, 1, 400)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(400), "x": x, "y": x * x, "c": np.where(x > 0, "p", "n"), "flat": 1.0}))
    got = {r["feature"]: r for r in boosting.association(df, {"x": F.col("x"), "flat": F.col("flat")}, F.col("y"), "k").collect()}
    assert abs(got["x"]["rho"]) < 0.01 and got["x"]["strength"] == got["x"]["xi"] > 0.95 and got["flat"]["strength"] < 0.1
    assert boosting.association(df.limit(4), {"x": F.col("x")}, F.col("y"), "k").first()["strength"] == 0.0
    eta = {r["feature"]: r["eta"] for r in boosting.class_association(df, {"x": F.col("x"), "flat": F.col("flat")}, F.col("c")).collect()}
    assert eta["x"] == pytest.approx(math.sqrt(0.75), abs=0.01) and eta["flat"] == 0.0
    q = {r["k"]: r["q"] for r in ranks.midrank_quantiles(df.filter("k < 4").withColumn("x", F.when(F.col("k") > 1, 5.0).otherwise(F.col("x"))), "k", "x").collect()}
    assert q == {0: 0.125, 1: 0.375, 2: 0.75, 3: 0.75}


def test_class_auditors_see_the_signal(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 1500))
    y = np.where(a > 0.5, 2, np.where(b > 0, 1, 0))
    df = spark.createDataFrame(pd.DataFrame({"a": np.where(rng.random(1500) < 0.05, np.nan, a), "b": b, "y": y})).replace(float("nan"), None)
    train, test = df.filter("b < 1"), df.filter("b >= -1")
    rows = {r["family"]: r for r in auditors.class_losses(train, train.limit(150), test, ["a", "b"], "y", 3).collect()}
    assert set(rows) == {"linear", "boosted"}
    for r in rows.values():
        assert r["real_loss"] < 0.8 * r["null_loss"] and r["retention"] < 1.05


def test_coordinates_have_their_places_and_bundles_their_last_rows(spark):
    panel = spark.createDataFrame([("lin", "additive", 0.5, 0.1), ("hinge", "additive", 0.7, 0.2), ("net", "neural", None, None)], "member string, family string, gain double, error double")
    rows = landmarks.coordinates(panel, 1000, 4, 3, (1.0, 2.0, float("nan"))).orderBy("place").collect()
    at = {r["name"]: r for r in rows}
    assert len(rows) == 96 and [r["place"] for r in rows] == list(range(96))
    assert at["hinge - lin"]["value"] == pytest.approx(0.2) and at["share hinge"]["value"] == 0.75 and not at["gain net"]["known"] and not at["target skew"]["known"]
    assert at["multiclass"]["value"] == 1.0 and at["rows"]["value"] == 0.5 and at["features"]["value"] == pytest.approx(2 / 12)
    bundles = spark.createDataFrame([("a", 1, 1, True, 10), ("a", 1, 2, False, 20), ("a", 1, 2, True, 15), ("b", 1, 9, True, 30), ("b", 2, 1, None, 40), (None, 1, 3, True, 50), (None, 1, 4, True, 60)], "scope string, t int, version int, complete boolean, value int")
    got = {(r["scope"], r["t"]): r["value"] for r in landmarks.merged_bundles(bundles, "scope", "t", "version", "complete").collect()}
    assert got == {("a", 1): 15, ("b", 1): 30, (None, 1): 60}


def test_discrepancies_follow_their_definitions():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 3)), rng.normal(size=(40, 3)) + 1
    d = lambda x, y: np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    positive = np.concatenate((d(a, a)[np.triu_indices(40, 1)], d(b, b)[np.triu_indices(40, 1)], d(a, b).ravel()))
    h = np.median(positive[positive > 0])
    want = np.mean([np.exp(-d(a, a) / (s * h)).mean() + np.exp(-d(b, b) / (s * h)).mean() - 2 * np.exp(-d(a, b) / (s * h)).mean() for s in (0.5, 1, 2)])
    assert privacy.kernel_discrepancy(a, b) == pytest.approx(want, rel=1e-6) and privacy.kernel_discrepancy(a, a) == pytest.approx(0, abs=1e-9)
    assert privacy.sliced_distance(a, a) == 0 and privacy.sliced_distance(a[:, :1], a[:, :1] + 2.0) == pytest.approx(2.0)


def test_signature_of_classes_sums_their_errors(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=(2, 900))
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(900), "x": x, "z": z, "c": np.where(np.abs(x) > 1, "far", np.where(z > 0, "up", "down"))}))
    got = {r["member"]: r["gain"] for r in landmarks.class_signature(spark, df, "k", ["x", "z"], "c", ["lin", "abs", "stump"]).collect()}
    assert got["abs"] > got["lin"] + 0.15 > 0.2 and got["stump"] > 0.05
    two = df.filter("c <> 'far'")
    one = {r["member"]: r["gain"] for r in landmarks.signature(spark, two.withColumn("y", (F.col("c") == "up").cast("double")), "k", ["x", "z"], "y", ["lin"]).collect()}
    both = {r["member"]: r["gain"] for r in landmarks.class_signature(spark, two, "k", ["x", "z"], "c", ["lin"]).collect()}
    assert both["lin"] == pytest.approx(one["lin"], abs=1e-6)
    none = landmarks.class_signature(spark, df.filter("false"), "k", ["x"], "c", ["lin"]).collect()
    assert [r["gain"] for r in none] == [None]
    with pytest.raises(ValueError, match="classes"):
        landmarks.class_signature(spark, df, "k", ["x"], "k", ["lin"])


def test_sign_agreement_without_direction(spark):
    rows = [("a", 0.0, 1.0), ("a", 0.0, 0.0), ("b", 3.0, 1.0), ("b", -1.0, 2.0), ("c", None, 1.0)]
    found = {r["g"]: r["sign"] for r in ledger.sign_agreement(spark.createDataFrame(rows, "g string, r double, s double"), "g", "r", "s").collect()}
    assert math.isnan(found["a"]) and found["b"] == 0.75 and found["c"] is None


def test_choice_regret_adds_in_the_order_of_the_table(spark, tmp_path):
    import duckdb

    from loomtab.plans import catalogue, measures  # noqa: F401

    # Many means on a half and many equal ones, over files of unequal size.
    rng = np.random.default_rng(4)
    n = 40_000
    rows = pd.DataFrame({"l_suppkey": rng.integers(0, 250, n), "l_linenumber": rng.integers(1, 5, n).astype("int32"), "l_tax": rng.integers(0, 9, n) / 100, "l_discount": rng.integers(0, 3, n) / 100})
    (tmp_path / "lineitem.parquet").mkdir()
    for k, part in enumerate(np.split(rows, [25_000, 28_000, 39_000])):
        part.to_parquet(tmp_path / "lineitem.parquet" / f"part-{k}.parquet", index=False)
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLE_SQL["choice_regret"]).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["choice_regret"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_near_copies_meet_once(spark):
    rng = np.random.default_rng(9)
    # On a grid of half the radius, with cells lost in any column, and some keys and rows twice.
    sides = []
    for n in (300, 400):
        x = rng.integers(-40, 40, (n, 3)) * 0.05
        rows = [(int(k), *(None if rng.random() < 0.3 else float(v) for v in r)) for k, r in enumerate(x)]
        sides.append([*rows, *rows[:20]])
    left, right = (spark.createDataFrame(r, "k long, a double, b double, c double") for r in sides)
    got = privacy.near_copies(left, right.withColumnRenamed("k", "j"), "k", "j", ["a", "b", "c"], 0.1)
    assert str(got._jdf.queryExecution().executedPlan()).count("Exchange") <= 2
    want = []
    for i, *p in sides[0]:
        for j, *q in sides[1]:
            if [u is None for u in p] == [u is None for u in q]:
                d = 0.0
                for u, v in zip(p, q, strict=True):
                    d += 0.0 if u is None else (u - v) * (u - v)
                if d <= 0.1 * 0.1 * 4:
                    want.append((i, j, round((d / 4) ** 0.5, 9)))
    assert sorted((r["k"], r["j"], round(r["distance"], 9)) for r in got.collect()) == sorted(want) and len(want) > 300
