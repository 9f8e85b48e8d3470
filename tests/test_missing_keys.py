"""No row with a null key or group is lost, constants and tiny inputs have results, and brackets give the same quantiles as all values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.operators import corpus, ledger, models, prepare, privacy, program, ranks, reducers, splits


@pytest.fixture(scope="module")
def rows(spark):
    made = [(k if k % 5 else None, "a" if k % 3 == 0 else "b" if k % 3 == 1 else None, float(k % 17), k) for k in range(60)]
    return spark.createDataFrame(made, "key long, stratum string, x double, place int")


def test_splits_keep_rows_without_a_key(rows):
    split = splits.stratified_split(rows, "key", "stratum", 0.25)
    assert split.count() == 60
    sides = {(r["stratum"], r["is_test"]): r["count"] for r in split.groupBy("stratum", "is_test").count().collect()}
    assert sides == {(s, t): n for s in ("a", "b", None) for t, n in ((True, 5), (False, 15))}
    assert splits.fit_validation_split(rows, "key").count() == 60
    assert splits.capped(rows, "key", "stratum", 100).count() == 60 and splits.capped(rows, "key", "stratum", 4).count() == 12
    assert splits.stratified_folds(rows, "key", "stratum", 4).groupBy("fold").count().filter("count = 15").count() == 4
    assert splits.stratified_subsample(rows, "key", "stratum", 30).count() == 30
    # Rows without a key are dealt by their content: they don't fill the sample.
    picked = splits.hash_sample(rows, "key", 30).collect()
    assert sum(r["key"] is None for r in picked) < 15
    assert rows.select(splits.fold_of(F.col("key"), 5).alias("f")).filter("f is null").count() == 0
    empty = rows.filter("false")
    assert splits.stratified_split(empty, "key", "stratum", 0.25).count() == splits.stratified_folds(empty, "key", "stratum", 4).count() == 0


def test_inventory_keeps_rows_without_a_fingerprint(spark):
    inventory = spark.createDataFrame([(1, "f", "g1"), (2, "f", "g2"), (None, "f", "g3"), (3, None, "g4"), (4, None, None), (5, "h", None)], "key long, print string, grp string")
    got = {(r["key"], r["first_key"], r["kept"], r["lineage"]) for r in corpus.first_of_each(inventory, "key", "print", "grp").collect()}
    assert got == {(1, 1, True, "g1"), (2, 1, False, "g1"), (None, 1, False, "g1"), (3, 3, True, "g4"), (4, 4, True, None), (5, 5, True, None)}


def test_groups_without_a_name_have_their_results(spark, rows):
    df = rows.withColumn("w", F.lit(1.0))
    plain = {s: [r["x"] for r in df.collect() if r["stratum"] == s] for s in ("a", "b", None)}
    quantiles = {r["stratum"]: r["q"] for r in ranks.quantiles(df.select("stratum", "x"), ["stratum"], "x", [0.1, 0.5]).collect()}
    assert {s: np.allclose(q, np.quantile(plain[s], [0.1, 0.5])) for s, q in quantiles.items()} == dict.fromkeys(plain, True)
    cvar = {r["stratum"]: r["cvar"] for r in ledger.weighted_cvar(df, "stratum", "x", "w", 0.75).collect()}
    assert all(math.isclose(cvar[s], np.mean(sorted(v)[-5:])) for s, v in plain.items()) and set(cvar) == set(plain)
    assert {r["stratum"]: r["n_tail"] for r in reducers.cvar(df, "stratum", "x", 0.25).collect()} == {s: sum(x >= np.quantile(v, 0.75) for x in v) for s, v in plain.items()}


def plain_sign(a, b):
    n, k = a + b, min(a, b)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def test_sign_test_holds_for_many_games(spark):
    cases = [(0, 0), (3, 0), (0, 9), (5, 5), (9, 12), (10, 11), (30, 41), (1500, 1500), (1500, 1400), (2000, 1800), (12, 900), (4, 3000)]
    got = spark.createDataFrame(cases, "a long, b long").select("a", "b", ledger.sign_test(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        want = plain_sign(r["a"], r["b"])
        assert math.isclose(r["p"], want, rel_tol=1e-8, abs_tol=1e-280), r
    # A fair coin over ten million games.
    assert abs(spark.createDataFrame([(5_000_000, 5_000_000)], "a long, b long").select(ledger.sign_test(F.col("a"), F.col("b"))).first()[0] - 1) < 1e-9


def test_median_interval_takes_many_rows(spark):
    values = spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    r = ledger.median_interval(values, "id", "v", 200).first()
    assert 400 < r["lower"] < r["centre"] < r["upper"] < 600 and r["upper"] - r["lower"] < 120
    none = ledger.median_interval(values.filter("false"), "id", "v", 20).first()
    assert none["centre"] is none["lower"] is none["upper"] is None


def test_constants_and_tiny_inputs(spark):
    flat = spark.range(40).selectExpr("id", "1.0 as a", "cast(id as double) as b", "cast(id % 7 as double) as c", "2.0 as y")
    edges = {r["child"]: r["weight"] for r in models.chow_liu(flat, ["a", "b", "c"], spark).collect()}
    assert set(edges) == {"b", "c"} and min(edges.values()) == 0
    assert program.retention(spark, flat, "id", "y", ["b"], [], rows=50).first()["retention"] is None
    few = spark.createDataFrame([(0.3, 0.9, 3, 3)], "r double, s double, n long, m long")
    assert privacy.false_rejections(few, "r", "s", "n", "m").first()["type_i"] == 0.0
    card = {r["column"]: r for r in prepare.fit_scalers(flat, {"a": F.col("a"), "b": F.col("b"), "z": F.when(F.col("b") > 99, 1.0)}).collect()}
    assert card["a"]["kind"] == card["z"]["kind"] == "constant" and card["b"]["kind"] == "robust" and card["z"]["missing_rate"] == 1.0


@pytest.mark.parametrize("limit", [0, 10**9])
def test_brackets_give_the_quantiles_of_all_values(spark, monkeypatch, limit):
    monkeypatch.setattr(ranks, "COUNTED_ROWS", limit)
    rng = np.random.default_rng(2)
    n = 30_000
    made = {"normal": rng.normal(size=n), "heavy": rng.standard_cauchy(n), "ties": rng.integers(0, 4, n).astype(float), "zeros": np.where(rng.random(n) < 0.9, 0.0, rng.random(n))}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*made.values(), strict=True)], ", ".join(f"{c} double" for c in made)).withColumn("none", F.lit(None).cast("double"))
    grid = [0.0, 0.005, 0.25, 0.3, 0.5, 0.501, 0.95, 0.995, 1.0]
    found, more = ranks.bracketed(df, {c: F.col(c) for c in (*made, "none")}, grid, [F.count("*").alias("rows")])
    assert more["rows"] == n and found["none"] == (0, None)
    for c, v in made.items():
        assert found[c][0] == n and np.allclose(found[c][1], np.quantile(v, grid), rtol=1e-12, atol=0)
    monkeypatch.setattr(ranks, "ORDERED_VALUES", 10)
    again, _ = ranks.bracketed(df, {c: F.col(c) for c in made}, grid)
    assert again == {c: found[c] for c in made}
    monkeypatch.setattr(ranks, "merged", lambda p, sketch, slack: [(0.0, 0.1)])
    missed, _ = ranks.bracketed(df, {"normal": F.col("normal")}, [0.25, 0.5])
    assert np.allclose(missed["normal"][1], np.quantile(made["normal"], [0.25, 0.5]))
