"""Operators of the core against plain versions of themselves, and on constant, empty, one-sided and missing inputs."""

import gzip
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtab.functions import cells, normal
from loomtab.operators import auditors, boosting, columns, compare, corpus, landmarks, ledger, models, prepare, privacy, ranks, reducers, splits
from loomtab.sources import files


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 600
    x, z = rng.normal(size=n), rng.integers(0, 4, n).astype(float)
    y = 2 * x + (z > 1) * 3 + 0.5 * rng.normal(size=n)
    rows = [(k, float(a), None if k % 17 == 0 else float(b), float(c), "ab"[int(c > 1)], 5.0) for k, (a, b, c) in enumerate(zip(x, z, y, strict=True))]
    return spark.createDataFrame(rows, "k long, x double, z double, y double, c string, same double")


def plain(table):
    return table.toPandas().sort_values("k").reset_index(drop=True)


def test_quantiles_are_exact(table):
    pdf = plain(table)
    grid = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = {r["c"]: r["q"] for r in ranks.quantiles(table, ["c"], "x", grid).collect()}
    for c, part in pdf.groupby("c"):
        assert np.allclose(found[c], np.quantile(part["x"], grid))
    assert np.allclose(ranks.quantiles(table, [], "z", grid).first()["q"], np.quantile(pdf["z"].dropna(), grid))
    assert ranks.quantiles(table.filter("false"), [], "x", grid).count() in (0, 1)


def test_constant_empty_and_one_sided_inputs(spark, table):
    none = table.filter("false")
    card = columns.robust_scale(table, "same").first()
    assert card["hi"] == card["lo"] + 1
    assert table.select(cells.unit(F.col("same"), F.lit(5.0), F.lit(5.0)).alias("u")).distinct().collect()[0]["u"] == 0.5
    assert ranks.spearman(table, "same", "x").first()["rho"] == 0.0 and ranks.spearman(none, "x", "y").first()["rho"] == 0.0
    assert ranks.correlation_ratio(table, "c", "same").first()["eta"] == 0.0 and ranks.correlation_ratio(none, "c", "x").first()["eta"] == 0.0
    assert ranks.chatterjee_xi(table, "x", "same", "k").first()["xi"] == 0.0 and ranks.chatterjee_xi(none, "x", "y", "k").first()["xi"] == 0.0
    assert columns.binned_information(table, "same", "x").first()["information"] == pytest.approx(0.0)
    assert columns.entropy(none, ["c"]).first()["entropy"] == 0.0
    assert compare.ks(table, F.lit(True), "x").first()["ks"] in (None, 0.0) and compare.rank_auc(table, F.lit(True), "x").first()["auc"] == 0.5
    assert compare.wasserstein(table, F.lit(True), "x").first()["wasserstein"] is None
    profile = columns.profile(none, ["x"]).first()
    assert profile["n_rows"] == 0 and profile["missing_share"] == 0.0 and profile["q50"] is None
    assert splits.bootstrap_means(none, "k", "x", 3).count() == 3
    assert reducers.leave_one_out(table.filter("c = 'a'"), "c", "x").first()["mean_without"] is None
    assert compare.exact_copies(spark.createDataFrame([(1, None), (2, "\x02"), (3, None)], "k long, t string"), "k", ["t"]).collect()[0]["n"] == 2


def test_chatterjee_xi_sums_pass_64_bits(spark):
    n = 4_000_000
    rows = spark.range(n).select("id", F.col("id").alias("x"), F.pmod(F.col("id") * 1_000_003, F.lit(n)).alias("y"))
    xi = ranks.chatterjee_xi(rows, "x", "y", "id").first()["xi"]
    # All ranks are distinct: the lower sum is (n^3 - n) / 6, the upper one comes from plain integers.
    y = (np.arange(n) * 1_000_003) % n
    assert xi == pytest.approx(1 - 3 * int(np.abs(np.diff(y)).sum()) / (n * n - 1), abs=1e-12)


def test_read_cells_is_strict(spark, tmp_path):
    def written(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    good = files.read_cells(spark, written("good.csv", 'a, b ,c\n1, x ,"2,5"\n,,\n'))
    assert good.columns == ["a", "b", "c"] and [tuple(r) for r in good.collect()][0] == ("1", "x", "2,5") and good.count() == 2
    for text in ("a,b\n1,2\n3\n", "a,b\n1,2,3\n"):
        ragged = files.read_cells(spark, written("ragged.csv", text))
        for read in (lambda d: d.select("a").collect(), lambda d: d.collect()):
            with pytest.raises(Exception, match="number of cells"):
                read(ragged)
    for text in ("a,a\n1,2\n", "a,,c\n1,2,3\n", ""):
        with pytest.raises(ValueError, match="header"):
            files.read_cells(spark, written("head.csv", text))
    (tmp_path / "t.tsv.gz").write_bytes(gzip.compress(b"a\tb\n1\t2\n"))
    assert [tuple(r) for r in files.read_cells(spark, str(tmp_path / "t.tsv.gz"), "\t").collect()] == [("1", "2")]
    assert files.read_json_lines(spark, written("j.jsonl", '{"a": 1}\n{"a": 2}\n'), "a int").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json_lines(spark, written("bad.jsonl", '{"a": 1}\nnot json\n'), "a int").collect()


def test_infer_keeps_text_with_few_levels_for_its_rows(spark):
    rows = [(f"v{k}" if k < 150 else None, str(k)) for k in range(1000)]
    found = {r["column"]: r["kind"] for r in files.infer(spark.createDataFrame(rows, "a string, y string"), "y").collect()}
    assert found == {"a": "category", "y": "number"}


def test_scalers_of_degenerate_columns(spark):
    rows = spark.createDataFrame([(None, 1.0, 0.0, float(k), 10.0**k) for k in range(9)] + [(None, 1.0, 1.0, None, None)], "none double, same double, two double, some double, wild double")
    card = {r["column"]: r for r in prepare.fit_scalers(rows, {c: F.col(c) for c in rows.columns}).collect()}
    assert {c: r["kind"] for c, r in card.items()} == {"none": "constant", "same": "constant", "two": "binary", "some": "robust", "wild": "log"}
    assert card["none"]["missing_rate"] == 1.0 and card["some"]["missing_rate"] == pytest.approx(0.1)
    for c, r in card.items():
        z = [v["z"] for v in rows.select(prepare.scaled(F.col(c), r.asDict()).alias("z")).collect()]
        assert all(v is not None and abs(v) <= 6 for v in z)


def test_logistic_matches_newton_in_numpy(table):
    pdf = plain(table)
    w = boosting.logistic(table, [F.col("x")], F.col("c") == "b", penalty=1e-3)
    a, t, v = np.column_stack((np.ones(len(pdf)), pdf["x"])), (pdf["c"] == "b").to_numpy(float), np.zeros(2)
    pull = np.diag([1e-9, 1e-3 * len(pdf)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ v))
        v = v + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (t - p) - pull @ v)
    assert np.allclose(w, v, atol=1e-6)
    assert boosting.logistic(table.filter("false"), [F.col("x")], F.col("c") == "b") == [0.0, 0.0]


def test_boosting_matches_a_plain_version(table):
    coded = table.select("k", F.floor((F.col("x") + 5) * 20).cast("int").alias("a"), F.coalesce(F.col("z") * 50, F.lit(0)).cast("int").alias("b"), "y")
    forest = boosting.boost(coded, ["a", "b"], "y", trees=2, depth=2, eta=0.5, penalty=1.0, least=20)
    pdf = coded.toPandas()
    y, f = pdf["y"].to_numpy(), np.full(len(pdf), pdf["y"].mean())
    for t in range(2):
        g, leaf = f - y, np.zeros(len(pdf), int)
        for level in range(2):
            best = None
            for name in ("a", "b"):
                for code in sorted(set(pdf[name])):
                    left = (pdf[name] <= code).to_numpy()
                    if left.sum() < 20 or (~left).sum() < 20:
                        continue
                    gain = sum(g[(leaf == j) & s].sum() ** 2 / (((leaf == j) & s).sum() + 1.0) for j in set(leaf) for s in (left, ~left))
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, name, code
            at = t * 2 + level
            assert (forest.features[at], forest.thresholds[at]) == best[1:]
            leaf = leaf + (pdf[best[1]] > best[2]).to_numpy() * (1 << level)
        f = f + np.array([-0.5 * g[leaf == j].sum() / ((leaf == j).sum() + 1.0) if (leaf == j).any() else 0.0 for j in range(4)])[leaf]
    got = [r["f"] for r in coded.orderBy("k").select(forest.output().alias("f")).collect()]
    assert np.allclose(got, f[np.argsort(pdf["k"])])
    flat = boosting.boost(coded.filter("false"), ["a"], "y", trees=1, depth=1)
    assert flat.base == 0.0 and flat.leaves == [[0.0, 0.0]]


def test_landmarks_tell_shapes(spark, table):
    found = {r["member"]: r["gain"] for r in landmarks.signature(spark, table, "k", ["x", "z"], "y", ["lin", "step", "pairs", "missing", "best1", "lin_quarter", "stump", "knn16", "net"]).collect()}
    assert found["lin"] > 0.8 and found["step"] > 0.8 and found["best1"] < found["lin"] and found["missing"] < 0.1
    assert found["stump"] > 0.2 and found["knn16"] > 0.7 and found["net"] > 0.8 and found["lin_quarter"] > 0.75
    assert landmarks.contrasts(landmarks.signature(spark, table, "k", ["x"], "y", ["lin", "pow"])).filter("name = 'pow - lin'").first()["value"] < 0.2


def test_a_linear_member_is_cross_validated_ridge(spark, table):
    pdf = plain(table)
    x = ((pdf["x"] - pdf["x"].mean()) / pdf["x"].std(ddof=0)).to_numpy()
    held = {r["k"]: (r["f"], r["i"]) for r in table.select("k", splits.fold_of(F.col("k"), 5, "fold").alias("f"), splits.fold_of(F.col("k"), 20, "inner").alias("i")).collect()}
    fold, inner = (np.array([held[k][j] for k in pdf["k"]]) for j in (0, 1))
    y, a = pdf["y"].to_numpy(), np.column_stack((np.ones(len(pdf)), x))

    def ridge(rows, penalty):
        n = rows.sum()
        scale = np.sqrt((a[rows] ** 2).sum(0) / n)
        pull = penalty * n * np.diag(scale**2)
        pull[0, 0] = 0
        return np.linalg.solve(a[rows].T @ a[rows] + pull + 1e-10 * n * np.eye(2), a[rows].T @ y[rows])

    gains = []
    for f in range(5):
        train = fold != f
        check = train & (inner % 5 == 0)
        penalty = min(landmarks.PENALTIES, key=lambda p: ((y[check] - a[check] @ ridge(train & ~check, p)) ** 2).sum())
        e = y[fold == f] - a[fold == f] @ ridge(train, penalty)
        gains.append(1 - (e**2).sum() / ((y[fold == f] - y[train].mean()) ** 2).sum())
    found = landmarks.signature(spark, table, "k", ["x"], "y", ["lin"]).first()
    assert found["gain"] == pytest.approx(np.mean(gains), abs=1e-9) and found["error"] == pytest.approx(np.std(gains, ddof=1) / math.sqrt(5), abs=1e-9)


def test_audits_keep_rows_with_missing_features(table):
    families = {r["family"]: r for r in auditors.family_losses(table, table, table, ["x", "z"], "y").collect()}
    assert all(r["retention"] == pytest.approx(1.0) for r in families.values())
    assert auditors.imputed(table, ["x", "z"], auditors.medians(table, ["x", "z"])).count() == table.count()


def test_regimes_depend_on_data_alone(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(-4, 1, 300), rng.normal(4, 0.5, 100)))
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, rng.normal(size=400), strict=True)], "a double, b double")
    one, two = (auditors.regimes(spark, d, ["a", "b"], 2).collect() for d in (rows.repartition(7), rows.coalesce(1)))
    assert [r["weight"] for r in one] == pytest.approx([0.75, 0.25], abs=0.02) and one[0]["mean"][0] == pytest.approx(-4, abs=0.2)
    assert [r["mean"] for r in one] == [pytest.approx(r["mean"], abs=1e-9) for r in two]
    assert auditors.regimes(spark, rows.filter("false"), ["a", "b"], 2).count() == 0


def test_ratings_of_one_sided_panels_end(spark):
    wins = spark.createDataFrame([("a", "b", 5000, 5000.0), ("b", "c", 5000, 5000.0), ("a", "c", 5000, 5000.0)], "a string, b string, games long, wins_a double")
    rows = {r["method"]: r["rating"] for r in reducers.elo(spark, wins).collect()}
    assert rows["a"] > rows["b"] > rows["c"] and all(math.isfinite(v) for v in rows.values())


def test_importance_and_tree_of_a_planted_table(spark, table):
    weights = models.ridge(table.fillna(0.0), {"x": F.col("x"), "z": F.col("z")}, F.col("y"))
    found = {r["column"]: r["importance"] for r in models.permutation_importance(table.fillna(0.0), "k", weights, ["x", "z"], F.col("y")).collect()}
    assert found["x"] > found["z"] > 0
    edges = {(r["parent"], r["child"]) for r in models.chow_liu(table, ["x", "y", "z"], spark).collect()}
    assert ("x", "y") in edges and ("y", "z") in edges


def test_geometry_by_plain_loops():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(20, 3)), rng.normal(size=(25, 3)) + 0.5
    d = lambda x, y: [[math.dist(p, q) for q in y] for p in x]
    assert privacy.energy_distance(a, b) == pytest.approx(2 * np.mean(d(a, b)) - np.mean(d(a, a)) - np.mean(d(b, b)), abs=1e-6)
    radius = [sorted(r)[5] for r in d(a, a)]
    assert privacy.prdc(a, b)["precision"] == pytest.approx(np.mean([any(math.dist(p, q) <= r for p, r in zip(a, radius, strict=True)) for q in b]))
    assert privacy.prdc(a, a)["recall"] == 1.0 and privacy.kernel_discrepancy(a, a) == pytest.approx(0.0, abs=1e-9)
    assert abs(privacy.unbiased_discrepancy(a, rng.normal(size=(400, 3)), 1.0)) < 0.05 and privacy.sliced_distance(a, a) == 0.0


def test_geometry_of_few_rows_is_null(spark):
    rows = spark.createDataFrame([(1, 0.0)], "k long, x double")
    assert privacy.geometry(spark, rows, rows, "k", ["x"]).first()["mmd"] is None


def test_lineage_split_by_a_plain_loop(spark):
    groups = [("s" if k % 2 else "t", k, float(100 - k)) for k in range(30)]
    got = {(r["stratum"], r["family"]): r["split"] for r in corpus.lineage_split(spark.createDataFrame(groups, "stratum string, family long, weight double"), "stratum", "family", "weight").collect()}
    assert len(got) == 30
    for s in "st":
        own = {n: sum(w for t, k, w in groups if t == s and got[t, k] == n) for n in ("train", "validation", "test")}
        total = sum(own.values())
        assert abs(own["train"] / total - 0.7) < 0.08 and min(own.values()) > 0.08 * total
        heaviest = max((g for g in groups if g[0] == s), key=lambda g: g[2])
        assert got[s, heaviest[1]] == "train"


def test_fingerprints_of_nulls_and_orders(spark):
    def of(rows, names):
        return corpus.content_fingerprint(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), names).first()["fingerprint"]

    one = of([("a", None, "b"), ("x", "y", "z")], ["p", "q", "r"])
    assert one == of([("z", "x", "y"), ("b", "a", None)], ["r", "p", "q"]) != of([("a", "b", None), ("x", "y", "z")], ["p", "q", "r"])


def test_intervals_and_student_bounds():
    assert normal.student_lower(0.05, 5) == pytest.approx(2.015048, abs=1e-4) and normal.student_lower(0.05, 10_000) == pytest.approx(1.645, abs=1e-3)


def test_sign_test_is_exact(spark):
    rows = spark.createDataFrame([(0, 0), (5, 0), (3, 4), (10, 2)], "w long, l long")
    got = {(r["w"], r["l"]): r["p"] for r in rows.withColumn("p", ledger.sign_test(F.col("w"), F.col("l"))).collect()}
    for (w, m), p in got.items():
        n = w + m
        assert p == pytest.approx(1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(w, m) + 1)) / 2**n))


def test_noise_of_few_rows_is_the_deviation(spark):
    rows = spark.createDataFrame([(0.1, 1.0), (-0.1, 2.0)], "r double, x double")
    found = boosting.noise_scale(rows, "r", ["x"])
    assert found["coefficients"][1] == 0.0 and math.exp(found["coefficients"][0]) == pytest.approx(0.1)
    assert pd.Series(found["knots"]).is_monotonic_increasing


def test_class_programs_learn_sample_and_retain(spark):
    from loomtab.operators import classes

    rng = np.random.default_rng(3)
    x, c = rng.normal(size=3000), rng.choice(["u", "v"], 3000)
    y = np.where(x + (c == "u") + 0.5 * rng.normal(size=3000) > 1, "hi", np.where(x < -0.5, "lo", "mid"))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "x": x, "c": c, "y": y}))
    fitted = classes.fit(df, "y", ["x"], ["c"])
    assert fitted.labels == ["hi", "lo", "mid"]
    scored = classes.predict(df, fitted).toPandas()
    p = np.array(scored["probabilities"].tolist())
    assert np.allclose(p.sum(1), 1) and (np.array(fitted.labels)[p.argmax(1)] == scored["y"]).mean() > 0.75
    made = classes.sample(spark, fitted, 3000).toPandas()
    assert all(abs((made["y"] == k).mean() - (y == k).mean()) < 0.05 for k in fitted.labels)
    found = classes.class_retention(spark, df, "id", "y", ["x"], ["c"], rows=3000).first()
    assert found["real_loss"] < 0.8 * found["null_loss"] and found["retention"] > 0.85
    assert classes.fit(df.filter("false"), "y", ["x"], ["c"]).labels == []


def test_packed_and_raw_tables_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(k % 2, k, k % 2, 0.25 * (k % 3), 0.1 * k) for k in range(20)], "task int, id long, bit int, level double, x double")
    files.write_packed(rows, str(tmp_path / "packed"), "task", "id")
    back = files.read_packed(spark, str(tmp_path / "packed")).select(rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    units = spark.createDataFrame([(0.5, 1.0, None), (0.25, 0.0, 1.0)], "a double, c double, n double")
    raw = files.raw_output(units, {"a": (0.0, 10.0, False, False), "n": (0.0, math.log1p(99), True, True)}, {"c": ["x", "y"]})
    assert [tuple(r) for r in raw.collect()] == [("5", "y", None), ("2.5", "x", "99")]
