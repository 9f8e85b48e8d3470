"""Dependence, budgets, additive and isotonic models, boosted classes, marginals and lineage against planted structure and plain versions."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtab.operators import additive, compiled, corpus, gradient, isotonic, ledger, marginals, models, splits
from loomtab.operators import dependence as dep
from loomtab.session import staged


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns)).replace(float("nan"), None)


# --- Dependence.


@pytest.mark.parametrize("family", ["gaussian", "frank", "clayton", "clayton90", "clayton180", "clayton270"])
def test_pair_copulas_agree_with_themselves(family):
    rng = np.random.default_rng(0)
    u, v = rng.uniform(0.02, 0.98, (2, 2000))
    for t in [t for f, t in dep.pair_candidates() if f == family][::4]:
        h = dep.conditional(family, t, u, v)
        inside = (h > 1e-4) & (h < 1 - 1e-4)
        assert np.abs(dep.conditional_inverse(family, t, h, v) - u)[inside].max() < 2e-4
        slope = (dep.conditional(family, t, u + 1e-5, v) - dep.conditional(family, t, u - 1e-5, v)) / 2e-5
        density = np.exp(dep.pair_log(family, t, u, v))
        assert np.quantile(np.abs(slope - density)[inside] / (0.05 + density[inside]), 0.98) < 0.03


def test_sums_of_all_pair_copulas_are_those_of_each():
    u, v = np.random.default_rng(12).uniform(0.01, 0.99, (2, 500))
    every = dep.pair_candidates()
    assert np.allclose(dep.pair_totals(every, u, v), [dep.pair_log(f, t, u, v).sum() for f, t in every])


VINE = dep.Vine(4, [2, 0, 1, 3], [[("clayton", 3.2), ("gaussian", 0.6), ("clayton90", 2.2)], [("gaussian", -0.4), ("frank", 4.0)]])
MIXTURE = dep.Mixture(3, [0.5, 0.5], [[-1.2, -1.2, 1.2], [1.2, 1.2, -1.2]], [[0.4, 0.4, 0.4]] * 2, {"kind": "independent", "d": 3})


def test_a_vines_draws_have_its_density():
    z = VINE.draw(np.random.default_rng(1).normal(size=(100_000, 4)))
    assert np.abs(z.mean(0)).max() < 0.02 and np.abs(z.std(0) - 1).max() < 0.02
    copula = VINE.log_density(z) + (z * z + dep.LOG_2PI).sum(1) / 2
    assert abs(np.exp(-copula).mean() - 1) < 0.05
    assert VINE.log_density(z).mean() > dep.fit_full(np.corrcoef(z.T)).log_density(z).mean() + 0.1


@pytest.mark.parametrize(("planted", "wanted"), [(VINE, "vine"), (MIXTURE, "mixture2")])
def test_planted_dependence_wins_on_held_out_rows_and_in_draws(spark, planted, wanted):
    rng = np.random.default_rng(2)
    z = planted.draw(rng.normal(size=(6000, planted.width())))
    names = [f"z{k}" for k in range(z.shape[1])]
    df = staged(frame(spark, **{n: z[:, k] for k, n in enumerate(names)}, held=np.arange(6000) % 5 == 0), "planted")
    ranking, found = dep.ranked(df, names, "held")
    # More regimes may describe a mixture as well; no model of one matrix does.
    assert ranking[0][0].startswith(wanted[:4]) and dict(ranking)[wanted] > max(dict(ranking)[n] for n in ("independent", "tree", "full", "factor1")) + 0.05
    drawn = found[wanted].draw(rng.normal(size=(20_000, found[wanted].width())))
    assert np.abs(np.corrcoef(drawn.T) - np.corrcoef(z.T)).max() < 0.08
    assert dep.from_dict(json.loads(json.dumps(dep.asdict(found[wanted])))) == found[wanted]


def test_gaussian_candidates_keep_their_correlations():
    r = np.array([[1.0, 0.8, 0.4], [0.8, 1.0, 0.5], [0.4, 0.5, 1.0]])
    assert np.allclose(dep.fit_full(r).matrix(), r) and np.allclose(dep.fit_tree(r).matrix()[[0, 1], [1, 2]], [0.8, 0.5]) and abs(dep.fit_tree(r).matrix()[0, 2] - 0.4) < 1e-9
    flat = np.eye(2)
    assert dep.fit_tree(flat).parents == [] and np.allclose(dep.fit_factor(flat, 1).matrix(), flat, atol=1e-6)
    assert set(dep.candidates(None, [], np.eye(0))) == {"independent"}


# --- Budgets.


def mixed(spark, classes, n=1500):
    rng = np.random.default_rng(0)
    x1 = rng.normal(size=n)
    x2 = 0.6 * x1 + 0.8 * rng.normal(size=n)
    colour, visits = rng.choice(["red", "green", "blue"], n), np.round(np.exp(rng.normal(1, 0.6, n)))
    signal = np.sin(1.5 * x1) + 0.5 * x2**2 + np.select([colour == "red", colour == "green"], [0.8, -0.5]) + 0.1 * visits
    y = signal + (0.5 if classes else 0.3) * rng.normal(size=n)
    return frame(spark, x1=x1, x2=np.where(rng.random(n) < 0.05, np.nan, x2), visits=visits, colour=colour, y=np.where(y > np.median(y), "yes", "no") if classes else y), ["x1", "x2", "visits"], ["colour"]


def modular(spark, classes):
    k = np.arange(150)
    a, b, c = (k * 7 % 50) / 49, (k * 11 % 50) / 49, (k * 13 % 50) / 49
    return frame(spark, a=a, b=b, c=c, y=np.array([f"c{i % 3}" for i in k]) if classes else a + b * c), ["a", "b", "c"], []


BUDGETS = [300, 700, 1500, 4096]


@pytest.mark.parametrize(("table", "classes"), [(mixed, False), (mixed, True), (modular, False), (modular, True)])
def test_no_program_exceeds_its_budget_and_retention_never_falls(spark, table, classes, monkeypatch):
    made, main = [], []
    once = compiled.Parts.once

    def counted(self, key, make):
        if not main:
            main.append(self)
        if self is main[0] and key not in self.made:
            made.append(str(key))
        return once(self, key, make)

    monkeypatch.setattr(compiled.Parts, "once", counted)
    df, numbers, categories = table(spark, classes)
    found = compiled.fit_levels(df, "y", numbers, categories, BUDGETS, classes)
    assert [b for b, _, _ in found] == BUDGETS and found[-1][1] is not None
    assert len(made) == len(set(made))  # each component once, whatever the number of budgets
    retained = [r for _, p, r in found if p is not None and r is not None]
    assert all(b >= a - 1e-9 for a, b in zip(retained, retained[1:], strict=False))
    for budget, program, _ in found:
        assert program is None or len(program.encode()) <= budget
    if table is mixed:
        assert retained[-1] > 0.8
    program = found[-1][1]
    again = compiled.Compiled.decode(program.encode())
    assert again.encode() == program.encode()
    rows = sorted(map(str, compiled.sample(spark, again, 300, 3).collect()))
    assert rows == sorted(map(str, compiled.sample(spark, again, 300, 3).repartition(5).collect())) != sorted(map(str, compiled.sample(spark, again, 300, 4).collect()))
    predicted = compiled.predict(df, again).collect()
    if classes:
        assert all(abs(sum(r["prediction"]) - 1) < 1e-9 for r in predicted)
        if table is mixed:
            assert np.mean([again.labels[int(np.argmax(r["prediction"]))] == r["y"] for r in predicted]) > 0.8
    else:
        y, p = np.array([[r["y"], r["prediction"]] for r in predicted]).T
        assert np.mean((y - p) ** 2) < 0.5 * y.var()


def test_parts_lift_a_program(spark):
    df, numbers, categories = mixed(spark, False)
    parts = compiled.Parts(df, "y", numbers, categories)
    losses = parts.losses(4)
    # Trees lower the linear model's loss, which is below the mean's.
    assert min(losses[1:-1]) < 0.6 * losses[0] < 0.6 * losses[-1]
    noise = parts.noise(4, len(losses) - 2)
    assert 0.2 < np.interp(0.84, compiled.normal.cdf(compiled.RESIDUAL_GRID), noise["knots"]) < 2 and noise["lo"] < noise["hi"]


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_trees_from_arrays_are_those_of_aggregations(spark, monkeypatch, classes):
    rng = np.random.default_rng(5)
    c = rng.integers(0, 256, (900, 3))
    y = (c[:, 0] > 90).astype(float) + (c[:, 1] > 200) if classes != 2 else (c[:, 0] + c[:, 2] > 250).astype(float)
    y = y + (0.1 * rng.normal(size=900) if not classes else 0.0)
    df = staged(frame(spark, a=c[:, 0], b=c[:, 1], c=c[:, 2], y=y), "coded")
    monkeypatch.setattr(gradient, "MOST_CELLS", 1)
    start = [F.col("a") / 1000] * max(1, classes * (classes > 2))
    want = gradient.boost_many(df, ["a", "b", "c"], "y", [None, start], classes, 4)
    got = gradient.boost_arrays(lambda make, size: make(c, y), ["a", "b", "c"], lambda z: z, [None, lambda z: np.tile(z[:, :1] / 1000, len(start))], classes, 4)
    for a, b in zip(want, got, strict=True):
        assert (a.features, a.thresholds) == (b.features, b.thresholds) and np.allclose(a.leaves, b.leaves) and np.allclose(a.base, b.base)


def test_an_audit_of_generated_rows_is_one_pass(spark):
    df, numbers, categories = mixed(spark, False)
    parts = compiled.Parts(df, "y", numbers, categories)
    programs = [parts.finished(len(parts.z), t, 2, "independent") for t in (1, 2)]
    parts.audit(programs[0])
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.jobsList(None).size()
    assert parts.audit(programs[1]) is not None
    # A shuffle is a job of its own; a level of each tree was a pass before.
    assert store.jobsList(None).size() - before <= 3


def test_tables_without_a_signal_or_rows_have_defined_programs(spark):
    df, numbers, categories = mixed(spark, False, 200)
    assert compiled.fit_levels(df.filter("false"), "y", numbers, categories, [500]) == [(500, None, None)]
    flat = compiled.fit_levels(df.withColumn("y", F.lit(2.0)), "y", numbers, categories, [600])[0]
    assert flat[1] is not None and flat[2] is None
    assert {r["y"] for r in compiled.sample(spark, flat[1], 50).collect()} == {2.0}
    alone = compiled.fit_levels(df, "y", [], [], [600])[0]
    assert alone[1] is not None and compiled.sample(spark, alone[1], 20).count() == 20
    with pytest.raises(ValueError, match="fits"):
        compiled.fit(df, "y", numbers, categories, 20)
    with pytest.raises(ValueError, match="classes"):
        compiled.Parts(df.withColumn("y", F.col("x1").cast("string")), "y", [], [], True)


# --- Target models.


def test_additive_models_find_main_effects_and_the_interaction(spark):
    rng = np.random.default_rng(3)
    c = rng.integers(0, 16, (6000, 4))
    y = np.sin(c[:, 0] / 3) + 0.1 * c[:, 1] + ((c[:, 2] > 7) == (c[:, 3] > 7)) + 0.2 * rng.normal(size=6000)
    df = staged(frame(spark, **{f"c{k}": c[:, k] for k in range(4)}, y=y), "coded")
    names = [f"c{k}" for k in range(4)]
    plain = additive.fit(df, names, F.col("y"), 16)
    paired = additive.fit(df, names, F.col("y"), 16, pairs=1)
    error = lambda m: df.agg(F.avg(F.pow(F.col("y") - m.output(), 2))).first()[0]
    assert list(paired.pairs) == [("c2", "c3")] and error(paired) < 0.06 < 0.25 < error(plain)
    assert np.corrcoef(plain.mains["c0"], np.sin(np.arange(16) / 3))[0, 1] > 0.99
    # Backfitting on counts ends where a least-squares fit of indicators does.
    n, s, rows, total = additive.meetings(df, names, F.col("y"), 16)
    base, f = additive.backfitted(n, s, rows, total, penalty=1e-9, cycles=200)
    x = np.column_stack([np.ones(len(c)), *((c[:, [j]] == np.arange(16)).astype(float) for j in range(4))])
    fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.abs(base + sum(f[j][c[:, j]] for j in range(4)) - fitted).max() < 1e-4
    empty = additive.fit(df.filter("false"), names, F.col("y"), 16, pairs=1)
    assert empty.base == 0.0 and not empty.pairs


def test_hinges_are_found_where_they_are_planted(spark):
    rng = np.random.default_rng(4)
    x, z = rng.integers(0, 40, 3000), rng.integers(0, 10, 3000)
    df = staged(frame(spark, x=x, z=z, w=rng.integers(0, 5, 3000), y=np.abs(x - 13) + 0.5 * z + 0.1 * rng.normal(size=3000)), "hinges")
    model = additive.fit_hinges(df, ["x", "z", "w"], F.col("y"), 1.0, 4)
    assert {t[:2] for t in model.terms} >= {("x", 13.0)} and not any(t[0] == "w" for t in model.terms)
    assert df.agg(F.avg(F.pow(F.col("y") - model.output(), 2))).first()[0] < 0.012
    assert additive.fit_hinges(df.filter("false"), ["x"], F.col("y"), 1.0) == additive.Hinges(0.0)


def test_boosting_of_classes_equals_a_plain_tree_and_stops(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 256, (2, 3000))
    y = np.where(a > 180, 2, np.where(b > 100, 1, 0))
    df = staged(frame(spark, a=a, b=b, y=y, held=np.arange(3000) % 4 == 0), "classes")
    trees = gradient.boost(df, ["a", "b"], "y", 3, trees=6, hold=F.col("held"))
    assert set(zip(trees.features, trees.thresholds, strict=True)) >= {("a", 180), ("b", 100)}
    margins = trees.of_codes(np.column_stack([a, b]), ["a", "b"])
    assert (np.argmax(margins, 1) == y).all()
    spark_margins = df.select(*(m.alias(f"m{k}") for k, m in enumerate(trees.margins()))).collect()
    assert np.allclose(sorted(map(tuple, spark_margins)), sorted(map(tuple, margins)))
    # One step by hand.
    first = gradient.boost(df, ["a", "b"], "y", 3, trees=1)
    p = np.bincount(y) / len(y)
    leaf = sum((np.array({"a": a, "b": b}[f]) > t).astype(int) << k for k, (f, t) in enumerate(zip(first.features, first.thresholds, strict=True)))
    for q in range(4):
        g, h = p - np.bincount(y[leaf == q], minlength=3) / max((leaf == q).sum(), 1), p * (1 - p)
        n = (leaf == q).sum()
        assert np.allclose(first.leaves[0][q], -0.3 * g * n / (h * n + 1))
    noise = staged(frame(spark, a=a, b=b, y=rng.integers(0, 2, 3000), held=np.arange(3000) % 4 == 0), "noise")
    assert len(gradient.boost(noise, ["a", "b"], "y", 2, trees=10, hold=F.col("held"), patience=2).leaves) < 10
    assert gradient.boost(df.filter("false"), ["a", "b"], "y").leaves == []


def test_out_of_fold_residuals_come_from_the_other_folds(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=400)
    y, fold = 2 * x + rng.normal(size=400), np.arange(400) % 3
    df = frame(spark, k=np.arange(400), x=np.where(np.arange(400) == 7, np.nan, x), y=y, fold=fold)
    got = {r["k"]: r["residual"] for r in models.out_of_fold(df, {"x": F.col("x")}, F.col("y"), F.col("fold"), 3).collect()}
    for q in range(3):
        use = (fold != q) & (np.arange(400) != 7)
        slope, start = np.polyfit(x[use], y[use], 1)
        for k in np.flatnonzero(fold == q):
            assert got[k] is None if k == 7 else abs(got[k] - (y[k] - start - slope * x[k])) < 1e-4


# --- Isotonic regression.


def plain_blocks(x, y, w):
    points = {}
    for a, b, c in sorted(zip(x, y, w, strict=True)):
        own = points.setdefault(a, [0.0, 0.0])
        own[0], own[1] = own[0] + c, own[1] + c * b
    return isotonic.pooled(pd.DataFrame([(a, a, *ws) for a, ws in points.items()], columns=["lo", "hi", "w", "s"]))


@pytest.mark.parametrize("size", [9, 50_000])
@pytest.mark.parametrize("shape", ["noise", "falling", "wave"])
def test_isotonic_blocks_are_those_of_a_plain_pass(spark, monkeypatch, size, shape):
    monkeypatch.setattr(isotonic, "GROUP_BLOCKS", size)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 90, 200).astype(float)
    y = {"noise": x + rng.normal(0, 20, 200), "falling": -x, "wave": 5 * np.sin(x / 10) + rng.normal(size=200)}[shape]
    w = rng.random(200) + 0.1
    df = frame(spark, x=x, y=y, w=w)
    want = plain_blocks(x, y, w)
    blocks = staged(isotonic.isotonic(df.union(spark.createDataFrame([(None, 1.0, 1.0), (3.0, None, 1.0), (3.0, 1.0, 0.0)], df.schema)), F.col("x"), F.col("y"), F.col("w")), "blocks")
    got = blocks.orderBy("lo").toPandas()
    assert got["lo"].tolist() == want["lo"].tolist() and np.allclose(got["mean"], want["s"] / want["w"]) and np.allclose(got["weight"], want["w"])
    found = isotonic.looked_up(df.select("x"), F.col("x") - 2.5, blocks, "v").collect()
    at, means = np.array(want["lo"]), np.array(want["s"] / want["w"])
    assert len(found) == 200 and all(abs(r["v"] - means[max(np.searchsorted(at, r["x"] - 2.5, "right") - 1, 0)]) < 1e-9 for r in found)


def test_isotonic_noise_rises_and_empty_tables_have_no_blocks(spark):
    rng = np.random.default_rng(8)
    s = rng.uniform(0, 4, 4000)
    df = frame(spark, s=s, r=rng.normal(size=4000) * (0.5 + s))
    got = isotonic.isotonic_noise(df, F.col("s"), F.col("r")).orderBy("lo").toPandas()
    sigma = np.interp([0.5, 2.0, 3.5], got["lo"], got["mean"])
    assert np.abs(sigma - [1.0, 2.5, 4.0]).max() < 0.5 and (np.diff(got["mean"]) >= 0).all()
    empty = isotonic.isotonic(df.filter("false"), F.col("s"), F.col("r"))
    assert empty.count() == 0 and isotonic.looked_up(df.limit(2), F.col("s"), empty, "v").collect()[0]["v"] is None


# --- Evidence, marginals, corpora.


def test_paired_interval_covers_a_difference_and_none(spark):
    rng = np.random.default_rng(9)
    n = 3000
    df = frame(spark, k=np.arange(n) % 97, null=np.full(n, 1.0), real=np.full(n, 0.2), a=0.3 + 0.1 * rng.random(n), b=0.4 + 0.1 * rng.random(n))
    better = ledger.paired_interval(df, F.col("k"), "null", "real", "a", "b", 500).first()
    assert 0.11 < better["lower"] < better["difference"] < better["upper"] < 0.14 and better["wins"] == 1.0
    same = ledger.paired_interval(df, F.col("k"), "null", "real", "a", "a", 200).first()
    assert same["lower"] == same["upper"] == same["difference"] == 0.0 and same["wins"] == 0.5
    assert ledger.paired_interval(df, F.col("k"), "real", "null", "a", "b", 50).first()["difference"] is None


def test_marginals_are_told_apart_and_drawn_back(spark):
    rng = np.random.default_rng(10)
    n = 3000
    made = {
        "beta": rng.beta(2, 5, n), "inflated": np.where(rng.random(n) < 0.2, 0, rng.beta(3, 2, n)), "bernoulli": (rng.random(n) < 0.3) * 1.0, "ordinal": rng.integers(0, 5, n) / 4,
        "quantiles": np.where(rng.random(n) < 0.5, rng.uniform(0, 0.2, n), rng.uniform(0.8, 1, n)), "spike": np.full(n, 0.25),
    }
    df = staged(frame(spark, **made), "unit")
    for kind, values in made.items():
        fitted = marginals.fit_marginal(df, kind)
        assert fitted["kind"] == kind
        u = spark.range(200).select(((F.col("id") + 0.5) / 200).alias("u"))
        drawn = np.array([r["x"] for r in u.select(marginals.value_at(F.col("u"), fitted).alias("x")).collect()])
        assert np.abs(np.quantile(drawn, [0.1, 0.5, 0.9]) - np.quantile(values, [0.1, 0.5, 0.9])).max() < 0.04
    assert marginals.fit_marginal(df.filter("false"), "beta") == {"kind": "spike", "value": 0.5}
    for a, b in ((0.5, 0.5), (2.5, 40.0), (300.0, 2.0)):
        p = spark.range(1, 20).select((F.col("id") / 20).alias("p"))
        back = p.select("p", marginals.beta_cdf(marginals.beta_ppf(F.col("p"), a, b), a, b).alias("q")).collect()
        assert max(abs(r["p"] - r["q"]) for r in back) < 1e-9


def test_near_copies_of_tables_share_a_lineage(spark):
    rng = np.random.default_rng(11)
    base = [rng.normal(k, 1 + k % 3, (200, 2)) for k in range(15)]
    tables = [*base, *(t + rng.normal(0, 0.002, t.shape) for t in base[:10])]
    long = pd.concat([pd.DataFrame(t, columns=["a", "b"]).assign(t=f"t{k:02d}", flat=1.0) for k, t in enumerate(tables)])
    got = {r["t"]: r["lineage"] for r in corpus.table_lineages(spark.createDataFrame(long), "t", ["a", "b", "flat"]).collect()}
    assert got == {f"t{k:02d}": f"t{k - 15 if k >= 15 else k:02d}" for k in range(25)}
    groups = spark.createDataFrame(sorted(set(got.values())), "string").selectExpr("value as lineage", "1.0 as w", "'s' as stratum")
    sides = {r["lineage"]: r["split"] for r in corpus.lineage_split(groups, "stratum", "lineage", "w").collect()}
    assert len(sides) == 15 and set(sides.values()) == {"train", "validation", "test"}


@pytest.mark.parametrize("budget", [0, 200, 5000, 10**9])
def test_byte_prefix_is_the_longest_that_fits(spark, monkeypatch, budget):
    monkeypatch.setattr(splits, "CHUNK_ROWS", 50)
    rows = spark.range(700).selectExpr("id as key", "cast(pmod(xxhash64(id), 1000) as string) as v").union(spark.createDataFrame([(None, "x"), (3, None), (3, None)], "key long, v string"))
    kept = splits.byte_prefix(rows, "key", budget)
    order = rows.withColumn("h", splits.row_hash(rows, "key")).withColumn("t", F.to_json(F.struct("key", "v"), {"ignoreNullFields": "false"})).orderBy("h", "t").collect()
    texts, most = [r["t"] for r in order], 0
    for n in range(len(texts) + 1):
        if sum(splits.packed_size(texts[k : min(k + 50, n)]) for k in range(0, n, 50)) <= budget:
            most = n
    want = sorted((str(r["key"]), str(r["v"])) for r in order[:most])
    assert sorted((str(r["key"]), str(r["v"])) for r in kept.collect()) == want
