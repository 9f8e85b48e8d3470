import numpy as np
import pandas as pd
from statistics import NormalDist

from loomtab.functions import normal
from loomtab.operators import program


def test_normal_matches_the_standard_library():
    d = NormalDist()
    for z in (-2.5, -1.0, 0.0, 0.3, 2.0):
        assert abs(normal.cdf(np.array([z]))[0] - d.cdf(z)) < 1e-6
        assert abs(normal.ppf(np.array([d.cdf(z)]))[0] - z) < 1e-4


def planted(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    c = rng.choice(["red", "green", "blue"], 4000)
    y = 3 * x + np.where(c == "red", 2.0, 0.0) + 0.3 * rng.normal(size=4000)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(4000), "x": np.where(rng.random(4000) < 0.05, np.nan, x), "c": c, "y": y})).replace(float("nan"), None)


def test_samples_do_not_depend_on_partitions(spark):
    fitted = program.fit(planted(spark), "y", ["x"], ["c"])
    a = program.sample(spark, fitted, 1000, 3)
    again = program.Program.decode(fitted.encode())
    spark_rows = sorted(map(str, a.collect()))
    assert spark_rows == sorted(map(str, program.sample(spark, again, 1000, 3).repartition(7).collect()))
    assert spark_rows != sorted(map(str, program.sample(spark, fitted, 1000, 4).collect()))
    assert len(fitted.encode()) < 4096
    assert 0.01 < sum(r["x"] is None for r in a.collect()) / 1000 < 0.1


def test_generated_rows_keep_most_of_the_gain(spark):
    found = program.retention(spark, planted(spark), "id", "y", ["x"], ["c"], rows=4000).first()
    assert found["real_loss"] < 0.2 * found["null_loss"] and found["retention"] > 0.9
