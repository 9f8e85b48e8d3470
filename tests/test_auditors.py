from loomtab.operators import auditors


def test_two_sample_classifier_tells_a_shift_from_none(spark):
    rows = spark.range(2000).selectExpr("id", "cast(pmod(xxhash64(id), 1000) as double) / 1000 as x")
    a, b = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    assert abs(auditors.c2st(a, b, ["x"]) - 0.5) < 0.1
    assert auditors.c2st(a, b.selectExpr("x + 1 as x"), ["x"]) > 0.95


def test_frontier_marks_the_first_budget_that_reaches_the_level(spark):
    df = spark.range(600).selectExpr("id", "cast(pmod(xxhash64(id), 100) as double) as x", "cast(id % 3 as string) as c").selectExpr("*", "3 * x + cast(c as double) as y")
    rows = auditors.frontier(spark, df, "id", "y", ["x"], ["c"], [64, 4096]).orderBy("budget").collect()
    assert rows[0]["program_bytes"] is None and not rows[0]["is_first"]
    assert rows[1]["retention"] > 0.9 and rows[1]["is_first"]
