"""The catalogue's queries against their SQL, at the smallest size."""

import glob
import math
import os

import duckdb
import pytest

from loomtab.plans import catalogue, evidence, measures, model_queries, preparation, privacy_queries, structure_queries  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(([r[k] for k in at] for r in rows), key=lambda r: [str(round(x, 3)) if isinstance(x, float) else str(x) for x in r])


def same(x, y):
    if isinstance(x, (int, float)) and isinstance(y, (int, float)):
        return math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4)
    return str(x) == str(y)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain([tuple(r) for r in got.collect()], got.columns), plain(want.fetchall(), want.columns)
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_elo_prefers_the_winner(spark):
    from loomtab.operators import reducers

    wins = spark.createDataFrame([("a", "b", 10, 9.0), ("a", "c", 10, 8.0), ("b", "c", 10, 5.0)], "a string, b string, games long, wins_a double")
    rows = {r["method"]: r["rating"] for r in reducers.elo(spark, wins).collect()}
    assert rows["a"] > rows["c"] and rows["a"] > rows["b"]


def test_event_windows_run_on_a_stream(spark, tmp_path):
    from loomtab.streaming import windows

    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    source = windows.stream(spark, str(tmp_path / "in"), events.schema)
    running = windows.tumbling(source, "1 day", "30 days").writeStream.format("memory").queryName("days").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    streamed = {(r["event_type"], r["day"], r["n"]) for r in spark.table("days").collect()}
    assert streamed == {(r["event_type"], r["day"], r["n"]) for r in windows.tumbling(events, "1 day").collect()}
