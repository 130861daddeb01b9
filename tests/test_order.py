"""Indexes, totals, ranks and quantiles over the whole table against plain versions, on skewed and odd rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from gridspark.operators import estimators, order, temporal


def test_index_and_totals(spark):
    rng = np.random.default_rng(3)
    values = [int(v) for v in rng.permutation(5000)]
    df = spark.createDataFrame([(v, float(v % 7)) for v in values], "v int, w double").repartition(7)
    got = {r["v"]: r for r in order.with_index(df, ["v"], "k").collect()}
    assert all(got[v]["k"] == v for v in values)
    totals = {r["v"]: (r["a"], r["b"]) for r in order.running_totals(df, ["v"], {"a": F.col("w"), "b": F.lit(1)}).collect()}
    assert all(totals[v] == (pytest.approx(sum(x % 7 for x in range(v))), v) for v in range(0, 5000, 97))
    none = df.limit(0)
    assert order.with_index(none, ["v"], "k").count() == 0 and order.running_totals(none, ["v"], {"a": F.col("w")}).count() == 0
    ties = order.with_index(spark.createDataFrame([(None,), (1,), (1,), (None,)], "v int"), ["v"], "k").orderBy("k").collect()
    assert [(r["v"], r["k"]) for r in ties] == [(None, 0), (None, 1), (1, 2), (1, 3)]


def test_percent_ranks(spark):
    df = spark.createDataFrame([(1, 5.0, True), (2, 5.0, True), (3, 1.0, True), (4, None, True), (5, 9.0, False), (6, 7.0, True)], "k int, v double, ok boolean")
    got = {r["k"]: r["p"] for r in order.percent_ranks(df, "v", "p", F.col("ok")).collect()}
    assert got == {1: 2.5 / 4, 2: 2.5 / 4, 3: 0.25, 4: None, 5: None, 6: 1.0}
    plan = order.percent_ranks(df, "v", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert all("__part" in line for line in plan.splitlines() if "Window [" in line)


def test_quantiles_of_one_group_with_all_rows(spark):
    """All of lineitem in one group, and skewed groups beside it, as SQL gives them."""
    li = spark.read.parquet(f"{DATA}/sf0.01/lineitem.parquet").select(F.lit(1).alias("one"), "l_returnflag", "l_quantity", "l_extendedprice")
    names = {"q05": ("l_extendedprice", 0.05), "mid": ("l_extendedprice", 0.5), "q99": ("l_extendedprice", 0.99), "quantity": ("l_quantity", 0.25)}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT 1 AS one, * FROM '{DATA}/sf0.01/lineitem.parquet'")
    for group in (["one"], ["one", "l_returnflag"]):
        key = ", ".join(group)
        want = con.sql(f"SELECT {key}, quantile_cont(l_extendedprice, 0.05), median(l_extendedprice), quantile_cont(l_extendedprice, 0.99), quantile_cont(l_quantity, 0.25) FROM lineitem GROUP BY {key}").fetchall()
        out = order.quantiles(li, group, names)
        rounded = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
        assert rounded(tuple(r[c] for c in (*group, *names)) for r in out.collect()) == rounded(want)


def test_quantiles_of_odd_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 2.0), (None, 4.0)] + [("hot", 7.0)] * 500 + [("hot", 8.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in order.quantiles(df, ["g"], {"m": ("v", 0.5)}).collect()}
    assert got == {"a": 1.0, "b": None, None: 3.0, "hot": 7.0}
    assert order.quantiles(df.limit(0), ["g"], {"m": ("v", 0.5)}).count() == 0


def test_event_index_of_long_calendars(spark, monkeypatch):
    df = spark.createDataFrame([(2024, k % 40) for k in range(200)], "season int, round int")
    short = {tuple(r) for r in temporal.event_index(df, ["season", "round"]).collect()}
    monkeypatch.setattr(temporal, "CALENDAR", 10)
    long = temporal.event_index(df, ["season", "round"])
    assert {tuple(r) for r in long.collect()} == short == {(2024, k, float(k)) for k in range(40)} and "Window" not in long._jdf.queryExecution().toString()


def test_backfit_plan_does_not_grow(spark):
    rows = [(f"t{k % 3}", f"d{k % 7}", float(k % 5), float(k // 9)) for k in range(90)]
    df = spark.createDataFrame(rows, "team string, driver string, y double, i double")
    size = lambda n: len(estimators.backfit(df, "team", "driver", "y", "i", 20.0, passes=n)._jdf.queryExecution().optimizedPlan().toString())
    assert size(6) < 1.2 * size(2)
