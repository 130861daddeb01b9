"""Decayed sums of cells by stretches of events against every row beside every later target."""

import pytest
from pyspark.sql import functions as F

from gridspark.operators import forecast


def test_cells_against_all_rows(spark):
    rows = [(i, ("a", "b")[k % 2], f"d{k % 5}", ("R1", "R2", None)[i // 60 % 3], float((i * 7 + k) % 11) if k else None, 0.8 if k % 3 else 1.0) for i in range(0, 300, 2) for k in range(6)]
    df = spark.createDataFrame(rows, "i int, team string, driver string, regime string, y double, __share double")
    targets = spark.createDataFrame([(t, float(t), "R1" if t < 100 else "R2") for t in (0, 1, 37, 130, 131, 299, 400, 900)], "target int, target_index double, target_regime string")
    hl, cross = 6.0, 0.35
    want = {}
    for t, at, regime in [tuple(r) for r in targets.collect()]:
        for i, team, driver, r, y, share in rows:
            w = 0.5 ** ((at - i) / hl) * (1.0 if r == regime else cross)
            if i < at and w > 1e-6:
                held = want.setdefault((t, team, driver), [0.0, 0.0])
                held[0] += w * share
                held[1] += w * share * (y or 0.0)
    out = forecast.decayed_cells(df, targets, ["team", "driver"], "i", hl, "regime", cross, {"wy": F.col("__share") * F.col("y")}, F.col("__share"))
    got = {(r["target"], r["team"], r["driver"]): [r["w"], r["wy"]] for r in out.collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == [pytest.approx(v[0], rel=1e-9), pytest.approx(v[1], rel=1e-9)]
    assert forecast.decayed_cells(df.limit(0), targets, ["team"], "i", hl, "regime", cross, {"wy": F.col("y")}).count() == 0


def test_rows_follow_cells_not_rows(spark):
    """A hundred times the rows of a cell's event give no more rows beside targets."""
    one = spark.createDataFrame([(i, "a", "d", "R", 1.0) for i in range(50)], "i int, team string, driver string, regime string, y double")
    targets = spark.range(50).select(F.col("id").alias("target"), F.col("id").cast("double").alias("target_index"), F.lit("R").alias("target_regime"))
    many = one.join(spark.range(100).withColumnRenamed("id", "copy"))
    made = lambda df: forecast.decayed_cells(df, targets, ["team", "driver"], "i", 6.0, "regime", 0.35, {"wy": F.col("y")})
    a, b = ({r["target"]: r["wy"] for r in made(df).collect()} for df in (one, many))
    assert all(b[t] == pytest.approx(100 * a[t]) for t in a) and len(a) == len(b) == 49
