"""The listwise ranker: gradients and one tree against plain versions, and NDCG against boosted trees on relevance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import lambdarank as L
from gridspark.operators import learners
from gridspark.operators.guards import ContractError


def races(spark, n, seed, size=12):
    """Relevance of the first five by a score in which one feature matters within races, another only between them."""
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(n):
        level = 10 * rng.normal()
        a, b = rng.normal(size=size), rng.normal(size=size)
        order = np.argsort(-(a + 0.5 * (b > 0.3) + 0.3 * rng.normal(size=size)))
        y = np.zeros(size)
        y[order[:5]] = [5, 4, 3, 2, 1]
        strong = rng.random() < 0.5
        rows += [(r, i, float(a[i] + level), float(b[i]), float(a[i]), float(y[i] if strong else max(y[i] - 2, 0))) for i in range(size)]
    return spark.createDataFrame(rows, "race int, entry int, x double, b double, a double, relevance double").coalesce(2)


def plain_gradients(rows, top, sigma=1.0):
    out = {}
    for race in {r["race"] for r in rows}:
        its = sorted((r for r in rows if r["race"] == race), key=lambda r: (-r["s"], r["__id"]))
        best = sorted((r["y"] for r in its), reverse=True)
        ideal = sum((2**y - 1) / math.log2(k + 2) for k, y in enumerate(best[:top]))
        d = [1 / math.log2(k + 2) if k < top else 0.0 for k in range(len(its))]
        for r in its:
            out[r["__id"]] = [0.0, 0.0]
        for i in range(len(its)):
            for j in range(len(its)):
                if its[i]["y"] > its[j]["y"] and min(i, j) < top and ideal > 0:
                    p = 1 / (1 + math.exp(sigma * (its[i]["s"] - its[j]["s"])))
                    delta = abs((2 ** its[i]["y"] - 2 ** its[j]["y"]) * (d[i] - d[j])) / ideal
                    for k, sign in ((i, 1), (j, -1)):
                        out[its[k]["__id"]][0] += sign * sigma * p * delta
                        out[its[k]["__id"]][1] += sigma * sigma * p * (1 - p) * delta
    return out


def test_gradients_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 7, float(rng.integers(0, 4)), float(rng.integers(0, 5))) for i in range(90)] + [(90 + i, 99, 1.0, 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "__id long, race int, s double, y double")
    want = plain_gradients([r.asDict() for r in df.collect()], 5)
    for r in L.gradients(df, "race", "s", "y", 5).collect():
        assert (r["g"], r["h"]) == (pytest.approx(want[r["__id"]][0]), pytest.approx(want[r["__id"]][1]))


def plain_tree(x, g, h, edges, config, level=0):
    leaf = config.rate * g.sum() / (h.sum() + config.smooth)
    best = (1e-12, None)
    if level < config.depth:
        for f in range(x.shape[1]):
            for e in edges[f]:
                left = x[:, f] <= e
                if left.sum() >= config.least and (~left).sum() >= config.least:
                    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + config.smooth)
                    best = max(best, (score(left) + score(~left) - g.sum() ** 2 / (h.sum() + config.smooth), (f, e)), key=lambda t: t[0])
    if best[1] is None:
        return leaf
    f, e = best[1]
    left = x[:, f] <= e
    return L.Split(f, e, plain_tree(x[left], g[left], h[left], edges, config, level + 1), plain_tree(x[~left], g[~left], h[~left], edges, config, level + 1))


def same(a, b):
    if isinstance(a, L.Split) and isinstance(b, L.Split):
        return (a.feature, a.edge) == (b.feature, b.edge) and same(a.left, b.left) and same(a.right, b.right)
    return a == pytest.approx(b)


def test_one_tree_against_a_plain_one(spark):
    df = races(spark, 25, 4)
    config = L.RankerConfig(trees=1, depth=3, bins=8)
    fit = L.fit_lambdarank(df, "race", ["x", "b"], config=config)
    rows = [r.asDict() for r in df.withColumn("__id", F.monotonically_increasing_id()).withColumn("s", F.lit(0.0)).withColumnRenamed("relevance", "y").collect()]
    grad = plain_gradients(rows, 5)
    x = np.array([[r["x"], r["b"]] for r in rows])
    g, h = (np.array([grad[r["__id"]][k] for r in rows]) for k in (0, 1))
    edges = L.bin_edges(df.select(F.col("x").alias("__x0"), F.col("b").alias("__x1")), ["x", "b"], 8)
    assert same(fit.trees[0], plain_tree(x, g, h, edges, config)) and isinstance(fit.trees[0], L.Split)
    assert fit.losses[1] < fit.losses[0]


def test_beats_trees_on_relevance(spark):
    """Races of different strength: relevance depends on the race, order within it on a feature alone."""
    train, held = races(spark, 80, 1).cache(), races(spark, 60, 2).cache()
    fit = L.fit_lambdarank(train, "race", ["a", "b", "x"], config=L.RankerConfig(trees=8, depth=2, rate=0.3, bins=16))
    mean = lambda df: L.ndcg(df, "race", "score", "relevance", 5, "entry").agg(F.avg("ndcg")).first()[0]
    listwise = mean(fit.transform(held))
    pointwise = mean(learners.fit_ranker(train, ["a", "b", "x"]).transform(held.select("*")))
    assert listwise > pointwise and fit.losses[-1] < fit.losses[0]


def test_odd_rows(spark):
    schema = "race int, x double, relevance double, score string"
    df = spark.createDataFrame([(1, 1.0, 2.0, "c"), (1, None, 0.0, "c"), (1, float("nan"), 1.0, "c"), (None, 1.0, 1.0, "c"), (2, 1.0, None, "c"), (3, 5.0, 0.0, "c")], schema)
    fit = L.fit_lambdarank(df, "race", ["x"], config=L.RankerConfig(trees=2, depth=1))
    got = fit.transform(df, "made").where("race = 1").orderBy("relevance").collect()
    assert len(got) == 3 and got[2]["made"] >= got[0]["made"]
    none = L.fit_lambdarank(df.limit(0), "race", ["x"], config=L.RankerConfig(trees=1))
    assert none.trees == (0.0,) and none.transform(df).count() == 6
    with pytest.raises(ContractError):
        L.fit_lambdarank(df.withColumn("relevance", F.lit(-1.0)), "race", ["x"])
