"""A journaled table after kills at every step, optional panel tables, the older metrics, and components."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import cli
from gridspark.operators import legacy, panel
from gridspark.operators.components import components
from gridspark.operators.guards import ContractError
from gridspark.sources import paths
from gridspark.sources.journal import JournaledTable

BATCHES = [[(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], [(1, 2, "B"), (3, 1, "d")], [(2, 1, "C"), (2, 2, "e")]]
SCHEMA = "season int, round int, v string"


def taken(spark, path, stops):
    """All batches, with the job killed before the given step of each and started again."""
    for k, rows in enumerate(BATCHES):
        df = spark.createDataFrame(rows, SCHEMA)
        if k in stops:
            assert not JournaledTable(spark, path, ["season", "round"], "season").upsert(f"b{k}", df, stop=stops[k])
        seen = JournaledTable(spark, path, ["season", "round"], "season").read()
        counts = k in stops and stops[k] == "apply"
        if k:
            held = {tuple(r) for r in seen.select("season", "round", "v").collect()}
            want = {(s, r): v for b in BATCHES[: k + counts] for s, r, v in b}
            assert held == {(s, r, v) for (s, r), v in want.items()}
        again = JournaledTable(spark, path, ["season", "round"], "season").upsert(f"b{k}", df)
        assert again == (not counts)
    assert not JournaledTable(spark, path, ["season", "round"], "season").upsert("b1", spark.createDataFrame(BATCHES[1], SCHEMA))
    return sorted(tuple(r) for r in JournaledTable(spark, path, ["season", "round"], "season").read().select("season", "round", "v").collect())


def test_killed_and_repeated_upserts(spark, tmp_path):
    clean = taken(spark, str(tmp_path / "clean"), {})
    assert clean == [(1, 1, "a"), (1, 2, "B"), (2, 1, "C"), (2, 2, "e"), (3, 1, "d")]
    for n, stops in enumerate(({0: "prepare", 1: "note", 2: "apply"}, {0: "apply", 1: "apply", 2: "note"}, {1: "prepare", 2: "prepare"})):
        assert taken(spark, str(tmp_path / f"run{n}"), stops) == clean
    table = JournaledTable(spark, str(tmp_path / "clean"), ["season", "round"], "season")
    assert set(table.batches().values()) == {"done"} and paths.names(spark, f"{tmp_path}/clean/prepared") == []
    with pytest.raises(ContractError):
        table.upsert("twice", spark.createDataFrame([(1, 1, "x"), (1, 1, "y")], SCHEMA))


def test_untouched_partitions_stay(spark, tmp_path):
    table = JournaledTable(spark, str(tmp_path / "t"), ["season", "round"], "season")
    table.upsert("a", spark.createDataFrame(BATCHES[0], SCHEMA))
    before = {p.name for p in (tmp_path / "t/data/season=2").glob("*.parquet")}
    table.upsert("b", spark.createDataFrame(BATCHES[1], SCHEMA))
    assert {p.name for p in (tmp_path / "t/data/season=2").glob("*.parquet")} == before


def test_paths(spark, tmp_path):
    assert cli.confined(spark, f"file://{tmp_path}/a/../b", str(tmp_path)) == f"file:{tmp_path}/b"
    for out in (f"{tmp_path}/../other", f"{tmp_path}x", "/elsewhere"):
        with pytest.raises(ContractError):
            cli.confined(spark, out, str(tmp_path))
    paths.write_text(spark, f"file://{tmp_path}/deep/note.json", "ä")
    assert paths.read_text(spark, f"{tmp_path}/deep/note.json") == "ä" and paths.names(spark, f"{tmp_path}/deep") == ["note.json"]
    assert paths.names(spark, f"{tmp_path}/none") == [] and not paths.exists(spark, f"{tmp_path}/none")


def test_optional_panel_tables(spark, tmp_path):
    folder = f"{tmp_path}/panel"
    with pytest.raises(ContractError, match="lacks results, qualifying, schedule"):
        cli.load_panel(spark, folder)
    spark.createDataFrame([("r1", 2024, 1, "2024-03-01")], "race_id string, season int, round int, date string").write.parquet(f"{folder}/schedule.parquet")
    spark.createDataFrame([("r1", "d1", 1, 1, 58, 5_400_000.0, 90.0), ("r1", "d2", 2, 1, 58, 5_427_000.0, 91.0), ("r1", "d3", 3, 1, 57, None, 93.0)], "race_id string, driver_id string, position_order int, classified int, laps int, total_ms double, fastest_lap_s double").write.parquet(f"{folder}/results.parquet")
    spark.createDataFrame([("r1", "d1", 0.0)], "race_id string, driver_id string, qual_gap_pct double").write.parquet(f"{folder}/qualifying.parquet")
    plain = cli.load_panel(spark, folder)
    assert plain.standings is None and plain.passes is None
    spark.createDataFrame([(2023, 22, "d1", 1)], "season int, after_round int, driver_id string, championship_position int").write.parquet(f"{folder}/standings.parquet")
    spark.createDataFrame([("r1", "c")], "race_id string, circuit_id string").write.parquet(f"{folder}/overtakes.parquet")
    held = cli.load_panel(spark, folder, "pace")
    assert held.standings.count() == 1 and held.passes.count() == 1
    timed = {r["driver_id"]: r["score"] for r in held.observations.where("kind = 'race'").collect()}
    assert set(timed) == {"d1", "d2", "d3"} and timed["d1"] > timed["d2"] > timed["d3"] and timed["d1"] - timed["d2"] == pytest.approx(0.5 / 0.75)
    with pytest.raises(ContractError):
        panel.observations(plain.results, plain.qualifying, "luck")
    spark.createDataFrame([("r9", "c")], "race_id string, circuit_id string").write.mode("overwrite").parquet(f"{folder}/overtakes.parquet")
    with pytest.raises(ContractError):
        cli.load_panel(spark, folder)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(70)] + [(f"p{k}", f"p{k + 1}") for k in range(40)] + [("hub", f"q{k}") for k in range(60)] + [(None, "x"), ("y", None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    want = {x: find(x) for x in root}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_older_metrics(spark):
    rows = [("a", "x", 3.0, 1.0, 2.0, 1, 1.0), ("a", "y", 2.0, 2.0, 1.0, 0, 2.0), ("a", "z", 2.0, None, 0.0, 0, None), ("b", "x", 1.0, 1.0, 2.0, 1, 9.0), ("b", "y", 2.0, 2.0, 1.0, 1, 1.0), ("c", "x", 5.0, 1.0, 0.0, 1, 1.0)]
    df = spark.createDataFrame(rows, "race string, k string, s double, finish_position double, relevance double, winner int, t double")
    got = {r["race"]: r for r in legacy.ranking_by_race(df, "race", "s", "k").collect()}
    assert (got["a"]["top1"], got["a"]["spearman"], got["a"]["rank_mae"]) == (1.0, pytest.approx(1), 0.0)
    tie = 0.5 * (1 / np.log2(3) + 1 / 2)
    assert got["a"]["ndcg5"] == pytest.approx((2 + tie) / (2 + 1 / np.log2(3)))
    assert got["b"]["top1"] is None and got["b"]["spearman"] == pytest.approx(-1) and got["c"]["spearman"] is None and got["c"]["ndcg5"] == 0.0
    out = legacy.ranking_metrics(legacy.ranking_by_race(df, "race", "s", "k")).first()
    assert (out["n_races"], out["top1"]) == (3, 1.0)
    with pytest.raises(ContractError):
        legacy.ranking_metrics(legacy.ranking_by_race(df, "race", "s", "k"), strict=True)
    deltas = {r["race"]: r["delta"] for r in legacy.top1_deltas(df, "race", "s", "t", "k").collect()}
    assert deltas == {"a": -1.0, "b": 0.0, "c": 0.0}
    boot = legacy.top1_bootstrap(df, "race", "s", "t", "k", draws=200).first()
    assert boot["n_races"] == 3 and boot["ci_low"] <= boot["delta"] <= boot["ci_high"] and boot["delta"] == pytest.approx(-1 / 3)
    holdout = df.where("race <> 'b'").withColumn("grid_effective", F.when(F.col("k") == "x", "1").otherwise("bad"))
    table = legacy.with_grid_baseline(holdout, spark.createDataFrame([("f", 0.5, 9)], "feature_set string, top1 double, other int"), "race", "k").collect()
    assert [(r["feature_set"], r["top1"]) for r in table] == [("GRID_BASELINE_RECOMPUTED", 1.0), ("f", 0.5)]
