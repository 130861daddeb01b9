"""Fitted models on small data whose answer is known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import learners, simulation


@pytest.fixture(scope="module")
def races(spark):
    rng = np.random.default_rng(2)
    rows = []
    for r in range(60):
        s = rng.normal(0, 1, 6)
        order = np.argsort(-(s / 2.0 + rng.gumbel(size=6)))
        for place, d in enumerate(order, 1):
            rows.append((f"r{r}", float(r), int(d), float(s[d]), place, int(place == 1), 1))
    return rows, spark.createDataFrame(rows, "race string, i double, d int, score double, position_order int, winner int, classified int")


def test_rank_calibration(races):
    rows, df = races
    for objective in ("winner", "ranking"):
        fit = learners.fit_rank_calibration(df, "race", "i", 50.0, "score", objective)

        def loss(t):
            out = []
            for r in range(50):
                z = np.array([x[3] for x in sorted((x for x in rows if x[0] == f"r{r}"), key=lambda x: x[4])]) / t
                rest = np.logaddexp.accumulate(z[::-1])[::-1]
                out.append(rest[0] - z[0] if objective == "winner" else np.mean(rest[:-1] - z[:-1]))
            return np.mean(out)

        assert fit.n_races == 50 and fit.last_training_index == 49.0 and all(loss(fit.temperature) <= loss(fit.temperature * f) + 1e-9 for f in (0.98, 1.02))
    assert learners.fit_rank_calibration(df, "race", "i", 5.0, "score").temperature == 1.0
    again = learners.fit_rank_calibration(df.withColumn("score", F.when(F.col("i") >= 50, -F.col("score")).otherwise(F.col("score"))), "race", "i", 50.0, "score")
    assert again == learners.fit_rank_calibration(df, "race", "i", 50.0, "score")


def test_robust_fits(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), 90 + 0.05 * a + 0.002 * a * a + 0.1 * t + 0.01 * rng.normal() + (30 if k % 25 == 0 else 0), t) for k, (a, t) in enumerate((a, float(rng.normal(30, 5))) for a in range(2, 30) for _ in range(8))]
    df = spark.createDataFrame(rows, "age double, time double, temp double")
    got = learners.tyre_degradation(df, "age", "time", "temp")
    assert got["linear_deg"] == pytest.approx(0.05, abs=0.02) and got["quadratic_deg"] == pytest.approx(0.002, abs=0.001) and got["temp_effect"] == pytest.approx(0.1, abs=0.02)
    assert learners.temperature_sensitivity(df.limit(2), "time", "temp") is None and learners.tyre_degradation(df.limit(3), "age", "time")["linear_deg"] is None


def test_practice_pace(spark):
    rng = np.random.default_rng(5)
    pace = {"a": 88.0, "b": 89.0, "c": 90.0, "d": 91.0}
    rows = []
    for d, p in pace.items():
        for k, compound in enumerate(("SOFT", "HARD")):
            for lap in range(8):
                t = p + 0.06 * (lap + 2) + 0.5 * k - 0.3 * lap / 60 + 0.02 * rng.normal()
                rows.append((d, compound, t, lap + 2.0, k + 1.0, 0.0, False, False, 1000 + 600 * k + 90 * lap))
    rows += [("e", "WET", 80.0, 3.0, 1.0, 0.0, False, False, 1000), ("a", "SOFT", 140.0, 4.0, 1.0, 0.0, False, False, 1500)]
    df = spark.createDataFrame(rows, "driver_id string, compound string, lap_duration double, tyre_age double, stint_number double, rainfall double, is_pit_out_lap boolean, interrupted boolean, s long")
    df = df.withColumn("date_start", F.timestamp_seconds("s")).withColumn("observed_at", F.timestamp_seconds(F.col("s") + 90)).drop("s")
    out = learners.corrected_practice_pace(df, F.timestamp_seconds(F.lit(9999))).orderBy(F.col("practice_score").desc()).collect()
    assert [r["driver_id"] for r in out] == ["a", "b", "c", "d"] and all(r["n_laps"] == 16 and r["pace_sd"] >= 0.5 for r in out)
    assert learners.corrected_practice_pace(df.where("driver_id < 'c'"), F.timestamp_seconds(F.lit(9999))).count() == 0
    blended = learners.practice_blend(spark.createDataFrame([("a", 0.0), ("z", 1.0)], "driver_id string, strength double"), spark.createDataFrame([("a", 1.0, 0.75)], "driver_id string, practice_score double, pace_sd double"), ["driver_id"])
    assert {r["driver_id"]: r["blended"] for r in blended.collect()} == {"a": pytest.approx(0.2), "z": 1.0}


def test_classifier_and_ranker(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 2))
    rows = [(float(a), float(b), float(a + 0.3 * rng.normal() > 1), float(5 * (a > 0) + b)) for a, b in x] + [(None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double, relevance double")
    made = learners.fit_classifier(df, ["a", "b"], "y").transform(df.where("a IS NOT NULL"))
    assert made.where("prediction = y").count() > 350
    ranked = learners.fit_ranker(df, ["a", "b"]).transform(df.where("a IS NOT NULL"))
    assert ranked.stat.corr("score", "relevance") > 0.9


def test_winner_only(spark):
    df = spark.createDataFrame([("r", "x", 1.0, 0.5, 0.9), ("r", "y", 2.0, 0.5, 0.8)], "race string, d string, score double, win_probability double, podium_probability double")
    out = {r["d"]: r for r in learners.winner_only(df, ["race"], "d").collect()}
    assert out["y"]["predicted_rank"] == 1 and out["x"]["win_probability_rank"] == out["y"]["win_probability_rank"] == 1 and out["x"]["podium_probability"] is None


def test_noise_fit(spark):
    rows = [(r, e, 1.0 - 0.2 * e, 0.0, 0.05, 0.4) for r in range(3) for e in range(5)]
    entries = spark.createDataFrame(rows, "race int, entry int, s double, sd double, p double, diff double")
    fit = learners.fit_noise(learners.simulator(entries, "race", "entry", "s", "sd", "p", "diff"), entries.where("entry = 0"), "race", "entry", simulation.SimulationSettings(), 300, 7)
    assert fit.n_races == 3 and fit.n_evaluations >= 7 and fit.improvement >= -1e-9 and math.isfinite(fit.loss)
    assert all(low <= getattr(fit.settings, k) <= high for k, (low, high) in learners.NOISE.items())
