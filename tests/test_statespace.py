"""The pace filter against the batch posterior, its variance fit, and the correlated ranking sampler."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.operators import guards, statespace

V = statespace.Variances(1.0, 0.4, 0.05, 0.002, 0.2, 0.3)


@pytest.fixture(scope="module")
def sessions(spark):
    rng = np.random.default_rng(6)
    team, driver = rng.normal(0, 1, 4), rng.normal(0, 0.6, 8)
    rows = []
    for i in range(18):
        for kind, noise in (("qualifying", 0.2), ("race", 0.3)):
            offset = rng.normal(0, 50)
            for d in range(8):
                value = None if (i + d) % 7 == 0 else float(offset + team[d // 2] + driver[d] - driver[d // 2 * 2 : d // 2 * 2 + 2].mean() + noise**0.5 * rng.normal())
                rows.append(("L", float(i), "R1" if i < 12 else "R2", kind, f"t{d // 2}", f"d{d}", value))
    return rows, spark.createDataFrame(rows, "league string, event_index double, regime string, kind string, team string, driver string, value double")


def batch(rows, until):
    """Posterior mean of the entries' deviations at an event, from one joint normal over all sessions of one regime."""
    names = [f"t{k}" for k in range(4)] + [f"d{k}" for k in range(8)]
    h = np.zeros((8, 12))
    for d in range(8):
        h[d, d // 2] = 1
        h[d, 4 + d] = 1
        h[d, 4 + d // 2 * 2 : 6 + d // 2 * 2] -= 0.5
    prior = np.array([V.team_prior] * 4 + [V.driver_prior] * 8)
    step = np.array([V.team_step] * 4 + [V.driver_step] * 8)
    cov = lambda i, j: np.diag(prior + step * min(i, j))
    frame = pd.DataFrame(rows, columns=["l", "i", "r", "kind", "t", "d", "v"])
    frame = frame[(frame["i"] < until) & frame["v"].notna()]
    sets = [(i, kind, np.array([int(d[1:]) for d in g["d"]]), g["v"].to_numpy()) for (i, kind), g in frame.groupby(["i", "kind"])]
    blocks = [(i, statespace.contrasts(len(ds)) @ h[ds], statespace.contrasts(len(ds)) @ v, getattr(V, kind)) for i, kind, ds, v in sets]
    big = np.block([[a @ cov(i, j) @ b.T + (noise * np.eye(len(a)) if x == y else 0) for y, (j, b, _, _) in enumerate(blocks)] for x, (i, a, _, noise) in enumerate(blocks)])
    cross = np.hstack([h @ cov(until, j) @ b.T for j, b, _, _ in blocks])
    m = cross @ np.linalg.solve(big, np.concatenate([y for _, _, y, _ in blocks]))
    return names and m - m.mean()


def test_filter_equals_batch_posterior(sessions):
    rows, df = sessions
    out = statespace.pace_forecasts(df, "league", V).toPandas()
    for event in (1.0, 7.0, 11.0):
        got = out[out["event_index"] == event].sort_values("driver")
        assert got["strength"].to_numpy() == pytest.approx(batch(rows, event), abs=1e-6)
        cov = np.array(got["covariance"].tolist())
        assert np.allclose(cov, cov.T) and np.allclose(cov.sum(axis=1), 0, atol=1e-9)
    first = out[out["event_index"] == 0.0]
    assert (first["strength"] == 0).all()
    reset = out[out["event_index"] == 12.0].groupby("team")["strength"].mean()
    assert np.ptp(reset) == pytest.approx(0, abs=1e-9)  # teams start anew with a regime, drivers stay
    changed = df.withColumn("value", F.when(F.col("event_index") >= 7, -F.col("value")).otherwise(F.col("value")))
    again = statespace.pace_forecasts(changed, "league", V).where("event_index = 7").orderBy("driver").toPandas()
    assert again["strength"].to_numpy() == pytest.approx(out[out["event_index"] == 7.0].sort_values("driver")["strength"].to_numpy())


def test_variance_fit(sessions):
    _, df = sessions
    fit = statespace.fit_variances(df, "league", 12.0, rounds=3)
    start = statespace.losses(df.where("event_index < 12"), "league", [V, fit.variances]).orderBy("candidate").collect()
    assert fit.n_events == 12 and start[1]["loss"] == pytest.approx(fit.loss) and np.isfinite(fit.loss)
    with pytest.raises(guards.ContractError):
        statespace.fit_variances(df, "league", 5.0)
    with pytest.raises(ValueError):
        statespace.Variances(race=0.0)


def test_rankings(spark, sessions):
    _, df = sessions
    made = statespace.pace_forecasts(df, "league", V).where("event_index = 11")
    out = statespace.sample_rankings(made, ["league", "event_index"], 4000).toPandas()
    assert out["win_probability"].sum() == pytest.approx(1) and out["podium_probability"].sum() == pytest.approx(3) and out["expected_finish"].mean() == pytest.approx(4.5)
    order = made.orderBy(F.col("strength").desc()).toPandas()["driver"].tolist()
    assert out.sort_values("predicted_rank")["driver"].iloc[0] == order[0] and (out["dnf_probability"] == 0).all()
    rates = made.withColumns({"a": F.when(F.col("team") == "t0", 9.0).otherwise(1.0), "b": F.lit(9.0)})
    hurt = statespace.sample_rankings(rates, ["league", "event_index"], 4000, rates=("a", "b")).toPandas().set_index("driver")["dnf_probability"]
    assert hurt["d0"] == pytest.approx(0.5, abs=0.05) and hurt["d7"] == pytest.approx(0.1, abs=0.03)
    same = statespace.sample_rankings(made, ["league", "event_index"], 4000).toPandas()
    assert same.sort_values("driver")["win_probability"].tolist() == out.sort_values("driver")["win_probability"].tolist()


def test_session_values(spark):
    results = spark.createDataFrame([("r", 3.0, 2024, "t", f"d{k}", 1, 50 if k < 4 else 49, 5.0e6 + k) for k in range(5)], "race_id string, event_index double, season int, team string, driver string, classified int, laps int, total_ms double")
    qualifying = spark.createDataFrame([("r", "t", "d0", 90.0), ("r", "t", "d1", 91.0), ("r", "u", "d9", 92.0)], "race_id string, team string, driver string, q1_s double")
    got = {(r["driver"], r["kind"]): r["value"] for r in statespace.session_values(results, qualifying).collect()}
    assert len(got) == 12 and got["d4", "race"] is None and got["d9", "race"] is None and got["d9", "qualifying"] == pytest.approx(-100 * np.log(92))
    assert got["d1", "race"] == pytest.approx(-100 * np.log((5.0e6 + 1) / 50000))
    with pytest.raises(guards.ContractError):
        statespace.session_values(results, qualifying.withColumn("team", F.lit("x")))
