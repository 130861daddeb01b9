"""Core operators against plain versions, on odd rows, and on the small fixtures that their contracts describe."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.functions import scalar as S
from gridspark.operators import circuits, evaluation, forecast, guards, pace, panel, retirement, simulation, temporal
from gridspark.operators import estimators as E
from gridspark.operators.search import golden, simplex
from gridspark.sources import feeds, files, responses


@pytest.fixture(scope="module")
def league(spark):
    """Four seasons of ten rounds, six drivers in three teams with known strengths; everyone is classified."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        order = sorted(range(6), key=lambda d: -(2 - d // 2 + 0.4 * (d % 2 == 0) + 0.5 * rng.normal()))
        for place, d in enumerate(order, 1):
            rows.append((f"{2022 + i // 10}_{i % 10 + 1:02d}", float(i), "R2022", f"d{d}", "abc"[d // 2], place, 1, 1, int(rng.random() < 0.1 + 0.2 * (d == 5)), 100.0 / place))
    return spark.createDataFrame(rows, "race_id string, event_index double, regime string, driver string, team string, position_order int, classified int, started int, dnf int, points double")


def observed(league):
    return league.withColumn("score", S.normal_score(F.col("position_order").cast("double"), F.lit(6.0))).withColumn("kind", F.lit("race"))


def test_fits_ignore_later_rows(league):
    late = league.where("event_index >= 30").withColumns({"dnf": F.lit(1), "position_order": 7 - F.col("position_order")})
    changed = league.where("event_index < 30").unionByName(late)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for fit in (
        lambda df: E.fit_hazards(df, "team", "driver", "dnf", "event_index", 30.0, started="started"),
        lambda df: E.backfit(observed(df), "team", "driver", "score", "event_index", 30.0),
        lambda df: pace.fit_ridge(observed(df), "team", "driver", "score", "event_index", 30.0).drivers,
    ):
        assert rows(fit(league)) == rows(fit(changed))


def test_ridge_against_dense_design(spark, league):
    obs = observed(league).where("event_index < 30").toPandas()
    w = 0.5 ** ((30 - obs["event_index"]) / 6)
    teams, drivers = sorted(set(obs["team"])), sorted(set(obs["driver"]))
    x = np.column_stack([np.ones(len(obs)), *[(obs["team"] == t) for t in teams], *[(obs["driver"] == d) for d in drivers]]).astype(float)
    gram = x.T @ (x * w.to_numpy()[:, None])
    full = gram + np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    beta = np.linalg.solve(full, x.T @ (w * obs["score"]))
    left = obs["score"] - x @ beta
    sd = math.sqrt((w * left**2).sum() / max(w.sum() - np.trace(np.linalg.solve(full, gram)), 1))
    cov = sd**2 * np.linalg.inv(full)
    fit = pace.fit_ridge(observed(league), "team", "driver", "score", "event_index", 30.0)
    assert fit.intercept == pytest.approx(beta[0]) and fit.residual_sd == pytest.approx(sd) and fit.n_observations == 180
    got = {r["driver"]: r for r in fit.drivers.collect()}
    for k, d in enumerate(drivers):
        n = w[obs["driver"] == d].sum()
        assert got[d]["driver_effect"] == pytest.approx(beta[4 + k]) and got[d]["effect_se"] == pytest.approx(math.sqrt(cov[4 + k, 4 + k]))
        assert got[d]["shrunk_effect"] == pytest.approx(beta[4 + k] * n / (n + 3))
    entries = spark.createDataFrame([("a", "d0"), ("a", "new"), ("zz", "d0"), ("zz", "new")], "t string, d string")
    se = [r["strength_se"] for r in pace.strength_variance(entries, fit, "t", "d").orderBy("d", "t").collect()]
    top = np.diag(cov)[1:].max()
    assert se == pytest.approx([math.sqrt(v) for v in (cov[1, 1] + cov[4, 4] + 2 * cov[1, 4], cov[4, 4] + top, cov[1, 1] + top, top)])
    none = pace.fit_ridge(observed(league), "team", "driver", "score", "event_index", 0.0)
    assert none.n_observations == 0 and none.drivers.isEmpty()


def test_dual_strengths(spark, league):
    both = observed(league).unionByName(observed(league).withColumn("kind", F.lit("qualifying")).withColumn("score", F.col("score") * 2))
    dual = pace.fit_dual(both, "team", "driver", "score", "event_index", 40.0)
    entries = spark.createDataFrame([("r", "a", "d0"), ("r", "b", "d2"), ("r", "c", "rookie")], "race string, t string, d string")
    rows = {r["d"]: r for r in pace.score_dual(entries, dual, "race", "t", "d").collect()}
    assert dual.n_observations == 480 and rows["rookie"]["is_rookie"] and not rows["d0"]["is_rookie"]
    for c in ("qual_strength_z", "race_strength_z"):
        z = [r[c] for r in rows.values()]
        assert sum(z) == pytest.approx(0, abs=1e-9) and np.std(z) == pytest.approx(1)
    assert rows["d0"]["strength"] == pytest.approx((rows["d0"]["qual_strength"] + rows["d0"]["race_strength"]) / 2) and rows["d0"]["strength"] > rows["d2"]["strength"]


def test_walk_forward(spark, league):
    obs = observed(league)
    targets = league.select(F.col("race_id").alias("target"), F.col("event_index").alias("target_index"), F.col("regime").alias("target_regime")).distinct().where("target_index IN (0, 20, 25, 39)")
    entries = league.where("event_index <> 25").select(F.col("race_id").alias("target"), "driver", "team", (-F.substring("driver", 2, 1).cast("double")).alias("fixed")).join(targets.select("target"), "target", "left_semi")
    settings = simulation.SimulationSettings(n_sims=600)
    predictions, metrics, skips = forecast.walk_forward(entries, obs, league, targets, {"fixed": F.col("fixed")}, settings=settings)
    assert {(r["target"], r["reason"]) for r in skips.collect()} == {("2022_01", "no history"), ("2024_06", "no entries")}
    rows = metrics.collect()
    assert {(r["model"], r["target"]) for r in rows} == {(m, t) for m in ("simulation", "fixed") for t in ("2024_01", "2025_10")}
    assert all(r["n_entries"] == 6 and (r["winner_logloss"] is None) == (r["model"] == "fixed") for r in rows)
    scored = forecast.scored_entries(entries, obs, league, targets).where("target = '2025_10'").orderBy(F.col("strength").desc()).collect()
    assert [r["team"] for r in scored] == ["a", "a", "b", "b", "c", "c"] and [r["driver"] for r in scored[:2]] == ["d0", "d1"]
    hazard = {r["driver"]: r["dnf_probability"] for r in scored}
    assert hazard["d5"] == max(hazard.values())
    changed = league.where("event_index < 39").unionByName(league.where("event_index >= 39").withColumn("dnf", F.lit(1)))
    again = forecast.scored_entries(entries, obs, changed, targets).where("target = '2025_10'").orderBy(F.col("strength").desc()).collect()
    assert [(r["driver"], round(r["dnf_probability"], 9)) for r in again] == [(r["driver"], round(r["dnf_probability"], 9)) for r in scored]
    ablation = forecast.ablate(entries, obs, league, targets, settings=settings)
    assert {r["model"] for r in ablation.select("model").distinct().collect()} == {"full", "no_circuit", "no_reliability", "no_simulator", "no_qualifying"}


def test_retirement_fit_and_probabilities(spark):
    rng = np.random.default_rng(8)
    rows = [(f"r{k % 3}", f"t{k % 12}", int(rng.random() < 0.05 + 0.02 * (k % 12)), 1, float(k // 40)) for k in range(2400)]
    df = spark.createDataFrame(rows, "regime string, team string, dnf int, started int, i double")
    fit = retirement.fit_retirement(df, "team", "dnf", "started", "regime", "i", 50.0, "r1")
    counts = pd.DataFrame([r for r in rows if r[4] < 50], columns=["regime", "team", "dnf", "started", "i"]).groupby(["regime", "team"])["dnf"].agg(["sum", "count"])
    lb = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    loss = lambda a, b: -sum(lb(a + f, b + n - f) - lb(a, b) for f, n in counts.to_numpy())
    best = loss(fit.alpha, fit.beta)
    assert fit.converged and all(best <= loss(fit.alpha * x, fit.beta * y) + 1e-6 for x in (0.8, 1, 1.25) for y in (0.8, 1, 1.25))
    own = {r["team"]: (r["a"] - fit.alpha, r["b"] - fit.beta) for r in fit.teams.collect()}
    for team, (f, ok) in own.items():
        n = counts.loc[("r1", team)]
        assert (f, ok) == pytest.approx((n["sum"], n["count"] - n["sum"]))
    entries = spark.createDataFrame([("x", "t1"), ("x", "t1"), ("x", "new")], "race string, team string")
    p = retirement.retirement_probabilities(entries, fit, ["race"], "team").collect()
    q = retirement.retirement_probabilities(entries, fit, ["race"], "team", True).collect()
    assert all(b["retire_probability"] < a["retire_probability"] for a, b in zip(sorted(p), sorted(q)))
    with pytest.raises(guards.ContractError):
        retirement.fit_retirement(df, "team", "dnf", "started", "regime", "i", 0.0, "r1")


def test_searches():
    assert golden(lambda x: (x - 1.3) ** 2, -5, 5) == pytest.approx(1.3, abs=1e-5)
    x, value, _, done = simplex(lambda p: (p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2 + 1, [0, 0])
    assert done and x == pytest.approx([1, -2], abs=1e-3) and value == pytest.approx(1)


def test_simulator_shares(spark):
    rows = [(1, k, (10 - k) / 10.0, 0.05, k) for k in range(1, 21)]
    e = spark.createDataFrame(rows, "race int, entry int, s double, p double, g int").withColumn("sd", F.lit(0.2)).withColumn("diff", F.lit(0.4))
    settings = simulation.SimulationSettings(n_sims=3000)
    out = simulation.simulate_race(e, "race", "entry", "s", "sd", "p", "diff", settings).collect()
    assert sum(r["win_probability"] for r in out) == pytest.approx(1) and sum(r["podium_probability"] for r in out) == pytest.approx(3) and sum(r["top10_probability"] for r in out) == pytest.approx(10)
    assert sum(r["pole_probability"] for r in out) == pytest.approx(1) and np.mean([r["expected_finish"] for r in out]) == pytest.approx(10.5)
    assert all(sum(r["finish_counts"]) == 3000 and len(r["finish_counts"]) == 20 for r in out) and np.mean([r["failure_probability"] for r in out]) == pytest.approx(0.05, abs=0.01)
    known = {r["entry"]: r for r in simulation.simulate_race(e, "race", "entry", "s", "sd", "p", "diff", settings, grid="g").collect()}
    assert "pole_probability" not in known[1].asDict() and known[1]["win_probability"] > known[20]["win_probability"]
    lone = simulation.simulate_race(e.limit(1), "race", "entry", "s", "sd", "p", "diff", settings).collect()
    assert [(r["win_probability"], r["finish_p90"]) for r in lone] == [(1.0, 1)]
    assert simulation.simulate_race(e.limit(0), "race", "entry", "s", "sd", "p", "diff", settings).count() == 0
    for bad in ({"n_sims": 0}, {"n_sims": 1.5}, {"race_noise": math.nan}, {"chaos_probability": 2}):
        with pytest.raises(ValueError):
            simulation.SimulationSettings(**bad)


def test_draws_are_spread():
    d = simulation.Draws(1, "r", range(4000), 5)
    u, z = d.uniform("a1"), d.normal("b")
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u.T) - np.eye(5)).max() < 0.06 and abs(z.std() - 1) < 0.02 and 0 < u.min() < u.max() < 1


def test_race_metrics_need_a_classified_winner(spark):
    rows = [("a", 1, 1, 0, 0.9, 0.5), ("a", 2, 2, 1, 0.1, 0.5), ("b", 1, 1, 1, 0.2, 0.6), ("b", 2, 2, 1, 0.9, 0.4), ("b", 3, 3, 0, None, 0.0)]
    df = spark.createDataFrame(rows, "race string, d int, pos int, cl int, sc double, p double")
    out = evaluation.race_metrics(df, ["race"], "d", "sc", "pos", "p", "cl").collect()
    assert [(r["race"], r["n_entries"], r["top1"], r["winner_rank"]) for r in out] == [("b", 2, 0.0, 2.0)]
    assert evaluation.broken_probabilities(df.replace(0.6, 0.7, "p"), ["race"], "p").count() == 1
    with pytest.raises(guards.ContractError):
        evaluation.require_probabilities(df.replace(0.6, 1.7, "p"), ["race"], "p")


def test_difficulty_needs_correlations(spark):
    df = spark.createDataFrame([("x", 0.5, 1.0), ("x", None, 9.0), ("x", None, 9.0), ("y", 0.9, 0.5), ("y", 0.8, 0.5), ("y", 0.7, 0.4)], "v string, rho double, mean_change double")
    got = {r["v"]: (r["n_events"], r["mean_change"], r["difficulty"] is None) for r in E.difficulty(df, "v").collect()}
    assert got == {"x": (1, 1.0, True), "y": (3, 0.5, False)}
    assert all(r["difficulty"] is not None for r in E.difficulty(df.where("v = 'x'"), "v").collect())


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    for broken in (lambda: guards.require_unique(df, ["k"]), lambda: guards.require_reference(df.where("k = 1"), ["k"], df.where("k IS NULL")), lambda: guards.require_columns(df, {"z": "int"})):
        with pytest.raises(guards.ContractError):
            broken()
    assert guards.require_columns(df.withColumn("n", F.lit("x7")), {"n": "int", "v": "string"}).columns == ["n", "v"]
    times = spark.createDataFrame([("2024-01-01",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    cutoff = F.lit("2024-01-02").cast("timestamp")
    assert guards.require_observed_before(times.where("t IS NOT NULL"), "t", cutoff).count() == 1
    with pytest.raises(guards.LeakageError):
        guards.require_observed_before(times, "t", cutoff)
    guards.require_stage(guards.FAMILIES, ["calendar", "practice_fp1"], "POST_FP1")
    for wanted, stage in ((["qualifying"], "POST_FP3"), (["unheard_of"], "RACE_START"), (["race_laps"], "RACE_START")):
        with pytest.raises(guards.LeakageError):
            guards.require_stage(guards.FAMILIES, wanted, stage)
    families = spark.createDataFrame([("grid",), ("fp1",), ("unheard_of",)], "family string")
    assert {r["family"] for r in guards.earlier_allowed(families, "POST_QUALI").where("allowed").collect()} == {"grid", "fp1"}
    guards.require_earlier_stage(families, "POST_RACE")
    with pytest.raises(guards.LeakageError):
        guards.require_earlier_stage(families, "POST_QUALI")
    rows = spark.createDataFrame([(1, 2), (None, 1), (3, None)], "f int, p int")
    assert guards.require_row_times(rows, "f", "p").count() == 3
    with pytest.raises(guards.LeakageError):
        guards.require_row_times(rows.unionByName(spark.createDataFrame([(5, 4)], "f int, p int")), "f", "p")


def test_panel(spark):
    schedule = spark.createDataFrame([("r1", 2024, 1, "2024-03-01"), ("r2", 2024, 2, "2024-03-08")], "race_id string, season int, round int, date string")
    results = spark.createDataFrame([("r1", "d1", 1, 1), ("r1", "d2", 2, 1), ("r2", "d1", 1, 0)], "race_id string, driver_id string, position_order int, classified int")
    qualifying = spark.createDataFrame([("r1", "d1", 0.0), ("r1", "d2", None)], "race_id string, driver_id string, qual_gap_pct double")
    made = panel.build_panel(results, qualifying, schedule)
    assert panel.index_of(made, "r2") == 1.0 and {(r["driver_id"], r["kind"]) for r in made.observations.collect()} == {("d1", "race"), ("d2", "race"), ("d1", "qualifying")}
    with pytest.raises(guards.ContractError):
        panel.index_of(made, "r9")
    for broken in ((results.unionByName(results), qualifying, schedule), (results, qualifying, schedule.where("round = 1")), (results, qualifying, schedule.unionByName(schedule))):
        with pytest.raises(guards.ContractError):
            panel.build_panel(*broken)


def test_venue_profiles(spark):
    profiles = spark.createDataFrame([("a", 210.0, 5000.0, 1.0, 0.2, False), ("b", 190.0, 4000.0, 2.0, 0.8, True), ("c", 200.0, None, 3.0, 0.5, True)], "venue string, avg_lap_speed_kmh double, lap_length_m double, field_spread_pct double, overtaking_difficulty double, is_street boolean")
    features = ["avg_lap_speed_kmh", "lap_length_m"]
    assert circuits.target_profile("a", profiles, "venue", features).first()["field_spread_pct"] == 1.0
    made = circuits.target_profile("new", profiles, "venue", features, 5000, 90, True).first()
    assert made["avg_lap_speed_kmh"] == pytest.approx(200) and made["field_spread_pct"] == 2.0 and made["is_street"]
    with pytest.raises(guards.ContractError):
        circuits.target_profile("c", profiles, "venue", features)
    near = circuits.nearest_in_family(circuits.target_profile("new", profiles, "venue", features, 5000, 90), profiles, "venue", features, ~F.col("is_street"))
    assert [r["venue"] for r in near.collect()] == ["a"]


def test_most_similar_in_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(90, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(90)] + [(90, None)], "id long, v array<double>")
    got = {(r["target"], r["id"]) for r in temporal.most_similar(df.where("id % 10 = 0"), df, "id", "v", 3, block=16).collect()}
    s = np.round((v / np.linalg.norm(v, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
    assert got == {(t, i) for t in range(0, 90, 10) for i in sorted((j for j in range(90) if j != t), key=lambda j: (-s[t, j], j))[:3]}


def response(**table):
    return json.dumps({"MRData": {"limit": "2", "offset": "0", "total": "3", **table}})


DRIVER = {"driverId": "ham", "code": "HAM", "givenName": "Lewis", "familyName": "Hamilton", "dateOfBirth": "1985-01-07"}
RACE = {"season": "2024", "round": "3", "raceName": "R", "date": "2024-03-24", "Circuit": {"circuitId": "c", "circuitName": "C", "Location": {"locality": "l", "country": "k", "lat": "1.5", "long": "x"}}}


def test_flattened_responses(spark):
    land = lambda *bodies: spark.createDataFrame([(b, "2024-04-01T00:00:00Z", "q") for b in bodies], "body string, fetched_at string, query string")
    one = lambda df: df.first().asDict()
    row = one(responses.flatten_schedule(land(response(RaceTable={"Races": [RACE]}), "broken")))
    assert (row["race_id"], row["lat"], row["lon"], row["regime"]) == ("2024_03", 1.5, None, "R2022") and str(row["race_start_utc"]) == "2024-03-24 12:00:00"
    team = {"constructorId": "m", "name": "M"}
    result = lambda p, text, status, **more: {"position": p, "positionText": text, "status": status, "grid": "1", "laps": "58", "points": "25", "Driver": DRIVER, "Constructor": team, **more}
    races = [{**RACE, "Results": [
        result("1", "1", "Finished", Time={"millis": "5400000"}, FastestLap={"rank": "1", "Time": {"time": "1:30.500"}}), result("2", "R", "Collision"), result("3", "R", "Engine"), result("4", "W", "Did not start"), result("11", "11", "+1 Lap")]}]
    rows = responses.flatten_results(land(response(RaceTable={"Races": races}))).orderBy("position_order").collect()
    assert [r["status_class"] for r in rows] == ["finished", "incident", "mechanical", "non_starter", "finished"] and [r["dnf"] for r in rows] == [0, 1, 1, 0, 0]
    assert [(r["winner"], r["podium"], r["top10"], r["dnf_incident"], r["dnf_mechanical"]) for r in rows] == [(1, 1, 1, 0, 0), (0, 0, 0, 1, 0), (0, 0, 0, 0, 1), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)]
    assert rows[0]["fastest_lap_s"] == pytest.approx(90.5) and rows[0]["total_ms"] == 5400000 and rows[0]["driver_name"] == "Lewis Hamilton" and rows[0]["field_size"] == 4
    q = [{"position": "1", "Q1": "1:31.0", "Q2": "1:30.0", "Driver": DRIVER, "Constructor": team}, {"position": "2", "Q1": "1:30.9", "Driver": {**DRIVER, "driverId": "b"}, "Constructor": team}, {"position": "3", "Driver": {**DRIVER, "driverId": "c"}, "Constructor": team}]
    rows = responses.flatten_qualifying(land(response(RaceTable={"Races": [{**RACE, "QualifyingResults": q}]}))).orderBy("qual_position").collect()
    assert [r["qual_best_s"] for r in rows] == [90.0, pytest.approx(90.9), None] and [r["qual_gap_pct"] for r in rows] == [0.0, pytest.approx(1.0), None]
    table = {"season": "2024", "round": "3", "DriverStandings": [{"position": "1", "positionText": "1", "points": "51", "wins": "2", "Driver": DRIVER, "Constructors": [team]}]}
    row = one(responses.flatten_standings(land(response(StandingsTable={"StandingsLists": [table]}))))
    assert (row["season"], row["after_round"], row["driver_id"], row["constructor_id"], row["championship_points"], row["championship_wins"]) == (2024, 3, "ham", "m", 51.0, 2)
    assert [r["offset"] for r in responses.missing_pages(land(response(RaceTable={"Races": []})), "query").collect()] == [2]


def test_practice_feeds(spark):
    sessions = spark.createDataFrame([(7, 2024, "2024-03-22T15:00:00+00:00", "2024-03-22T16:00:00+00:00"), (8, 2024, "2024-06-01T15:00:00Z", "2024-06-01T16:00:00Z")], "session_key int, season int, date_start string, date_end string")
    schedule = spark.createDataFrame([("2024_03", 2024, "2024-03-24", "c")], "race_id string, season int, date string, circuit_id string")
    matched = feeds.match_calendar(sessions, schedule, 0, 3)
    assert {(r["session_key"], r["race_id"], r["status"]) for r in matched.collect()} == {(7, "2024_03", "matched"), (8, None, "calendar_match_failed")}
    stamp = lambda m: f"2024-03-22T15:{m:02d}:00.000+00:00"
    laps = spark.createDataFrame([(7, 44, 1, stamp(1), 90.0, False), (7, 44, 2, stamp(3), 91.0, True), (7, 44, 3, stamp(20), 89.5, False), (7, 44, 4, stamp(40), None, False)], "session_key int, driver_number int, lap_number int, date_start string, lap_duration double, is_pit_out_lap boolean")
    stints = spark.createDataFrame([(7, 44, 1, 1, 3, "soft", 2), (7, 44, 2, 3, 9, "hard", None)], "session_key int, driver_number int, stint_number int, lap_start int, lap_end int, compound string, tyre_age_at_start int")
    drivers = spark.createDataFrame([(7, 44, "HAM")], "session_key int, driver_number int, name_acronym string")
    control = spark.createDataFrame([(7, stamp(2))], "session_key int, date string")
    weather = spark.createDataFrame([(7, stamp(0), 0), (7, stamp(10), 1)], "session_key int, date string, rainfall int")
    codes = feeds.driver_codes(spark.createDataFrame([(2024, "HAM", "ham"), (2024, "HAM", "ham")], "season int, driver_code string, driver_id string"))
    rows = feeds.practice_laps(laps, stints, drivers, control, weather, matched.where("status = 'matched'"), codes).orderBy("lap_number").collect()
    assert [(r["lap_number"], r["compound"], r["tyre_age"], r["interrupted"], r["rainfall"], r["driver_id"]) for r in rows] == [(1, "SOFT", 2.0, True, 0.0, "ham"), (2, "SOFT", 3.0, False, 0.0, "ham"), (3, "HARD", 0.0, False, 1.0, "ham")]
    with pytest.raises(guards.ContractError):
        feeds.driver_codes(spark.createDataFrame([(2024, "HAM", "ham"), (2024, "HAM", "other")], "season int, driver_code string, driver_id string"))
    with pytest.raises(guards.ContractError):
        feeds.normalise_practice(laps)
    events = feeds.race_events(spark.createDataFrame([(7, 1), (8, 2)], "session_key int, x int"), matched)
    assert [(r["race_id"], r["circuit_id"], r["x"]) for r in events.collect()] == [("2024_03", "c", 1)]


def test_feed_names(spark):
    car = feeds.normalise_car_data(spark.createDataFrame([("2024-01-01T00:00:00.5Z", "7", "x")], "date string, n_gear string, speed string")).first()
    assert car["gear"] == 7.0 and car["speed"] is None and str(car["timestamp"]) == "2024-01-01 00:00:00.500000"
    assert feeds.normalise_trace(spark.createDataFrame([(1, 2)], "`Distance M` int, `Speed KMH` int")).columns == ["distance", "speed"]
    assert feeds.normalise_weather(spark.createDataFrame([("bad", 1.0)], "date string, track_temperature double")).first().asDict() == {"timestamp": None, "track_temp": 1.0}
    assert feeds.corner_markers(spark.createDataFrame([(1, 2.0, "x")], "Number int, Distance double, Letter string")).columns == ["corner", "distance"]
    lap = feeds.lap_telemetry(spark.sql("SELECT INTERVAL '1 02:03:04.5' DAY TO SECOND AS Time, '12' AS Speed")).first()
    assert lap["time_s"] == pytest.approx(93784.5) and lap["speed"] == 12.0
    w = feeds.session_weather(spark.sql("SELECT INTERVAL '0 00:01:00' DAY TO SECOND AS Time, 20.5 AS AirTemp"), F.lit("2024-01-01 10:00:00").cast("timestamp")).first()
    assert str(w["timestamp"]) == "2024-01-01 10:01:00" and "air_temp" in w.asDict()
    flags = spark.createDataFrame([("true",), (None,), ("0",), ("zz",)], "f string").select(feeds.flag(F.col("f"))).collect()
    assert [r[0] for r in flags] == [True, False, False, False]
    assert feeds.endpoint_url("https://x.org/v1", "/laps/", session_key=7, driver=[1, 2]) == "https://x.org/v1/laps?session_key=7&driver=1&driver=2"
    assert feeds.trace_url("https://x.org", "A B", "Q", "f.json") == "https://x.org/A%20B/Q/f.json" and "past_days=2" in feeds.archived_weather_url("https://w.org", 1, 2, "a", "b", ["t"], 2)
    quota = feeds.over_quota(spark.sql("SELECT 'c' AS client, timestamp_seconds(id) AS at FROM range(5)"), "client", "at", 2, 3)
    assert quota.count() == 3


def test_timing_source(spark):
    rows = [("HAM", 1, "0 00:01:30", 3, "soft", 1, None, None, "0 00:10:00", None, True, "1"), ("HAM", 2, "0 00:01:31", 4, "soft", 1, None, None, "0 00:12:00", True, True, "1"), ("XXX", 1, "0 00:01:30", 3, "soft", 1, None, None, "0 00:10:00", None, True, "1")]
    iv = lambda c: F.col(c).cast("interval day to second")
    laps = spark.createDataFrame(rows, "Driver string, LapNumber int, LapTime string, TyreLife int, Compound string, Stint int, PitOutTime string, PitInTime string, LapStartTime string, Deleted boolean, IsAccurate boolean, TrackStatus string")
    laps = laps.withColumns({"LapTime": iv("LapTime"), "LapStartTime": iv("LapStartTime"), "race_id": F.lit("r"), "season": F.lit(2024), "stage": F.lit("POST_FP2")})
    weather = spark.createDataFrame([("r", "0 00:11:00", True)], "race_id string, Time string, Rainfall boolean").withColumn("Time", iv("Time"))
    codes = spark.createDataFrame([(2024, "HAM", "ham")], "season int, driver_code string, driver_id string")
    start = F.lit("2024-03-22 15:00:00").cast("timestamp")
    out = feeds.timing_laps(laps, weather, codes, start).orderBy("lap_number").collect()
    assert [(r["interrupted"], r["rainfall"], r["compound"]) for r in out] == [(False, 1.0, "SOFT"), (True, 1.0, "SOFT")]
    assert all(r["rainfall"] == 1.0 for r in feeds.timing_laps(laps, weather.limit(0), codes, start).collect())


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1, 2.5), (None, None, None)], "s string, n int, x double")
    types = {"s": "string", "n": "int", "x": "double"}
    for kind in ("parquet", "csv", "json"):
        path = f"{tmp_path}/{kind}"
        files.write_table(df, path, kind)
        assert {tuple(r) for r in files.read_table(spark, path, types, kind).collect()} == {("a,b", 1, 2.5), (None, None, None)}, kind
    with pytest.raises(ValueError):
        files.read_table(spark, f"{tmp_path}/csv", kind="csv")
    (tmp_path / "one.txt").write_text("abc")
    held = json.loads(files.manifest(spark, [f"{tmp_path}/one.txt"], seed=7))
    assert held["seed"] == 7 and held["inputs"][0]["length"] == 3 and held["inputs"][0]["sha256"].startswith("ba7816bf")
    (tmp_path / "u.meta.json").write_text(json.dumps({"url": "u", "fetched_at": "t", "status": 200, "bytes": 3}))
    records = feeds.provenance(spark, str(tmp_path))
    assert feeds.record_of(records, "u").first()["status"] == 200 and records.select(feeds.cache_key(F.lit("u"))).first()[0] == "0bfe935e70c321c7ca3afc75ce0d0ca2"


def test_stream(spark, sf, tmp_path):
    from gridspark.streaming.daily import daily_means, run_once

    ev = spark.read.parquet(f"{sf}/events.parquet")
    ev.repartition(3).write.parquet(f"{tmp_path}/in")
    run_once(spark, f"{tmp_path}/in", ev.schema, f"{tmp_path}/out", f"{tmp_path}/ck")
    batch = {(r["user_id"], r["day"]): (r["n"], round(r["mean"], 6) if r["mean"] is not None else None) for r in daily_means(ev).collect()}
    stream = {(r["user_id"], r["day"]): (r["n"], round(r["mean"], 6) if r["mean"] is not None else None) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert stream and all(batch[k] == v for k, v in stream.items())


def test_vehicle_dynamics(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert v(S.clock_seconds(lit("1:30.5"))) == 90.5 and v(S.clock_seconds(lit("1:00:01"))) == 3601 and v(S.clock_seconds(lit("x"))) is None and v(S.clock_seconds(lit(None).cast("string"))) is None
    assert v(S.braking_efficiency(lit(300.0), lit(100.0), lit(100.0))) == pytest.approx(((300 / 3.6) ** 2 - (100 / 3.6) ** 2) / 200) and v(S.braking_efficiency(lit(300.0), lit(100.0), lit(0.0))) is None
    assert v(S.traction_index(lit(100.0), lit(136.0), lit(2.0))) == pytest.approx(5) and v(S.straight_time_gain(lit(72.0), lit(36.0), lit(100.0))) == pytest.approx(5)
    assert v(S.lateral_g(lit(36.0), lit(-0.1))) == pytest.approx(10 / 9.80665) and v(S.aero_commitment(lit(36.0), lit(0.1), lit(50.0))) == pytest.approx(5 / 9.80665)
    head, cross = S.wind_components(lit(10.0), lit(90.0), lit(0.0))
    assert v(head) == pytest.approx(0, abs=1e-9) and v(cross) == pytest.approx(10) and v(S.pit_loss(lit(1.0), lit(30.0), lit(5.0))) == 24
    assert [v(S.traffic_class(lit(x))) for x in (0.5, 1.5, 3.0, -math.inf, math.nan)] == ["dirty", "affected", "clean", "clean", "clean"]
    assert v(S.is_finished(lit("+1 Lap"))) and v(S.is_finished(lit(" Lapped"))) and not v(S.is_finished(lit("Engine")))
    assert v(S.from_free(S.to_free(lit(1.5), 0.0, 6.0), 0.0, 6.0)) == pytest.approx(1.5) and v(S.shrink_mean(lit(0.0), lit(0), lit(0.3))) == 0.3
    row = one.select(lit(1.0).alias("low_speed_share"), lit(2.0).alias("low_speed"), lit(0.5).alias("braking_demand"), lit(1.0).alias("braking"), lit(9.0).alias("aero"))
    assert row.select(S.named_cosine(row.columns)).first()[0] == pytest.approx(1)


def test_lap_corners_and_session_practice(spark):
    """Two drivers on a circle: the one who is faster through the corner performs better there."""
    from gridspark.operators import corners

    rows = []
    for driver, fast in (("a", 10.0), ("b", 0.0)):
        for k in range(120):
            d = 10.0 * k
            speed = 250 - 120 * math.exp(-(((d - 600) / 120) ** 2)) + fast
            angle = 2 * math.pi * d / 1200
            rows.append(("t", driver, d, speed, 100.0 if d > 620 else 0.0, 1.0 if 450 < d < 600 else 0.0, d / 60, 190 * math.cos(angle), 190 * math.sin(angle)))
    telemetry = spark.createDataFrame(rows, "track string, driver string, distance double, speed double, throttle double, brake double, time_s double, x double, y double")
    markers = spark.createDataFrame([("t", 1, 600.0), ("t", 2, 5000.0)], "track string, corner int, distance double")
    out = {r["driver"]: r for r in corners.lap_corners(telemetry, markers, ["track"], ["driver"], step=5.0).collect()}
    assert set(out) == {"a", "b"} and out["a"]["corner_performance"] == pytest.approx(1) and out["b"]["corner_performance"] == pytest.approx(-1)
    a = out["a"]
    assert a["apex_speed_kmh"] == pytest.approx(140, abs=0.5) and a["entry_speed_kmh"] > a["apex_speed_kmh"] < a["exit_speed_kmh"] and 100 < a["braking_distance_m"] < 160
    laps = [(d, "FP2", 1, 60.0 * k, 90 + (0.2 if d == "b" else 0) - 0.01 * k) for d in "ab" for k in range(12)]
    df = spark.createDataFrame(laps, "driver string, session string, stint int, session_seconds double, lap_time double")
    out = corners.session_practice(df, ["session"]).orderBy("driver").collect()
    assert [r["driver"] for r in out] == ["a", "b"] and out[0]["session"] == "FP2"


def test_joins_on_odd_rows(spark):
    points = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, None), (None, 5.0), (2, 100.0)], "k int, t double")
    spans = spark.createDataFrame([(1, 0.0, 5.0, "x", 1), (1, 5.0, 9.0, "y", 2), (1, 9.0, 1.0, "back", 9), (2, None, None, "none", 3)], "k int, lo double, hi double, name string, r int")
    for width in (None, 2.0):
        got = sorted(((r["k"], r["t"], r["name"]) for r in temporal.interval_join(points, spans, ["k"], "t", "lo", "hi", "r", width=width).collect()), key=str)
        assert got == sorted([(1, 5.0, "y"), (1, 5.0, "y"), (1, None, None), (None, 5.0, None), (2, 100.0, None)], key=str)
        assert temporal.interval_join(points.limit(0), spans, ["k"], "t", "lo", "hi", "r", width=width).count() == 0
    left = spark.createDataFrame([(1, 0.5, "clash"), (1, 7.0, "b"), (2, 7.0, "c")], "k int, t double, __name string")
    right = spark.createDataFrame([(1, 0.5, 10), (1, 6.0, None), (3, 1.0, 5)], "k int, t double, v int")
    for width in (None, 1.0):
        got = {(r["k"], r["t"], r["v"], r["matched_at"]) for r in temporal.as_of(left, right, ["k"], "t", ["v"], width=width).collect()}
        assert got == {(1, 0.5, 10, 0.5), (1, 7.0, None, 6.0), (2, 7.0, None, None)}
        strict = {(r["k"], r["t"], r["matched_at"]) for r in temporal.as_of(left, right, ["k"], "t", ["v"], strict=True, width=width).collect()}
        assert strict == {(1, 0.5, None), (1, 7.0, 6.0), (2, 7.0, None)}
