"""Fitted models: ranking temperature, robust regressions, classifiers, corrected practice pace, simulator noise."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import geometric_grid
from .guards import require_columns, require_observed_before
from .search import simplex
from .simulation import SimulationSettings, simulate_race, winner_logloss

# Dry compounds.
DRY = ("SOFT", "MEDIUM", "HARD")


@dataclass(frozen=True)
class RankCalibration:
    temperature: float
    n_races: int
    last_training_index: float | None
    objective: str


def race_losses(past: DataFrame, race: str, score: str, temperatures: list[float], objective: str = "winner", position: str = "position_order", winner: str = "winner", classified: str = "classified") -> DataFrame:
    """(race, temperature, l): a race's winner log-loss of the softmax of score / temperature, or its mean Plackett-Luce
    loss of the classified order; NULL without a winner.  Scores are shifted by their race's maximum, so nothing overflows.
    """
    rows = past.where(F.col(classified) == 1) if objective == "ranking" else past
    w = Window.partitionBy(race)
    rows = rows.withColumn("__n", F.count("*").over(w)).where("__n >= 2").withColumn("__z", F.col(score) - F.max(score).over(w))
    rows = rows.select(race, winner, position, "__n", "__z", F.explode(F.array(*map(F.lit, temperatures))).alias("temperature"))
    e = F.exp(F.col("__z") / F.col("temperature"))
    if objective == "ranking":
        rest = F.ln(F.sum(e).over(Window.partitionBy(race, "temperature").orderBy(F.col(position).desc()).rowsBetween(Window.unboundedPreceding, 0)))
        each = rows.withColumn("__l", rest - F.col("__z") / F.col("temperature")).withColumn("__last", F.max(position).over(Window.partitionBy(race, "temperature")))
        per = each.where(F.col(position) < F.col("__last")).groupBy(race, "temperature").agg(F.avg("__l").alias("l"))
    else:
        per = rows.groupBy(race, "temperature").agg((F.ln(F.sum(e)) - F.max(F.when(F.col(winner).cast("int") == 1, F.col("__z") / F.col("temperature")))).alias("l"))
    return per.select(race, "temperature", "l")


def rank_losses(past: DataFrame, race: str, score: str, temperatures: list[float], objective: str = "winner", **names) -> DataFrame:
    """(temperature, loss, n_races): means of race_losses over the races that have one."""
    return race_losses(past, race, score, temperatures, objective, **names).groupBy("temperature").agg(F.avg("l").alias("loss"), F.count("l").alias("n_races"))


def fit_rank_calibration(history: DataFrame, race: str, index: str, as_of: float, score: str, objective: str = "winner", least: int = 10, **names) -> RankCalibration:
    """The temperature between 0.05 and 20 of least loss over races before as_of; 1 under `least` races.

    A grid of 80 is searched in one job, then a grid as fine again between the best one's neighbours.  Races before as_of
    need two entries, one winner and finite scores each; others are refused.
    """
    from .calibration import require_rankable

    if objective not in ("winner", "ranking"):
        raise ValueError(f"no such objective: {objective}")
    past = history.where(F.col(index) < as_of)
    require_rankable(past, race, score, names.get("winner", "winner"))
    grid, best = geometric_grid(0.05, 20.0, 80), None
    for _ in range(2):
        found = rank_losses(past, race, score, grid, objective, **names).orderBy("loss", "temperature").first()
        if found is None or found["n_races"] < least:
            last = past.agg(F.max(index)).first()[0]
            return RankCalibration(1.0, found["n_races"] if found else 0, last, objective)
        best = found
        k = min(range(len(grid)), key=lambda i: abs(math.log(grid[i] / found["temperature"])))
        grid = geometric_grid(grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)], 80)
    return RankCalibration(best["temperature"], best["n_races"], past.agg(F.max(index)).first()[0], objective)


def winner_only(df: DataFrame, race: list[str], entry: str, score: str = "score", probability: str = "win_probability") -> DataFrame:
    """df as the forecast of a model of winners alone: its other probabilities are unknown, and ranks are made anew."""
    other = ("podium_probability", "top10_probability", "dnf_probability_sim", "dnf_probability", "expected_finish", "expected_finish_if_classified", "pole_probability", "finish_p10", "finish_p50", "finish_p90", "pace_rank_score")
    out = df.withColumns({c: F.lit(None).cast("double") for c in other if c in df.columns} | {"probability_scope": F.lit("winner_only")})
    w = Window.partitionBy(*race)
    return out.withColumn("predicted_rank", F.row_number().over(w.orderBy(F.col(score).desc(), entry))).withColumn("win_probability_rank", F.rank().over(w.orderBy(F.col(probability).desc_nulls_last())))


def practice_blend(scores: DataFrame, practice: DataFrame, keys: list[str], score: str = "strength", most: float = 0.35) -> DataFrame:
    """scores with blended: a driver's practice score enters with most / (1 + its standard deviation)."""
    p = practice.select(*keys, "practice_score", "pace_sd")
    w = most / (1 + F.col("pace_sd"))
    out = scores.join(p, keys, "left")
    return out.select(*scores.columns, F.coalesce((1 - w) * F.col(score) + w * F.col("practice_score"), F.col(score)).alias("blended"))


def _numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all columns are numbers."""
    out = df.select(*[F.col(c).try_cast("double").alias(c) for c in columns])
    return out.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in columns))


def huber_slopes(df: DataFrame, label: str, features: list[str], least: int) -> list[float] | None:
    """Coefficients of a robust linear fit; None under `least` rows."""
    rows = _numeric(df, [label, *features])
    if rows.count() < least:
        return None
    model = LinearRegression(featuresCol="__x", labelCol=label, loss="huber", maxIter=200, tol=1e-9)
    return [float(c) for c in model.fit(VectorAssembler(inputCols=features, outputCol="__x").transform(rows)).coefficients]


def temperature_sensitivity(df: DataFrame, pace: str, temperature: str) -> float | None:
    found = huber_slopes(df, pace, [temperature], 3)
    return found[0] if found else None


def tyre_degradation(df: DataFrame, age: str, time: str, temperature: str | None = None) -> dict[str, float | None]:
    """linear_deg, quadratic_deg and temp_effect of lap times on tyre age, its square and the temperature."""
    features = ["__age", "__age2", *([temperature] if temperature else [])]
    a = F.col(age).try_cast("double")
    found = huber_slopes(df.withColumn("__age", a).withColumn("__age2", a * a), time, features, 5) or [None] * len(features)
    return dict(zip(("linear_deg", "quadratic_deg", "temp_effect"), [*found, None]))


def corrected_practice_pace(laps: DataFrame, cutoff: Column, least_laps: int = 5, least_drivers: int = 4) -> DataFrame:
    """driver_id, practice_score, pace_sd, n_laps of one session, all observed before the cutoff.

    Kept are dry, clean laps near their stint's median in stints of some length; a robust regression on tyre age, time
    and compound with an intercept a stint takes the controls' part out, and a driver's median of the rest counts.
    """
    needed = ("driver_id", "compound", "lap_duration", "tyre_age", "stint_number", "rainfall", "is_pit_out_lap", "interrupted", "date_start", "observed_at")
    require_columns(laps, {c: laps.schema[c].dataType.simpleString() if c in laps.columns else "string" for c in needed})
    require_observed_before(laps, "observed_at", cutoff)
    number = {c: F.col(c).try_cast("double") for c in ("lap_duration", "tyre_age", "stint_number", "rainfall")}
    g = laps.withColumns(number).where(F.col("driver_id").isNotNull() & F.col("compound").isin(*DRY) & (F.col("lap_duration") > 0) & (F.col("tyre_age") >= 2) & (F.col("rainfall") == 0) & ~F.col("is_pit_out_lap") & ~F.col("interrupted"))
    stint = Window.partitionBy("driver_id", "stint_number")
    g = g.withColumn("__m", F.median("lap_duration").over(stint)).where(F.col("lap_duration").between(0.95 * F.col("__m"), 1.025 * F.col("__m")))
    g = g.withColumn("__n", F.count("*").over(stint)).where(F.col("__n") >= least_laps)
    first, drivers = g.agg(F.min("date_start"), F.countDistinct("driver_id")).first()
    if drivers < least_drivers:
        return laps.sparkSession.createDataFrame([], "driver_id string, practice_score double, pace_sd double, n_laps long")
    hours = (F.unix_micros("date_start") - F.unix_micros(F.lit(first))) / 3.6e9
    g = g.withColumn("hours", hours).withColumn("stint", F.concat_ws(":", "driver_id", "stint_number"))
    index = StringIndexer(inputCols=["compound", "stint"], outputCols=["__c", "__s"], stringOrderType="alphabetDesc")
    hot = OneHotEncoder(inputCols=["__c", "__s"], outputCols=["__cv", "__sv"], dropLast=True)
    controls = VectorAssembler(inputCols=["tyre_age", "hours", "__cv"], outputCol="__control")
    model = Pipeline(stages=[index, hot, controls, VectorAssembler(inputCols=["__control", "__sv"], outputCol="__x"), LinearRegression(featuresCol="__x", labelCol="lap_duration", loss="huber", maxIter=500, tol=1e-9, regParam=1e-4)])
    fitted = model.fit(g)
    n_controls = 2 + len(fitted.stages[0].labelsArray[0]) - 1
    slopes = [float(c) for c in fitted.stages[-1].coefficients[:n_controls]]
    from pyspark.ml.functions import vector_to_array

    values = vector_to_array(F.col("__control"))
    part = sum((F.get(values, F.lit(k)) * b for k, b in enumerate(slopes)), F.lit(0.0))
    per = fitted.transform(g).withColumn("__a", F.col("lap_duration") - part).groupBy("driver_id").agg(F.median("__a").alias("pace"), F.stddev_samp("__a").alias("spread"), F.count("*").alias("n_laps"))
    every = per.agg(F.median("pace").alias("__mid"), F.greatest(F.coalesce(F.stddev_samp("pace"), F.lit(0.0)), F.lit(0.5)).alias("__scale"))
    out = per.join(F.broadcast(every))
    sd = F.sqrt(F.pow(F.coalesce("spread", "__scale"), 2) / F.col("n_laps") + 0.25)
    return out.select("driver_id", (-(F.col("pace") - F.col("__mid")) / F.col("__scale")).alias("practice_score"), sd.alias("pace_sd"), "n_laps")


def fit_classifier(df: DataFrame, features: list[str], target: str, balanced: bool = True) -> PipelineModel:
    """A logistic model of a 0/1 target on complete rows; balanced weighs both outcomes alike."""
    rows = _numeric(df, [*features, target])
    share = rows.agg(F.avg(target).alias("__share"))
    weight = F.when(F.col(target) == 1, 0.5 / F.col("__share")).otherwise(0.5 / (1 - F.col("__share"))) if balanced else F.lit(1.0)
    weighed = rows.join(F.broadcast(share)).withColumn("__w", F.coalesce(weight, F.lit(1.0)))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol=target, weightCol="__w", maxIter=200)]).fit(weighed)


def fit_ranker(df: DataFrame, features: list[str], relevance: str = "relevance", seed: int = 42) -> PipelineModel:
    """Boosted trees on relevance, which stand in for a listwise ranker; order by their prediction within a race."""
    rows = _numeric(df, [*features, relevance])
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), GBTRegressor(featuresCol="__x", labelCol=relevance, predictionCol="score", maxIter=60, maxDepth=4, stepSize=0.1, seed=seed)]).fit(rows)


#: Bounds of the simulator's fitted noise.
NOISE = {"qualifying_noise": (0.05, 2.0), "race_noise": (0.05, 2.0), "start_swing": (0.0, 6.0), "strategy_swing": (0.0, 6.0)}


@dataclass(frozen=True)
class NoiseFit:
    settings: SimulationSettings
    incumbent: SimulationSettings
    loss: float
    incumbent_loss: float
    n_races: int
    n_evaluations: int
    trace: tuple[dict, ...]

    @property
    def improvement(self) -> float:
        return self.incumbent_loss - self.loss


def fit_noise(simulate: Callable[[SimulationSettings], DataFrame], winners: DataFrame, race: str, entry: str, incumbent: SimulationSettings = SimulationSettings(), n_sims: int = 4000, evaluations: int = 120) -> NoiseFit:
    """The simulator's four noise settings of least winner log-loss; every evaluation simulates all races in one job,
    with the same seed, so settings are compared and not draws.

    simulate gives the simulated table of all races for some settings, such as a partial simulate_race.
    """
    base, trace = replace(incumbent, n_sims=n_sims), []
    low, high = (np.array([b[k] for b in NOISE.values()]) for k in (0, 1))

    def tried(settings: SimulationSettings) -> float:
        row = winner_logloss(simulate(settings), winners, race, entry).first()
        trace.append({**{k: getattr(settings, k) for k in NOISE}, "loss": row["logloss"], "n_races": row["n_races"]})
        return float(row["logloss"])

    free = lambda x: np.log(x / (1 - x))
    start = np.clip((np.array([getattr(incumbent, k) for k in NOISE]) - low) / (high - low), 1e-6, 1 - 1e-6)
    at = lambda p: replace(base, **dict(zip(NOISE, (float(x) for x in low + (high - low) / (1 + np.exp(-p))))))
    point, _, _, _ = simplex(lambda p: tried(at(p)), free(start), 0.5, evaluations, 1e-4)
    loss, old = tried(at(point)), tried(base)
    return NoiseFit(at(point), base, loss, old, trace[-1]["n_races"], len(trace), tuple(trace))


def simulator(entries: DataFrame, race: str, entry: str, strength: str, spread: str, failure: str, difficulty: str) -> Callable[[SimulationSettings], DataFrame]:
    """simulate_race of some entries, as fit_noise wants it."""
    return lambda settings: simulate_race(entries, race, entry, strength, spread, failure, difficulty, settings)
