"""Forecasts of many races at once, each from what was known before it: strengths, hazards, simulation, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hazard, logit, recency_weight
from .evaluation import race_metrics
from .simulation import SimulationSettings, simulate_race


@dataclass(frozen=True)
class ForecastConfig:
    half_life: float = 6.0
    cross_regime: float = 0.35
    ridge: float = 1.0
    driver_shrinkage: float = 3.0
    alpha: float = 1.2
    beta: float = 12.0
    rookie_penalty: float = -0.25
    rookie_spread: float = 0.45
    passes: int = 4
    kinds: tuple[tuple[str, float], ...] = (("qualifying", 1.0), ("race", 0.8))


def decayed_cells(rows: DataFrame, targets: DataFrame, keys: list[str], index: str, half_life: float, regime: str, cross: float, amounts: dict[str, Column], share: Column | None = None) -> DataFrame:
    """(target, <keys>, w, and each amount): sums of recency and regime weights (times a row's share), and of the weighted
    amounts, over the rows of a cell of keys before each later target.

    targets is a calendar (target, target_index, target_regime), a small dimension.  A weight falls under 1e-6 after
    twenty half-lives and is left out there.  Rows are summed by cell and event first, then a cell's events of such a
    stretch become one row: what meets a target is a cell's stretch, not its rows, and no more rows than there are cells
    with a past for a target come out.  A stretch holds a bounded number of events.
    """
    reach = 20 * half_life
    block = lambda c: F.floor(c / reach)
    per = rows.groupBy(*keys, F.col(regime).alias("__regime"), F.col(index).cast("double").alias("__at")).agg(F.sum(F.lit(1.0) if share is None else share).alias("__w"), *[F.sum(c).alias(f"__a{k}") for k, c in enumerate(amounts.values())])
    names = ["__w", *[f"__a{k}" for k in range(len(amounts))]]
    packed = per.groupBy(*keys, block(F.col("__at")).alias("__block")).agg(F.collect_list(F.struct("__at", "__regime", *names)).alias("__events"))
    t = targets.select("target", F.col("target_index").cast("double").alias("target_index"), "target_regime", F.explode(F.array(block(F.col("target_index")), block(F.col("target_index")) - 1)).alias("__block"))
    met = packed.join(F.broadcast(t), "__block")
    weight = lambda x: recency_weight(x["__at"], F.col("target_index"), half_life) * F.when(x["__regime"] == F.col("target_regime"), 1.0).otherwise(cross)
    counted = F.filter("__events", lambda x: (x["__at"] < F.col("target_index")) & (weight(x) > 1e-6))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])
    sums = F.aggregate(counted, zero, lambda held, x: F.struct(*[(held[n] + weight(x) * F.coalesce(x[n].cast("double"), F.lit(0.0))).alias(n) for n in names]))
    met = met.select("target", *keys, F.size(counted).alias("__n"), sums.alias("__s")).where("__n > 0")
    return met.groupBy("target", *keys).agg(F.sum("__s.__w").alias("w"), *[F.sum(f"__s.__a{k}").alias(n) for k, n in enumerate(amounts)])


def strengths(observations: DataFrame, targets: DataFrame, config: ForecastConfig = ForecastConfig()) -> tuple[DataFrame, DataFrame]:
    """(target, team, team_effect) and (target, driver, shrunk_effect, n_obs) by backfitting, all targets side by side.

    observations has (event_index, regime, kind, team, driver, score).
    """
    kinds = F.create_map(*[F.lit(x) for pair in config.kinds for x in pair])
    share = F.coalesce(kinds[F.col("kind")], F.lit(0.5))
    cell = decayed_cells(observations.where("score IS NOT NULL"), targets, ["team", "driver"], "event_index", config.half_life, "regime", config.cross_regime, {"wy": share * F.col("score")}, share)
    every, team, driver = Window.partitionBy("target"), Window.partitionBy("target", "team"), Window.partitionBy("target", "driver")
    cell = cell.withColumn("mu", F.sum("wy").over(every) / F.sum("w").over(every)).withColumn("d", F.lit(0.0))
    for _ in range(config.passes):
        cell = cell.withColumn("t", F.sum(F.col("wy") - F.col("w") * (F.col("mu") + F.col("d"))).over(team) / (F.sum("w").over(team) + config.ridge))
        cell = cell.withColumn("d", F.sum(F.col("wy") - F.col("w") * (F.col("mu") + F.col("t"))).over(driver) / (F.sum("w").over(driver) + config.ridge))
        cell = cell.withColumn("s", F.sum(F.col("w") * F.col("d")).over(every) / F.sum("w").over(every))
        cell = cell.withColumn("d", F.col("d") - F.col("s")).withColumn("mu", F.col("mu") + F.col("s")).drop("s")
    teams = cell.groupBy("target", "team").agg(F.first("t").alias("team_effect"))
    n = F.sum("w")
    drivers = cell.groupBy("target", "driver").agg((F.first("d") * n / (n + config.driver_shrinkage)).alias("shrunk_effect"), n.alias("n_obs"))
    return teams, drivers


def hazards(results: DataFrame, targets: DataFrame, config: ForecastConfig = ForecastConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(target, base), (target, team, team_rate) and (target, driver, excess) of retirements among starters."""
    cell = decayed_cells(results.where("started = 1"), targets, ["team", "driver"], "event_index", 2 * config.half_life, "regime", config.cross_regime, {"wy": F.col("dnf").cast("double")})
    cell = cell.withColumn("base", F.sum("wy").over(Window.partitionBy("target")) / F.sum("w").over(Window.partitionBy("target")))
    mass, own = config.alpha + config.beta, Window.partitionBy("target", "team")
    cell = cell.withColumn("team_rate", (F.sum("wy").over(own) + mass * F.col("base")) / (F.sum("w").over(own) + mass))
    k = 2 * config.driver_shrinkage
    expected = F.sum(F.col("w") * F.col("team_rate")) / F.sum("w")
    rate = (F.sum("wy") + k * expected) / (F.sum("w") + k)
    drivers = cell.groupBy("target", "driver").agg((logit(rate) - logit(expected)).alias("excess"))
    return cell.groupBy("target").agg(F.first("base").alias("base")), cell.groupBy("target", "team").agg(F.first("team_rate").alias("team_rate")), drivers


def scored_entries(entries: DataFrame, observations: DataFrame, results: DataFrame, targets: DataFrame, context: DataFrame | None = None, config: ForecastConfig = ForecastConfig()) -> DataFrame:
    """entries (target, driver, team, ...) with strength, is_rookie, strength_sd, dnf_probability, difficulty and scope.

    context may give (target, difficulty, multiplier); else 0.5 and 1.  Entries of a target without any history are
    marked by a NULL base rate.
    """
    teams, drivers = strengths(observations, targets, config)
    base, team_rates, excess = hazards(results, targets, config)
    out = entries.join(teams, ["target", "team"], "left").join(drivers, ["target", "driver"], "left").join(F.broadcast(base), "target", "left")
    out = out.join(team_rates, ["target", "team"], "left").join(excess, ["target", "driver"], "left")
    out = out.join(F.broadcast(context), "target", "left") if context is not None else out.withColumns({"difficulty": F.lit(0.5), "multiplier": F.lit(1.0)})
    n = F.coalesce("n_obs", F.lit(0.0))
    return out.select(
        *entries.columns, F.col("shrunk_effect").isNull().alias("is_rookie"), n.alias("driver_obs_weight"), "base",
        (F.coalesce("team_effect", F.lit(0.0)) + F.coalesce("shrunk_effect", F.lit(config.rookie_penalty))).alias("strength"), (config.rookie_spread / (1 + n / 3)).alias("strength_sd"),
        hazard(F.coalesce("team_rate", "base"), F.col("excess"), F.coalesce("multiplier", F.lit(1.0))).alias("dnf_probability"), F.coalesce("difficulty", F.lit(0.5)).alias("difficulty"))


def forecast_races(entries: DataFrame, observations: DataFrame, results: DataFrame, targets: DataFrame, context: DataFrame | None = None, config: ForecastConfig = ForecastConfig(), settings: SimulationSettings = SimulationSettings(), grid: str | None = None) -> DataFrame:
    """The simulated table of every target with history, beside the entries' strengths."""
    scored = scored_entries(entries, observations, results, targets, context, config).where("base IS NOT NULL")
    table = simulate_race(scored, "target", "driver", "strength", "strength_sd", "dnf_probability", "difficulty", settings, grid=grid)
    return scored.join(table, ["target", "driver"])


def skipped(targets: DataFrame, entries: DataFrame, forecasts: DataFrame) -> DataFrame:
    """target, reason of the targets without a forecast."""
    named = entries.select("target").distinct().withColumn("__named", F.lit(True))
    left = targets.select("target").join(forecasts.select("target").distinct(), "target", "left_anti").join(named, "target", "left")
    return left.select("target", F.when(F.col("__named").isNull(), "no entries").otherwise("no history").alias("reason"))


def walk_forward(entries: DataFrame, observations: DataFrame, results: DataFrame, targets: DataFrame, baselines: dict[str, Column] | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, per-race metrics, skip log) of the model and of baselines, which are columns of entries.

    Predictions carry the outcome by (target, driver); entries that did not start are left out of the metrics.
    """
    made = forecast_races(entries, observations, results, targets, **options)
    own = F.struct(F.lit("simulation").alias("model"), (-F.col("expected_finish_if_classified")).alias("score"), F.col("win_probability"))
    none = F.lit(None).cast("double").alias("win_probability")
    others = [F.struct(F.lit(name).alias("model"), c.cast("double").alias("score"), none) for name, c in (baselines or {}).items()]
    rows = made.select("target", "driver", F.inline(F.array(own, *others)))
    truth = results.where("started = 1").select(F.col("race_id").alias("target"), "driver", "position_order", "classified")
    predictions = rows.join(truth, ["target", "driver"])
    win = Window.partitionBy("target", "model")
    predictions = predictions.withColumn("win_probability", F.col("win_probability") / F.sum("win_probability").over(win))
    metrics = race_metrics(predictions, ["model", "target"], "driver", "score", "position_order", "win_probability", "classified")
    return predictions, metrics, skipped(targets, entries, made)


def ablate(entries: DataFrame, observations: DataFrame, results: DataFrame, targets: DataFrame, context: DataFrame | None = None, config: ForecastConfig = ForecastConfig(), settings: SimulationSettings = SimulationSettings(n_sims=8000)) -> DataFrame:
    """Per-race metrics of five variants: full, and without circuit, reliability, simulator or qualifying observations."""
    def metrics(name: str, obs: DataFrame, ctx: DataFrame | None, flat: bool, simulate: bool) -> DataFrame:
        scored = scored_entries(entries, obs, results, targets, ctx, config).where("base IS NOT NULL")
        scored = scored.withColumn("dnf_probability", F.col("base")) if flat else scored
        if simulate:
            table = simulate_race(scored, "target", "driver", "strength", "strength_sd", "dnf_probability", "difficulty", settings)
            rows = table.select("target", "driver", (-F.col("expected_finish_if_classified")).alias("score"), "win_probability")
        else:
            rows = scored.select("target", "driver", F.col("strength").alias("score"), F.lit(None).cast("double").alias("win_probability"))
        truth = results.where("started = 1").select(F.col("race_id").alias("target"), "driver", "position_order", "classified")
        return race_metrics(rows.join(truth, ["target", "driver"]), ["target"], "driver", "score", "position_order", "win_probability", "classified").withColumn("model", F.lit(name))

    race_only = observations.where("kind <> 'qualifying'")
    variants = [
        metrics("full", observations, context, False, True), metrics("no_circuit", observations, None, False, True), metrics("no_reliability", observations, context, True, True),
        metrics("no_simulator", observations, context, False, False), metrics("no_qualifying", race_only, context, False, True)]
    out = variants[0]
    for v in variants[1:]:
        out = out.unionByName(v)
    return out
