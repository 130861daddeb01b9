"""Ranking temperatures of every race from the races before it, in one job, and the comparison of candidates that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import geometric_grid, leaderboard, race_metrics
from .guards import ContractError
from .learners import practice_blend, race_losses

#: Temperatures between which the best one is sought.
GRID = tuple(geometric_grid(0.05, 20.0, 80))


def unrankable(history: DataFrame, race: str, score: str, winner: str = "winner") -> DataFrame:
    """race, reason of the races that say nothing about a temperature: other than one winner, a score that is NULL or not
    finite, or fewer than two entries."""
    s = F.col(score).cast("double")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    per = history.groupBy(race).agg(F.coalesce(F.sum(F.col(winner).cast("int")), F.lit(0)).alias("w"), F.count(F.when(bad, 1)).alias("b"), F.count("*").alias("n"))
    reason = F.when(F.col("n") < 2, "fewer than two entries").when(F.col("w") != 1, "not exactly one winner").when(F.col("b") > 0, "a score is missing or not finite")
    return per.select(race, reason.alias("reason")).where("reason IS NOT NULL")


def require_rankable(history: DataFrame, race: str, score: str, winner: str = "winner") -> None:
    found = unrankable(history, race, score, winner).orderBy(race).limit(3).collect()
    if found:
        raise ContractError("races that can't be ranked: " + ", ".join(f"{r[0]} ({r['reason']})" for r in found))


def asof_temperatures(history: DataFrame, race: str, index: str, score: str, objective: str = "winner", least: int = 10, temperatures: tuple[float, ...] = GRID, strict: bool = True, **names) -> DataFrame:
    """race, index, n_races, temperature of every race: the temperature of least mean loss over the races strictly before
    its index; 1 where there are fewer than `least` of them.

    A race's loss at each temperature is computed once; sums along the order of events give every race its own fit, so
    later rows change nothing.  The minimum lies on a parabola through the grid's best three points, in log temperature.
    strict refuses histories with races that can't be ranked; else those are left out of the fits.
    """
    winner = names.get("winner", "winner")
    if strict:
        require_rankable(history, race, score, winner)
    known = history.join(unrankable(history, race, score, winner).select(race), race, "left_anti")
    events = history.groupBy(race).agg(F.min(index).alias(index))
    losses = race_losses(known, race, score, list(temperatures), objective, **names).where("l IS NOT NULL").join(events, race)
    at = losses.groupBy(index, "temperature").agg(F.sum("l").alias("l"), F.count("*").alias("n"))
    # An event without losses of its own still asks for a temperature: it adds nothing to the sums.
    asked = events.select(index).distinct().select(index, F.explode(F.array(*map(F.lit, temperatures))).alias("temperature"))
    asked = asked.join(at, [index, "temperature"], "left")
    before = Window.partitionBy("temperature").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    sums = asked.select(index, "temperature", F.sum("l").over(before).alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    grid = Window.partitionBy(index).orderBy("temperature")
    mean = F.col("l") / F.col("n")
    sums = sums.select(index, "temperature", "n", mean.alias("m"), F.lag(mean).over(grid).alias("a"), F.lead(mean).over(grid).alias("c"), (F.ln(F.lead("temperature").over(grid)) - F.ln("temperature")).alias("h"))
    best = sums.groupBy(index).agg(F.min("n").alias("n_races"), F.min(F.struct("m", "temperature", "a", "c", "h")).alias("b"))
    bend = F.col("b.a") - 2 * F.col("b.m") + F.col("b.c")
    moved = F.exp(F.ln("b.temperature") + F.col("b.h") * (F.col("b.a") - F.col("b.c")) / (2 * bend))
    fitted = F.when(bend > 1e-15, moved).otherwise(F.col("b.temperature"))
    best = best.select(index, "n_races", F.when(F.col("n_races") >= least, F.coalesce(fitted, "b.temperature")).otherwise(1.0).alias("temperature"))
    return events.join(best, index).select(race, index, "n_races", "temperature")


def compare_candidates(predictions: DataFrame, race: str, entry: str, index: str, score: str, position: str = "position_order", winner: str = "winner", classified: str = "classified", practice: DataFrame | None = None, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates' rows, per-race metrics, leaderboard) of scores as they are, with as-of temperatures by winners and by
    whole orders, and with practice (race, entry, practice_score, pace_sd) blended in, calibrated by winners."""
    names = {"position": position, "winner": winner, "classified": classified}
    base = predictions.withColumn("__s", F.col(score).cast("double"))
    made = [base.withColumns({"model": F.lit("raw"), "temperature": F.lit(1.0)})]
    fit = lambda rows, objective: asof_temperatures(rows, race, index, "__s", objective, least, **names).select(race, "temperature")
    for objective in ("winner", "ranking"):
        made.append(base.join(fit(base, objective), race).withColumn("model", F.lit(f"{objective}_calibrated")))
    if practice is not None:
        mixed = practice_blend(base, practice, [race, entry], "__s").withColumn("__s", F.col("blended")).drop("blended")
        made.append(mixed.join(fit(mixed, "winner"), race).withColumn("model", F.lit("practice_blend")))
    rows = made[0]
    for m in made[1:]:
        rows = rows.unionByName(m)
    w = Window.partitionBy("model", race)
    e = F.exp((F.col("__s") - F.max("__s").over(w)) / F.col("temperature"))
    rows = rows.withColumn("__e", e).withColumn("win_probability", F.col("__e") / F.sum("__e").over(w)).drop("__e").withColumnRenamed("__s", "candidate_score")
    metrics = race_metrics(rows, ["model", race], entry, "candidate_score", position, "win_probability", classified)
    return rows, metrics, leaderboard(metrics, "model", ["ndcg5", "spearman", "winner_logloss"])
