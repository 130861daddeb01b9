"""Weighted estimators as aggregates: rates, hazards, effects, profiles, similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import average_rank, clip, logit, recency_weight
from ..staging import staged
from .order import percent_ranks, quantiles


def weighted_mean(df: DataFrame, group: list[str], value: str, weight: Column, name: str = "mean") -> DataFrame:
    return df.groupBy(*group).agg(F.try_divide(F.sum(weight * F.col(value)), F.sum(weight)).alias(name), F.sum(weight).alias("weight"))


def as_of_weight(index: str, as_of: float, half_life: float, regime: str | None = None, target: str | None = None, cross: float = 0.35) -> Column:
    """Recency weight of a row before the target event, less in another regime; later rows must be filtered out."""
    w = recency_weight(F.col(index), as_of, half_life)
    return w * F.when(F.col(regime) == target, 1.0).otherwise(cross) if regime else w


def fit_hazards(df: DataFrame, team: str, driver: str, failed: str, index: str, as_of: float, half_life: float = 12.0, alpha: float = 1.2, beta: float = 12.0, shrink: float = 6.0, started: str | None = None, regime: str | None = None, target: str | None = None) -> DataFrame:
    """Per driver: base rate, team rate, driver rate and log-odds excess, from recency-weighted counts of starters in
    events before as_of."""
    w = as_of_weight(index, as_of, half_life, regime, target)
    history = df.where(F.col(index) < as_of)
    history = history.where(F.col(started) == 1) if started else history
    rows = history.select(F.col(team).alias("team"), F.col(driver).alias("driver"), F.col(failed).cast("double").alias("y"), w.alias("w")).where("w > 1e-6")
    cells = rows.groupBy("team", "driver").agg(F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("w"))
    base = cells.agg(F.try_divide(F.sum("wy"), F.sum("w")).alias("base"))
    mass = alpha + beta
    teams = cells.groupBy("team").agg(F.sum("wy").alias("wy"), F.sum("w").alias("w")).join(F.broadcast(base))
    teams = teams.select("team", "base", ((F.col("wy") + mass * F.col("base")) / (F.col("w") + mass)).alias("team_rate"))
    per = cells.join(teams, "team").groupBy("driver").agg(
        F.first("base").alias("base"), F.sum("wy").alias("wy"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("team_rate")).alias("we")
    )
    expected = F.col("we") / F.col("w")
    rate = (F.col("wy") + shrink * expected) / (F.col("w") + shrink)
    return per.select("driver", "base", expected.alias("expected"), rate.alias("rate"), (logit(rate) - logit(expected)).alias("excess"))


def rate_multipliers(df: DataFrame, group: str, failed: str, pseudo: float = 80.0, started: str | None = None) -> DataFrame:
    """group, n, rate, multiplier over starters, shrunk to the base rate by pseudo entries."""
    df = df.where(F.col(started) == 1) if started else df
    per = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("double")).alias("y"))
    base = df.agg(F.avg(F.col(failed).cast("double")).alias("base"))
    rate = (F.col("y") + pseudo * F.col("base")) / (F.col("n") + pseudo)
    return per.join(F.broadcast(base)).select(group, F.col("n"), rate.alias("rate"), F.try_divide(rate, F.col("base")).alias("multiplier"))


def family_multiplier(df: DataFrame, family: str, failed: str, started: str | None = None, least: int = 100) -> DataFrame:
    """family, n, multiplier: a family's failure rate over the base rate; 1 under `least` rows or without a base."""
    df = df.where(F.col(started) == 1) if started else df
    y = F.col(failed).cast("double")
    per = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.count("*").alias("n"), F.avg(y).alias("rate"))
    ratio = F.try_divide(F.col("rate"), F.col("base"))
    return per.join(F.broadcast(df.agg(F.avg(y).alias("base")))).select(family, "n", F.when((F.col("n") >= least) & (F.col("base") > 0), ratio).otherwise(1.0).alias("multiplier"))


def spearman(df: DataFrame, group: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Rank correlation by group, by average ranks; NULL under `least` rows or without spread."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__x", average_rank(x, group)).withColumn("__y", average_rank(y, group))
    spread = (F.stddev_pop("__x") > 0) & (F.stddev_pop("__y") > 0) & (F.count("*") >= least)
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), F.when(spread, F.corr("__x", "__y")).alias("rho"), F.avg(F.abs(F.col("__x") - F.col("__y"))).alias("mean_change"))


def difficulty(per_event: DataFrame, venue: str, least: int = 3) -> DataFrame:
    """Per venue: medians of rank correlation and change over events with a correlation, and their percentile ranks'
    mean, clipped.

    Medians and ranks are exact and of any size: no venue's events and not all venues meet in one task.  Venues with fewer than `least` such events have no difficulty, unless no venue has as many: then all have one.
    """
    valid = per_event.where(F.col(venue).isNotNull() & F.col("rho").isNotNull())
    per = staged(quantiles(valid, [venue], {"rho": ("rho", 0.5), "mean_change": ("mean_change", 0.5)}, "n_events"), "venue-medians")
    enough = per.agg((F.coalesce(F.max("n_events"), F.lit(0)) >= least).alias("__any"))
    per = per.join(F.broadcast(enough)).withColumn("__ok", (F.col("n_events") >= least) | ~F.col("__any"))
    for c in ("rho", "mean_change"):
        per = percent_ranks(per, c, f"__r_{c}", F.col("__ok"))
    score = (F.col("__r_rho") + 1 - F.col("__r_mean_change")) / 2
    return per.select(venue, "rho", "mean_change", "n_events", F.when(F.col("__ok"), clip(score, 0.02, 0.98)).alias("difficulty"))


def z_scores(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """df with z_<column>: population standard deviation, 1 where there is none.  Without a group, means and deviations
    are one row of aggregates, so no task holds the whole table."""
    named = [(c, F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}")) for c in columns]
    if group:
        w = Window.partitionBy(*group)
        out = df.select("*", *[x.over(w).alias(n) for c in columns for x, n in ((F.avg(c), f"__m_{c}"), (F.stddev_pop(c), f"__s_{c}"))])
    else:
        out = df.join(F.broadcast(df.agg(*[x for _, m, s in named for x in (m, s)])))
    z = lambda c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
    return out.select(*df.columns, *[z(c).alias(f"z_{c}") for c in columns])


def nearest(pool: DataFrame, key: str, target, columns: list[str], k: int) -> DataFrame:
    """The k rows nearest to the target row in z-score space, ties by key: a top-k, not a sort."""
    z = z_scores(pool, columns)
    t = z.where(F.col(key) == target).select(*[F.col(f"z_{c}").alias(f"t_{c}") for c in columns])
    distance = F.sqrt(sum(((F.col(f"z_{c}") - F.col(f"t_{c}")) ** 2 for c in columns), F.lit(0.0)))
    return z.where(F.col(key) != target).join(F.broadcast(t)).select(key, distance.alias("distance")).orderBy("distance", key).limit(k)


def kernel_similarity(pool: DataFrame, key: str, target, columns: list[str], family: str, bandwidth: float = 1.0, bonus: float = 0.35) -> DataFrame:
    z = z_scores(pool, columns)
    t = z.where(F.col(key) == target).select(F.col(family).alias("t_family"), *[F.col(f"z_{c}").alias(f"t_{c}") for c in columns])
    d2 = sum(((F.col(f"z_{c}") - F.col(f"t_{c}")) ** 2 for c in columns), F.lit(0.0))
    d2 = F.greatest(d2 - F.when(F.col(family) == F.col("t_family"), bonus).otherwise(0.0), F.lit(0.0))
    return z.join(F.broadcast(t)).select(key, F.exp(-d2 / (2 * bandwidth * bandwidth)).alias("similarity"))


def similarity_weights(observations: DataFrame, similarity: DataFrame, key: str, floor: float = 0.15) -> DataFrame:
    middle = similarity.agg(F.median("similarity").alias("__median"))
    out = observations.join(similarity.select(key, "similarity"), key, "left").join(F.broadcast(middle))
    return out.withColumn("weight", F.greatest(F.coalesce("similarity", "__median"), F.lit(floor))).drop("__median", "similarity")


def robust_z(df: DataFrame, value: str, group: list[str], name: str = "robust_z") -> DataFrame:
    w = Window.partitionBy(*group)
    out = df.withColumn("__m", F.median(value).over(w)).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    mad = 1.4826 * F.median("__d").over(w)
    return out.withColumn(name, (F.col(value) - F.col("__m")) / F.when(mad > 1e-9, mad).otherwise(1.0)).drop("__m", "__d")


def pace_gap(df: DataFrame, group: list[str], lead: str, fallback: str, low: float = 0.0, high: float = 8.0) -> DataFrame:
    """Gap in percent to the group's best lead time, else to the best fallback time; gaps outside [low, high] are NULL.

    A best time of 0 has no finite gap to it: its group keeps that source, and no gap."""
    w = Window.partitionBy(*group)

    def gap(c):
        best = F.min(c).over(w)
        return F.when(best != 0, 100 * (F.col(c) - best) / best).when(F.col(c).isNotNull(), float("nan"))

    value = F.coalesce(gap(lead), gap(fallback))
    source = F.when(gap(lead).isNotNull(), "lead").when(gap(fallback).isNotNull(), "fallback")
    return df.withColumn("gap_pct", F.when(value.between(low, high), value)).withColumn("gap_source", source)


def backfit(df: DataFrame, team: str, driver: str, value: str, index: str, as_of: float, team_half_life: float = 6.0, driver_half_life: float = 6.0, ridge: float = 1.0, shrink: float = 3.0, passes: int = 4, regime: str | None = None, target: str | None = None) -> DataFrame:
    """driver, team, effects by backfitting on cell sums of the rows before as_of: (team, driver) cells carry all that
    the passes need.

    Weighted sums per cell are aggregated once and written down, and so are the cells after each pass, which is two
    windows and one row of sums: the fact table is read once, and the plan of a pass does not hold the one before.
    """
    wt, wd = as_of_weight(index, as_of, team_half_life, regime, target), as_of_weight(index, as_of, driver_half_life, regime, target)
    rows = df.where((F.col(index) < as_of) & F.col(value).isNotNull()).where((wt > 1e-6) | (wd > 1e-6))
    cell = rows.groupBy(F.col(team).alias("team"), F.col(driver).alias("driver")).agg(
        F.sum(wt).alias("wt"), F.sum(wt * F.col(value)).alias("wty"), F.sum(wd).alias("wd"), F.sum(wd * F.col(value)).alias("wdy")
    )
    cell = staged(cell, "backfit-cells")
    start = cell.agg((F.sum("wty") / F.sum("wt")).alias("mu"), F.sum("wd").alias("all"))
    cell = cell.join(F.broadcast(start)).withColumn("t", F.lit(0.0)).withColumn("d", F.lit(0.0))
    by_team, by_driver = Window.partitionBy("team"), Window.partitionBy("driver")
    for _ in range(passes):
        cell = cell.withColumn("t", F.sum(F.col("wty") - F.col("wt") * (F.col("mu") + F.col("d"))).over(by_team) / (F.sum("wt").over(by_team) + ridge))
        cell = cell.withColumn("d", F.sum(F.col("wdy") - F.col("wd") * (F.col("mu") + F.col("t"))).over(by_driver) / (F.sum("wd").over(by_driver) + ridge))
        cell = staged(cell, "backfit-pass")
        centre = cell.agg((F.sum(F.col("wd") * F.col("d")) / F.first("all")).alias("s"))
        cell = cell.join(F.broadcast(centre)).withColumn("d", F.col("d") - F.col("s")).withColumn("mu", F.col("mu") + F.col("s")).drop("s")
    n = F.sum("wd").over(by_driver)
    return cell.select(
        "team", "driver", F.col("mu").alias("intercept"), F.col("t").alias("team_effect"), F.col("d").alias("driver_effect"),
        (F.col("d") * n / (n + shrink)).alias("driver_shrunk"), n.alias("driver_weight"))


