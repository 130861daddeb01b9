"""Retirement as a beta-binomial hierarchy: a prior from all past team and regime counts, a posterior per team."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import ContractError
from .search import simplex

#: Distinct (failed, starts) pairs that the likelihood may take on the driver.
MOST_PAIRS = 2_000_000
BOUNDS = ((-12.0, 12.0), (math.log(1e-3), math.log(1e6)))


@dataclass(frozen=True)
class Retirement:
    """teams: team, a, b of the target regime's teams; others have the prior (alpha, beta)."""

    teams: DataFrame
    alpha: float
    beta: float
    last_training_index: float
    converged: bool
    at_boundary: bool


def _log_beta(a, b):
    gamma = np.vectorize(math.lgamma)
    return gamma(a) + gamma(b) - gamma(a + b)


def fit_retirement(results: DataFrame, team: str, failed: str, started: str, regime: str, index: str, as_of: float, target: str) -> Retirement:
    """Fit on starters before as_of; earlier regimes shape the prior but not a team's own count.

    Counts by regime and team are aggregated in Spark; the likelihood needs each distinct (failed, starts) pair once
    with how often it occurs.
    """
    past = results.where((F.col(index) < as_of) & (F.col(started) == 1))
    y = F.col(failed).cast("double")
    counts = past.groupBy(F.col(regime).alias("regime"), F.col(team).alias("team")).agg(F.sum(y).alias("f"), F.count("*").alias("n"), F.max(index).alias("last"), F.bool_and(y.isin(0.0, 1.0)).alias("ok"))
    counts = counts.where("team IS NOT NULL AND regime IS NOT NULL")
    groups, last, valid = counts.agg(F.count("*"), F.max("last"), F.bool_and("ok")).first()
    if groups < 3 or not valid:
        raise ContractError("at least three earlier team and regime groups with valid outcomes are required")
    pairs = counts.groupBy("f", "n").agg(F.count("*").alias("times"))
    if pairs.count() > MOST_PAIRS:
        raise ContractError("too many distinct counts for the likelihood")
    p = pairs.toPandas().astype(float)
    f, n, times = (p[c].to_numpy() for c in ("f", "n", "times"))

    def loss(x: np.ndarray) -> float:
        if any(not low <= v <= high for v, (low, high) in zip(x, BOUNDS)):
            return math.inf
        mu, k = 1 / (1 + math.exp(-x[0])), math.exp(x[1])
        a, b = mu * k, (1 - mu) * k
        return -float((times * (_log_beta(a + f, b + n - f) - _log_beta(a, b))).sum())

    rate = min(max((times * f).sum() / (times * n).sum(), 1e-5), 1 - 1e-5)
    fits = [simplex(loss, [math.log(rate / (1 - rate)), math.log(k)]) for k in (10, 100)]
    x, _, _, done = min(fits, key=lambda fit: fit[1])
    mu, k = 1 / (1 + math.exp(-x[0])), math.exp(x[1])
    a, b = mu * k, (1 - mu) * k
    now = counts.where(F.col("regime") == target).select("team", (F.lit(a) + F.col("f")).alias("a"), (F.lit(b) + F.col("n") - F.col("f")).alias("b"))
    edge = any(abs(v - e) < 1e-3 for v, bound in zip(x, BOUNDS) for e in bound)
    return Retirement(now, a, b, float(last), done, edge)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for positive numbers, to about 1e-10: the argument is raised by eight, then Stirling."""
    up = x + 8.0
    series = 1 / (12.0 * up) - 1 / (360.0 * up * up * up) + 1 / (1260.0 * up * up * up * up * up) - 1 / (1680.0 * up * up * up * up * up * up * up)
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.ln(x + float(k))
    return (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + series - shift


def retirement_probabilities(entries: DataFrame, fit: Retirement, race: list[str], team: str, one_finishes: bool = False) -> DataFrame:
    """entries with retire_probability: the team's posterior mean, or given that at least one entry of the race finishes.

    A team's entries share its rate, so the chance that all retire is a product over teams of beta ratios.
    """
    own = fit.teams.select(F.col("team").alias("__t"), F.col("a").alias("__a"), F.col("b").alias("__b"))
    out = entries.join(own, F.col(team) == F.col("__t"), "left")
    out = out.select(*entries.columns, F.coalesce("__a", F.lit(fit.alpha)).alias("__a"), F.coalesce("__b", F.lit(fit.beta)).alias("__b"))
    mean = F.col("__a") / (F.col("__a") + F.col("__b"))
    if not one_finishes:
        return out.select(*entries.columns, mean.alias("retire_probability"))
    per = out.groupBy(*race, team).agg(F.count("*").cast("double").alias("m"), F.first("__a").alias("a"), F.first("__b").alias("b"))
    ratio = log_gamma(F.col("a") + F.col("m")) - log_gamma(F.col("a")) + log_gamma(F.col("a") + F.col("b")) - log_gamma(F.col("a") + F.col("b") + F.col("m"))
    none = per.groupBy(*race).agg(F.exp(F.sum(ratio)).alias("__none"))
    p = (mean - F.col("__none")) / (1 - F.col("__none"))
    return out.join(none, race).select(*entries.columns, p.alias("retire_probability"))
