"""Joint ridge strengths with their covariance, scoring of entries, one-lap and race-trim halves, race pace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .estimators import as_of_weight, pace_gap
from .ridge import Ridge, solve

#: Percent of lap time for one unit of score.
SCALE = 0.75


@dataclass(frozen=True)
class Strength:
    """teams: team, team_effect, n_obs, effect_se; drivers: driver, driver_effect, shrunk_effect, n_obs, effect_se; system
    has their covariances; and what holds for all."""

    teams: DataFrame
    drivers: DataFrame
    n_observations: int
    intercept: float = 0.0
    residual_sd: float | None = None
    system: Ridge | None = None
    teams_are_small: bool = True

    def covariances(self, pairs: DataFrame) -> DataFrame:
        """(team, driver, covariance) of two effects, for pairs (team, driver) of known levels; others have no row."""
        if self.system is None:
            return pairs.sparkSession.createDataFrame([], "team string, driver string, covariance double")
        small, large = ("team", "driver") if self.teams_are_small else ("driver", "team")
        i = self.system.small.select("i", F.col("level").alias(small))
        b = self.system.large.select("b", F.col("level").alias(large))
        known = pairs.select("team", "driver").distinct().join(i, small).join(b, large)
        return self.system.covariances(known.select("b", "i")).join(known, ["b", "i"]).select("team", "driver", "covariance")


def _empty(spark, n: int = 0) -> Strength:
    make = lambda schema: spark.createDataFrame([], schema)
    return Strength(
        make("team string, team_effect double, n_obs double, effect_se double"),
        make("driver string, driver_effect double, shrunk_effect double, n_obs double, effect_se double"), n)


def fit_ridge(df: DataFrame, team: str, driver: str, value: str, index: str, as_of: float, half_life: float = 6.0, ridge: float = 1.0, shrink: float = 3.0, kinds: dict[str, float] | None = None, kind: str = "kind", regime: str | None = None, target: str | None = None, multiplier: Column | None = None) -> Strength:
    """The joint weighted ridge of team and driver effects over rows before as_of, with an unpenalised intercept.

    Rows are summed to (team, driver) cells; ridge.solve takes the system from those, whatever the number of levels.  No
    rows, or fewer than two drivers, give the neutral estimate; a NULL team or driver has no effect and is left out.
    """
    w = as_of_weight(index, as_of, half_life, regime, target)
    if kinds:
        known = F.coalesce(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col(kind)], F.lit(0.5))
        w = w * known
    w = w * F.coalesce(multiplier, F.lit(1.0)) if multiplier is not None else w
    rows = df.where((F.col(index) < as_of) & F.col(value).isNotNull() & F.col(team).isNotNull() & F.col(driver).isNotNull())
    rows = rows.select(F.col(team).cast("string").alias("team"), F.col(driver).cast("string").alias("driver"), F.col(value).cast("double").alias("y"), w.alias("w")).where("w > 1e-6")
    cells = rows.groupBy("team", "driver").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"))
    cells = staged(cells, "ridge-cells")
    levels = cells.agg(F.countDistinct("team").alias("t"), F.countDistinct("driver").alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if levels["d"] < 2:
        return _empty(df.sparkSession, levels["n"])
    few = levels["t"] <= levels["d"]
    fit = solve(cells, *(("team", "driver") if few else ("driver", "team")), ridge)
    teams, drivers = (fit.small, fit.large) if few else (fit.large, fit.small)
    n = F.col("weight")
    named = lambda f, kind, *more: f.select(F.col("level").alias(kind), F.col("effect").alias(f"{kind}_effect"), *more, n.alias("n_obs"), F.sqrt(F.greatest("variance", F.lit(0.0))).alias("effect_se"))
    return Strength(named(teams, "team"), named(drivers, "driver", (F.col("effect") * n / (n + shrink)).alias("shrunk_effect")), levels["n"], fit.intercept, fit.variance**0.5, fit, few)


def score_entries(entries: DataFrame, teams: DataFrame, drivers: DataFrame, team: str, driver: str, rookie_penalty: float = -0.25) -> DataFrame:
    """entries with team_effect, driver_effect, driver_obs_weight, is_rookie and strength.

    teams has (team, team_effect) and drivers (driver, shrunk_effect, n_obs).  An unseen team counts as the field's
    mean; an unseen driver is a rookie, with the penalty for an effect.
    """
    t = teams.select(F.col("team").alias("__t"), F.col("team_effect").alias("__te"))
    d = drivers.select(F.col("driver").alias("__d"), F.col("shrunk_effect").alias("__de"), F.col("n_obs").alias("__n"))
    out = entries.join(t, F.col(team) == F.col("__t"), "left").join(d, F.col(driver) == F.col("__d"), "left")
    out = out.select(
        *entries.columns, F.coalesce("__te", F.lit(0.0)).alias("team_effect"), F.coalesce("__de", F.lit(rookie_penalty)).alias("driver_effect"),
        F.coalesce("__n", F.lit(0.0)).alias("driver_obs_weight"), F.col("__de").isNull().alias("is_rookie"))
    return out.withColumn("strength", F.col("team_effect") + F.col("driver_effect"))


def strength_variance(entries: DataFrame, strength: Strength, team: str, driver: str) -> DataFrame:
    """entries with strength_se: the standard error of team plus driver effect, with their covariance.

    With one side unseen, its variance is the largest of any effect; with both, the largest alone.
    """
    t = strength.teams.select(F.col("team").alias("__t"), F.pow("effect_se", F.lit(2)).alias("__tv"))
    d = strength.drivers.select(F.col("driver").alias("__d"), F.pow("effect_se", F.lit(2)).alias("__dv"))
    asked = entries.select(F.col(team).cast("string").alias("team"), F.col(driver).cast("string").alias("driver"))
    p = strength.covariances(asked).select(F.col("team").alias("__pt"), F.col("driver").alias("__pd"), "covariance")
    top = strength.teams.select("effect_se").unionByName(strength.drivers.select("effect_se")).agg(F.pow(F.max("effect_se"), F.lit(2)).alias("__top"))
    out = entries.join(t, F.col(team) == F.col("__t"), "left").join(d, F.col(driver) == F.col("__d"), "left")
    out = out.join(p, (F.col("__t") == F.col("__pt")) & (F.col("__d") == F.col("__pd")), "left").join(F.broadcast(top))
    both = F.col("__tv") + F.col("__dv") + 2 * F.col("covariance")
    var = F.coalesce(both, F.col("__tv") + F.col("__top"), F.col("__dv") + F.col("__top"), F.col("__top"))
    return out.select(*entries.columns, F.sqrt(F.greatest(var, F.lit(0.0))).alias("strength_se"))


@dataclass(frozen=True)
class DualStrength:
    """One-lap and race-trim strengths, each from its own kind of observations."""

    qualifying: Strength
    race: Strength

    @property
    def n_observations(self) -> int:
        return self.qualifying.n_observations + self.race.n_observations


def fit_dual(observations: DataFrame, team: str, driver: str, value: str, index: str, as_of: float, kind: str = "kind", **options) -> DualStrength:
    half = lambda k: fit_ridge(observations.where(F.col(kind) == k), team, driver, value, index, as_of, **options)
    return DualStrength(half("qualifying"), half("race"))


def score_dual(entries: DataFrame, dual: DualStrength, race: str, team: str, driver: str, rookie_penalty: float = -0.25) -> DataFrame:
    """entries with qual_strength, race_strength, strength (their mean), is_rookie (in either) and both as z-scores
    within the race, where no spread counts as 1."""
    names = {"strength": "qual_strength", "is_rookie": "__qr", "driver_obs_weight": "__qn"}
    q = score_entries(entries, dual.qualifying.teams, dual.qualifying.drivers, team, driver, rookie_penalty)
    q = q.select(*entries.columns, *[F.col(a).alias(b) for a, b in names.items()])
    r = score_entries(q, dual.race.teams, dual.race.drivers, team, driver, rookie_penalty)
    out = r.select(
        *entries.columns, "qual_strength", F.col("strength").alias("race_strength"), "team_effect", (F.col("__qr") | F.col("is_rookie")).alias("is_rookie"),
        F.least("__qn", "driver_obs_weight").alias("driver_obs_weight"), (0.5 * (F.col("qual_strength") + F.col("strength"))).alias("strength"))
    return race_z(out, race, ["qual_strength", "race_strength"])


def race_z(df: DataFrame, race: str, columns: list[str]) -> DataFrame:
    """df with <column>_z within the race, by the population's standard deviation, 1 where there is none."""
    w = Window.partitionBy(race)
    sd = lambda c: F.stddev_pop(c).over(w)
    return df.select("*", *[((F.col(c) - F.avg(c).over(w)) / F.when(sd(c) > 1e-9, sd(c)).otherwise(1.0)).alias(f"{c}_z") for c in columns])


def race_pace(results: DataFrame, race: str, laps: str, total_ms: str, fastest: str, classified: str = "classified") -> DataFrame:
    """Classified rows with gap_pct, gap_source and score: total time a lap of those on the lead lap, else the fastest
    lap, as a gap to the race's best; scores are centred within the race."""
    w = Window.partitionBy(race)
    n, total = F.col(laps).try_cast("double"), F.col(total_ms).try_cast("double")
    rows = results.where(F.col(classified) == 1).withColumn("__lead", F.max(n).over(w))
    rows = rows.withColumn("__lap", F.when((n == F.col("__lead")) & total.isNotNull(), total / F.greatest(n, F.lit(1.0)))).withColumn("__fast", F.col(fastest).try_cast("double"))
    out = pace_gap(rows, [race], "__lap", "__fast").drop("__lead", "__lap", "__fast")
    score = -F.col("gap_pct") / SCALE
    return out.withColumn("gap_source", F.coalesce("gap_source", F.lit("none"))).withColumn("score", score - F.avg(score).over(w))


def pace_coverage(paced: DataFrame, season: str) -> DataFrame:
    """Per season: classified rows, how many each source measures, how many have no usable gap, and the median gap."""
    count = lambda c: F.count(F.when(c, 1))
    return paced.groupBy(season).agg(
        F.count("*").alias("classified"), count(F.col("gap_source") == "lead").alias("race_time"), count(F.col("gap_source") == "fallback").alias("fastest_lap"),
        count(F.col("gap_pct").isNull()).alias("unusable"), F.median("gap_pct").alias("median_gap_pct"))
