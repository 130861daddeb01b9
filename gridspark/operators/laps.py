"""Lap, stint and corner summaries, per group of rows; NULL values never count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import beta_rate, clip
from ..staging import staged
from .order import percent_ranks, with_index

# Apex speeds in km/h at which a corner stops being slow, and medium.
SLOW, MEDIUM = 140, 220


def fuel_corrected(df: DataFrame, group: list[str], lap: str, time: str, slope: float = -0.035, name: str = "corrected") -> DataFrame:
    """Times as with the fuel of the group's first lap."""
    return df.withColumn(name, F.col(time) - slope * (F.col(lap) - F.min(lap).over(Window.partitionBy(*group))))


def track_evolution(df: DataFrame, group: list[str], clock: str, time: str, bins: int = 8, least: int = 4, name: str = "evolved") -> DataFrame:
    """Times less what the track cost in their part of the session: the part's median over the best part's.

    Parts are quantiles of the clock, min(bins, rows) of them, equal edges merged; under `least` rows times stay.
    One aggregate finds the edges for every possible count of parts.
    """
    shares = sorted({k / q for q in range(least, bins + 1) for k in range(1, q)})
    valid = df.where(F.col(clock).isNotNull() & F.col(time).isNotNull())
    edges = valid.groupBy(*group).agg(F.count("*").alias("__n"), F.percentile(clock, shares).alias("__all"))
    pick = F.array()
    for q in range(least, bins + 1):
        mine = F.array(*[F.col("__all")[shares.index(k / q)] for k in range(1, q)])
        pick = F.when(F.least("__n", F.lit(bins)) == q, F.array_distinct(mine)).otherwise(pick)
    rows = df.join(edges.select(*group, pick.alias("__edges")), group, "left")
    part = F.when(F.col(clock).isNotNull() & F.col(time).isNotNull(), F.size(F.filter("__edges", lambda e: e < F.col(clock))))
    rows = rows.withColumn("__part", part)
    medians = rows.where("__part IS NOT NULL").groupBy(*group, "__part").agg(F.median(time).alias("__median"))
    medians = medians.withColumn("__best", F.min("__median").over(Window.partitionBy(*group)))
    shift = F.when(F.size("__edges") > 0, F.col("__median") - F.col("__best")).otherwise(0.0)
    return rows.join(medians, [*group, "__part"], "left").select(*df.columns, (F.col(time) - shift).alias(name))


def warmup_laps(df: DataFrame, group: list[str], order: str, time: str, tolerance: float = 0.2) -> DataFrame:
    """The first lap within the tolerance of the later half's median; the last one if none is; NULL under three laps."""
    w = Window.partitionBy(*group)
    rows = df.where(F.col(time).isNotNull()).withColumn("__k", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count("*").over(w))
    late = F.col("__k") > F.greatest(F.floor(F.col("__n") / 2), F.lit(2))
    rows = rows.withColumn("__steady", F.median(F.when(late, F.col(time))).over(w))
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min(F.when(F.col(time) <= F.col("__steady") + tolerance, F.col("__k"))).alias("first"))
    return out.select(*group, "n", F.when(F.col("n") >= 3, F.coalesce("first", "n")).cast("long").alias("warmup"))


def wet_residual(df: DataFrame, driver: str, car: str, pace: str, wet: Column) -> DataFrame:
    """Mean advantage of each driver over their car's mean in the wet; positive is faster.

    Sums per (car, driver) carry all that both means need, so rows are shuffled once.
    """
    cells = df.where(wet & F.col(pace).isNotNull()).groupBy(car, driver).agg(F.sum(pace).alias("s"), F.count("*").alias("n"))
    by_car = Window.partitionBy(car)
    cells = cells.withColumn("m", F.sum("s").over(by_car) / F.sum("n").over(by_car))
    return cells.groupBy(driver).agg(F.sum("n").alias("n"), (-F.sum(F.col("s") - F.col("n") * F.col("m")) / F.sum("n")).alias("residual"))


def dirty_air_penalty(df: DataFrame, group: list[str], pace: str, gap: str, clean_from: float = 2.0) -> DataFrame:
    """Mean pace behind another car less the mean in clean air; NULL where either is missing."""
    rows = df.where(F.col(pace).isNotNull() & F.col(gap).isNotNull())
    mean = lambda near: F.avg(F.when((F.col(gap) < clean_from) == F.lit(near), F.col(pace)))
    return rows.groupBy(*group).agg((mean(True) - mean(False)).alias("penalty"))


def practice_summary(df: DataFrame, driver: str, stint: str, time: str, best: int = 3, least: int = 5) -> DataFrame:
    """Median of each driver's best laps, and the mean of the medians of stints with enough laps."""
    rows = df.select(driver, stint, time)
    top = rows.where(F.col(time).isNotNull()).withColumn("__k", F.row_number().over(Window.partitionBy(driver).orderBy(time))).where(F.col("__k") <= best)
    single = top.groupBy(driver).agg(F.median(time).alias("single_lap_pace"))
    runs = rows.where(F.col(stint).isNotNull()).groupBy(driver, stint).agg(F.count(time).alias("n"), F.median(time).alias("m")).where(F.col("n") >= least)
    long_ = runs.groupBy(driver).agg(F.avg("m").alias("long_run_pace"))
    return rows.select(driver).distinct().join(single, driver, "left").join(long_, driver, "left")


def rolling_rate(df: DataFrame, group: list[str], order: str, failed: str, window: int = 10, name: str = "rate") -> DataFrame:
    """Smoothed rate of failures in the rows before; NULL for a group's first row."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(-window, -1)
    n = F.count(failed).over(w)
    return df.withColumn(name, F.when(n > 0, beta_rate(F.sum(failed).over(w), n)))


def _classes(speed: str) -> dict[str, Column]:
    s = F.col(speed)
    return {"low": s < SLOW, "medium": (s >= SLOW) & (s < MEDIUM), "high": s >= MEDIUM}


def demand_vector(df: DataFrame, group: list[str], speed: str, means: dict[str, str]) -> DataFrame:
    """Shares of corners by speed class, of all corners, and means of measures (name: column)."""
    shares = [(F.count(F.when(c, 1)) / F.count("*")).alias(f"{k}_speed_share") for k, c in _classes(speed).items()]
    return df.groupBy(*group).agg(*shares, *[F.avg(c).alias(k) for k, c in means.items()])


def track_vector(df: DataFrame, group: list[str], corner: str, speed: str, means: dict[str, str]) -> DataFrame:
    """The demand vector of the medians of each corner over all laps and drivers."""
    per = df.groupBy(*group, corner).agg(*[F.median(c).alias(c) for c in sorted({speed, *means.values()})])
    return demand_vector(per, group, speed, means)


def capability_vector(df: DataFrame, group: list[str], speed: str, performance: str, means: dict[str, str], strength: float = 8.0, prior: dict[str, float] | None = None) -> DataFrame:
    """Means shrunk toward a prior, by default the dimension's own median; 0 without any value and prior."""
    parts = {f"{k}_speed": F.when(c, F.col(performance)) for k, c in _classes(speed).items()} | {k: F.col(c) for k, c in means.items()}
    out = []
    for k, x in parts.items():
        p = F.lit(float(prior[k])) if prior and k in prior else F.coalesce(F.median(x), F.lit(0.0))
        out.append(F.when(F.count(x) > 0, (F.sum(x) + strength * p) / (F.count(x) + strength)).otherwise(p).alias(k))
    return df.groupBy(*group).agg(*out)


def driver_corners(df: DataFrame, driver: str, speed: str, performance: str, means: dict[str, str]) -> DataFrame:
    """Means of measures, and of the performance by speed class; here a class holds its upper bound."""
    s = F.col(speed)
    classes = {"low": s <= SLOW, "medium": (s > SLOW) & (s <= MEDIUM), "high": s > MEDIUM}
    return df.groupBy(driver).agg(*[F.avg(c).alias(k) for k, c in means.items()], *[F.avg(F.when(c, F.col(performance))).alias(f"{k}_speed_performance") for k, c in classes.items()])


def transfer_difficulty(profiles: DataFrame, venue: str, family: str, wanted: bool, analogues: list[str] = (), least: int = 3, fallback: float = 0.5) -> DataFrame:
    """One row (difficulty, source): the median of named analogues, two at least, else of the family, else the fallback."""
    have = profiles.where(F.col("n_events") >= least)
    near, kin = F.col(venue).isin(list(analogues)), F.col(family) == F.lit(wanted)
    found = have.agg(
        F.count(F.when(near, 1)).alias("n"), F.median(F.when(near, F.col("difficulty"))).alias("a"), F.median(F.when(kin, F.col("difficulty"))).alias("f"),
        F.array_join(F.sort_array(F.collect_list(F.when(near, F.col(venue)))), ",").alias("names"),
    )
    named = F.col("n") >= 2
    source = F.when(named, F.concat(F.lit("analogues="), F.col("names"))).when(F.col("f").isNotNull(), f"family={str(wanted).lower()}").otherwise("default")
    return found.select(F.when(named, F.col("a")).otherwise(F.coalesce("f", F.lit(fallback))).alias("difficulty"), source.alias("source"))


def measured_difficulty(rates: DataFrame, venue: str, rate: str) -> DataFrame:
    """One less the percentile rank of a passing rate, clipped; no row for fewer than two venues."""
    known = staged(rates.where(F.col(rate).isNotNull()), "rates")
    out = percent_ranks(known, rate, "__share").join(F.broadcast(known.agg(F.count("*").alias("__n")))).where("__n >= 2")
    return out.withColumn("difficulty", clip(1 - F.col("__share"), 0.02, 0.98)).drop("__share", "__n")


def projected_entries(results: DataFrame, entrant: list[str], index: str, season: str) -> DataFrame:
    """Entrants of the event before, as the field of every event but a season's first."""
    events = results.select(F.col(index).alias("__i"), F.col(season).alias("__s")).distinct()
    placed = with_index(events, ["__i"], "__k")
    after = placed.select((F.col("__k") - 1).alias("__k"), F.col("__i").alias("target"), F.col("__s").alias("__next"))
    follow = placed.join(after, "__k").where(F.col("__s") == F.col("__next")).select("__i", "target")
    return results.select(*entrant, F.col(index).alias("__i")).distinct().join(follow, "__i").select("target", *entrant)
