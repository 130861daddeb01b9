"""Venues: speed profiles, counted passes, pit loss, joined profiles, and the cascade that settles a target's context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..staging import staged
from .estimators import nearest
from .guards import ContractError
from .order import percent_ranks, quantiles

#: Regulated race distance in metres; venues may differ.
DISTANCE = 305_000.0


def speed_profile(results: DataFrame, qualifying: DataFrame, venue: str, race: str, since: int = 2018, shorter: dict[str, float] | None = None) -> DataFrame:
    """venue, lap_length_m, pole_time_s, avg_lap_speed_kmh, field_spread_pct: medians over races since a season.

    The lap's length is the regulated distance over the winner's laps; the pole time is a race's best qualifying time.
    What is read more than once is written down first: of one table given as both, its rows are made once.
    """
    one = results is qualifying
    qualifying = qualifying.where((F.col("season") >= since) & F.col(venue).isNotNull())
    qualifying = staged(qualifying.select(venue, race, "season", "qual_best_s", "qual_gap_pct", *(["winner", "laps"] if one else [])), "venue-qualifying")
    results = qualifying if one else results
    own = F.create_map(*[F.lit(x) for pair in shorter.items() for x in pair])[F.col(venue)] if shorter else F.lit(None).cast("double")
    won = results.where((F.col("season") >= since) & (F.col("winner") == 1) & F.col(venue).isNotNull())
    won = won.select(venue, (F.coalesce(own, F.lit(DISTANCE)) / F.greatest(F.col("laps"), F.lit(1.0))).alias("__l"))
    length = quantiles(won, [venue], {"lap_length_m": ("__l", 0.5)})
    pole = quantiles(qualifying.groupBy(venue, race).agg(F.min("qual_best_s").alias("__p")), [venue], {"pole_time_s": ("__p", 0.5)})
    spread = quantiles(qualifying, [venue], {"field_spread_pct": ("qual_gap_pct", 0.5)})
    out = length.join(pole, venue, "full").join(spread, venue, "full")
    return out.select(venue, "lap_length_m", "pole_time_s", F.try_divide(3.6 * F.col("lap_length_m"), F.col("pole_time_s")).alias("avg_lap_speed_kmh"), "field_spread_pct")


def pass_rate(passes: DataFrame, results: DataFrame, venue: str, race: str, least: int = 2, as_of: float | None = None, index: str = "event_index") -> DataFrame:
    """venue, overtakes_per_100_laps, n_races: passes per hundred laps of the classified field, the median of at least
    so many races (before as_of, if given)."""
    passes = passes if as_of is None else passes.where(F.col(index) < as_of)
    n = passes.groupBy(race, venue).agg(F.count("*").alias("passes"))
    run = results.where("classified = 1").groupBy(race).agg(F.max("laps").alias("laps"), F.count("*").alias("field"))
    rate = 100.0 * F.col("passes") / F.greatest(F.col("laps") * F.col("field"), F.lit(1.0))
    out = n.join(run, race).where(F.col(venue).isNotNull()).select(venue, rate.alias("__rate"))
    return quantiles(out, [venue], {"overtakes_per_100_laps": ("__rate", 0.5)}, "n_races").where(F.col("n_races") >= least)


def counted_difficulty(rates: DataFrame, venue: str) -> DataFrame:
    """venue, n_races, difficulty: the percentile rank of the pass rate turned round; nothing for a single venue."""
    rates = staged(rates, "pass-rates")
    out = percent_ranks(rates, "overtakes_per_100_laps", "__share").join(F.broadcast(rates.agg(F.count("*").alias("__n"))))
    return out.where("__n >= 2").select(venue, "n_races", clip(1.0 - F.col("__share"), 0.02, 0.98).alias("difficulty"))


def pit_lane_loss(stops: DataFrame, venue: str, seconds: str, low: float = 12.0, high: float = 60.0, least: int = 10) -> DataFrame:
    """venue, pit_loss_s, n_stops: median of plausible stops, of venues with enough of them."""
    plausible = stops.where(F.col(seconds).between(low, high))
    return quantiles(plausible.where(F.col(venue).isNotNull()), [venue], {"pit_loss_s": (seconds, 0.5)}, "n_stops").where(F.col("n_stops") >= least)


def venue_profiles(difficulty: DataFrame, attrition: DataFrame, venue: str, street: list[str] = ()) -> DataFrame:
    """Difficulty and attrition of all venues that have either, with is_street."""
    return difficulty.join(attrition, venue, "full").withColumn("is_street", F.col(venue).isin(list(street)) if street else F.lit(False))


def target_profile(venue_id: str, profiles: DataFrame, venue: str, features: list[str], lap_length: float | None = None, pole_time: float | None = None, is_street: bool | None = None, difficulty: float | None = None) -> DataFrame:
    """One row for a target: its own profile if that is complete, else one made of its published lap and pole time and
    the medians of all others.  A target with neither is refused."""
    own = profiles.where(F.col(venue) == venue_id)
    for f in features:
        own = own.where(F.col(f).isNotNull())
    own = own.limit(1)
    if not own.isEmpty():
        return own.select(venue, "lap_length_m", "avg_lap_speed_kmh", "field_spread_pct", "overtaking_difficulty", "is_street")
    if not lap_length or not pole_time:
        raise ContractError(f"{venue_id} has no history and no published specification")
    return profiles.agg(F.median("field_spread_pct").alias("s"), F.median("overtaking_difficulty").alias("d")).select(
        F.lit(venue_id).alias(venue), F.lit(float(lap_length)).alias("lap_length_m"), F.lit(3.6 * lap_length / pole_time).alias("avg_lap_speed_kmh"), F.col("s").alias("field_spread_pct"),
        (F.col("d") if difficulty is None else F.lit(float(difficulty))).alias("overtaking_difficulty"), F.lit(bool(is_street)).alias("is_street"))


def nearest_in_family(target: DataFrame, profiles: DataFrame, venue: str, features: list[str], family: Column, k: int = 4) -> DataFrame:
    """The k venues of a family nearest to the target in z-score space."""
    pool = profiles.where(family).select(venue, *features).where(" AND ".join(f"{f} IS NOT NULL" for f in features))
    name = "__target"
    return nearest(pool.unionByName(target.select(F.lit(name).alias(venue), *features)), venue, name, features, k)


def resolve_contexts(targets: DataFrame, profiles: DataFrame, counted: DataFrame, transfer: DataFrame, family: DataFrame, venue: str, street: str = "is_street", least: int = 3) -> DataFrame:
    """targets (venue, is_street) with overtaking_difficulty, dnf_multiplier and source, all at once.

    A venue with enough history takes the counted difficulty if there is one, else its empirical one, and its own
    multiplier; another takes its family's transferred difficulty and multiplier.  profiles has (venue, difficulty,
    multiplier, n_events), counted (venue, counted), transfer (street, difficulty, source), family (street, multiplier).
    """
    own = profiles.select(F.col(venue), F.col("difficulty").alias("__own"), F.col("multiplier").alias("__m"), F.col("n_events").alias("__n"))
    t = transfer.select(F.col(street), F.col("difficulty").alias("__td"), F.col("source").alias("__ts"))
    f = family.select(F.col(street), F.col("multiplier").alias("__fm"))
    out = targets.join(own, venue, "left").join(counted.select(venue, F.col("counted").alias("__c")), venue, "left").join(F.broadcast(t), street, "left").join(F.broadcast(f), street, "left")
    known = F.coalesce((F.col("__n") >= least) & F.col("__own").isNotNull(), F.lit(False))
    return out.select(
        *targets.columns, F.when(known, F.coalesce("__c", "__own")).otherwise(F.coalesce("__td", F.lit(0.5))).alias("overtaking_difficulty"),
        F.when(known, F.col("__m")).otherwise(F.coalesce("__fm", F.lit(1.0))).alias("dnf_multiplier"),
        F.when(known & F.col("__c").isNotNull(), "measured_passes").when(known, "empirical").otherwise(F.coalesce("__ts", F.lit("default"))).alias("source"))
