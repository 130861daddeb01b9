"""Scalar expressions: all built from native functions, so they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Coefficients of the published rational approximation of the normal quantile (Acklam).
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
QUANTILE_TAIL = 0.02425

# Stages in order, and hours before the start at which information closes.
STAGES = {"PRE_WEEKEND": -60, "POST_FP1": -50, "POST_FP2": -46, "POST_FP3": -27, "POST_QUALI": -23, "RACE_START": 0}
# Regimes by first and last season; the last one is open.
REGIMES = (("R2014", 2014, 2016), ("R2017", 2017, 2021), ("R2022", 2022, 2025), ("R2026", 2026, None))


def clip(x: Column, low: float, high: float) -> Column:
    """Within [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def probit(p: Column) -> Column:
    """Normal quantile to 4e-9, for p strictly between 0 and 1."""
    tail = lambda q: _poly(q, QUANTILE_C) / (_poly(q, QUANTILE_D) * q + 1.0)
    r = (p - 0.5) * (p - 0.5)
    middle = _poly(r, QUANTILE_A) * (p - 0.5) / (_poly(r, QUANTILE_B) * r + 1.0)
    low, high = F.sqrt(-2.0 * F.ln(p)), F.sqrt(-2.0 * F.ln(1.0 - p))
    return F.when(p < QUANTILE_TAIL, tail(low)).when(p > 1 - QUANTILE_TAIL, -tail(high)).otherwise(middle)


def normal_score(position: Column, field_size: Column) -> Column:
    """Van der Waerden score: the first of a field is highest; NULL positions stay NULL."""
    return -probit(clip((position - 0.5) / field_size, 1e-4, 1 - 1e-4))


def qualifying_score(gap_pct: Column) -> Column:
    return -gap_pct / 0.75


def recency_weight(index: Column, latest: Column | float, half_life: float) -> Column:
    age = F.greatest(F.lit(latest) - index if not isinstance(latest, Column) else latest - index, F.lit(0.0))
    return F.pow(F.lit(0.5), age / half_life)


def beta_rate(events: Column, trials: Column, alpha: float = 1.0, beta: float = 9.0) -> Column:
    return (events + alpha) / (trials + alpha + beta)


def logit(p: Column) -> Column:
    q = clip(p, 1e-9, 1 - 1e-9)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def hazard(base: Column, excess: Column, multiplier: Column | float = 1.0) -> Column:
    """Log-odds hazard kept within [0.01, 0.60]; a missing excess counts as none."""
    m = multiplier if isinstance(multiplier, Column) else F.lit(multiplier)
    return clip(sigmoid(logit(base) + F.coalesce(excess, F.lit(0.0)) + F.ln(F.greatest(m, F.lit(1e-9)))), 0.01, 0.60)


def split_rate(p: Column, chaos: Column, multiplier: Column) -> tuple[Column, Column]:
    """(calm, chaos) rates whose mixture is p: the chaos rate is multiplier times the calm one, or 1."""
    calm = p / (1 + chaos * (multiplier - 1))
    capped = F.when(calm * multiplier > 1, F.try_divide(p - chaos, 1 - chaos)).otherwise(calm)
    return (
        F.when(chaos >= 1, p / multiplier).otherwise(capped),
        F.when(chaos >= 1, p).otherwise(F.least(capped * multiplier, F.lit(1.0))),
    )


def overtaking_blend(difficulty: Column) -> Column:
    return 0.18 + 0.70 * clip(difficulty, 0.0, 1.0)


def clock_seconds(text: Column) -> Column:
    """Seconds of s.sss, m:ss.sss and h:m:s texts; anything else is NULL."""
    part = F.split(text, ":")
    at = lambda k: F.get(part, k).try_cast("double")
    return F.when(F.size(part) == 1, at(0)).when(F.size(part) == 2, at(0) * 60 + at(1)).when(F.size(part) == 3, at(0) * 3600 + at(1) * 60 + at(2))


def american_to_decimal(odds: Column) -> Column:
    return F.when(odds > 0, 1 + odds / 100.0).when(odds < 0, 1 + 100.0 / F.abs(odds))


def american_to_implied(odds: Column) -> Column:
    return F.when(odds > 0, 100.0 / (odds + 100.0)).when(odds < 0, F.abs(odds) / (F.abs(odds) + 100.0))


def kelly_fraction(p: Column, decimal_odds: Column) -> Column:
    b = decimal_odds - 1
    return F.coalesce(F.when(b > 0, F.greatest((p * b - (1 - p)) / b, F.lit(0.0))), F.lit(0.0))


def wilson(successes: Column, trials: Column, z: float = 1.959963985) -> tuple[Column, Column]:
    p, z2 = successes / trials, z * z
    mid = (p + z2 / (2 * trials)) / (1 + z2 / trials)
    half = z * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials)) / (1 + z2 / trials)
    return mid - half, mid + half


def stage_order(stage: Column) -> Column:
    out = F.lit(None).cast("long")
    for k, name in enumerate(STAGES):
        out = F.when(stage == name, F.lit(k).cast("long")).otherwise(out)
    return out


def stage_allowed(earliest: Column, stage: Column) -> Column:
    """Whether a feature is known at a stage; unknown features and POST_RACE are never."""
    return F.coalesce(stage_order(earliest) <= stage_order(stage), F.lit(False))


def stage_cutoff(start: Column, stage: str) -> Column:
    if stage not in STAGES:
        raise ValueError(f"no such stage: {stage}")
    return start + F.make_dt_interval(F.lit(0), F.lit(STAGES[stage]))


def regime(season: Column) -> Column:
    out = F.lit("UNKNOWN")
    for name, first, last in REGIMES:
        inside = (season >= first) if last is None else season.between(first, last)
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def average_rank(value: str, by: list[str], descending: bool = False) -> Column:
    """Average rank within by; ties share the mean of their places."""
    column = F.col(value).desc() if descending else F.col(value)
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def hash_uniform(*parts: Column, part: int = 0) -> Column:
    """A reproducible number in (0, 1): 32 bits of the MD5 of the parts joined by |."""
    text = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(text, 1 + 8 * part, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def hash_normal(*parts: Column) -> Column:
    return F.sqrt(-2.0 * F.ln(hash_uniform(*parts))) * F.cos(2 * math.pi * hash_uniform(*parts, part=1))


def hash_gumbel(*parts: Column) -> Column:
    return -F.ln(-F.ln(hash_uniform(*parts)))


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays over the places that both have; NULL if either is zero."""
    pair = F.filter(F.zip_with(x, y, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    total = lambda f: F.aggregate(pair, F.lit(0.0), lambda s, p: s + f(p))
    return F.try_divide(total(lambda p: p["a"] * p["b"]), F.sqrt(total(lambda p: p["a"] * p["a"])) * F.sqrt(total(lambda p: p["b"] * p["b"])))


# Vehicle dynamics; speeds in km/h, distances in metres, times in seconds.
def braking_efficiency(entry: Column, apex: Column, distance: Column) -> Column:
    return F.when(distance > 0, (F.pow(entry / 3.6, 2) - F.pow(apex / 3.6, 2)) / (2 * distance))


def traction_index(apex: Column, exit_: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, (exit_ - apex) / 3.6 / seconds)


def exit_amplification(delta_exit: Column, straight: Column) -> Column:
    return delta_exit * straight


def straight_time_gain(exit_a: Column, exit_b: Column, straight: Column) -> Column:
    metres = lambda v: F.greatest(v / 3.6, F.lit(1e-9))
    return straight * (1 / metres(exit_b) - 1 / metres(exit_a))


def lateral_g(speed: Column, curvature: Column) -> Column:
    return F.pow(speed / 3.6, 2) * F.abs(curvature) / 9.80665


def aero_commitment(speed: Column, curvature: Column, throttle: Column) -> Column:
    return lateral_g(speed, curvature) * clip(throttle / 100.0, 0.0, 1.0)


def wind_components(speed: Column, wind_degrees: Column, heading_degrees: Column) -> tuple[Column, Column]:
    angle = F.radians(wind_degrees - heading_degrees)
    return speed * F.cos(angle), F.abs(speed * F.sin(angle))


def traffic_class(gap: Column) -> Column:
    """By seconds to the car ahead; a gap that is missing or not finite is clean air."""
    return F.when(gap.isNull() | F.isnan(gap) | (F.abs(gap) == float("inf")), "clean").when(gap < 1, "dirty").when(gap < 2, "affected").otherwise("clean")


def pit_loss(entry: Column, exit_: Column, reference: Column) -> Column:
    return exit_ - entry - reference


# Words in a status that name an incident, and statuses of those who never started.
INCIDENT_WORDS = ("collision", "accident", "spun", "damage", "puncture", "crash", "contact")
NON_STARTERS = ("Did not start", "Did not qualify", "Did not prequalify", "Withdrew", "Injury")


def status_class(status: Column, position_text: Column) -> Column:
    """non_starter, finished (the position is a number), incident or mechanical, in that precedence."""
    s, p = F.trim(F.coalesce(status, F.lit(""))), F.trim(F.coalesce(position_text, F.lit("")))
    incident = F.lower(s).rlike("|".join(INCIDENT_WORDS)) | (p == "D")
    never = s.isin(*NON_STARTERS) | p.isin("W", "F")
    return F.when(never, "non_starter").when(p.rlike("^[0-9]+$"), "finished").when(incident, "incident").otherwise("mechanical")


#: Statuses of cars that reached the flag.
FINISHED = ("Finished", "Lapped")


def is_finished(status: Column) -> Column:
    s = F.trim(F.coalesce(status, F.lit("")))
    return s.isin(*FINISHED) | s.startswith("+")


def to_free(value: Column, low: float, high: float) -> Column:
    """A bounded number on the whole line."""
    return logit(clip((value - low) / (high - low), 1e-6, 1 - 1e-6))


def from_free(value: Column, low: float, high: float) -> Column:
    return low + (high - low) * sigmoid(value)


def undercut_power(before: Column, fresh: Column, pit_loss: Column, laps: float = 2.0) -> Column:
    """Time that fresh tyres gain over some laps, as a share of the pit loss."""
    return F.greatest(before - fresh, F.lit(0.0)) * laps / F.greatest(pit_loss, F.lit(1e-9))


def shrink_mean(total: Column, count: Column, prior: Column, strength: float = 5.0) -> Column:
    """The mean of count values, drawn to the prior as by `strength` more of them; without values the prior."""
    return F.when(count > 0, (total + strength * prior) / (count + strength)).otherwise(prior)


#: Dimensions of a track's demand and of a car's capability that belong together.
MATCHED = (("low_speed_share", "low_speed"), ("medium_speed_share", "medium_speed"), ("high_speed_share", "high_speed"), ("braking_demand", "braking"), ("traction_demand", "traction"), ("aero_demand", "aero"))


def named_cosine(columns: list[str]) -> Column:
    """Cosine of a track's and a car's matched dimensions, of those that a row has on both sides."""
    have = [(a, b) for a, b in MATCHED if a in columns and b in columns]
    return cosine(F.array(*[F.col(a).cast("double") for a, _ in have]), F.array(*[F.col(b).cast("double") for _, b in have]))
