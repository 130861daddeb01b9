"""Contracts that fail closed: schema, keys, references, stages and observation times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import STAGES, stage_allowed


class ContractError(ValueError):
    """A frame breaks its contract."""


class LeakageError(ContractError):
    """Information from after the cutoff would be used."""


def require_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with exactly these columns, cast without failing (bad values become NULL)."""
    if missing := [c for c in types if c not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def missing_references(df: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str] | None = None) -> DataFrame:
    side = parent.select(*[F.col(p).alias(k) for k, p in zip(keys, parent_keys or keys)])
    return df.join(side, keys, "left_anti")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    nulls = df.where(" OR ".join(f"`{k}` IS NULL" for k in keys))
    if not nulls.isEmpty() or not duplicate_keys(df, keys).isEmpty():
        raise ContractError(f"not unique or NULL: {', '.join(keys)}")
    return df


def require_reference(df: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str] | None = None) -> DataFrame:
    if not missing_references(df, keys, parent, parent_keys).isEmpty():
        raise ContractError(f"no parent row: {', '.join(keys)}")
    return df


def late_rows(df: DataFrame, observed: str, cutoff: Column) -> DataFrame:
    """Rows observed at or after the cutoff, or at no known time."""
    return df.where(F.col(observed).isNull() | cutoff.isNull() | (F.col(observed) >= cutoff))


def require_observed_before(df: DataFrame, observed: str, cutoff: Column) -> DataFrame:
    if not late_rows(df, observed, cutoff).isEmpty():
        raise LeakageError(f"{observed} is missing, or not before the cutoff")
    return df


def stage_gate(features: DataFrame, stages: DataFrame) -> DataFrame:
    """feature, earliest_stage, stage, allowed; both sides are dimensions of a few rows."""
    pairs = features.join(F.broadcast(stages))
    return pairs.select("feature", "earliest_stage", "stage", stage_allowed(F.col("earliest_stage"), F.col("stage")).alias("allowed"))


def require_stage(families: dict[str, str], wanted: list[str], stage: str) -> None:
    """wanted features must be known at a stage; a feature that families lacks counts as known after the race only."""
    order = list(STAGES)
    if stage not in order:
        raise ContractError(f"no such stage: {stage}")
    bad = [f for f in wanted if families.get(f) not in order or order.index(families[f]) > order.index(stage)]
    if bad:
        raise LeakageError(f"not known at {stage}: {', '.join(bad)}")


# Feature families and the stage from which each is known; POST_RACE ones never are.
FAMILIES = {
    "calendar": "PRE_WEEKEND", "track_geometry": "PRE_WEEKEND", "track_similarity": "PRE_WEEKEND", "historical_results": "PRE_WEEKEND", "historical_qualifying": "PRE_WEEKEND", "team_strength": "PRE_WEEKEND",
    "driver_strength": "PRE_WEEKEND", "reliability": "PRE_WEEKEND", "weather_forecast": "PRE_WEEKEND", "championship_state": "PRE_WEEKEND", "practice_fp1": "POST_FP1", "practice_fp2": "POST_FP2",
    "practice_fp3": "POST_FP3", "telemetry_practice": "POST_FP1", "qualifying": "POST_QUALI", "grid": "POST_QUALI", "race_laps": "POST_RACE", "race_weather_observed": "POST_RACE", "race_pitstops": "POST_RACE", "race_result": "POST_RACE",
}


def feature_catalogue(spark: SparkSession) -> DataFrame:
    """(feature, earliest_stage) of every known family."""
    return spark.createDataFrame(list(FAMILIES.items()), "feature string, earliest_stage string")


# The earlier catalogue of feature families, in which POST_RACE is a stage like the others.
EARLIER_STAGES = ("PRE_WEEKEND", "POST_FP1", "POST_FP2", "POST_FP3", "POST_QUALI", "RACE_START", "POST_RACE")
EARLIER_FAMILIES = {
    "historical_form": "PRE_WEEKEND", "track_geometry": "PRE_WEEKEND", "track_similarity": "PRE_WEEKEND", "archived_weather": "PRE_WEEKEND", "fp1": "POST_FP1", "fp2": "POST_FP2", "fp3": "POST_FP3",
    "qualifying": "POST_QUALI", "grid": "POST_QUALI", "race_weather": "POST_RACE", "race_stints": "POST_RACE", "pit_stops": "POST_RACE", "race_laps": "POST_RACE", "result": "POST_RACE",
}


def earlier_allowed(families: DataFrame, stage: str) -> DataFrame:
    """family, allowed under the earlier catalogue; unknown families are known after the race only."""
    if stage not in EARLIER_STAGES:
        raise ContractError(f"no such stage: {stage}")
    last = EARLIER_STAGES.index(stage)
    known = [f for f, s in EARLIER_FAMILIES.items() if EARLIER_STAGES.index(s) <= last]
    listed = list(EARLIER_FAMILIES)
    family = F.col("family")
    return families.select("family", F.coalesce(family.isin(known) | (~family.isin(listed) & F.lit(stage == "POST_RACE")), F.lit(False)).alias("allowed"))


def require_earlier_stage(families: DataFrame, stage: str) -> None:
    bad = sorted(r[0] or "NULL" for r in earlier_allowed(families, stage).where("NOT allowed").select("family").distinct().limit(100).collect())
    if bad:
        raise LeakageError(f"not known at {stage}: {', '.join(bad)}")


def require_row_times(df: DataFrame, known: str, predicted: str) -> DataFrame:
    """df, unless a row's feature time lies after its own prediction time; rows that lack either pass."""
    if not df.where(F.col(known) > F.col(predicted)).isEmpty():
        raise LeakageError(f"{known} lies after {predicted}")
    return df
