"""Corners of a lap: windows around markers, braking, apex and exit measures, and within-corner comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import aero_commitment, braking_efficiency, exit_amplification, traction_index
from .laps import practice_summary, track_evolution
from .order import quantiles
from .temporal import curvature, resample


def segment_corners(telemetry: DataFrame, markers: DataFrame, track: list[str], before: float = 120.0, after: float = 180.0, distance: str = "distance", corner: str = "corner") -> DataFrame:
    """telemetry rows with each corner whose window holds them: corner, corner_distance, relative_distance.

    Windows are dealt to buckets of distance, so rows meet them by an equality on track and bucket; a row within two
    windows comes twice.
    """
    width = before + after
    centre = F.col(distance)
    cells = F.sequence(F.floor((centre - before) / width), F.floor((centre + after) / width))
    side = markers.select(*track, F.col(corner).alias("corner"), centre.cast("double").alias("corner_distance"), F.explode(cells).alias("__cell"))
    rows = telemetry.drop("corner", "corner_distance", "relative_distance").withColumn("__cell", F.floor(F.col(distance) / width))
    out = rows.join(side, [*track, "__cell"]).where(F.col(distance).between(F.col("corner_distance") - before, F.col("corner_distance") + after)).drop("__cell")
    return out.withColumn("relative_distance", F.col(distance) - F.col("corner_distance"))


def following_straights(markers: DataFrame, lengths: DataFrame, track: list[str], distance: str = "distance", corner: str = "corner") -> DataFrame:
    """track, corner, following_straight: metres to the next marker, after the last one to the lap's end (lengths has
    track and lap_length)."""
    here = markers.select(*track, F.col(corner).alias("corner"), F.col(distance).alias("__d"))
    here = here.withColumn("__next", F.lead("__d").over(Window.partitionBy(*track).orderBy("__d"))).join(lengths, track)
    return here.select(*track, "corner", F.greatest(F.coalesce("__next", "lap_length") - F.col("__d"), F.lit(0.0)).alias("following_straight"))


def corner_metrics(segments: DataFrame, group: list[str], straight: str | None = None) -> DataFrame:
    """Per group (a corner of a lap): entry, apex and exit speed, braking distance and efficiency, traction, commitment
    and what the exit is worth on the straight that follows.

    segments has distance, speed, brake, time_s, curvature and throttle.  The apex is the slowest row, the first of
    equal ones; entry is the fastest row up to it, exit the last row.
    """
    rows = segments.where(F.col("speed").isNotNull() & F.col("distance").isNotNull())
    apex = F.min(F.struct("speed", "distance")).over(Window.partitionBy(*group))
    rows = rows.withColumn("__apex", apex.getField("distance")).withColumn("__slow", apex.getField("speed"))
    upto, later = F.col("distance") <= F.col("__apex"), F.col("distance") >= F.col("__apex")
    speed, clock = F.col("speed"), F.col("time_s")
    end = lambda c: F.max_by(c, F.when(later, F.col("distance")))
    held = rows.groupBy(*group).agg(
        F.max(F.when(upto, speed)).alias("entry_speed_kmh"), F.first("__slow").alias("apex_speed_kmh"), end(speed).alias("exit_speed_kmh"), F.first("__apex").alias("__at"),
        F.min(F.when(upto & (F.col("brake") > 0.5), F.col("distance"))).alias("__brake"), F.min(F.when(F.col("distance") == F.col("__apex"), clock)).alias("__t0"), end(clock).alias("__t1"), F.max("distance").alias("__end"),
        F.median("curvature").alias("__kappa"), F.avg("throttle").alias("__throttle"), (F.first(straight) if straight else F.lit(0.0)).alias("__straight"))
    coast = (F.col("__end") - F.col("__at")) / F.greatest((F.col("apex_speed_kmh") + F.col("exit_speed_kmh")) / 2 / 3.6, F.lit(1e-9))
    seconds = F.greatest(F.coalesce(F.col("__t1") - F.col("__t0"), coast), F.lit(1e-9))
    metres = F.when(F.col("__brake").isNotNull(), F.greatest(F.lit(1.0), F.col("__at") - F.col("__brake")))
    return held.select(
        *group, "entry_speed_kmh", "apex_speed_kmh", "exit_speed_kmh", metres.alias("braking_distance_m"),
        braking_efficiency(F.col("entry_speed_kmh"), F.col("apex_speed_kmh"), metres).alias("braking_efficiency_ms2"), traction_index(F.col("apex_speed_kmh"), F.col("exit_speed_kmh"), seconds).alias("traction_index_ms2"),
        aero_commitment(F.col("apex_speed_kmh"), F.col("__kappa"), F.col("__throttle")).alias("aero_commitment"),
        exit_amplification(F.col("exit_speed_kmh") - F.col("apex_speed_kmh"), F.col("__straight")).alias("exit_amplification"))


def corner_performance(metrics: DataFrame, corner: list[str]) -> DataFrame:
    """metrics with corner_performance: the mean z-score of apex and exit speed among a corner's rows."""
    w = Window.partitionBy(*corner)

    def z(c: str) -> Column:
        sd = F.stddev_pop(c).over(w)
        return (F.col(c) - F.avg(c).over(w)) / F.when(sd > 0, sd).otherwise(1.0)

    return metrics.withColumn("corner_performance", (z("apex_speed_kmh") + z("exit_speed_kmh")) / 2)


def lap_corners(telemetry: DataFrame, markers: DataFrame, track: list[str], lap: list[str], step: float = 2.0) -> DataFrame:
    """From laps' traces (track and lap columns, distance, speed, throttle, brake, time_s, x, y) to corner metrics with
    performance: resampled, with curvature, cut into windows and compared across laps."""
    by = [*track, *lap]
    grid = resample(telemetry.where("distance IS NOT NULL AND speed IS NOT NULL"), by, "distance", ["speed", "throttle", "brake", "time_s", "x", "y"], step)
    grid = curvature(grid, by, "distance", "x", "y")
    ends = grid.groupBy(*track).agg(F.max("distance").alias("lap_length"))
    cut = segment_corners(grid, markers, track).join(following_straights(markers, ends, track), [*track, "corner"])
    return corner_performance(corner_metrics(cut, [*by, "corner"], "following_straight"), [*track, "corner"])


def session_practice(laps: DataFrame, session: list[str], driver: str = "driver", stint: str = "stint", clock: str = "session_seconds", time: str = "lap_time") -> DataFrame:
    """Practice summaries of a session's drivers from laps corrected for the track's evolution."""
    even = track_evolution(laps, session, clock, time, name="corrected_lap")
    key = F.struct(*session, driver)
    out = practice_summary(even.withColumn("__who", key), "__who", stint, "corrected_lap")
    return out.select("__who.*", *[c for c in out.columns if c != "__who"])


def curvature_indices(df: DataFrame, group: list[str], value: str = "curvature") -> DataFrame:
    """Exposure (mean), severity (95% quantile) of the absolute curvature, and its variation."""
    k = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    rows = df.select(*group, k.alias("__k"), F.abs(k).alias("__size"))
    means = rows.groupBy(*group).agg(F.avg("__size").alias("curvature_exposure"), F.stddev_pop("__k").alias("curvature_variation"))
    return means.join(quantiles(rows, group, {"curvature_severity": ("__size", 0.95)}), group)
