"""Ordered state: a local-level Kalman filter as a fold over each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def local_level(df: DataFrame, group: list[str], order: str, value: str, prior: float = 1.0, step: float = 0.05, noise: float = 0.3) -> DataFrame:
    """group, n, level, variance, loglik after a series' last row; it predicts strictly before it observes.

    The series is folded in order by a higher-order function, so it stays in the JVM; one series is one row.
    """
    series = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("double").alias("t"), F.col(value).cast("double").alias("y")))).alias("x"))
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(prior).alias("p"), F.lit(None).cast("double").alias("t"), F.lit(0.0).alias("l"))

    def observe(s, x):
        p = s["p"] + F.coalesce(x["t"] - s["t"], F.lit(0.0)) * step
        total = p + noise
        gain, error = p / total, x["y"] - s["m"]
        density = -0.5 * (F.ln(2 * 3.141592653589793 * total) + error * error / total)
        return F.struct((s["m"] + gain * error).alias("m"), (p * (1 - gain)).alias("p"), x["t"].alias("t"), (s["l"] + density).alias("l"))

    out = series.select(*group, F.size("x").alias("n"), F.aggregate("x", zero, observe).alias("s"))
    return out.select(*group, F.col("n").cast("long").alias("n"), F.col("s.m").alias("level"), F.col("s.p").alias("variance"), F.col("s.l").alias("loglik"))
