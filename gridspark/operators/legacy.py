"""The older metrics of a ranking, with their rules for missing values, their summary and the paired Top-1 test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import bootstrap
from .guards import ContractError


def ranking_by_race(df: DataFrame, race: str, score: str, entry: str, finish: str | None = "finish_position", relevance: str | None = "relevance", winner: str | None = "winner", top: int = 5) -> DataFrame:
    """race, top1, winner_top3, spearman, rank_mae, ndcg5 of one score.

    Without exactly one winner the first two are NULL.  Rank correlation and error leave out missing finishes; NDCG has
    gain equal to relevance, and entries of equal score share their places' discounts.  Ties in score are ranked by entry.
    """
    w = Window.partitionBy(race)
    number = lambda c: F.col(c).cast("double") if c else F.lit(None).cast("double")
    rows = df.select(race, number(score).alias("s"), F.col(entry).alias("k"), number(finish).alias("f"), number(relevance).alias("y"), F.coalesce(number(winner), F.lit(0.0)).alias("w"))
    place = F.row_number().over(w.orderBy(F.col("s").desc_nulls_last(), "k"))
    ideal = F.row_number().over(w.orderBy(F.col("y").desc_nulls_last(), "k"))
    rows = rows.withColumns({"r": place, "b": ideal, "tie": F.avg(F.coalesce("y", F.lit(0.0))).over(Window.partitionBy(race, "s"))})
    has = F.when(F.col("f").isNotNull(), F.lit(race))
    average = lambda c: F.rank().over(Window.partitionBy(race, has).orderBy(c)) + (F.count("*").over(Window.partitionBy(race, has, c)) - 1) / 2
    rows = rows.withColumns({"pr": F.when(F.col("f").isNotNull(), average("r")), "pf": F.when(F.col("f").isNotNull(), average("f"))})
    discount = lambda c: F.when(F.col(c) <= top, 1.0 / F.log2(F.col(c) + 1.0)).otherwise(0.0)
    one = F.sum("w") == 1
    at = F.min(F.when(F.col("w") == 1, F.col("r")))
    spread = (F.stddev_pop("pr") > 0) & (F.stddev_pop("pf") > 0)
    out = rows.groupBy(race).agg(
        F.when(one, (at == 1).cast("double")).alias("top1"), F.when(one, (at <= 3).cast("double")).alias("winner_top3"), F.when(spread, F.corr("pr", "pf")).alias("spearman"),
        F.avg(F.abs(F.col("r") - F.col("f"))).alias("rank_mae"), F.coalesce(F.try_divide(F.sum(F.col("tie") * discount("r")), F.sum(F.coalesce("y", F.lit(0.0)) * discount("b"))), F.lit(0.0)).alias("ndcg5"))
    return out if relevance else out.withColumn("ndcg5", F.lit(None).cast("double"))


METRICS = ("top1", "winner_top3", "spearman", "rank_mae", "ndcg5")


def ranking_metrics(per_race: DataFrame, strict: bool = False) -> DataFrame:
    """One row: n_races and the means of ranking_by_race over the races that have each; strict refuses races without one winner."""
    if strict:
        bad = per_race.where("top1 IS NULL").limit(1).count()
        if bad:
            raise ContractError("a race has no single winner")
    return per_race.agg(F.count("*").alias("n_races"), *[F.avg(m).alias(m) for m in METRICS])


def with_grid_baseline(holdout: DataFrame, experiments: DataFrame, race: str, entry: str, grid: str = "grid_effective", name: str = "GRID_BASELINE_RECOMPUTED") -> DataFrame:
    """Recorded experiments below the grid's own metrics, computed anew: a missing place counts as 99."""
    score = -F.coalesce(F.col(grid).try_cast("double"), F.lit(99.0))
    base = ranking_metrics(ranking_by_race(holdout.withColumn("__grid", score), race, "__grid", entry), strict=True).withColumn("feature_set", F.lit(name))
    known = [c for c in ("feature_set", "n_races", *METRICS, "n_features") if c in experiments.columns]
    return base.select("feature_set", "n_races", *METRICS).unionByName(experiments.select(*known), allowMissingColumns=True)


def top1_deltas(df: DataFrame, race: str, a: str, b: str, entry: str, winner: str = "winner") -> DataFrame:
    """race, delta: whether b's highest score is the winner's, less whether a's is; the first entry of equal scores counts,
    missing scores never do."""
    def hit(c: str):
        rank = F.when(F.col(c).isNotNull() & ~F.isnan(c), F.struct(-F.col(c).cast("double"), F.col(entry)))
        return F.coalesce(F.min_by(F.col(winner).cast("double"), rank) == 1, F.lit(False)).cast("double")

    return df.groupBy(race).agg(hit(a).alias("x"), hit(b).alias("y")).select(race, (F.col("y") - F.col("x")).alias("delta"))


def top1_bootstrap(df: DataFrame, race: str, a: str, b: str, entry: str, winner: str = "winner", draws: int = 5000, seed: int = 42) -> DataFrame:
    """delta, ci_low, ci_high, n_races of b over a in Top-1, by resampling races."""
    return bootstrap(top1_deltas(df, race, a, b, entry, winner), race, "top1", draws, seed)
