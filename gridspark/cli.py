"""Jobs from the command line: ingest landed responses, backtest a panel, forecast its next race."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import regime
from .operators import evaluation, forecast, panel
from .operators.guards import ContractError
from .operators.simulation import SimulationSettings
from .sources import paths, responses
from .sources.files import manifest, write_table

FLATTEN = {"schedule": responses.flatten_schedule, "results": responses.flatten_results, "qualifying": responses.flatten_qualifying, "standings": responses.flatten_standings}


def confined(spark: SparkSession, out: str, root: str) -> str:
    """The output folder as a whole URI, which must lie within the root, on whatever file system."""
    path, base = paths.qualified(spark, out), paths.qualified(spark, root)
    if path != base and not path.startswith(base.rstrip("/") + "/"):
        raise ContractError(f"{out} lies outside {root}")
    return path


def load_panel(spark: SparkSession, folder: str, race_score: str = "rank") -> panel.Panel:
    """The panel of a folder's results, qualifying and schedule tables, with standings and overtakes if they are there."""
    missing = [n for n in ("results", "qualifying", "schedule") if not paths.exists(spark, f"{folder}/{n}.parquet")]
    if missing:
        raise ContractError(f"{folder} lacks {', '.join(missing)}")
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    more = {kind: read(name) for kind, name in (("standings", "standings"), ("passes", "overtakes")) if paths.exists(spark, f"{folder}/{name}.parquet")}
    return panel.build_panel(read("results"), read("qualifying"), read("schedule"), race_score=race_score, **more)


def model_tables(held: panel.Panel) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, results, calendar) in the names that forecasts use."""
    calendar = held.schedule.select(F.col("race_id").alias("target"), "season").join(held.event_order.withColumnRenamed("race_id", "target"), "target")
    calendar = calendar.select("target", F.col("event_index").alias("target_index"), regime(F.col("season")).alias("target_regime"), "season")
    when = calendar.select(F.col("target").alias("race_id"), F.col("target_index").alias("event_index"), F.col("target_regime").alias("regime"))
    results = held.results.select("race_id", F.col("driver_id").alias("driver"), F.col("constructor_id").alias("team"), "position_order", "classified", "started", "dnf").join(F.broadcast(when), "race_id")
    teams = results.select("race_id", "driver", "team").unionByName(held.qualifying.select("race_id", F.col("driver_id").alias("driver"), F.col("constructor_id").alias("team"))).distinct()
    seen = held.observations.select("race_id", F.col("driver_id").alias("driver"), "kind", "score").join(teams, ["race_id", "driver"]).join(F.broadcast(when), "race_id")
    return seen, results, calendar


def ingest(spark: SparkSession, landed: str, out: str) -> list[str]:
    """Each kind of landed responses (folders of text files, one response each) as a Parquet table; kinds without any are
    left out."""
    done = []
    for kind, flatten in FLATTEN.items():
        if not paths.exists(spark, f"{landed}/{kind}"):
            continue
        raw = spark.read.text(f"{landed}/{kind}", wholetext=True).select(F.col("value").alias("body"), F.col("_metadata.file_modification_time").cast("string").alias("fetched_at"))
        write_table(flatten(raw), f"{out}/{kind}.parquet")
        done.append(kind)
    if not done:
        raise ContractError(f"no landed responses in {landed}")
    return done


def backtest(spark: SparkSession, folder: str, out: str, seasons: tuple[int, int], n_sims: int, draws: int = 10_000) -> DataFrame:
    """Predictions, metrics, leaderboard, paired tests, probability report and skip log of the seasons' races, written as
    tables with a manifest; returns the leaderboard."""
    seen, results, calendar = model_tables(load_panel(spark, folder))
    targets = calendar.where(F.col("season").between(*seasons))
    entries = results.where("started = 1").select(F.col("race_id").alias("target"), "driver", "team").join(F.broadcast(targets.select("target")), "target", "left_semi").withColumn("uniform", F.lit(0.0))
    predictions, metrics, skips = forecast.walk_forward(entries, seen, results, targets, {"uniform": F.col("uniform")}, settings=SimulationSettings(n_sims=n_sims))
    write_table(predictions, f"{out}/predictions")
    write_table(metrics, f"{out}/per_race", "csv")
    kept = spark.read.option("header", True).schema(metrics.schema).csv(f"{out}/per_race")
    board = evaluation.leaderboard(kept, "model", ["top1", "ndcg5", "spearman", "rank_mae", "winner_logloss"])
    write_table(board, f"{out}/leaderboard", "csv")
    write_table(evaluation.paired_table(kept, "simulation", "target", ("top1", "ndcg5", "spearman", "rank_mae"), draws=draws), f"{out}/paired_tests", "csv")
    made = spark.read.parquet(f"{out}/predictions").where("win_probability IS NOT NULL")
    write_table(evaluation.probability_report(made), f"{out}/probability_report", "csv")
    write_table(skips, f"{out}/skipped", "csv")
    inputs = [paths.files_of(spark, f"{folder}/{n}.parquet") for n in ("results", "qualifying", "schedule")]
    paths.write_text(spark, f"{out}/manifest.json", manifest(spark, inputs, seasons=list(seasons), n_sims=n_sims, spark_version=spark.version))
    return board


def predict(spark: SparkSession, folder: str, entries: str, out: str, n_sims: int) -> DataFrame:
    """The forecast of the race of an entry list (CSV with race_id, driver_id, constructor_id) from all events before it."""
    seen, results, calendar = model_tables(load_panel(spark, folder))
    named = spark.read.option("header", True).csv(entries).select(F.col("race_id").alias("target"), F.col("driver_id").alias("driver"), F.col("constructor_id").alias("team"))
    targets = calendar.join(named.select("target").distinct(), "target", "left_semi")
    if targets.isEmpty():
        raise ContractError("the entry list's race is not in the calendar")
    write_table(forecast.forecast_races(named, seen, results, targets, settings=SimulationSettings(n_sims=n_sims)), f"{out}/forecast")
    return spark.read.parquet(f"{out}/forecast")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridspark")
    parser.add_argument("--root", default=".", help="outputs must lie within this folder")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, extra in (("ingest", ["landed"]), ("backtest", ["panel"]), ("predict", ["panel", "entries"])):
        job = jobs.add_parser(name)
        for x in extra:
            job.add_argument(x)
        job.add_argument("--out", required=True)
        job.add_argument("--sims", type=int, default=100_000 if name == "predict" else 20_000)
        job.add_argument("--seasons", type=int, nargs=2, default=(2022, 2025))
        job.add_argument("--draws", type=int, default=10_000)
    args = parser.parse_args(argv)
    try:
        spark = spark or SparkSession.builder.appName("gridspark").getOrCreate()
        out = confined(spark, args.out, args.root)
        if args.job == "ingest":
            print(", ".join(ingest(spark, args.landed, out)))
        elif args.job == "backtest":
            backtest(spark, args.panel, out, tuple(args.seasons), args.sims, args.draws).show(truncate=False)
        else:
            predict(spark, args.panel, args.entries, out, args.sims).orderBy("predicted_rank").show(truncate=False)
    except (ContractError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
