"""A panel: facts bound to one calendar, with availability times, observations, baselines and alignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_score, qualifying_score, stage_cutoff
from .guards import ContractError, require_reference, require_unique
from .temporal import event_index


@dataclass(frozen=True)
class Panel:
    results: DataFrame
    qualifying: DataFrame
    schedule: DataFrame
    observations: DataFrame
    event_order: DataFrame
    #: Championship tables and counted passes, where a panel has them.
    standings: DataFrame | None = None
    passes: DataFrame | None = None


def with_availability(df: DataFrame, date: str, published: str | None = None) -> DataFrame:
    """available_at: the published time, else one day after the event; availability_basis says which."""
    proxy = F.col(date).cast("timestamp") + F.make_dt_interval(F.lit(1))
    known = F.col(published) if published else F.lit(None).cast("timestamp")
    return df.withColumn("available_at", F.coalesce(known, proxy)).withColumn("availability_basis", F.when(known.isNotNull(), "published").otherwise("reconstructed"))


def observations(results: DataFrame, qualifying: DataFrame, race_score: str = "rank") -> DataFrame:
    """race_id, driver_id, kind, score: classified finishers by normal score of their rank, or by their pace over the
    distance (race_score "pace", which needs laps, total_ms and fastest_lap_s); qualifying by gap."""
    if race_score not in ("rank", "pace"):
        raise ContractError(f"no such race score: {race_score}")
    if race_score == "pace":
        from .pace import race_pace

        timed = race_pace(results, "race_id", "laps", "total_ms", "fastest_lap_s").where("score IS NOT NULL")
        race = timed.select("race_id", "driver_id", F.lit("race").alias("kind"), "score")
    else:
        n = F.count("*").over(Window.partitionBy("race_id")).cast("double")
        race = results.where("classified = 1").select("race_id", "driver_id", F.lit("race").alias("kind"), normal_score(F.col("position_order").cast("double"), n).alias("score"))
    laps = qualifying.where("qual_gap_pct IS NOT NULL").select("race_id", "driver_id", F.lit("qualifying").alias("kind"), qualifying_score(F.col("qual_gap_pct")).alias("score"))
    return race.unionByName(laps)


def build_panel(results: DataFrame, qualifying: DataFrame, schedule: DataFrame, published: str | None = None, standings: DataFrame | None = None, passes: DataFrame | None = None, race_score: str = "rank") -> Panel:
    """Checks keys and references, then joins the calendar's dense index; the calendar is a small dimension.

    standings (season, after_round, driver_id) and passes (race_id) are optional; races of passes must be in the calendar.
    """
    if standings is not None:
        require_unique(standings, ["season", "after_round", "driver_id"])
    if passes is not None:
        require_reference(passes, ["race_id"], schedule)
    require_unique(schedule, ["race_id"])
    require_unique(schedule, ["season", "round"])
    order = event_index(schedule, ["season", "round", "race_id"]).select("race_id", "event_index")
    dates = schedule.select("race_id", "date").join(order, "race_id")
    facts = []
    for fact in (results, qualifying):
        require_unique(fact, ["race_id", "driver_id"])
        require_reference(fact, ["race_id"], schedule)
        facts.append(with_availability(fact.drop("date").join(dates, "race_id"), "date", published if published in fact.columns else None))
    seen = observations(*facts, race_score).join(order, "race_id")
    return Panel(facts[0], facts[1], schedule, seen, order, standings, passes)


def baselines(results: DataFrame, driver: str, index: str, position: str, points: str) -> DataFrame:
    """results with what was known of each driver before: points so far, last place, mean of the last five."""
    w = Window.partitionBy(driver).orderBy(index)
    before, five = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-5, -1)
    return results.select(
        "*", F.coalesce(F.sum(points).over(before), F.lit(0.0)).alias("gp_points"), (-F.lag(position).over(w)).cast("double").alias("last_race"), (-F.avg(position).over(five)).alias("form5")
    )


def align_field(entries: DataFrame, truth: DataFrame, race: str, driver: str, position: str) -> DataFrame:
    """Named entries re-ranked: finishers by position, then the absent by id; with counts of both kinds of surprise and
    whether the race can be scored, that is whether its winner was named."""
    t = truth.select(race, driver, F.col(position).alias("__p"))
    both = entries.select(race, driver, F.lit(1).alias("__named")).join(t, [race, driver], "full")
    w = Window.partitionBy(race)
    out = both.withColumn("n_absent", F.sum(F.col("__p").isNull().cast("long")).over(w)).withColumn("n_unforeseen", F.sum(F.col("__named").isNull().cast("long")).over(w))
    out = out.withColumn("scoreable", F.coalesce(F.bool_or((F.col("__named") == 1) & (F.col("__p") == 1)).over(w), F.lit(False)))
    rank = F.row_number().over(w.orderBy(F.col("__p").isNull(), "__p", driver))
    return out.where("__named = 1").withColumn("aligned", rank.cast("long")).select(race, driver, "aligned", F.col("__p").isNull().alias("absent"), "n_absent", "n_unforeseen", "scoreable")


def index_of(panel: Panel, race: str) -> float:
    """The event index of a race; an unknown race is refused."""
    row = panel.event_order.where(F.col("race_id") == race).select("event_index").first()
    if row is None:
        raise ContractError(f"no such race: {race}")
    return float(row[0])


def race_entries(results: DataFrame, columns: list[str], started: str = "started") -> DataFrame:
    """Retrospective entries: who started, without outcomes."""
    return results.where(F.col(started) == 1).select(*columns).distinct()


def all_baselines(entries: DataFrame, results: DataFrame, standings: DataFrame) -> DataFrame:
    """entries (race_id, driver_id, season, round, event_index, grid, qual_position) with a score for each baseline, of
    all races at once: uniform, championship, gp_points, last_race, form5, grid_score, qualifying_score.

    results has (driver_id, season, event_index, position_order, points), standings (season, after_round, driver_id,
    championship_position).  At an opener the championship is the last one's final order.  Unknown drivers come after
    all known ones.
    """
    field = F.count("*").over(Window.partitionBy("race_id")).cast("double")
    out = entries.withColumn("__field", field)
    last = standings.groupBy("season").agg(F.max("after_round").alias("__last"))
    order = standings.join(F.broadcast(last), "season").select(
        F.when(F.col("after_round") == F.col("__last"), F.array(F.struct((F.col("season") + 1).alias("s"), F.lit(1).alias("r")), F.struct(F.col("season").alias("s"), (F.col("after_round") + 1).alias("r"))))
        .otherwise(F.array(F.struct(F.col("season").alias("s"), (F.col("after_round") + 1).alias("r")))).alias("at"), F.col("driver_id").alias("__driver"), "championship_position")
    order = order.select(F.explode("at").alias("at"), "__driver", "championship_position").select(F.col("at.s").alias("__s"), F.col("at.r").alias("__r"), "__driver", "championship_position")
    order = order.where(F.col("__r") > 0)
    n = order.groupBy(F.col("__s").alias("__ns"), F.col("__r").alias("__nr")).agg(F.count("*").cast("double").alias("__known"))
    out = out.join(order, (F.col("season") == F.col("__s")) & (F.col("round") == F.col("__r")) & (F.col("driver_id") == F.col("__driver")), "left")
    out = out.join(F.broadcast(n), (F.col("season") == F.col("__ns")) & (F.col("round") == F.col("__nr")), "left")
    championship = F.when(F.col("__known").isNull(), 0.0).otherwise(-F.coalesce(F.col("championship_position").cast("double"), F.col("__known") + 1))
    # What was known of a driver before an event: cumulated over the driver's own earlier events, met by the latest.
    w = Window.partitionBy("driver_id").orderBy("event_index")
    season = Window.partitionBy("driver_id", "season").orderBy("event_index")
    seen = results.select(
        F.col("driver_id").alias("__d"), F.col("season").alias("__hs"), F.col("event_index").alias("__i"), F.sum("points").over(season).alias("__points"), F.avg("position_order").over(w.rowsBetween(-4, 0)).alias("__five"),
        F.col("position_order").alias("__pos"), F.lead("event_index").over(w).alias("__next"))
    events = results.select("event_index").unionByName(entries.select("event_index")).distinct()
    before = events.select(F.col("event_index").alias("__t"), F.lag("event_index").over(Window.orderBy("event_index")).alias("__prev"))
    out = out.join(F.broadcast(before), F.col("event_index") == F.col("__t"), "left")
    held = (F.col("driver_id") == F.col("__d")) & (F.col("__i") < F.col("event_index")) & (F.col("__next").isNull() | (F.col("__next") >= F.col("event_index")))
    out = out.join(seen, held, "left")
    behind = -(F.col("__field") + 1)
    shown = lambda c: F.rank().over(Window.partitionBy("race_id").orderBy(F.coalesce(F.when(F.col(c) > 0, F.col(c).cast("double")), F.col("__field") + 1)))
    return out.select(
        *entries.columns, F.lit(0.0).alias("uniform"), championship.alias("championship"), F.coalesce(F.when(F.col("__hs") == F.col("season"), F.col("__points")), F.lit(0.0)).alias("gp_points"),
        F.when(F.col("__prev").isNull(), 0.0).otherwise(F.coalesce(F.when(F.col("__i") == F.col("__prev"), -F.col("__pos").cast("double")), behind)).alias("last_race"),
        F.coalesce(-F.col("__five"), behind).alias("form5"), (-shown("grid")).cast("double").alias("grid_score"), (-shown("qual_position")).cast("double").alias("qualifying_score"))


def snapshots(schedule: DataFrame, results: DataFrame, stage: str = "PRE_WEEKEND", grid: DataFrame | None = None) -> DataFrame:
    """Entries of every event but a season's first, projected from the event before: (race_id, season, round, driver_id,
    constructor_id, observed_at, cutoff_utc); with a grid (race_id, driver_id, grid), unknown places go to the back.

    schedule has (race_id, season, round, event_index, race_start_utc), results (event_index, driver_id, constructor_id,
    started, available_at).  Events whose field was not known before the cutoff are left out.
    """
    w = Window.partitionBy("season").orderBy("event_index")
    target = schedule.select("race_id", "season", "round", stage_cutoff(F.col("race_start_utc"), stage).alias("cutoff_utc"), F.lag("event_index").over(w).alias("__i")).where("__i IS NOT NULL")
    past = results.where("started = 1").groupBy(F.col("event_index").alias("__i"), "driver_id", "constructor_id").agg(F.max("available_at").alias("observed_at"))
    out = past.join(F.broadcast(target), "__i").where(F.col("observed_at") < F.col("cutoff_utc"))
    out = out.select("race_id", "season", "round", "driver_id", "constructor_id", "observed_at", "cutoff_utc")
    if grid is None:
        return out
    g = grid.select("race_id", "driver_id", F.when(F.col("grid") > 0, F.col("grid")).alias("grid"))
    back = F.coalesce(F.max("grid").over(Window.partitionBy("race_id")), F.lit(0.0)) + 1
    return out.join(g, ["race_id", "driver_id"], "left").withColumn("grid", F.coalesce("grid", back))
