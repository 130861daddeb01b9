"""Landed API responses flattened to tables: calendar, results, qualifying and standings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clock_seconds, regime, status_class
from ..staging import staged

_DRIVER = "Driver:struct<driverId:string,code:string,givenName:string,familyName:string,dateOfBirth:string>"
_TEAM = "struct<constructorId:string,name:string>"
_RACE = "season:string,round:string,raceName:string,date:string,time:string,Circuit:struct<circuitId:string,circuitName:string,Location:struct<locality:string,country:string,lat:string,long:string>>"
_RESULT = (
    f"position:string,positionText:string,grid:string,laps:string,points:string,status:string,{_DRIVER},Constructor:{_TEAM},Time:struct<millis:string>,"
    "FastestLap:struct<rank:string,Time:struct<time:string>>"
)
#: Schemas of a response's list of races and of its standings; only what is needed is parsed.
RACES = f"array<struct<{_RACE},Results:array<struct<{_RESULT}>>,QualifyingResults:array<struct<position:string,Q1:string,Q2:string,Q3:string,{_DRIVER},Constructor:{_TEAM}>>>>"
STANDINGS = f"array<struct<season:string,round:string,DriverStandings:array<struct<position:string,positionText:string,points:string,wins:string,{_DRIVER},Constructors:array<{_TEAM}>>>>>"
_PAGE = "MRData struct<`limit`:string,`offset`:string,total:string,RaceTable:struct<Races:%s>,StandingsTable:struct<StandingsLists:%s>>" % (RACES, STANDINGS)


def parsed(landed: DataFrame, body: str = "body", fetched: str = "fetched_at", keep: tuple[str, ...] = ()) -> DataFrame:
    """fetched_at, limit, offset, total, races, lists of each response and columns to keep; broken JSON gives NULLs."""
    page = F.from_json(F.col(body), _PAGE)["MRData"]
    number = lambda c: page[c].try_cast("long").alias(c)
    return landed.select(F.col(fetched).alias("fetched_at"), number("limit"), number("offset"), number("total"), page["RaceTable"]["Races"].alias("races"), page["StandingsTable"]["StandingsLists"].alias("lists"), *keep)


def missing_pages(landed: DataFrame, query: str, body: str = "body", fetched: str = "fetched_at") -> DataFrame:
    """<query>, offset of the pages that a query's responses promise by their total and limit but that did not land."""
    page = F.from_json(F.col(body), _PAGE)["MRData"]
    p = landed.select(query, *[page[c].try_cast("long").alias(c) for c in ("limit", "offset", "total")]).where("`limit` > 0 AND total > 0")
    wanted = p.groupBy(query).agg(F.max("total").alias("total"), F.min("limit").alias("limit"))
    wanted = wanted.select(query, F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.col("limit"))).alias("offset"))
    return wanted.join(p.select(query, "offset"), [query, "offset"], "left_anti")


def race_id(season: Column, round_: Column) -> Column:
    """season_round, the round with two digits at least; NULL if either is missing."""
    n = round_.cast("int").cast("string")
    return F.concat(season.cast("int").cast("string"), F.lit("_"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))


def _races(landed: DataFrame, body: str, fetched: str, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = parsed(landed, body, fetched, keep).select("fetched_at", *keep, F.explode("races").alias("r"))
    season, round_ = F.col("r.season").try_cast("int"), F.col("r.round").try_cast("int")
    return rows.select("fetched_at", *keep, "r", season.alias("season"), round_.alias("round"), race_id(season, round_).alias("race_id"))


def _number(column: str, name: str, kind: str = "double") -> Column:
    return F.col(column).try_cast(kind).alias(name)


def flatten_schedule(landed: DataFrame, body: str = "body", fetched: str = "fetched_at", keep: tuple[str, ...] = ()) -> DataFrame:
    """The calendar, with the start in UTC (noon where no time is given), the regime, and columns of responses to keep."""
    start = F.concat_ws(" ", F.col("r.date"), F.replace(F.coalesce("r.time", F.lit("12:00:00Z")), F.lit("Z"), F.lit("")))
    place = "r.Circuit.Location"
    return _races(landed, body, fetched, keep).select(
        *keep, "race_id", "season", "round", F.col("r.raceName").alias("race_name"), F.col("r.Circuit.circuitId").alias("circuit_id"), F.col("r.Circuit.circuitName").alias("circuit_name"),
        F.col(f"{place}.locality").alias("locality"), F.col(f"{place}.country").alias("country"), _number(f"{place}.lat", "lat"), _number(f"{place}.long", "lon"),
        F.col("r.date").alias("date"), F.col("r.time").alias("time"), F.try_to_timestamp(start).alias("race_start_utc"), regime(F.col("season")).alias("regime"))


def with_outcome(df: DataFrame) -> DataFrame:
    """df with the columns that status, position_text, position_order and season imply."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out = df.withColumn("status_class", status_class(F.col("status"), F.col("position_text")))
    out = out.withColumns({"classified": flag(F.col("position_text").rlike("^[0-9]+$")), "started": flag(F.col("status_class") != "non_starter"), "regime": regime(F.col("season"))})
    out = out.withColumn("dnf", flag((F.col("started") == 1) & (F.col("classified") == 0)))
    upto = lambda k: flag((F.col("position_order") <= k) & (F.col("classified") == 1))
    out = out.withColumns({
        "dnf_mechanical": flag((F.col("dnf") == 1) & (F.col("status_class") == "mechanical")), "dnf_incident": flag((F.col("dnf") == 1) & (F.col("status_class") == "incident")),
        "winner": flag((F.col("position_order") == 1) & (F.col("classified") == 1)), "podium": upto(3), "top10": upto(10),
    })
    return _with_race(out, field_size=F.sum("started").cast("int"))


def _with_race(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with aggregates of their race, NULL being one; rows are written down, so that no task holds a race's rows.

    One row a race is joined: a broadcast if its files are small, as Spark sees by their size, else a shuffle.
    """
    rows = staged(rows, "responses", keep=True)
    per = staged(rows.groupBy(F.col("race_id").alias("__race")).agg(*[v.alias(k) for k, v in values.items()]), "races", keep=True)
    return rows.join(per, F.col("race_id").eqNullSafe(F.col("__race"))).drop("__race")


def flatten_results(landed: DataFrame, body: str = "body", fetched: str = "fetched_at") -> DataFrame:
    """One row per result, with outcome columns; the field's size counts starters."""
    rows = _races(landed, body, fetched).select("*", F.explode("r.Results").alias("x"))
    rows = rows.select(
        "race_id", F.col("fetched_at").alias("observed_at"), "season", "round", F.col("r.Circuit.circuitId").alias("circuit_id"), F.col("r.date").alias("date"),
        F.col("x.Driver.driverId").alias("driver_id"), F.col("x.Driver.code").alias("driver_code"), F.concat_ws(" ", "x.Driver.givenName", "x.Driver.familyName").alias("driver_name"),
        F.col("x.Driver.dateOfBirth").alias("dob"), F.col("x.Constructor.constructorId").alias("constructor_id"), F.col("x.Constructor.name").alias("constructor_name"),
        _number("x.grid", "grid"), _number("x.position", "position_order"), F.col("x.positionText").alias("position_text"), _number("x.points", "points"), _number("x.laps", "laps"),
        F.col("x.status").alias("status"), _number("x.Time.millis", "total_ms"), clock_seconds(F.col("x.FastestLap.Time.time")).alias("fastest_lap_s"), _number("x.FastestLap.rank", "fastest_lap_rank"))
    return with_outcome(rows)


def flatten_qualifying(landed: DataFrame, body: str = "body", fetched: str = "fetched_at") -> DataFrame:
    """One row per qualifying result: the three segments' times, the best, and its gap in percent to the race's best."""
    rows = _races(landed, body, fetched).select("*", F.explode("r.QualifyingResults").alias("x"))
    rows = rows.select(
        "race_id", "season", "round", F.col("x.Driver.driverId").alias("driver_id"), F.col("x.Constructor.constructorId").alias("constructor_id"), _number("x.position", "qual_position"),
        F.col("fetched_at").alias("observed_at"), *[clock_seconds(F.col(f"x.Q{k}")).alias(f"q{k}_s") for k in (1, 2, 3)])
    rows = rows.withColumn("qual_best_s", F.least("q1_s", "q2_s", "q3_s"))
    rows, best = _with_race(rows, __best=F.min("qual_best_s")), F.col("__best")
    return rows.withColumn("qual_gap_pct", 100.0 * (F.col("qual_best_s") - best) / best).drop("__best")


def flatten_standings(landed: DataFrame, body: str = "body", fetched: str = "fetched_at") -> DataFrame:
    """One row per driver of a response's first standings list."""
    rows = parsed(landed, body, fetched).select("fetched_at", F.get("lists", F.lit(0)).alias("l")).select("fetched_at", "l", F.explode("l.DriverStandings").alias("x"))
    return rows.select(
        _number("l.season", "season", "int"), _number("l.round", "after_round", "int"), F.col("x.Driver.driverId").alias("driver_id"), F.get("x.Constructors", F.lit(0))["constructorId"].alias("constructor_id"),
        _number("x.position", "championship_position"), F.col("x.positionText").alias("position_text"), F.col("fetched_at").alias("observed_at"), _number("x.points", "championship_points"), _number("x.wins", "championship_wins", "int"))
