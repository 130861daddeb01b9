"""Timing, weather and control feeds brought to shared contracts, and the addresses and records of cached responses."""

from __future__ import annotations

from urllib.parse import quote, urlencode

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.guards import ContractError, require_unique
from ..operators.temporal import as_of, interval_join

# Columns of the practice contract and their types.
PRACTICE = {
    "race_id": "string", "season": "int", "stage": "string", "driver_id": "string", "lap_duration": "double", "tyre_age": "double", "compound": "string", "stint_number": "double",
    "is_pit_out_lap": "boolean", "interrupted": "boolean", "rainfall": "double", "date_start": "timestamp", "observed_at": "timestamp", "session_start": "timestamp", "cutoff_utc": "timestamp",
}
# Names that feeds use, and ours.
CAR = {"date": "timestamp", "n_gear": "gear"}
WEATHER = {"date": "timestamp", "air_temperature": "air_temp", "track_temperature": "track_temp"}
TRACE = {"distance_m": "distance", "speed_kmh": "speed", "throttle_pct": "throttle", "brake_pct": "brake", "x_m": "x", "y_m": "y", "z_m": "z", "time": "time_s"}
LAP = {"Distance": "distance", "Speed": "speed", "Throttle": "throttle", "Brake": "brake", "RPM": "rpm", "nGear": "gear", "DRS": "drs", "X": "x", "Y": "y", "Z": "z", "Time": "time_delta"}
SESSION_WEATHER = {"Time": "time_delta", "AirTemp": "air_temp", "TrackTemp": "track_temp", "Humidity": "humidity", "Pressure": "pressure", "Rainfall": "rainfall", "WindDirection": "wind_direction", "WindSpeed": "wind_speed"}
CORNERS = {"Number": "corner", "Distance": "distance", "Angle": "angle"}
TELEMETRY = ("distance", "speed", "throttle", "brake", "rpm", "gear", "drs", "x", "y", "z")


def utc(value: Column) -> Column:
    """A timestamp of ISO 8601 texts with or without fractions and zone (UTC then); anything else is NULL."""
    return F.try_to_timestamp(value.cast("string"))


def flag(value: Column) -> Column:
    """A boolean of booleans, numbers and texts; missing is false."""
    return F.coalesce(value.try_cast("boolean"), F.lit(False))


def _renamed(df: DataFrame, names: dict[str, str], numbers: tuple[str, ...] = ()) -> DataFrame:
    out = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
    have = [c for c in numbers if c in out.columns]
    return out.withColumns({c: F.col(c).try_cast("double") for c in have}) if have else out


def normalise_practice(df: DataFrame) -> DataFrame:
    """df with the contract's columns in its types: times in UTC, flags without NULL, compounds in upper case; further
    columns stay."""
    if missing := sorted(set(PRACTICE) - set(df.columns)):
        raise ContractError(f"practice source is missing {', '.join(missing)}")
    cast = {"timestamp": lambda c: utc(F.col(c)), "boolean": lambda c: flag(F.col(c))}
    out = df.withColumns({c: cast[t](c) if t in cast else F.col(c).try_cast(t) for c, t in PRACTICE.items()})
    return out.withColumn("compound", F.upper("compound"))


def normalise_car_data(df: DataFrame) -> DataFrame:
    out = _renamed(df, CAR, ("speed", "throttle", "brake", "rpm", "gear", "drs"))
    return out.withColumn("timestamp", utc(F.col("timestamp"))) if "timestamp" in out.columns else out


def normalise_weather(df: DataFrame) -> DataFrame:
    out = _renamed(df, WEATHER)
    return out.withColumn("timestamp", utc(F.col("timestamp"))) if "timestamp" in out.columns else out


def normalise_trace(df: DataFrame) -> DataFrame:
    """Columns in lower case with underscores, and units dropped from their names."""
    return _renamed(df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns]), TRACE)


def corner_markers(df: DataFrame) -> DataFrame:
    out = _renamed(df, CORNERS)
    return out.select(*[c for c in CORNERS.values() if c in out.columns])


def _seconds(interval: Column) -> Column:
    return F.expr("1").cast("double") * (F.extract(F.lit("DAY"), interval) * 86400 + F.extract(F.lit("HOUR"), interval) * 3600 + F.extract(F.lit("MINUTE"), interval) * 60 + F.extract(F.lit("SECOND"), interval).cast("double"))


def lap_telemetry(df: DataFrame) -> DataFrame:
    """A lap's trace in our names and numbers; time_s is the elapsed interval in seconds."""
    out = _renamed(df, LAP, TELEMETRY)
    return out.withColumn("time_s", _seconds(F.col("time_delta"))) if "time_delta" in out.columns else out


def session_weather(df: DataFrame, start: Column) -> DataFrame:
    """Weather rows with the timestamp that the session's start and their elapsed interval give."""
    out = _renamed(df, SESSION_WEATHER)
    return out.withColumn("timestamp", start + F.col("time_delta")) if "time_delta" in out.columns else out


def driver_codes(results: DataFrame) -> DataFrame:
    """season, driver_code, driver_id; a code that names two drivers in a season is refused."""
    codes = results.select("season", "driver_code", "driver_id").where("driver_code IS NOT NULL").distinct()
    return require_unique(codes, ["season", "driver_code"])


def match_calendar(sessions: DataFrame, schedule: DataFrame, before: int, after: int) -> DataFrame:
    """sessions with race_id, circuit_id, race_season and status: 'matched' if exactly one race of the season lies
    between so many days before and after the session's day, else 'calendar_match_failed'.

    Both sides meet on season and day, each race once for every day of its band, so there is no join on a range.
    """
    day = F.date_sub(F.to_date("date"), 0)
    races = schedule.select(F.col("season").alias("race_season"), F.col("race_id"), "circuit_id", F.explode(F.sequence(F.date_sub(day, after), F.date_add(day, before))).alias("__day"))
    own = sessions.withColumn("__day", F.to_date(utc(F.col("date_start"))))
    hit = own.join(races, (own["season"] == races["race_season"]) & (own["__day"] == races["__day"]), "left").drop("__day")
    per = hit.groupBy(*sessions.columns).agg(F.count("race_id").alias("__n"), F.first("race_id").alias("race_id"), F.first("circuit_id").alias("circuit_id"))
    one = F.col("__n") == 1
    return per.select(
        *sessions.columns, F.when(one, F.col("race_id")).alias("race_id"), F.when(one, F.col("circuit_id")).alias("circuit_id"),
        F.when(one, "matched").otherwise("calendar_match_failed").alias("status"))


def practice_laps(laps: DataFrame, stints: DataFrame, drivers: DataFrame, control: DataFrame, weather: DataFrame, sessions: DataFrame, codes: DataFrame, stage: str = "POST_FP2") -> DataFrame:
    """Laps of matched practice sessions in the contract: driver by code, the last stint that holds the lap, laps near a
    control message marked as interrupted (all of a session without control), weather as of the lap's end.

    sessions has (session_key, race_id, season, date_start, date_end) of matched sessions.
    """
    known = drivers.select("session_key", "driver_number", F.col("name_acronym").alias("driver_code")).distinct()
    s = sessions.select("session_key", "race_id", "season", utc(F.col("date_start")).alias("session_start"), (utc(F.col("date_end")) + F.expr("INTERVAL 5 MINUTES")).alias("cutoff_utc"))
    rows = laps.drop("season", "race_id").join(F.broadcast(s), "session_key").join(known, ["session_key", "driver_number"]).join(codes, ["season", "driver_code"], "left")
    rows = rows.withColumn("date_start", utc(F.col("date_start"))).withColumn("observed_at", F.col("date_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("lap_duration").cast("decimal(18,6)")))
    own = stints.select("session_key", "driver_number", "stint_number", "lap_start", "lap_end", "compound", F.col("tyre_age_at_start"))
    rows = interval_join(rows.where("observed_at IS NOT NULL"), own, ["session_key", "driver_number"], "lap_number", "lap_start", "lap_end", "stint_number")
    rows = rows.withColumn("tyre_age", F.col("lap_number") - F.col("lap_start") + F.coalesce("tyre_age_at_start", F.lit(0)))
    calls = control.select("session_key", utc(F.col("date")).alias("__call"))
    heard = calls.select("session_key").distinct().withColumn("__heard", F.lit(True))
    rows = rows.withColumn("__lap", F.xxhash64("session_key", "driver_number", "lap_number", "date_start"))
    near = rows.select("session_key", "__lap", "date_start", "observed_at").join(calls, "session_key")
    near = near.where((F.col("date_start") <= F.col("__call")) & (F.col("observed_at") + F.expr("INTERVAL 2 MINUTES") >= F.col("__call"))).select("session_key", "__lap").distinct().withColumn("__near", F.lit(True))
    rows = rows.join(near, ["session_key", "__lap"], "left").join(F.broadcast(heard), "session_key", "left")
    rows = rows.withColumn("interrupted", F.col("__near").isNotNull() | F.col("__heard").isNull()).drop("__near", "__heard", "__lap")
    air = weather.select("session_key", utc(F.col("date")).alias("observed_at"), F.col("rainfall").try_cast("double").alias("rainfall"))
    rows = as_of(rows, air, ["session_key"], "observed_at", ["rainfall"]).drop("matched_at")
    return normalise_practice(rows.withColumn("stage", F.lit(stage)))


def timing_laps(laps: DataFrame, weather: DataFrame, codes: DataFrame, start: Column) -> DataFrame:
    """Laps of an alternate timing source in the contract's columns: a lap counts as interrupted unless the source
    vouches for it, and without weather every lap counts as wet."""
    lap = laps.select(
        "race_id", "season", "stage", F.col("Driver").cast("string").alias("driver_code"), F.col("LapNumber").try_cast("double").alias("lap_number"), _seconds(F.col("LapTime")).alias("lap_duration"),
        F.col("TyreLife").try_cast("double").alias("tyre_age"), F.upper(F.col("Compound").cast("string")).alias("compound"), F.col("Stint").try_cast("double").alias("stint_number"),
        F.col("PitOutTime").isNotNull().alias("is_pit_out_lap"), (start + F.col("LapStartTime")).alias("date_start"), (start + F.col("LapStartTime") + F.col("LapTime")).alias("observed_at"),
        (flag(F.col("Deleted")) | ~flag(F.col("IsAccurate")) | F.col("PitInTime").isNotNull() | F.coalesce(F.col("TrackStatus").cast("string") != "1", F.lit(True))).alias("interrupted"))
    lap = lap.join(codes, ["season", "driver_code"]).where("driver_id IS NOT NULL AND observed_at IS NOT NULL")
    lap = lap.withColumn("session_start", start).withColumn("cutoff_utc", F.max("observed_at").over(Window.partitionBy("race_id")) + F.expr("INTERVAL 5 MINUTES"))
    air = weather.select("race_id", (start + F.col("Time")).alias("observed_at"), F.col("Rainfall").cast("double").alias("rainfall")).where("rainfall IS NOT NULL")
    has = air.select("race_id").distinct().withColumn("__air", F.lit(True))
    out = as_of(lap, air, ["race_id"], "observed_at", ["rainfall"]).drop("matched_at").join(F.broadcast(has), "race_id", "left")
    return normalise_practice(out.withColumn("rainfall", F.when(F.col("__air").isNull(), 1.0).otherwise(F.coalesce("rainfall", F.lit(0.0)))).drop("__air"))


def race_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events of matched race sessions with race_id, season and circuit_id."""
    s = sessions.where("status = 'matched'").select("session_key", "race_id", "season", "circuit_id")
    return events.drop("race_id", "season", "circuit_id").join(F.broadcast(s), "session_key")


def union_known(frames: list[DataFrame]) -> DataFrame:
    """All frames by name; columns that one lacks are NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def endpoint_url(base: str, endpoint: str, **params) -> str:
    return f"{base}/{quote(endpoint.strip('/'))}?{urlencode(params, doseq=True)}"


def trace_url(base: str, event: str, session: str, filename: str) -> str:
    return "/".join([base, *map(quote, (event, session, filename))])


def archived_weather_url(base: str, lat: float, lon: float, start_date: str, end_date: str, hourly: list[str], past_days: int | None = None) -> str:
    params = {"latitude": lat, "longitude": lon, "start_date": start_date, "end_date": end_date, "hourly": ",".join(hourly), "timezone": "UTC"}
    return f"{base}?{urlencode(params | ({} if past_days is None else {'past_days': past_days}))}"


def cache_key(url: Column) -> Column:
    """The name under which a response is cached."""
    return F.substring(F.sha2(url, 256), 1, 32)


def provenance(spark: SparkSession, folder: str) -> DataFrame:
    """url, fetched_at, status, bytes of every cached response's record."""
    return spark.read.schema("url string, fetched_at string, status int, bytes long").json(f"{folder}/*.meta.json")


def record_of(records: DataFrame, url: str) -> DataFrame:
    return records.where(F.col("url") == url)


def over_quota(requests: DataFrame, client: str, time: str, most: int, seconds: int) -> DataFrame:
    """Requests that follow `most` others of their client within so many seconds: what a limiter would have held back."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(client).orderBy("__at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("__at", at).withColumn("in_window", F.count("*").over(w)).where(F.col("in_window") > most).drop("__at")
