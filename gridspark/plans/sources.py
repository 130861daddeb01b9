"""Queries of flattened responses, normalised feeds and vehicle dynamics, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources import feeds, responses
from .catalog import longs, query, r6, r6s, table

# Orders stand for races and their lines for results: each order is one landed response.
_ORDERS = """
ra AS (SELECT o_orderkey, CAST(year(o_orderdate) + 20 AS BIGINT) AS season, CAST(o_orderkey % 30 + 1 AS BIGINT) AS round, o_custkey, o_orderdate FROM orders),
li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_tax, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos FROM lineitem),
re AS (SELECT CAST(season AS VARCHAR) || '_' || lpad(CAST(round AS VARCHAR), 2, '0') AS race_id, ra.*, li.* FROM ra JOIN li ON l_orderkey = o_orderkey)
"""


#: Lines that one task orders and puts into responses.
LINES = 1_000_000


def _landed(spark, sf_dir):
    """body, fetched_at, query: JSON of every order."""
    o = table(spark, sf_dir, "orders")
    text = lambda c: c.cast("string")
    li = table(spark, sf_dir, "lineitem")
    # Both sides are dealt by order once, to as many tasks as the lines need.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // LINES))
    held = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_returnflag", "l_linestatus")]
    per = li.select("l_orderkey", *held).repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*held))).alias("x"))
    o = o.repartition(parts, "o_orderkey")

    def both(e, i):
        """A line's entries among results and qualifying results, by its place in its order."""
        line, pos = e.getField, i + 1
        whole = lambda name: line(name).cast("long").cast("string")
        driver = F.struct(F.concat(F.lit("p"), text(line("l_partkey"))).alias("driverId"), F.lit("C").alias("code"), F.lit("G").alias("givenName"), text(line("l_suppkey")).alias("familyName"))
        team = F.struct(F.concat(F.lit("s"), text(line("l_suppkey"))).alias("constructorId"), F.lit("N").alias("name"))
        out = F.when(line("l_returnflag") == "R", "R").when(line("l_returnflag") == "A", "W").otherwise(text(pos))
        status = F.when(line("l_returnflag") == "R", F.when(line("l_linestatus") == "F", "Collision damage").otherwise("Engine")).when(line("l_returnflag") == "A", "Withdrew").otherwise("Finished")
        lap = F.concat(F.lit("1:"), F.lpad(whole("l_quantity"), 2, "0"), F.lit(".5"))
        result = F.struct(
            text(pos).alias("position"), out.alias("positionText"), whole("l_linenumber").alias("grid"), whole("l_quantity").alias("laps"), F.lit("1.5").alias("points"), status.alias("status"), driver.alias("Driver"), team.alias("Constructor"),
            F.struct(F.when(line("l_tax") < 0.05, line("l_partkey").cast("string")).alias("millis")).alias("Time"), F.struct(F.lit("1").alias("rank"), F.struct(lap.alias("time")).alias("Time")).alias("FastestLap"))
        timed = F.struct(text(pos).alias("position"), lap.alias("Q1"), F.when(line("l_linenumber") > 2, F.lit("bad")).alias("Q2"), F.when(line("l_tax") < 0.03, F.concat(F.lit("1:0"), (line("l_quantity") % 10).cast("long").cast("string"))).alias("Q3"), driver.alias("Driver"), team.alias("Constructor"))
        return F.struct(result.alias("result"), timed.alias("timed"))

    per = per.withColumn("y", F.transform("x", both)).select("l_orderkey", F.col("y.result").alias("Results"), F.col("y.timed").alias("QualifyingResults"))
    where = F.struct(F.lit("l").alias("locality"), F.lit("k").alias("country"), text(F.col("o_custkey")).alias("lat"), F.lit("x").alias("long"))
    circuit = F.struct(F.concat(F.lit("c"), text(F.col("o_custkey") % 24)).alias("circuitId"), F.lit("C").alias("circuitName"), where.alias("Location"))
    race = F.struct(
        text(F.year("o_orderdate") + 20).alias("season"), text(F.col("o_orderkey") % 30 + 1).alias("round"), F.lit("R").alias("raceName"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderkey") % 2 == 0, "13:30:00Z").alias("time"), circuit.alias("Circuit"), "Results", "QualifyingResults")
    page = F.struct(F.lit("100").alias("limit"), F.lit("0").alias("offset"), F.lit("1").alias("total"), F.struct(F.array(race).alias("Races")).alias("RaceTable"))
    return o.join(per, F.col("o_orderkey") == F.col("l_orderkey")).select(F.to_json(F.struct(page.alias("MRData"))).alias("body"), F.lit("2024-01-01").alias("fetched_at"), text(F.col("o_orderkey")).alias("query"))


@query(f"""
WITH {_ORDERS} SELECT DISTINCT race_id, season, round, 'c' || CAST(o_custkey % 24 AS VARCHAR) AS circuit_id, CAST(o_custkey AS DOUBLE) AS lat, o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 810 MINUTE ELSE INTERVAL 720 MINUTE END AS race_start_utc,
  CASE WHEN season BETWEEN 2014 AND 2016 THEN 'R2014' WHEN season BETWEEN 2017 AND 2021 THEN 'R2017' WHEN season BETWEEN 2022 AND 2025 THEN 'R2022' WHEN season >= 2026 THEN 'R2026' ELSE 'UNKNOWN' END AS regime, o_orderkey FROM re
""")
def flattened_schedule(spark, sf_dir):
    out = responses.flatten_schedule(_landed(spark, sf_dir), keep=("query",)).withColumn("o_orderkey", F.col("query").cast("long"))
    start = out.withColumn("race_start_utc", F.col("race_start_utc").cast("timestamp_ntz"))
    return start.select("race_id", *longs("season", "round"), "circuit_id", "lat", "race_start_utc", "regime", "o_orderkey").distinct()


@query(f"""
WITH {_ORDERS}, s AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'non_starter' WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'incident' ELSE 'mechanical' END ELSE 'finished' END AS sc FROM re),
t AS (SELECT *, CAST(sc = 'finished' AS INT) AS cl, CAST(sc <> 'non_starter' AS INT) AS st FROM s)
SELECT race_id, 'p' || CAST(l_partkey AS VARCHAR) AS driver_id, 's' || CAST(l_suppkey AS VARCHAR) AS constructor_id, CAST(pos AS DOUBLE) AS position_order, sc AS status_class, CAST(cl AS BIGINT) AS classified, CAST(st AS BIGINT) AS started, CAST(st = 1 AND cl = 0 AS BIGINT) AS dnf,
  CAST(st = 1 AND cl = 0 AND sc = 'incident' AS BIGINT) AS dnf_incident, CAST(pos = 1 AND cl = 1 AS BIGINT) AS winner, CAST(pos <= 3 AND cl = 1 AS BIGINT) AS podium, CASE WHEN l_tax < 0.05 THEN CAST(l_partkey AS DOUBLE) END AS total_ms, 60.5 + l_quantity AS fastest_lap_s,
  CAST(sum(st) OVER (PARTITION BY race_id) AS BIGINT) AS field_size FROM t
""")
def flattened_results(spark, sf_dir):
    out = responses.flatten_results(_landed(spark, sf_dir))
    return out.select("race_id", "driver_id", "constructor_id", "position_order", "status_class", *longs("classified", "started", "dnf", "dnf_incident", "winner", "podium"), "total_ms", "fastest_lap_s", *longs("field_size"))


@query(f"""
WITH {_ORDERS}, q AS (SELECT race_id, l_partkey, pos, 60.5 + l_quantity AS q1, CASE WHEN l_tax < 0.03 THEN 60.0 + CAST(floor(l_quantity) AS BIGINT) % 10 END AS q3 FROM re), b AS (SELECT *, least(q1, coalesce(q3, q1)) AS best FROM q)
SELECT race_id, 'p' || CAST(l_partkey AS VARCHAR) AS driver_id, CAST(pos AS DOUBLE) AS qual_position, CAST(q1 AS DOUBLE) AS q1_s, CAST(q3 AS DOUBLE) AS q3_s, CAST(best AS DOUBLE) AS qual_best_s, round(100.0 * (best - min(best) OVER (PARTITION BY race_id)) / min(best) OVER (PARTITION BY race_id), 6) AS qual_gap_pct FROM b
""")
def flattened_qualifying(spark, sf_dir):
    out = responses.flatten_qualifying(_landed(spark, sf_dir)).where("q2_s IS NULL")
    return out.select("race_id", "driver_id", "qual_position", "q1_s", "q3_s", "qual_best_s", *r6s("qual_gap_pct"))


@query("""
SELECT event_id, CAST(user_id AS DOUBLE) AS gear, value AS speed, ts AS timestamp FROM events
""")
def normalised_feed(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    raw = ev.select("event_id", stamp.alias("date"), F.col("user_id").cast("string").alias("n_gear"), F.col("value").cast("string").alias("speed"))
    return feeds.normalise_car_data(raw).select("event_id", "gear", "speed", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("""
SELECT event_id, round((pow((value + 200) / 3.6, 2) - pow(value / 3.6, 2)) / 200, 6) AS braking, round(value / 3.6 / 2, 6) AS traction, round(value * 3, 6) AS amplification,
  round(100 * (1 / greatest((value + 10) / 3.6, 1e-9) - 1 / greatest((value + 20) / 3.6, 1e-9)), 6) AS gain, round(pow(value / 3.6, 2) * 0.01 / 9.80665, 6) AS lateral, round(pow(value / 3.6, 2) * 0.01 / 9.80665 * least(value / 100.0, 1), 6) AS commitment,
  round(user_id * cos(radians(value - 30)), 6) AS head, round(abs(user_id * sin(radians(value - 30))), 6) AS side, CASE WHEN value / 20 < 1 THEN 'dirty' WHEN value / 20 < 2 THEN 'affected' ELSE 'clean' END AS traffic, round(value - 5, 6) AS pit,
  round(greatest(value - 40, 0) * 2 / 20, 6) AS undercut, round((value + 5 * 0.5) / 6, 6) AS shrunk, 60.5 + CAST(user_id % 50 AS DOUBLE) AS clock FROM events WHERE value IS NOT NULL AND value >= 0
""")
def vehicle_dynamics(spark, sf_dir):
    v, lit = F.col("value"), F.lit
    head, side = S.wind_components(F.col("user_id").cast("double"), v, lit(30.0))
    clock = F.concat(lit("1:"), F.lpad((F.col("user_id") % 50).cast("string"), 2, "0"), lit(".5"))
    return table(spark, sf_dir, "events").where("value IS NOT NULL AND value >= 0").select(
        "event_id", r6(S.braking_efficiency(v + 200, v, lit(100.0)), "braking"), r6(S.traction_index(lit(0.0), v, lit(2.0)), "traction"), r6(S.exit_amplification(v, lit(3.0)), "amplification"),
        r6(S.straight_time_gain(v + 20, v + 10, lit(100.0)), "gain"), r6(S.lateral_g(v, lit(-0.01)), "lateral"), r6(S.aero_commitment(v, lit(0.01), v), "commitment"), r6(head, "head"), r6(side, "side"),
        S.traffic_class(v / 20).alias("traffic"), r6(S.pit_loss(lit(2.0), v, lit(3.0)), "pit"), r6(S.undercut_power(v, lit(40.0), lit(20.0)), "undercut"), r6(S.shrink_mean(v, lit(1), lit(0.5)), "shrunk"), S.clock_seconds(clock).alias("clock"))
