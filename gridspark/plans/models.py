"""Queries of strengths, race pace, corners, venues, baselines and snapshots, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import circuits, corners, filtering, pace, panel, retirement
from ..operators import estimators as E
from ..streaming.daily import daily_means as daily
from .catalog import _DAYS, _LINES, _passes, days, lines, longs, query, r6, r6s, table

_CELLS = f"""
{_LINES}, w AS (SELECT team, l_suppkey AS driver, l_quantity AS y, pow(0.5, (48 - i) / 6.0) AS w FROM li WHERE i < 48),
cell AS (SELECT team, driver, sum(w) AS wt, sum(w * y) AS wty, sum(w) AS wd, sum(w * y) AS wdy FROM w GROUP BY ALL), {_passes()}
"""


@query(f"""
WITH {_CELLS}, te AS (SELECT DISTINCT team, t FROM c4), dr AS (SELECT driver, any_value(d) AS d, sum(wd) AS n FROM c4 GROUP BY driver),
en AS (SELECT s_suppkey, CASE WHEN s_suppkey % 17 = 0 THEN 99 ELSE s_nationkey END AS team, CASE WHEN s_suppkey % 13 = 0 THEN -s_suppkey ELSE s_suppkey END AS driver FROM supplier)
SELECT s_suppkey, round(coalesce(t, 0), 6) AS team_effect, round(coalesce(d * n / (n + 3), -0.25), 6) AS driver_effect, round(coalesce(n, 0), 6) AS driver_obs_weight, d IS NULL AS is_rookie,
  round(coalesce(t, 0) + coalesce(d * n / (n + 3), -0.25), 6) AS strength FROM en LEFT JOIN te ON en.team = te.team LEFT JOIN dr ON en.driver = dr.driver
""")
def entry_strength(spark, sf_dir):
    fit = E.backfit(lines(spark, sf_dir), "team", "l_suppkey", "l_quantity", "i", 48.0)
    teams = fit.groupBy("team").agg(F.first("team_effect").alias("team_effect"))
    drivers = fit.groupBy("driver").agg(F.first("driver_shrunk").alias("shrunk_effect"), F.first("driver_weight").alias("n_obs"))
    key = F.col("s_suppkey")
    entries = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(key % 17 == 0, 99).otherwise(F.col("s_nationkey")).cast("long").alias("t"), F.when(key % 13 == 0, -key).otherwise(key).alias("d"))
    out = pace.score_entries(entries, teams, drivers, "t", "d")
    return out.select("s_suppkey", *r6s("team_effect", "driver_effect", "driver_obs_weight"), "is_rookie", *r6s("strength"))


_RACE = f"{_DAYS}, rr AS (SELECT user_id, i, CAST((7 * n + user_id) % 11 <> 0 AS INT) AS classified, CAST(n AS DOUBLE) AS laps, CASE WHEN user_id % 3 <> 0 THEN 1000 * s END AS total, CASE WHEN user_id % 7 <> 0 THEN v END AS fast FROM d)"
_GAPS = f"""
{_RACE}, ra AS (SELECT *, CASE WHEN laps = max(laps) OVER (PARTITION BY i) AND total IS NOT NULL THEN total / greatest(laps, 1) END AS lead FROM rr WHERE classified = 1),
rb AS (SELECT *, 100 * (lead - min(lead) OVER w) / min(lead) OVER w AS a, 100 * (fast - min(fast) OVER w) / min(fast) OVER w AS b FROM ra WINDOW w AS (PARTITION BY i)),
rc AS (SELECT user_id, i, CASE WHEN coalesce(a, b) BETWEEN 0 AND 8 THEN coalesce(a, b) END AS gap, CASE WHEN a IS NOT NULL THEN 'lead' WHEN b IS NOT NULL THEN 'fallback' ELSE 'none' END AS src FROM rb)
"""


def _paced(spark, sf_dir):
    d = days(spark, sf_dir)
    rows = d.select(
        "user_id", "i", ((7 * F.col("n") + F.col("user_id")) % 11 != 0).cast("int").alias("classified"), F.col("n").cast("double").alias("laps"),
        F.when(F.col("user_id") % 3 != 0, 1000 * F.col("s")).alias("total"), F.when(F.col("user_id") % 7 != 0, F.col("v")).alias("fast"))
    return pace.race_pace(rows, "i", "laps", "total", "fast")


@query(f"WITH {_GAPS} SELECT user_id, i, round(gap, 6) AS gap_pct, src AS gap_source, round(-gap / 0.75 - avg(-gap / 0.75) OVER (PARTITION BY i), 6) AS score FROM rc")
def race_pace(spark, sf_dir):
    return _paced(spark, sf_dir).select("user_id", "i", *r6s("gap_pct"), "gap_source", *r6s("score"))


@query(f"WITH {_GAPS} SELECT CAST(floor(i / 8) AS BIGINT) AS season, count(*) AS classified, count(CASE WHEN src = 'lead' THEN 1 END) AS race_time, count(CASE WHEN src = 'fallback' THEN 1 END) AS fastest_lap, count(*) - count(gap) AS unusable, round(median(gap), 6) AS median_gap_pct FROM rc GROUP BY 1")
def pace_coverage(spark, sf_dir):
    rows = _paced(spark, sf_dir).withColumn("season", F.floor(F.col("i") / 8).cast("long"))
    return pace.pace_coverage(rows, "season").select("season", *longs("classified", "race_time", "fastest_lap", "unusable"), *r6s("median_gap_pct"))


_TRACE = """
te AS (SELECT user_id % 5 AS track, user_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 600000000.0 AS distance, value AS speed, CAST(value < 20 AS INT) AS brake, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000000.0 AS time_s,
  value / 100000.0 AS curvature, least(value, 100) AS throttle FROM events WHERE value IS NOT NULL),
mk AS (SELECT t.track, k.corner, 500.0 * k.corner + 10 * t.track AS centre, lead(500.0 * k.corner + 10 * t.track) OVER (PARTITION BY t.track ORDER BY k.corner) AS nxt FROM (SELECT unnest(range(5)) AS track) t, (SELECT unnest(range(1, 9)) AS corner) k),
ln AS (SELECT track, max(distance) AS lap FROM te GROUP BY track),
sg AS (SELECT te.*, corner, centre, greatest(coalesce(nxt, lap) - centre, 0) AS straight FROM te JOIN mk ON te.track = mk.track AND distance BETWEEN centre - 120 AND centre + 180 JOIN ln ON te.track = ln.track)
"""


def _segments(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    te = table(spark, sf_dir, "events").where("value IS NOT NULL").select(
        (F.col("user_id") % 5).alias("track"), "user_id", (micros / 600000000.0).alias("distance"), F.col("value").alias("speed"), (F.col("value") < 20).cast("int").alias("brake"), (micros / 1000000000.0).alias("time_s"),
        (F.col("value") / 100000.0).alias("curvature"), F.least("value", F.lit(100.0)).alias("throttle"))
    markers = spark.range(5).select(F.col("id").alias("track"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("corner")).withColumn("distance", 500.0 * F.col("corner") + 10 * F.col("track"))
    ends = te.groupBy("track").agg(F.max("distance").alias("lap_length"))
    return corners.segment_corners(te, markers, ["track"]).join(corners.following_straights(markers, ends, ["track"]), ["track", "corner"])


@query(f"WITH {_TRACE} SELECT track, corner, count(*) AS n, round(min(distance - centre), 6) AS first_m, round(max(distance - centre), 6) AS last_m, round(max(straight), 6) AS straight FROM sg GROUP BY ALL")
def corner_segments(spark, sf_dir):
    s = _segments(spark, sf_dir)
    return s.groupBy("track", "corner").agg(F.count("*").alias("n"), r6(F.min("relative_distance"), "first_m"), r6(F.max("relative_distance"), "last_m"), r6(F.max("following_straight"), "straight"))


_APEX = f"""
{_TRACE}, ap AS (SELECT *, min(speed) OVER w AS slow, first_value(distance) OVER (PARTITION BY track, user_id, corner ORDER BY speed, distance) AS axd FROM sg WINDOW w AS (PARTITION BY track, user_id, corner)),
cm AS (SELECT track, user_id, corner, max(CASE WHEN distance <= axd THEN speed END) AS en, any_value(slow) AS apx, arg_max(speed, distance) AS ex, any_value(axd) AS axd, min(CASE WHEN distance <= axd AND brake > 0.5 THEN distance END) AS br,
  min(CASE WHEN distance = axd THEN time_s END) AS t0, arg_max(time_s, distance) AS t1, median(curvature) AS kap, avg(throttle) AS thr, any_value(straight) AS st FROM ap GROUP BY ALL),
cx AS (SELECT *, CASE WHEN br IS NOT NULL THEN greatest(1.0, axd - br) END AS bd, greatest(t1 - t0, 1e-9) AS dt FROM cm)
"""


@query(f"""
WITH {_APEX} SELECT track, user_id, corner, round(en, 6) AS entry_speed_kmh, round(apx, 6) AS apex_speed_kmh, round(ex, 6) AS exit_speed_kmh, round(bd, 6) AS braking_distance_m,
  round((pow(en / 3.6, 2) - pow(apx / 3.6, 2)) / (2 * bd), 6) AS braking_efficiency_ms2, round(pow(apx / 3.6, 2) * abs(kap) / 9.80665 * least(greatest(thr / 100.0, 0), 1), 6) AS aero_commitment, round((ex - apx) * st, 6) AS exit_amplification FROM cx
""")
def corner_metrics(spark, sf_dir):
    out = corners.corner_metrics(_segments(spark, sf_dir), ["track", "user_id", "corner"], "following_straight")
    return out.select("track", "user_id", "corner", *r6s("entry_speed_kmh", "apex_speed_kmh", "exit_speed_kmh", "braking_distance_m", "braking_efficiency_ms2", "aero_commitment", "exit_amplification"))


@query(f"""
WITH {_APEX}, z AS (SELECT track, user_id, corner, (apx - avg(apx) OVER w) / CASE WHEN stddev_pop(apx) OVER w > 0 THEN stddev_pop(apx) OVER w ELSE 1 END AS a, (ex - avg(ex) OVER w) / CASE WHEN stddev_pop(ex) OVER w > 0 THEN stddev_pop(ex) OVER w ELSE 1 END AS b FROM cx WINDOW w AS (PARTITION BY track, corner))
SELECT track, user_id, corner, round((a + b) / 2, 6) AS corner_performance FROM z
""")
def corner_performance(spark, sf_dir):
    out = corners.corner_performance(corners.corner_metrics(_segments(spark, sf_dir), ["track", "user_id", "corner"]), ["track", "corner"])
    return out.select("track", "user_id", "corner", *r6s("corner_performance"))


@query("SELECT event_type, round(avg(abs(value / 100.0 - 0.5)), 6) AS curvature_exposure, round(quantile_cont(abs(value / 100.0 - 0.5), 0.95), 6) AS curvature_severity, round(stddev_pop(value / 100.0 - 0.5), 6) AS curvature_variation FROM events GROUP BY event_type")
def curvature_indices(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100.0 - 0.5).alias("curvature"))
    return corners.curvature_indices(ev, ["event_type"]).select("event_type", *r6s("curvature_exposure", "curvature_severity", "curvature_variation"))


_VENUES = f"{_LINES}, c AS (SELECT p_type, i, CAST(2010 + floor(i / 6) AS BIGINT) AS season, p_type || CAST(i AS VARCHAR) AS race, l_suppkey, round(sum(l_quantity), 6) AS laps, round(avg(price), 6) AS best FROM li GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY laps DESC, l_suppkey) AS pos, 100 * (best - min(best) OVER (PARTITION BY race)) / min(best) OVER (PARTITION BY race) AS gap FROM c)"


def _venue_rows(spark, sf_dir):
    c = lines(spark, sf_dir).groupBy("p_type", "i", "l_suppkey").agg(F.round(F.sum("l_quantity"), 6).alias("laps"), F.round(F.avg("price"), 6).alias("qual_best_s"))
    c = c.withColumn("season", 2010 + F.floor(F.col("i") / 6)).withColumn("race", F.concat("p_type", F.col("i").cast("string")))
    w = Window.partitionBy("race")
    c = c.withColumn("winner", (F.row_number().over(w.orderBy(F.col("laps").desc(), "l_suppkey")) == 1).cast("int"))
    return c.withColumn("qual_gap_pct", 100 * (F.col("qual_best_s") - F.min("qual_best_s").over(w)) / F.min("qual_best_s").over(w))


@query(f"""
WITH {_VENUES}, l AS (SELECT p_type, median(CASE WHEN p_type = 'ECONOMY' THEN 260000.0 ELSE 305000.0 END / greatest(laps, 1)) AS len FROM v WHERE pos = 1 AND season >= 2012 GROUP BY p_type),
p AS (SELECT p_type, median(b) AS pole FROM (SELECT p_type, race, min(best) AS b FROM v WHERE season >= 2012 GROUP BY ALL) GROUP BY p_type), s AS (SELECT p_type, median(gap) AS spread FROM v WHERE season >= 2012 GROUP BY p_type)
SELECT p_type, round(len, 6) AS lap_length_m, round(pole, 6) AS pole_time_s, round(3.6 * len / pole, 6) AS avg_lap_speed_kmh, round(spread, 6) AS field_spread_pct FROM l JOIN p USING (p_type) JOIN s USING (p_type)
""")
def venue_speed_profile(spark, sf_dir):
    rows = _venue_rows(spark, sf_dir)
    out = circuits.speed_profile(rows, rows, "p_type", "race", 2012, {"ECONOMY": 260_000.0})
    return out.select("p_type", *r6s("lap_length_m", "pole_time_s", "avg_lap_speed_kmh", "field_spread_pct"))


_PASSES = f"""
{_VENUES}, n AS (SELECT p_type, p_type || CAST(i AS VARCHAR) AS race, count(*) AS passes FROM li WHERE flag = 'R' AND i < 48 GROUP BY ALL), f AS (SELECT race, max(laps) AS laps, count(*) AS field FROM v GROUP BY race),
pr AS (SELECT p_type, median(100.0 * passes / greatest(laps * field, 1)) AS rate, count(*) AS n_races FROM n JOIN f USING (race) GROUP BY p_type HAVING count(*) >= 2)
"""


def _pass_rates(spark, sf_dir):
    passes = lines(spark, sf_dir).where("flag = 'R'").select("p_type", F.concat("p_type", F.col("i").cast("string")).alias("race"), F.col("i").alias("event_index"))
    return circuits.pass_rate(passes, _venue_rows(spark, sf_dir).withColumn("classified", F.lit(1)), "p_type", "race", as_of=48.0)


@query(f"WITH {_PASSES} SELECT p_type, round(rate, 6) AS overtakes_per_100_laps, n_races FROM pr")
def pass_rate(spark, sf_dir):
    return _pass_rates(spark, sf_dir).select("p_type", *r6s("overtakes_per_100_laps"), "n_races")


@query(f"WITH {_PASSES} SELECT p_type, n_races, round(least(greatest(1 - (rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0) / count(*) OVER (), 0.02), 0.98), 6) AS difficulty FROM pr")
def counted_difficulty(spark, sf_dir):
    return circuits.counted_difficulty(_pass_rates(spark, sf_dir), "p_type").select("p_type", "n_races", *r6s("difficulty"))


@query("SELECT p_brand, median(l_quantity) AS pit_loss_s, count(*) AS n_stops FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity BETWEEN 12 AND 60 GROUP BY p_brand HAVING count(*) >= 10")
def pit_lane_loss(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return circuits.pit_lane_loss(li, "p_brand", "l_quantity")


@query("""
WITH p AS (SELECT p_brand, avg(p_size) / 50.0 AS difficulty, avg(p_retailprice) / 1000.0 AS multiplier, count(*) % 5 AS n, min(p_size) < 2 AS counted FROM part GROUP BY p_brand),
t AS (SELECT p_brand, p_brand LIKE '%1' AS is_street FROM p UNION ALL SELECT 'New#1', true UNION ALL SELECT 'New#2', false)
SELECT t.p_brand, t.is_street, round(CASE WHEN coalesce(n >= 3, false) THEN CASE WHEN counted THEN 0.3 ELSE difficulty END ELSE CASE WHEN t.is_street THEN 0.7 ELSE 0.4 END END, 6) AS overtaking_difficulty,
  round(CASE WHEN coalesce(n >= 3, false) THEN multiplier ELSE CASE WHEN t.is_street THEN 1.2 ELSE 0.9 END END, 6) AS dnf_multiplier,
  CASE WHEN coalesce(n >= 3, false) THEN CASE WHEN counted THEN 'measured_passes' ELSE 'empirical' END WHEN t.is_street THEN 'analogues=a,b' ELSE 'family=false' END AS source FROM t LEFT JOIN p USING (p_brand)
""")
def venue_contexts(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.avg("p_size") / 50.0).alias("difficulty"), (F.avg("p_retailprice") / 1000.0).alias("multiplier"), (F.count("*") % 5).alias("n_events"), (F.min("p_size") < 2).alias("c"))
    fresh = spark.createDataFrame([("New#1", True), ("New#2", False)], "p_brand string, is_street boolean")
    targets = p.select("p_brand", F.col("p_brand").endswith("1").alias("is_street")).unionByName(fresh)
    transfer = spark.createDataFrame([(True, 0.7, "analogues=a,b"), (False, 0.4, "family=false")], "is_street boolean, difficulty double, source string")
    family = spark.createDataFrame([(True, 1.2), (False, 0.9)], "is_street boolean, multiplier double")
    out = circuits.resolve_contexts(targets, p, p.where("c").select("p_brand", F.lit(0.3).alias("counted")), transfer, family, "p_brand")
    return out.select("p_brand", "is_street", *r6s("overtaking_difficulty", "dnf_multiplier"), "source")


@query(f"""
WITH {_LINES}, t AS (SELECT team, 1.2 + sum(failed) AS a, 12.0 + count(*) - sum(failed) AS b FROM li WHERE i < 48 AND started = 1 AND team % 6 <> 0 GROUP BY team),
e AS (SELECT s_suppkey % 10 AS race, s_suppkey, CAST(s_nationkey AS BIGINT) AS team, coalesce(a, 1.2) AS a, coalesce(b, 12.0) AS b FROM supplier LEFT JOIN t ON t.team = s_nationkey),
g AS (SELECT race, team, count(*) AS m, any_value(a) AS a, any_value(b) AS b FROM e GROUP BY ALL),
n AS (SELECT race, exp(sum(lgamma(a + m) - lgamma(a) + lgamma(a + b) - lgamma(a + b + m))) AS none FROM g GROUP BY race)
SELECT race, s_suppkey, round(a / (a + b), 6) AS retire_probability, round((a / (a + b) - none) / (1 - none), 6) AS given_a_finisher FROM e JOIN n USING (race)
""")
def retirement_probabilities(spark, sf_dir):
    past = lines(spark, sf_dir).where("i < 48 AND started = 1 AND team % 6 <> 0")
    teams = past.groupBy("team").agg((1.2 + F.sum("failed")).alias("a"), (12.0 + F.count("*") - F.sum("failed")).alias("b"))
    fit = retirement.Retirement(teams, 1.2, 12.0, 47.0, True, False)
    entries = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("race"), "s_suppkey", F.col("s_nationkey").cast("long").alias("team"))
    one = retirement.retirement_probabilities(entries, fit, ["race"], "team", True).select("race", "s_suppkey", F.col("retire_probability").alias("given_a_finisher"))
    both = retirement.retirement_probabilities(entries, fit, ["race"], "team").join(one, ["race", "s_suppkey"])
    return both.select("race", "s_suppkey", *r6s("retire_probability", "given_a_finisher"))


_SEASONS = f"""
{_DAYS}, re AS (SELECT user_id, i, CAST(2022 + floor(i / 8) AS BIGINT) AS season, CAST(i % 8 + 1 AS BIGINT) AS round, s AS points, row_number() OVER (PARTITION BY i ORDER BY s DESC, user_id) AS pos, n % 5 AS grid, user_id % 9 AS qp FROM d),
evs AS (SELECT DISTINCT season, round, i FROM re), us AS (SELECT DISTINCT season, user_id FROM re),
cu AS (SELECT evs.season, evs.round, us.user_id, round(sum(CASE WHEN re.round <= evs.round THEN points END), 6) AS p FROM evs JOIN us USING (season) JOIN re ON re.season = evs.season AND re.user_id = us.user_id GROUP BY ALL),
st AS (SELECT season, round AS after_round, user_id, row_number() OVER (PARTITION BY season, round ORDER BY p DESC, user_id) AS cp FROM cu WHERE p IS NOT NULL)
"""


def _seasons(spark, sf_dir):
    d = days(spark, sf_dir)
    re = d.select(
        F.col("user_id").alias("driver_id"), F.col("i").alias("event_index"), F.col("i").alias("race_id"), (2022 + F.floor(F.col("i") / 8)).alias("season"), (F.col("i").cast("long") % 8 + 1).alias("round"), F.col("s").alias("points"),
        F.row_number().over(Window.partitionBy("i").orderBy(F.col("s").desc(), "user_id")).alias("position_order"), (F.col("n") % 5).alias("grid"), (F.col("user_id") % 9).alias("qual_position"))
    events = re.select("season", "round").distinct().withColumnRenamed("round", "after_round")
    so_far = re.join(events, "season").where("round <= after_round").groupBy("season", "after_round", "driver_id").agg(F.round(F.sum("points"), 6).alias("p"))
    place = F.row_number().over(Window.partitionBy("season", "after_round").orderBy(F.col("p").desc(), "driver_id"))
    return re, so_far.select("season", "after_round", "driver_id", place.alias("championship_position"))


@query(f"""
WITH {_SEASONS}, f AS (SELECT *, count(*) OVER (PARTITION BY i) AS field FROM re),
la AS (SELECT season, max(after_round) AS lr FROM st GROUP BY season), kn AS (SELECT season, after_round, count(*) AS k FROM st GROUP BY ALL),
g AS (SELECT f.*, CASE WHEN f.round = 1 THEN f.season - 1 ELSE f.season END AS ss, CASE WHEN f.round = 1 THEN la.lr ELSE f.round - 1 END AS sr FROM f LEFT JOIN la ON la.season = f.season - 1),
h AS (SELECT g.*, k, cp FROM g LEFT JOIN kn ON kn.season = ss AND kn.after_round = sr LEFT JOIN st ON st.season = ss AND st.after_round = sr AND st.user_id = g.user_id)
SELECT i AS race_id, user_id AS driver_id, CASE WHEN k IS NULL THEN 0.0 ELSE -CAST(coalesce(cp, k + 1) AS DOUBLE) END AS championship,
  round(coalesce((SELECT sum(points) FROM re x WHERE x.user_id = h.user_id AND x.season = h.season AND x.i < h.i), 0), 6) AS gp_points,
  CASE WHEN i = 0 THEN 0.0 ELSE -CAST(coalesce((SELECT pos FROM re x WHERE x.user_id = h.user_id AND x.i = h.i - 1), field + 1) AS DOUBLE) END AS last_race,
  round(-coalesce((SELECT avg(pos) FROM (SELECT pos FROM re x WHERE x.user_id = h.user_id AND x.i < h.i ORDER BY x.i DESC LIMIT 5)), field + 1), 6) AS form5,
  -CAST(rank() OVER (PARTITION BY i ORDER BY CASE WHEN grid > 0 THEN grid ELSE field + 1 END) AS DOUBLE) AS grid_score, -CAST(rank() OVER (PARTITION BY i ORDER BY CASE WHEN qp > 0 THEN qp ELSE field + 1 END) AS DOUBLE) AS qualifying_score FROM h
""")
def baseline_scores(spark, sf_dir):
    re, standings = _seasons(spark, sf_dir)
    out = panel.all_baselines(re.select("race_id", "driver_id", "season", "round", "event_index", "grid", "qual_position"), re, standings)
    return out.select("race_id", "driver_id", "championship", *r6s("gp_points"), "last_race", *r6s("form5"), "grid_score", "qualifying_score")


@query(f"""
WITH {_SEASONS}, sc AS (SELECT DISTINCT i, season, round, TIMESTAMP '2020-01-01 14:00:00' + INTERVAL 7 DAY * CAST(i AS INT) AS start_ FROM re), nx AS (SELECT *, lag(i) OVER (PARTITION BY season ORDER BY i) AS pi FROM sc)
SELECT nx.i AS race_id, nx.round, re.user_id AS driver_id, TIMESTAMP '2020-01-02' + INTERVAL 7 DAY * CAST(pi AS INT) AS observed_at, nx.start_ - INTERVAL 60 HOUR AS cutoff_utc FROM nx JOIN re ON re.i = nx.pi WHERE pi IS NOT NULL AND re.user_id % 4 <> 0
""")
def entry_snapshots(spark, sf_dir):
    re, _ = _seasons(spark, sf_dir)
    week = lambda text, index: F.lit(text).cast("timestamp") + F.make_dt_interval(F.col(index).cast("int") * 7)
    schedule = re.select("race_id", "season", "round", "event_index").distinct().withColumn("race_start_utc", week("2020-01-01 14:00:00", "event_index"))
    rows = re.select("event_index", "driver_id", F.lit("t").alias("constructor_id"), (F.col("driver_id") % 4 != 0).cast("int").alias("started"), week("2020-01-02", "event_index").alias("available_at"))
    out = panel.snapshots(schedule, rows)
    return out.select("race_id", "round", "driver_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("observed_at", "cutoff_utc")])


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n, round(ln(u / (1 - u)), 6) AS free, round(greatest(l_quantity - 20, 0) * 2 / greatest(l_tax * 100, 1e-9), 6) AS undercut
FROM (SELECT *, least(greatest((l_quantity - 0.05) / 60.0, 1e-6), 1 - 1e-6) AS u FROM lineitem WHERE l_tax > 0) GROUP BY ALL
""".replace("GROUP BY ALL", "GROUP BY l_orderkey, l_linenumber, u, l_quantity, l_tax"))
def bounded_parameters(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_tax > 0").groupBy("l_orderkey", "l_linenumber", "l_quantity", "l_tax").agg(F.count("*").alias("n"))
    return li.select("l_orderkey", *longs("l_linenumber"), "n", r6(S.to_free(F.col("l_quantity"), 0.05, 60.05), "free"), r6(S.undercut_power(F.col("l_quantity"), F.lit(20.0), F.col("l_tax") * 100), "undercut"))


#: Rows of the full system, solved by Gauss-Jordan steps on lists; brands and suppliers are crossed.
_RIDGE = f"""
{_LINES}, w AS (SELECT p_brand AS t, CAST(l_suppkey AS VARCHAR) AS d, l_quantity AS y, pow(0.5, (48 - i) / 6.0) AS w FROM li WHERE i < 48),
c AS (SELECT t, d, sum(w) AS w, sum(w * y) AS wy, sum(w * y * y) AS wyy FROM w WHERE w > 1e-6 GROUP BY ALL),
lv AS (SELECT *, row_number() OVER (ORDER BY kind, level) AS k FROM (SELECT '0' AS kind, '' AS level UNION ALL SELECT DISTINCT '1', t FROM c UNION ALL SELECT DISTINCT '2', d FROM c)),
x AS (SELECT a.k AS a, b.k AS b, c.k AS c, w, wy, wyy FROM c AS s JOIN lv a ON a.kind = '0' JOIN lv b ON b.kind = '1' AND b.level = t JOIN lv c ON c.kind = '2' AND c.level = d),
g AS (SELECT i, j, sum(w) AS v FROM (SELECT w, unnest([a, a, a, b, b, b, c, c, c]) AS i, unnest([a, b, c, a, b, c, a, b, c]) AS j FROM x) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM lv), y AS (SELECT i, sum(wy) AS v FROM (SELECT wy, unnest([a, b, c]) AS i FROM x) GROUP BY i),
m AS (SELECT p.k AS i, list(coalesce(g.v, 0) + CASE WHEN p.k = q.k AND p.k > 1 THEN 1 ELSE 0 END ORDER BY q.k) AS a, list(CASE WHEN p.k = q.k THEN 1.0::DOUBLE ELSE 0 END ORDER BY q.k) AS e FROM lv p CROSS JOIN lv q LEFT JOIN g ON g.i = p.k AND g.j = q.k GROUP BY p.k),
gj AS (SELECT 1::BIGINT AS k, i, list_concat(a, e) AS r FROM m UNION ALL
  SELECT gj.k + 1, gj.i, CASE WHEN gj.i = gj.k THEN list_transform(gj.r, lambda v: v / gj.r[gj.k]) ELSE list_transform(list_zip(gj.r, p.r), lambda z: z[1] - gj.r[gj.k] / p.r[gj.k] * z[2]) END
  FROM gj JOIN gj p ON p.i = gj.k JOIN n ON gj.k <= n),
v AS (SELECT i, list_slice(r, n + 1, 2 * n) AS r FROM gj, n WHERE k = n + 1), ys AS (SELECT list(v ORDER BY i) AS y FROM y),
be AS (SELECT i, list_sum(list_transform(list_zip(r, y), lambda z: z[1] * z[2])) AS b, r[i] AS u FROM v, ys),
f AS (SELECT sum(wyy - 2 * (ba.b + bb.b + bc.b) * wy + w * pow(ba.b + bb.b + bc.b, 2)) AS rss, sum(w) AS w FROM x JOIN be ba ON ba.i = a JOIN be bb ON bb.i = x.b JOIN be bc ON bc.i = c),
s AS (SELECT greatest(rss / greatest(any_value(f.w) - (count(*) + 1 - sum(u)), 1.0), 1e-12) AS s2 FROM f, be WHERE i > 1 GROUP BY rss)
"""


def _ridge(spark, sf_dir):
    return pace.fit_ridge(lines(spark, sf_dir), "p_brand", "l_suppkey", "l_quantity", "i", 48.0)


@query(f"""
WITH RECURSIVE {_RIDGE} SELECT CASE kind WHEN '1' THEN 'team:' ELSE 'driver:' END || level AS effect, round(b, 6) AS value, round(sqrt(u * s2), 6) AS se, round((SELECT b FROM be WHERE i = 1), 6) AS intercept, round(sqrt(s2), 6) AS residual_sd
FROM lv JOIN be ON be.i = lv.k, s WHERE kind <> '0'
""")
def ridge_effects(spark, sf_dir):
    fit = _ridge(spark, sf_dir)
    named = lambda df, kind, value: df.select(F.concat(F.lit(f"{kind}:"), F.col(kind)).alias("effect"), F.col(value).alias("value"), F.col("effect_se").alias("se"))
    out = named(fit.teams, "team", "team_effect").unionByName(named(fit.drivers, "driver", "driver_effect"))
    return out.select("effect", *r6s("value", "se"), F.lit(round(fit.intercept, 6)).alias("intercept"), F.lit(round(fit.residual_sd, 6)).alias("residual_sd"))


@query(f"""
WITH RECURSIVE {_RIDGE}, top AS (SELECT max(u * s2) AS top FROM be, s WHERE i > 1),
en AS (SELECT s_suppkey, 'Brand#' || (1 + s_suppkey % 6) || (1 + s_suppkey % 5) AS t, CASE WHEN s_suppkey % 7 = 0 THEN 'new' ELSE CAST(s_suppkey AS VARCHAR) END AS d FROM supplier),
ko AS (SELECT en.*, a.k AS a, b.k AS b FROM en LEFT JOIN lv a ON a.kind = '1' AND a.level = t LEFT JOIN lv b ON b.kind = '2' AND b.level = d)
SELECT s_suppkey, t AS team, round(sqrt(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN s2 * (x.r[a] + y.r[b] + 2 * x.r[b]) WHEN a IS NOT NULL THEN s2 * x.r[a] + top WHEN b IS NOT NULL THEN s2 * y.r[b] + top ELSE top END), 6) AS strength_se
FROM ko LEFT JOIN v x ON x.i = a LEFT JOIN v y ON y.i = b, s, top
""")
def ridge_pairs(spark, sf_dir):
    """Standard errors of pairs of effects, also of those never seen together, with new teams and drivers among them."""
    key = F.col("s_suppkey")
    team = F.concat(F.lit("Brand#"), (1 + key % 6).cast("string"), (1 + key % 5).cast("string"))
    entries = table(spark, sf_dir, "supplier").select("s_suppkey", team.alias("team"), F.when(key % 7 == 0, "new").otherwise(key.cast("string")).alias("driver"))
    return pace.strength_variance(entries, _ridge(spark, sf_dir), "team", "driver").select("s_suppkey", "team", *r6s("strength_se"))


@query(f"""
WITH RECURSIVE {_DAYS}, x AS (SELECT user_id, i, v, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM d WHERE v IS NOT NULL),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS m, CAST(100 AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS l FROM x
  UNION ALL SELECT x.user_id, x.k, m + (p + coalesce(x.i - t, 0)) / (p + coalesce(x.i - t, 0) + 50) * (x.v - m), (p + coalesce(x.i - t, 0)) * (1 - (p + coalesce(x.i - t, 0)) / (p + coalesce(x.i - t, 0) + 50)), x.i,
    l - 0.5 * (ln(2 * 3.141592653589793 * (p + coalesce(x.i - t, 0) + 50)) + (x.v - m) * (x.v - m) / (p + coalesce(x.i - t, 0) + 50)) FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1)
SELECT f.user_id, n, round(m, 6) AS level, round(p, 6) AS variance, round(l, 6) AS loglik FROM f JOIN x USING (user_id, k) WHERE k = n
""")
def local_level(spark, sf_dir):
    return filtering.local_level(days(spark, sf_dir), ["user_id"], "i", "v", prior=100.0, step=1.0, noise=50.0).select("user_id", "n", *r6s("level", "variance", "loglik"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def daily_means(spark, sf_dir):
    return daily(table(spark, sf_dir, "events")).select("user_id", "day", "n", *r6s("mean"))
