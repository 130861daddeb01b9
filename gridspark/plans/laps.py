"""Queries of lap, stint and corner summaries, status classes, projections and outcome reports, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evaluation as V
from ..operators import laps as L
from .catalog import _DAYS, days, query, r6s, table


@query(f"WITH {_DAYS} SELECT user_id, i, round(v + 0.035 * (i - min(i) OVER (PARTITION BY user_id)), 6) AS corrected FROM d")
def fuel_corrected(spark, sf_dir):
    return L.fuel_corrected(days(spark, sf_dir), ["user_id"], "i", "v").select("user_id", "i", *r6s("corrected"))


@query(f"""
WITH {_DAYS}, q AS (SELECT user_id, least(count(*), 8) AS parts FROM d GROUP BY user_id),
g AS (SELECT user_id, parts, unnest(range(1, parts)) AS k FROM q WHERE parts >= 4),
e AS (SELECT user_id, k, CASE parts WHEN 4 THEN quantile_cont(i, [0.25, 0.5, 0.75])[k] WHEN 5 THEN quantile_cont(i, [1/5::DOUBLE, 2/5::DOUBLE, 3/5::DOUBLE, 4/5::DOUBLE])[k]
  WHEN 6 THEN quantile_cont(i, [1/6::DOUBLE, 2/6::DOUBLE, 3/6::DOUBLE, 4/6::DOUBLE, 5/6::DOUBLE])[k] WHEN 7 THEN quantile_cont(i, [1/7::DOUBLE, 2/7::DOUBLE, 3/7::DOUBLE, 4/7::DOUBLE, 5/7::DOUBLE, 6/7::DOUBLE])[k]
  ELSE quantile_cont(i, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])[k] END AS edge FROM g JOIN d USING (user_id) GROUP BY user_id, k, parts),
p AS (SELECT d.user_id, d.i, d.v, count(DISTINCT e.edge) AS part FROM d LEFT JOIN e ON d.user_id = e.user_id AND e.edge < d.i GROUP BY ALL),
m AS (SELECT user_id, part, median(v) AS m FROM p GROUP BY ALL),
b AS (SELECT *, m - min(m) OVER (PARTITION BY user_id) AS shift FROM m)
SELECT user_id, i, round(CASE WHEN parts >= 4 THEN v - shift ELSE v END, 6) AS evolved FROM p JOIN b USING (user_id, part) JOIN q USING (user_id)
""")
def track_evolution(spark, sf_dir):
    return L.track_evolution(days(spark, sf_dir), ["user_id"], "i", "v").select("user_id", "i", *r6s("evolved"))


@query(f"""
WITH {_DAYS}, k AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM d),
s AS (SELECT *, median(CASE WHEN k > greatest(floor(n / 2.0), 2) THEN v END) OVER (PARTITION BY user_id) AS steady FROM k)
SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN coalesce(min(CASE WHEN v <= steady + 0.2 THEN k END), count(*)) END AS warmup FROM s GROUP BY user_id
""")
def warmup_laps(spark, sf_dir):
    return L.warmup_laps(days(spark, sf_dir), ["user_id"], "i", "v")


@query("""
WITH w AS (SELECT l_suppkey, CAST(l_discount AS DOUBLE) - avg(CAST(l_discount AS DOUBLE)) OVER (PARTITION BY l_partkey % 25) AS r FROM lineitem WHERE l_returnflag = 'R')
SELECT l_suppkey, count(*) AS n, round(-avg(r), 6) AS residual FROM w GROUP BY l_suppkey
""")
def wet_residual(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 25).alias("car"), F.col("l_discount").cast("double").alias("pace"), "l_returnflag")
    return L.wet_residual(li, "l_suppkey", "car", "pace", F.col("l_returnflag") == "R").select("l_suppkey", "n", *r6s("residual"))


@query("""
SELECT l_suppkey, round(avg(CASE WHEN l_quantity / 10.0 < 2 THEN CAST(l_tax AS DOUBLE) END) - avg(CASE WHEN l_quantity / 10.0 >= 2 THEN CAST(l_tax AS DOUBLE) END), 6) AS penalty FROM lineitem GROUP BY l_suppkey
""")
def dirty_air(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_tax").cast("double").alias("pace"), (F.col("l_quantity").cast("double") / 10).alias("gap"))
    return L.dirty_air_penalty(li, ["l_suppkey"], "pace", "gap").select("l_suppkey", *r6s("penalty"))


@query(f"""
WITH {_DAYS}, k AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v) AS k FROM d),
s AS (SELECT user_id, median(v) AS single_lap_pace FROM k WHERE k <= 3 GROUP BY user_id),
r AS (SELECT user_id, floor(i / 7) AS stint, median(v) AS m FROM d GROUP BY ALL HAVING count(v) >= 5),
g AS (SELECT user_id, avg(m) AS long_run_pace FROM r GROUP BY user_id)
SELECT user_id, round(single_lap_pace, 6) AS single_lap_pace, round(long_run_pace, 6) AS long_run_pace FROM s LEFT JOIN g USING (user_id)
""")
def practice_summary(spark, sf_dir):
    d = days(spark, sf_dir).withColumn("stint", F.floor(F.col("i") / 7))
    return L.practice_summary(d, "user_id", "stint", "v").select("user_id", *r6s("single_lap_pace", "long_run_pace"))


@query(f"""
WITH {_DAYS}, f AS (SELECT user_id, i, CAST(n >= 2 AS INT) AS y FROM d)
SELECT user_id, i, round((sum(y) OVER w + 1.0) / (nullif(count(y) OVER w, 0) + 10.0), 6) AS rate FROM f WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
""")
def rolling_rate(spark, sf_dir):
    d = days(spark, sf_dir).withColumn("y", (F.col("n") >= 2).cast("int"))
    return L.rolling_rate(d, ["user_id"], "i", "y").select("user_id", "i", *r6s("rate"))


_CORNERS = "co AS (SELECT l_suppkey, l_partkey % 16 AS corner, 6 * CAST(l_quantity AS DOUBLE) AS speed, CAST(l_extendedprice AS DOUBLE) / 1000 AS perf, CAST(l_discount AS DOUBLE) AS brake, CAST(l_tax AS DOUBLE) AS grip FROM lineitem)"
_MEANS = {"braking_demand": "brake", "traction_demand": "grip"}
_SHARES = "round(avg(CAST(speed < 140 AS INT)), 6) AS low_speed_share, round(avg(CAST(speed >= 140 AND speed < 220 AS INT)), 6) AS medium_speed_share, round(avg(CAST(speed >= 220 AS INT)), 6) AS high_speed_share, round(avg(brake), 6) AS braking_demand, round(avg(grip), 6) AS traction_demand"


def _corners(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_suppkey", (F.col("l_partkey") % 16).alias("corner"), (6 * d("l_quantity")).alias("speed"), (d("l_extendedprice") / 1000).alias("perf"), d("l_discount").alias("brake"), d("l_tax").alias("grip"))


@query(f"WITH {_CORNERS} SELECT l_suppkey, {_SHARES} FROM co GROUP BY l_suppkey")
def demand_vector(spark, sf_dir):
    out = L.demand_vector(_corners(spark, sf_dir), ["l_suppkey"], "speed", _MEANS)
    return out.select("l_suppkey", *r6s(*out.columns[1:]))


@query(f"WITH {_CORNERS}, pc AS (SELECT l_suppkey, corner, median(speed) AS speed, median(brake) AS brake, median(grip) AS grip FROM co GROUP BY ALL) SELECT l_suppkey, {_SHARES.replace('round(', 'round(round(').replace(', 6) AS', ', 9), 6) AS')} FROM pc GROUP BY l_suppkey")
def track_vector(spark, sf_dir):
    out = L.track_vector(_corners(spark, sf_dir), ["l_suppkey"], "corner", "speed", _MEANS)
    # Means of medians fall on halves at the seventh place, which the order of summing would decide.
    return out.select("l_suppkey", *[F.round(F.round(c, 9), 6).alias(c) for c in out.columns[1:]])


def _shrunk(x: str, name: str) -> str:
    return f"round(coalesce((sum({x}) + 8 * median({x})) / (count({x}) + 8), 0), 6) AS {name}"


_PARTS = {"low": "speed < 140", "medium": "speed >= 140 AND speed < 220", "high": "speed >= 220"}


@query(f"WITH {_CORNERS} SELECT l_suppkey, {', '.join(_shrunk(f'CASE WHEN {c} THEN perf END', f'{k}_speed') for k, c in _PARTS.items())}, {_shrunk('brake', 'braking')}, {_shrunk('grip', 'traction')} FROM co GROUP BY l_suppkey")
def capability_vector(spark, sf_dir):
    out = L.capability_vector(_corners(spark, sf_dir), ["l_suppkey"], "speed", "perf", {"braking": "brake", "traction": "grip"})
    return out.select("l_suppkey", *r6s(*out.columns[1:]))


@query(f"""
WITH {_CORNERS} SELECT l_suppkey, round(avg(brake), 6) AS braking_strength, round(avg(grip), 6) AS traction_strength, round(avg(CASE WHEN speed <= 140 THEN perf END), 6) AS low_speed_performance,
  round(avg(CASE WHEN speed > 140 AND speed <= 220 THEN perf END), 6) AS medium_speed_performance, round(avg(CASE WHEN speed > 220 THEN perf END), 6) AS high_speed_performance FROM co GROUP BY l_suppkey
""")
def driver_corners(spark, sf_dir):
    out = L.driver_corners(_corners(spark, sf_dir), "l_suppkey", "speed", "perf", {"braking_strength": "brake", "traction_strength": "grip"})
    return out.select("l_suppkey", *r6s(*out.columns[1:]))


@query("""
WITH p AS (SELECT p_brand, p_brand LIKE '%1' AS street, count(*) AS n, avg(p_size) / 50.0 AS d FROM part GROUP BY ALL), h AS (SELECT * FROM p WHERE n >= 3),
a AS (SELECT CASE WHEN count(*) >= 2 THEN median(d) ELSE (SELECT median(d) FROM h WHERE street) END AS difficulty, CASE WHEN count(*) >= 2 THEN 'analogues=' || string_agg(p_brand, ',' ORDER BY p_brand) ELSE 'family=true' END AS source FROM h WHERE p_brand IN ('Brand#12', 'Brand#23', 'Brand#45')),
f AS (SELECT median(d) AS difficulty, 'family=false' AS source FROM h WHERE NOT street)
SELECT round(difficulty, 6) AS difficulty, source FROM (SELECT * FROM a UNION ALL SELECT * FROM f UNION ALL SELECT 0.5, 'default')
""")
def transfer_difficulty(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_brand").like("%1").alias("street")).agg(F.count("*").alias("n_events"), (F.avg("p_size") / 50.0).alias("difficulty"))
    named = L.transfer_difficulty(p, "p_brand", "street", True, ["Brand#12", "Brand#23", "Brand#45"])
    out = named.unionByName(L.transfer_difficulty(p, "p_brand", "street", False)).unionByName(L.transfer_difficulty(p.where("n_events < 0"), "p_brand", "street", True))
    return out.select(*r6s("difficulty"), "source")


@query("""
WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY ALL),
r AS (SELECT event_type, round(median(100.0 * n / greatest(u * 3, 1)), 6) AS rate FROM e GROUP BY event_type HAVING count(*) >= 2),
k AS (SELECT *, (rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0) / count(*) OVER () AS pct, count(*) OVER () AS n FROM r)
SELECT event_type, rate, round(least(greatest(1 - pct, 0.02), 0.98), 6) AS difficulty FROM k WHERE n >= 2
""")
def measured_difficulty(spark, sf_dir):
    from .catalog import rate_per_hundred

    return L.measured_difficulty(rate_per_hundred(spark, sf_dir), "event_type", "rate").select("event_type", "rate", *r6s("difficulty"))


@query("""
WITH s AS (SELECT o_orderkey, ['Finished', '+1 Lap', 'Collision damage', 'Engine', 'Withdrew', 'Spun off', NULL][1 + o_orderkey % 7] AS status, ['1', 'R', 'D', 'W', '12'][1 + o_orderkey % 5] AS pt FROM orders)
SELECT o_orderkey, CASE WHEN coalesce(status, '') = 'Withdrew' OR pt = 'W' THEN 'non_starter' WHEN pt IN ('1', '12') THEN 'finished' WHEN coalesce(status, '') IN ('Collision damage', 'Spun off') OR pt = 'D' THEN 'incident' ELSE 'mechanical' END AS status_class FROM s
""")
def status_classes(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    status = pick(["Finished", "+1 Lap", "Collision damage", "Engine", "Withdrew", "Spun off", None])
    return table(spark, sf_dir, "orders").select("o_orderkey", S.status_class(status, pick(["1", "R", "D", "W", "12"])).alias("status_class"))


@query(f"""
WITH {_DAYS}, x AS (SELECT i, floor(i / 16) AS season, lead(i) OVER (ORDER BY i) AS t, lead(floor(i / 16)) OVER (ORDER BY i) AS ts FROM (SELECT DISTINCT i FROM d))
SELECT t AS target, user_id FROM d JOIN x USING (i) WHERE ts = season
""")
def projected_entries(spark, sf_dir):
    return L.projected_entries(days(spark, sf_dir).withColumn("season", F.floor(F.col("i") / 16)), ["user_id"], "i", "season")


@query("""
WITH r AS (SELECT CAST(l_discount AS DOUBLE) AS p1, CAST(l_tax AS DOUBLE) * 2 AS p2, CAST(l_discount AS DOUBLE) * 2 AS p3, l_returnflag <> 'R' AS ok, l_linenumber AS pos, 2 AS lo, CAST(l_quantity AS DOUBLE) / 6 AS hi FROM lineitem),
f AS (
  SELECT 'winner' AS outcome, 'win_probability' AS probability_column, p1 AS p, CAST(ok AND pos <= 1 AS DOUBLE) AS y FROM r
  UNION ALL SELECT 'podium', 'podium_probability', p2, CAST(ok AND pos <= 3 AS DOUBLE) FROM r
  UNION ALL SELECT 'dnf', 'dnf_probability', p3, CAST(NOT ok AS DOUBLE) FROM r),
b AS (SELECT outcome, probability_column, greatest(ceil(round(p * 10, 9)), 1) AS bin, count(*) AS n, sum(p) AS p, sum(y) AS y, sum((p - y) * (p - y)) AS e FROM f GROUP BY ALL),
i AS (SELECT count(*) AS n, avg(CAST(pos BETWEEN lo AND hi AS DOUBLE)) AS x FROM r)
SELECT outcome, probability_column, CAST(sum(n) AS BIGINT) AS n, round(sum(p) / sum(n), 6) AS predicted_mean, round(sum(y) / sum(n), 6) AS observed_rate, round(sum(abs(p - y)) / sum(n), 6) AS ece, round(sum(e) / sum(n), 6) AS brier FROM b GROUP BY ALL
UNION ALL SELECT 'finish_inside_p10_p90', 'finish_p10..finish_p90', n, 0.8, round(x, 6), round(abs(x - 0.8), 6), NULL FROM i
""")
def probability_report(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(
        d("l_discount").alias("win_probability"), (d("l_tax") * 2).alias("podium_probability"), (d("l_discount") * 2).alias("dnf_probability"), (F.col("l_returnflag") != "R").alias("classified"),
        F.col("l_linenumber").alias("position_order"), F.lit(2).alias("finish_p10"), (d("l_quantity") / 6).alias("finish_p90"),
    )
    out = V.probability_report(rows)
    return out.select("outcome", "probability_column", "n", *r6s("predicted_mean", "observed_rate", "ece", "brier"))
