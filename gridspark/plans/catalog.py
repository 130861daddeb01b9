"""One query for each operator, on whole tables, beside its SQL.

An event is a day of `events` or a month of `orders`; an entrant is a user or a supplier; doubles are rounded to
six places and integers are long, so that both engines give equal values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import estimators as E
from ..operators import evaluation as V
from ..operators import guards, panel, temporal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column, name: str):
    return F.round(column, 6).alias(name)


def r6s(*names: str):
    return [r6(F.col(n), n) for n in names]


def longs(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, i (dense index), n, v (mean), s (sum)."""
    ev = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), "value")
    per = ev.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("v"), F.round(F.sum("value"), 9).alias("s"))
    return per.join(F.broadcast(temporal.event_index(per, ["day"], "i")), "day")


_DAYS = """
ev AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 9) AS v, round(sum(value), 9) AS s FROM events GROUP BY ALL),
ix AS (SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS DOUBLE) AS i FROM (SELECT DISTINCT day FROM ev)),
d AS (SELECT ev.*, ix.i FROM ev JOIN ix USING (day))
"""


@query(f"""
WITH {_DAYS} SELECT user_id, i,
  round(avg(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS form5,
  round(sum(s) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS to_date,
  CASE WHEN count(v) OVER w >= 3 THEN round(max(v) OVER w, 6) END AS best3
FROM d WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def form_window(spark, sf_dir):
    d = temporal.shifted(days(spark, sf_dir), ["user_id"], "v", "i", "form5", window=5)
    d = temporal.shifted(d, ["user_id"], "s", "i", "to_date", stat="sum")
    d = temporal.shifted(d, ["user_id"], "v", "i", "best3", min_periods=3, stat="max")
    return d.select("user_id", "i", *r6s("form5", "to_date", "best3"))


@query("SELECT m, CAST(row_number() OVER (ORDER BY m) - 1 AS DOUBLE) AS event_index FROM (SELECT DISTINCT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS m FROM orders)")
def event_index(spark, sf_dir):
    m = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("m")
    return temporal.event_index(table(spark, sf_dir, "orders").select(m), ["m"])


@query("""
SELECT o_orderkey, n_name, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderdate ELSE o_orderdate + INTERVAL 1 DAY END AS available_at,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'published' ELSE 'reconstructed' END AS availability_basis
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
def panel_availability(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("seen", F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderdate").cast("timestamp")))
    o = panel.with_availability(o, "o_orderdate", "seen").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select("o_orderkey", "n_name", F.col("available_at").cast("timestamp_ntz").alias("available_at"), "availability_basis")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return guards.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", *longs("l_linenumber"), "n_rows")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def missing_references(spark, sf_dir):
    return guards.missing_references(table(spark, sf_dir, "customer"), ["c_custkey"], table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'"), ["o_custkey"]).select("c_custkey")


def _probit(p: str) -> str:
    poly = lambda q, cs: "(" * (len(cs) - 1) + repr(cs[0]) + "".join(f" * {q} + {c!r})" for c in cs[1:])
    mid, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    tail = lambda q: f"({poly(q, S.QUANTILE_C)} / ({poly(q, S.QUANTILE_D)} * {q} + 1.0))"
    low, high = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    return (
        f"(CASE WHEN {p} < {S.QUANTILE_TAIL} THEN {tail(low)} WHEN {p} > {1 - S.QUANTILE_TAIL} THEN -{tail(high)} "
        f"ELSE {poly(r, S.QUANTILE_A)} * {mid} / ({poly(r, S.QUANTILE_B)} * {r} + 1.0) END)"
    )


@query(f"""
WITH {_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, user_id) AS p, count(*) OVER (PARTITION BY i) AS c, max(s) OVER (PARTITION BY i) AS top FROM d),
q AS (SELECT *, least(greatest((p - 0.5) / c, 1e-4), 1 - 1e-4) AS x FROM r)
SELECT user_id, i, 'race' AS kind, round(-{_probit("x")}, 6) AS score FROM q
UNION ALL SELECT user_id, i, 'qualifying', round(-((top - s) / top * 100) / 0.75, 6) FROM r
""")
def observation_union(spark, sf_dir):
    d = days(spark, sf_dir).withColumn("driver_id", F.col("user_id")).withColumn("race_id", F.col("i")).withColumn("classified", F.lit(1))
    w = Window.partitionBy("i")
    d = d.withColumn("position_order", F.row_number().over(w.orderBy(F.col("v").desc(), "user_id"))).withColumn("qual_gap_pct", (F.max("s").over(w) - F.col("s")) / F.max("s").over(w) * 100)
    return panel.observations(d, d).select(F.col("driver_id").alias("user_id"), F.col("race_id").alias("i"), "kind", *r6s("score"))


@query("""
SELECT CASE WHEN s BETWEEN 2014 AND 2016 THEN 'R2014' WHEN s BETWEEN 2017 AND 2021 THEN 'R2017' WHEN s BETWEEN 2022 AND 2025 THEN 'R2022' WHEN s >= 2026 THEN 'R2026' ELSE 'UNKNOWN' END AS regime, count(*) AS n
FROM (SELECT year(o_orderdate) + 20 AS s FROM orders) GROUP BY 1
""")
def regime_lookup(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(S.regime(F.year("o_orderdate") + 20).alias("regime")).agg(F.count("*").alias("n"))


@query(f"""
WITH f(feature, earliest_stage) AS (VALUES {', '.join(map(str, guards.FAMILIES.items()))}),
s(stage, k) AS (VALUES ('PRE_WEEKEND', 0), ('POST_FP1', 1), ('POST_FP2', 2), ('POST_FP3', 3), ('POST_QUALI', 4), ('RACE_START', 5))
SELECT f.feature, f.earliest_stage, s.stage, coalesce(e.k <= s.k, false) AS allowed FROM f CROSS JOIN s LEFT JOIN s e ON e.stage = f.earliest_stage
""")
def stage_gate(spark, sf_dir):
    return guards.stage_gate(guards.feature_catalogue(spark), spark.createDataFrame([(s,) for s in S.STAGES], "stage string"))


@query("SELECT event_type, count(*) AS n_late FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-20' - INTERVAL 60 HOUR GROUP BY event_type")
def timestamp_gate(spark, sf_dir):
    cutoff = S.stage_cutoff(F.lit("2024-01-20").cast("timestamp"), "PRE_WEEKEND")
    ev = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return guards.late_rows(ev, "at", cutoff).groupBy("event_type").agg(F.count("*").alias("n_late"))


@query("""
WITH h AS (SELECT date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS age, user_id, value FROM events)
SELECT user_id, round(sum(pow(0.5, age / 6.0) * value) / sum(pow(0.5, age / 6.0)), 6) AS mean, round(sum(pow(0.5, age / 6.0)), 6) AS weight FROM h GROUP BY user_id
""")
def recency_weighted_mean(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "value", (-F.datediff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date"))).cast("double").alias("i"))
    return E.weighted_mean(ev, ["user_id"], "value", S.recency_weight(F.col("i"), 0.0, 6.0)).select("user_id", *r6s("mean", "weight"))


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id AS view_id, value FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, v.view_id, v.value, v.ts AS matched_at FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def asof_backward(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), "value")
    return temporal.as_of(left, right, ["user_id"], "ts", ["view_id", "value"], width=86400).select("event_id", "user_id", "view_id", "value", "matched_at")


@query("""
WITH iv AS (SELECT user_id, ts AS lo, ts + INTERVAL 6 HOUR AS hi, event_id AS stint FROM events WHERE event_type = 'signup')
SELECT e.event_id, max(iv.stint) AS stint FROM events e LEFT JOIN iv ON e.user_id = iv.user_id AND e.ts BETWEEN iv.lo AND iv.hi WHERE e.event_type = 'click' GROUP BY e.event_id
""")
def interval_join(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    iv = ev.where("event_type = 'signup'").select("user_id", F.col("ts").alias("lo"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("hi"), F.col("event_id").alias("stint"))
    points = ev.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return temporal.interval_join(points, iv, ["user_id"], "ts", "lo", "hi", "stint", width=6 * 3600).select("event_id", "stint")


@query("""
SELECT event_id, user_id FROM events e WHERE event_type <> 'error' AND NOT EXISTS
  (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id AND x.ts BETWEEN e.ts - INTERVAL 30 MINUTE AND e.ts + INTERVAL 30 MINUTE)
""")
def overlap_anti(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return temporal.without_overlap(ev.where("event_type <> 'error'"), ev.where("event_type = 'error'"), ["user_id"], "ts", "ts", 1800).select("event_id", "user_id")


@query(f"""
WITH {_DAYS}, r AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY v DESC) AS p FROM d)
SELECT user_id, i, round(coalesce(sum(s) OVER b, 0), 6) AS gp_points, -CAST(lag(p) OVER w AS DOUBLE) AS last_race, round(-avg(p) OVER f, 6) AS form5
FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
""")
def baselines_wide(spark, sf_dir):
    d = days(spark, sf_dir).withColumn("p", F.rank().over(Window.partitionBy("i").orderBy(F.col("v").desc())))
    return panel.baselines(d, "user_id", "i", "p", "s").select("user_id", "i", *r6s("gp_points"), "last_race", *r6s("form5"))


@query(f"""
WITH {_DAYS}, t AS (SELECT i - 1 AS i, user_id, row_number() OVER (PARTITION BY i ORDER BY v DESC, user_id) AS p FROM d),
b AS (SELECT coalesce(e.i, t.i) AS i, coalesce(e.user_id, t.user_id) AS user_id, e.user_id IS NOT NULL AS named, p FROM d e FULL JOIN t ON e.i = t.i AND e.user_id = t.user_id),
r AS (SELECT *, sum(CAST(p IS NULL AS INT)) OVER w AS na, sum(CAST(NOT named AS INT)) OVER w AS nu, coalesce(bool_or(named AND p = 1) OVER w, false) AS sc FROM b WINDOW w AS (PARTITION BY i))
SELECT i, user_id, row_number() OVER (PARTITION BY i ORDER BY p IS NULL, p, user_id) AS aligned, p IS NULL AS absent, CAST(na AS BIGINT) AS n_absent, CAST(nu AS BIGINT) AS n_unforeseen, sc AS scoreable FROM r WHERE named
""")
def align_field(spark, sf_dir):
    d = days(spark, sf_dir)
    truth = d.select((F.col("i") - 1).alias("i"), "user_id", F.row_number().over(Window.partitionBy("i").orderBy(F.col("v").desc(), "user_id")).alias("p"))
    return panel.align_field(d.select("i", "user_id"), truth, "i", "user_id", "p")


def lines(spark, sf_dir):
    """team (nation), driver (supplier), failed, venue (part type) and month index of each line."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", (F.col("l_linenumber") % 5 != 0).cast("int").alias("started"), F.col("l_returnflag").alias("flag"), ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("double").alias("i"))
    su, pa = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("team")), table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    out = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(pa, F.col("l_partkey") == F.col("p_partkey"))
    return out.withColumn("failed", (F.col("flag") == "R").cast("int")).withColumn("price", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6))


_LINES = """
li AS (SELECT l_suppkey, CAST(s_nationkey AS BIGINT) AS team, p_type, p_brand, p_size, l_returnflag AS flag, CAST(l_returnflag = 'R' AS INT) AS failed, CAST(l_linenumber % 5 <> 0 AS INT) AS started,
  CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS DOUBLE) AS i, l_quantity, l_extendedprice, round(l_extendedprice / l_quantity, 6) AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
"""


@query(f"""
WITH {_LINES}, w AS (SELECT team, l_suppkey, failed, pow(0.5, (48 - i) / 12.0) * CASE WHEN i >= 24 THEN 1 ELSE 0.35 END AS w FROM li WHERE i < 48 AND started = 1),
b AS (SELECT sum(w * failed) / sum(w) AS base FROM w),
t AS (SELECT team, (sum(w * failed) + 13.2 * any_value(base)) / (sum(w) + 13.2) AS tr FROM w, b GROUP BY team),
x AS (SELECT l_suppkey, sum(w * failed) AS wy, sum(w) AS sw, sum(w * tr) / sum(w) AS e FROM w JOIN t USING (team) GROUP BY l_suppkey),
y AS (SELECT *, (wy + 6.0 * e) / (sw + 6.0) AS r FROM x)
SELECT l_suppkey, round(base, 6) AS base, round(e, 6) AS expected, round(r, 6) AS rate, round(ln(r / (1 - r)) - ln(e / (1 - e)), 6) AS excess,
  round(least(greatest(1 / (1 + exp(-(ln(e / (1 - e)) + ln(r / (1 - r)) - ln(e / (1 - e))))), 0.01), 0.60), 6) AS hazard FROM y, b
""")
def hazard_hierarchy(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("regime", F.when(F.col("i") >= 24, "new").otherwise("old"))
    fit = E.fit_hazards(rows, "team", "l_suppkey", "failed", "i", 48.0, started="started", regime="regime", target="new")
    return fit.select(F.col("driver").alias("l_suppkey"), *r6s("base", "expected", "rate", "excess"), r6(S.hazard(F.col("expected"), F.col("excess")), "hazard"))


@query(f"WITH {_LINES}, b AS (SELECT avg(failed) AS base FROM li WHERE started = 1) SELECT p_type, count(*) AS n, round((sum(failed) + 80 * any_value(base)) / (count(*) + 80), 6) AS rate, round((sum(failed) + 80 * any_value(base)) / (count(*) + 80) / any_value(base), 6) AS multiplier FROM li, b WHERE started = 1 GROUP BY p_type")
def venue_multiplier(spark, sf_dir):
    return E.rate_multipliers(lines(spark, sf_dir), "p_type", "failed", started="started").select("p_type", "n", *r6s("rate", "multiplier"))


@query(f"WITH {_LINES}, b AS (SELECT avg(failed) AS base FROM li WHERE started = 1) SELECT p_brand, count(*) AS n, round(CASE WHEN count(*) >= 1500 THEN avg(failed) / any_value(base) ELSE 1 END, 6) AS multiplier FROM li, b WHERE started = 1 GROUP BY p_brand")
def family_multiplier(spark, sf_dir):
    return E.family_multiplier(lines(spark, sf_dir), "p_brand", "failed", "started", least=1500).select("p_brand", "n", *r6s("multiplier"))


_RHO = f"""
{_LINES}, c AS (SELECT p_type, i, l_suppkey, round(sum(l_quantity), 6) AS q, round(avg(price), 6) AS p FROM li GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY p_type, i ORDER BY q) + (count(*) OVER (PARTITION BY p_type, i, q) - 1) / 2.0 AS rq, rank() OVER (PARTITION BY p_type, i ORDER BY p) + (count(*) OVER (PARTITION BY p_type, i, p) - 1) / 2.0 AS rp FROM c),
sp AS (SELECT p_type, i, count(*) AS n, CASE WHEN stddev_pop(rq) > 0 AND stddev_pop(rp) > 0 AND count(*) >= 8 THEN corr(rq, rp) END AS rho, avg(abs(rq - rp)) AS mc FROM rk GROUP BY ALL)
"""


def _cells(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("p_type", "i", "l_suppkey").agg(F.round(F.sum("l_quantity"), 6).alias("q"), F.round(F.avg("price"), 6).alias("p"))


@query(f"WITH {_RHO} SELECT p_type, i, n, round(rho, 6) AS rho, round(mc, 6) AS mean_change FROM sp")
def spearman_by_event(spark, sf_dir):
    return E.spearman(_cells(spark, sf_dir), ["p_type", "i"], "q", "p", least=8).select("p_type", "i", "n", *r6s("rho", "mean_change"))


@query(f"""
WITH {_RHO}, m AS (SELECT p_type, median(round(rho, 6)) AS rho, median(round(mc, 6)) AS mc, count(*) AS n FROM sp WHERE rho IS NOT NULL GROUP BY p_type),
z AS (SELECT *, (rank() OVER (ORDER BY rho) + (count(*) OVER (PARTITION BY rho) - 1) / 2.0) / count(*) OVER () AS a, (rank() OVER (ORDER BY mc) + (count(*) OVER (PARTITION BY mc) - 1) / 2.0) / count(*) OVER () AS b FROM m)
SELECT p_type, round(rho, 6) AS rho, round(mc, 6) AS mean_change, n AS n_events, round(least(greatest((a + 1 - b) / 2, 0.02), 0.98), 6) AS difficulty FROM z
""")
def difficulty_index(spark, sf_dir):
    rho = E.spearman(_cells(spark, sf_dir), ["p_type", "i"], "q", "p", least=8).select("p_type", *r6s("rho", "mean_change"))
    return E.difficulty(rho, "p_type").select("p_type", *r6s("rho", "mean_change"), "n_events", *r6s("difficulty"))


@query(f"""
WITH {_LINES}, e AS (SELECT p_type, i, min(price) AS best, max(price) AS worst FROM li GROUP BY ALL)
SELECT p_type, round(median(best), 6) AS pole, round(3.6 * 5000 / median(best), 6) AS speed, count(*) AS n FROM e WHERE worst BETWEEN 12 AND 1e9 GROUP BY p_type HAVING count(*) >= 10
""")
def speed_profile(spark, sf_dir):
    per = lines(spark, sf_dir).groupBy("p_type", "i").agg(F.min("price").alias("best"), F.max("price").alias("worst")).where(F.col("worst").between(12, 1e9))
    out = per.groupBy("p_type").agg(F.median("best").alias("pole"), F.count("*").alias("n")).where("n >= 10")
    return out.select("p_type", *r6s("pole"), r6(3.6 * 5000 / F.col("pole"), "speed"), "n")


@query("""
WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY ALL)
SELECT event_type, round(median(100.0 * n / greatest(u * 3, 1)), 6) AS rate, count(*) AS n_days FROM e GROUP BY event_type HAVING count(*) >= 2
""")
def rate_per_hundred(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"))
    out = e.groupBy("event_type").agg(F.median(100.0 * F.col("n") / F.greatest(F.col("u") * 3, F.lit(1))).alias("rate"), F.count("*").alias("n_days")).where("n_days >= 2")
    return out.select("event_type", *r6s("rate"), "n_days")


_BRANDS = "br AS (SELECT p_brand, round(avg(p_size), 9) AS a, round(avg(p_retailprice), 9) AS b, CAST(min(p_size) < 2 AS BOOLEAN) AS f FROM part GROUP BY p_brand), zz AS (SELECT *, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS za, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS zb FROM br), tt AS (SELECT za AS ta, zb AS tb, f AS tf FROM zz WHERE p_brand = (SELECT min(p_brand) FROM part))"


def _brands(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    out = part.groupBy("p_brand").agg(F.round(F.avg("p_size"), 9).alias("a"), F.round(F.avg("p_retailprice"), 9).alias("b"), (F.min("p_size") < 2).alias("f"))
    return out, part.agg(F.min("p_brand")).first()[0]


@query(f"WITH {_BRANDS} SELECT p_brand, round(sqrt(pow(za - ta, 2) + pow(zb - tb, 2)), 6) AS distance FROM zz, tt WHERE p_brand <> (SELECT min(p_brand) FROM part) ORDER BY sqrt(pow(za - ta, 2) + pow(zb - tb, 2)), p_brand LIMIT 4")
def knn_zscore(spark, sf_dir):
    pool, first = _brands(spark, sf_dir)
    return E.nearest(pool, "p_brand", first, ["a", "b"], 4).select("p_brand", *r6s("distance"))


@query(f"""
WITH {_BRANDS}, k AS (SELECT p_brand, exp(-greatest(pow(za - ta, 2) + pow(zb - tb, 2) - CASE WHEN f = tf THEN 0.35 ELSE 0 END, 0) / 2) AS s FROM zz, tt)
SELECT p_brand, count(*) AS n, round(sum(greatest(s, 0.15)), 6) AS weight FROM part JOIN k USING (p_brand) GROUP BY p_brand
""")
def kernel_similarity(spark, sf_dir):
    pool, first = _brands(spark, sf_dir)
    weighted = E.similarity_weights(table(spark, sf_dir, "part").select("p_brand"), E.kernel_similarity(pool, "p_brand", first, ["a", "b"], "f"), "p_brand")
    return weighted.groupBy("p_brand").agg(F.count("*").alias("n"), r6(F.sum("weight"), "weight"))


@query(f"""
WITH {_DAYS}, m AS (SELECT i, median(v) AS m FROM d GROUP BY i), a AS (SELECT i, 1.4826 * median(abs(v - m)) AS mad FROM d JOIN m USING (i) GROUP BY i)
SELECT user_id, i, round((v - m) / CASE WHEN mad > 1e-9 THEN mad ELSE 1 END, 6) AS robust_z FROM d JOIN m USING (i) JOIN a USING (i)
""")
def robust_z(spark, sf_dir):
    return E.robust_z(days(spark, sf_dir), "v", ["i"]).select("user_id", "i", *r6s("robust_z"))


@query(f"""
WITH {_DAYS}, x AS (SELECT *, CASE WHEN n >= 3 THEN v END AS lead FROM d),
g AS (SELECT user_id, i, 100 * (lead - min(lead) OVER w) / min(lead) OVER w AS a, 100 * (v - min(v) OVER w) / min(v) OVER w AS b FROM x WINDOW w AS (PARTITION BY i))
SELECT user_id, i, CASE WHEN coalesce(a, b) BETWEEN 0 AND 800 THEN round(coalesce(a, b), 6) END AS gap_pct, CASE WHEN a IS NOT NULL THEN 'lead' WHEN b IS NOT NULL THEN 'fallback' END AS gap_source FROM g
""")
def pace_gap(spark, sf_dir):
    d = days(spark, sf_dir).withColumn("lead", F.when(F.col("n") >= 3, F.col("v")))
    return E.pace_gap(d, ["i"], "lead", "v", 0.0, 800.0).select("user_id", "i", *r6s("gap_pct"), "gap_source")


def _passes() -> str:
    out = "c0 AS (SELECT *, sum(wty) OVER () / sum(wt) OVER () AS mu, 0.0 AS d FROM cell)"
    for k in range(4):
        out += f""",
t{k} AS (SELECT *, sum(wty - wt * (mu + d)) OVER (PARTITION BY team) / (sum(wt) OVER (PARTITION BY team) + 1) AS t FROM c{k}),
e{k} AS (SELECT * EXCLUDE (d), sum(wdy - wd * (mu + t)) OVER (PARTITION BY driver) / (sum(wd) OVER (PARTITION BY driver) + 1) AS d FROM t{k}),
s{k} AS (SELECT *, sum(wd * d) OVER () / sum(wd) OVER () AS sh FROM e{k}),
c{k + 1} AS (SELECT team, driver, wt, wty, wd, wdy, {"t," if k == 3 else ""} mu + sh AS mu, d - sh AS d FROM s{k})"""
    return out


@query(f"""
WITH {_LINES}, w AS (SELECT team, l_suppkey AS driver, l_quantity AS y, pow(0.5, (48 - i) / 6.0) AS w FROM li WHERE i < 48),
cell AS (SELECT team, driver, sum(w) AS wt, sum(w * y) AS wty, sum(w) AS wd, sum(w * y) AS wdy FROM w GROUP BY ALL), {_passes()}
SELECT team, driver, round(mu, 6) AS intercept, round(t, 6) AS team_effect, round(d, 6) AS driver_effect, round(d * sum(wd) OVER (PARTITION BY driver) / (sum(wd) OVER (PARTITION BY driver) + 3), 6) AS driver_shrunk FROM c4
""")
def backfit(spark, sf_dir):
    out = E.backfit(lines(spark, sf_dir), "team", "l_suppkey", "l_quantity", "i", 48.0)
    return out.select("team", "driver", *r6s("intercept", "team_effect", "driver_effect", "driver_shrunk"))


_FIELD = f"""
{_DAYS}, z AS (SELECT user_id, i, n, v, rank() OVER (PARTITION BY i ORDER BY s DESC, user_id) AS pos, CAST((7 * n + user_id) % 11 <> 0 AS INT) AS classified, exp((v - max(v) OVER (PARTITION BY i)) / 20.0) AS ex FROM d),
f AS (SELECT *, round(ex / sum(ex) OVER (PARTITION BY i), 12) AS pr FROM z)
"""


def field(spark, sf_dir):
    """Entrants of each day with their finishing position and a softmax probability of winning."""
    d = days(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("i").orderBy(F.col("s").desc(), "user_id")))
    d = d.withColumn("classified", ((7 * F.col("n") + F.col("user_id")) % 11 != 0).cast("int"))
    return V.softmax(d, "v", ["i"], 20.0).withColumn("pr", F.round("probability", 12))


@query(f"WITH {_FIELD} SELECT user_id, i, round(pr, 6) AS probability FROM f")
def softmax_temperature(spark, sf_dir):
    return field(spark, sf_dir).select("user_id", "i", r6(F.col("pr"), "probability"))


_ODDS = f"{_FIELD}, o AS (SELECT *, CASE WHEN n >= 3 THEN -110 - 10 * n ELSE 100 + 150 * n END AS odds FROM f), k AS (SELECT *, CASE WHEN odds > 0 THEN 100.0 / (odds + 100.0) ELSE abs(odds) / (abs(odds) + 100.0) END AS raw, CASE WHEN odds > 0 THEN 1 + odds / 100.0 ELSE 1 + 100.0 / abs(odds) END AS dec FROM o), h AS (SELECT *, sum(raw) OVER (PARTITION BY i) AS ov, raw / sum(raw) OVER (PARTITION BY i) AS mp FROM k), j AS (SELECT *, pr * dec - 1 AS xv, greatest((pr * (dec - 1) - (1 - pr)) / (dec - 1), 0) AS kf FROM h)"


def _board(spark, sf_dir):
    f = field(spark, sf_dir)
    odds = f.select("user_id", "i", F.when(F.col("n") >= 3, -110 - 10 * F.col("n")).otherwise(100 + 150 * F.col("n")).alias("american_odds"))
    return V.price_board(f.select("user_id", "i", "pos", F.col("pr").alias("win_probability")), odds, ["user_id", "i"], board=["i"])


@query(f"WITH {_ODDS} SELECT user_id, i, round(ov, 6) AS overround, round(mp, 6) AS market_probability, round(100 * (pr - mp), 6) AS edge_vs_market_pp, abs(rank() OVER (PARTITION BY i ORDER BY pr DESC) - rank() OVER (PARTITION BY i ORDER BY round(mp, 9) DESC)) AS disagreement FROM j")
def market_board(spark, sf_dir):
    b = _board(spark, sf_dir).withColumn("market_probability", F.round("market_probability", 9))
    return V.compare_to_market(b, ["i"]).select("user_id", "i", *r6s("overround", "market_probability", "edge_vs_market_pp"), *longs("disagreement"))


@query(f"""
WITH {_ODDS}, b AS (SELECT *, 250 * kf AS stake FROM j WHERE xv >= 0.05 AND kf > 0), c AS (SELECT stake, CASE WHEN pos = 1 THEN stake * dec ELSE 0 END AS ret FROM b)
SELECT count(*) AS n_bets, round(sum(stake), 6) AS staked, round(sum(ret), 6) AS returned, round(sum(ret - stake), 6) AS profit, round(sum(ret - stake) / sum(stake), 6) AS roi FROM c
""")
def stake_and_settle(spark, sf_dir):
    bets = V.settle(_board(spark, sf_dir).withColumn("won", F.col("pos") == 1), "won")
    return V.staking_report(bets).select("n_bets", *r6s("staked", "returned", "profit", "roi"))


def _u(*parts: str, part: int = 0) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((CAST('0x' || substr(md5({text}), {1 + 8 * part}, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def _z(*parts: str) -> str:
    return f"(sqrt(-2.0 * ln({_u(*parts)})) * cos(6.283185307179586 * {_u(*parts, part=1)}))"


_SEED = 20260913


@query("SELECT p, q, round(CASE WHEN q >= 1 THEN p / 2.1 ELSE c END, 6) AS calm, round(CASE WHEN q >= 1 THEN p ELSE least(c * 2.1, 1) END, 6) AS chaos FROM (SELECT p, q, CASE WHEN p / (1 + q * 1.1) * 2.1 > 1 THEN (p - q) / nullif(1 - q, 0) ELSE p / (1 + q * 1.1) END AS c FROM (SELECT DISTINCT CAST(l_discount AS DOUBLE) * 8 AS p FROM lineitem) a CROSS JOIN (VALUES (0.0::DOUBLE), (0.22::DOUBLE), (1.0::DOUBLE)) t(q))")
def rate_split(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 8).alias("p")).distinct()
    p = p.select("p", F.explode(F.array(F.lit(0.0), F.lit(0.22), F.lit(1.0))).alias("q"))
    calm, chaos = S.split_rate(F.col("p"), F.col("q"), F.lit(2.1))
    return p.select("p", "q", r6(calm, "calm"), r6(chaos, "chaos"))


@query("""
WITH t AS (SELECT vec_id AS target, embedding AS te FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT target, vec_id, round(list_dot_product(embedding::DOUBLE[], te::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(te::DOUBLE[], te::DOUBLE[])), 6) AS similarity FROM embeddings, t WHERE vec_id <> target)
SELECT target, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 5
""")
def embedding_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return temporal.most_similar(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


@query(f"""
WITH {_DAYS}, w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k, count(*) OVER (PARTITION BY user_id) AS c, v AS x, s AS y FROM d),
a AS (SELECT *, CASE WHEN k = 1 THEN lead(x) OVER o - x WHEN k = c THEN x - lag(x) OVER o ELSE (lead(x) OVER o - lag(x) OVER o) / 2 END AS dx, CASE WHEN k = 1 THEN lead(y) OVER o - y WHEN k = c THEN y - lag(y) OVER o ELSE (lead(y) OVER o - lag(y) OVER o) / 2 END AS dy FROM w WINDOW o AS (PARTITION BY user_id ORDER BY i)),
b AS (SELECT *, CASE WHEN k = 1 THEN lead(dx) OVER o - dx WHEN k = c THEN dx - lag(dx) OVER o ELSE (lead(dx) OVER o - lag(dx) OVER o) / 2 END AS ex, CASE WHEN k = 1 THEN lead(dy) OVER o - dy WHEN k = c THEN dy - lag(dy) OVER o ELSE (lead(dy) OVER o - lag(dy) OVER o) / 2 END AS ey FROM a WINDOW o AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, CASE WHEN c >= 5 THEN round(abs(dx * ey - dy * ex) / greatest(pow(dx * dx + dy * dy, 1.5), 1e-9), 6) END AS curvature FROM b
""")
def curvature(spark, sf_dir):
    return temporal.curvature(days(spark, sf_dir), ["user_id"], "i", "v", "s").select("user_id", "i", *r6s("curvature"))


@query(f"""
WITH {_DAYS}, w AS (SELECT user_id, i, v, min(i) OVER (PARTITION BY user_id) AS i0, lead(i) OVER o AS i1, lead(v) OVER o AS v1 FROM d WINDOW o AS (PARTITION BY user_id ORDER BY i)),
g AS (SELECT *, unnest(range(CAST(ceil((i - i0) / 0.5) AS BIGINT), CASE WHEN i1 IS NULL THEN CAST(floor((i - i0) / 0.5) AS BIGINT) + 1 ELSE CAST(ceil((i1 - i0) / 0.5) AS BIGINT) END)) AS k FROM w)
SELECT user_id, i0 + k * 0.5 AS i, round(v + CASE WHEN i1 > i THEN (i0 + k * 0.5 - i) / (i1 - i) ELSE 0 END * (coalesce(v1, v) - v), 6) AS v FROM g
""")
def resample_grid(spark, sf_dir):
    return temporal.resample(days(spark, sf_dir), ["user_id"], "i", ["v"], 0.5).select("user_id", "i", *r6s("v"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k long")["k"].alias("k")
    return table(spark, sf_dir, "events").select(k).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 6) AS o_totalprice FROM orders UNION ALL SELECT -o_orderkey - 1, 0.0 FROM orders WHERE o_orderkey % 300 = 0")
def upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2).unionByName(o.where("o_orderkey % 300 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit(0.0).alias("o_totalprice")))
    return temporal.upsert(o, new, ["o_orderkey"]).select("o_orderkey", *r6s("o_totalprice"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, round(avg(CAST(n_chars > 2000 AS INT)), 6) AS long_share, round(median(n_chars), 6) AS median_chars FROM documents GROUP BY lang")
def data_quality(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), r6(F.avg((F.col("n_chars") > 2000).cast("int")), "long_share"), r6(F.median("n_chars"), "median_chars"))
