"""Queries of calibration as of each race, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import lambdarank
from .catalog import _DAYS, days, longs, query, r6s

# Days stand for races and users for entrants: their mean value is the score, their sum decides.
_HISTORY = f"""
{_DAYS}, hi AS (SELECT i, user_id, v / 20.0 AS score, row_number() OVER (PARTITION BY i ORDER BY s DESC, user_id) AS pos, CAST(n % 7 <> 0 AS INT) AS cl FROM d WHERE v IS NOT NULL),
gr AS (SELECT unnest([{", ".join(map(repr, C.GRID))}])::DOUBLE AS t)
"""
_WON = "lo AS (SELECT i, t, ln(sum(exp((score - mx) / t))) - max(CASE WHEN pos = 1 THEN (score - mx) / t END) AS l FROM (SELECT *, max(score) OVER (PARTITION BY i) AS mx FROM hi), gr GROUP BY ALL)"
# A day whose order ranks nobody has no loss, and is asked for a temperature like any other.
_ORDER = """
fi AS (SELECT i, pos, score - max(score) OVER (PARTITION BY i) AS z, max(pos) OVER (PARTITION BY i) AS last FROM hi WHERE cl = 1),
su AS (SELECT i, t, pos, last, ln(sum(exp(z / t)) OVER (PARTITION BY i, t ORDER BY pos DESC)) - z / t AS l FROM fi, gr), ra AS (SELECT i, t, avg(l) AS l FROM su WHERE pos < last GROUP BY ALL),
lo AS (SELECT e.i, gr.t, ra.l FROM (SELECT DISTINCT i FROM hi) e CROSS JOIN gr LEFT JOIN ra ON ra.i = e.i AND ra.t = gr.t)
"""
_FIT = """
pr AS (SELECT i, t, sum(l) OVER w AS l, count(l) OVER w AS n FROM lo WINDOW w AS (PARTITION BY t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
nb AS (SELECT i, t, n, l / n AS m, lag(l / n) OVER w AS a, lead(l / n) OVER w AS c, ln(lead(t) OVER w) - ln(t) AS h FROM pr WINDOW w AS (PARTITION BY i ORDER BY t)),
be AS (SELECT *, a - 2 * m + c AS bend FROM nb QUALIFY row_number() OVER (PARTITION BY i ORDER BY m, t) = 1),
te AS (SELECT i, n AS n_races, CASE WHEN n < 10 THEN 1 WHEN bend > 1e-15 THEN coalesce(exp(ln(t) + h * (a - c) / (2 * bend)), t) ELSE t END AS temperature FROM be)
"""


def _history(spark, sf_dir):
    d = days(spark, sf_dir).where("v IS NOT NULL")
    pos = F.row_number().over(Window.partitionBy("i").orderBy(F.col("s").desc(), "user_id"))
    return d.select(F.col("i").alias("race"), "i", "user_id", (F.col("v") / 20.0).alias("score"), pos.alias("position_order"), (pos == 1).cast("int").alias("winner"), (F.col("n") % 7 != 0).cast("int").alias("classified"))


@query(f"WITH {_HISTORY}, {_WON}, {_FIT} SELECT i, n_races, round(temperature, 6) AS temperature FROM te")
def asof_calibration(spark, sf_dir):
    return C.asof_temperatures(_history(spark, sf_dir), "race", "i", "score").select("i", *longs("n_races"), *r6s("temperature"))


@query(f"WITH {_HISTORY}, {_ORDER}, {_FIT} SELECT i, n_races, round(temperature, 6) AS temperature FROM te")
def asof_ranking_calibration(spark, sf_dir):
    return C.asof_temperatures(_history(spark, sf_dir), "race", "i", "score", "ranking").select("i", *longs("n_races"), *r6s("temperature"))


@query(f"""
WITH {_HISTORY}, {_WON}, {_FIT}, tt AS (SELECT 'raw' AS model, i, 1.0 AS temperature FROM te UNION ALL SELECT 'winner_calibrated', i, temperature FROM te),
pb AS (SELECT model, i, exp(score / temperature) / sum(exp(score / temperature)) OVER (PARTITION BY model, i) AS p, pos FROM hi JOIN tt USING (i) QUALIFY pos = 1)
SELECT model, count(*) AS n_races, round(avg(-ln(p)), 6) AS winner_logloss FROM pb GROUP BY model
""")
def candidate_losses(spark, sf_dir):
    rows, _, _ = C.compare_candidates(_history(spark, sf_dir), "race", "user_id", "i", "score")
    won = rows.where("winner = 1 AND model <> 'ranking_calibrated'")
    return won.groupBy("model").agg(F.count("*").alias("n_races"), F.round(F.avg(-F.ln("win_probability")), 6).alias("winner_logloss"))


@query(f"""
WITH {_DAYS}, rw AS (SELECT i, user_id, round(v / 20.0, 6) AS s, CAST(n % 4 AS DOUBLE) AS y FROM d WHERE v IS NOT NULL),
rk AS (SELECT *, pow(2, y) - 1 AS gain, row_number() OVER (PARTITION BY i ORDER BY s DESC, user_id) AS r, row_number() OVER (PARTITION BY i ORDER BY y DESC, user_id) AS b FROM rw),
ds AS (SELECT *, CASE WHEN r <= 5 THEN 1 / log2(r + 1) ELSE 0 END AS d, sum(CASE WHEN b <= 5 THEN gain / log2(b + 1) ELSE 0 END) OVER (PARTITION BY i) AS ideal FROM rk),
pa AS (SELECT x.i, x.user_id AS hi, z.user_id AS lo, 1 / (1 + exp(x.s - z.s)) AS p, abs((x.gain - z.gain) * (x.d - z.d)) / x.ideal AS delta FROM ds x JOIN ds z ON x.i = z.i AND x.y > z.y AND least(x.r, z.r) <= 5 WHERE x.ideal > 0),
su AS (SELECT i, user_id, sum(g) AS g, sum(h) AS h FROM (SELECT i, hi AS user_id, p * delta AS g, p * (1 - p) * delta AS h FROM pa UNION ALL SELECT i, lo, -p * delta, p * (1 - p) * delta FROM pa) GROUP BY ALL)
SELECT rw.i, rw.user_id, round(coalesce(g, 0), 6) + 0.0 AS g, round(coalesce(h, 0), 6) AS h FROM rw LEFT JOIN su ON su.i = rw.i AND su.user_id = rw.user_id
""")
def lambda_gradients(spark, sf_dir):
    d = days(spark, sf_dir).where("v IS NOT NULL")
    rows = d.select((F.col("i") * 1_000_000 + F.col("user_id")).cast("long").alias("__id"), "i", "user_id", F.round(F.col("v") / 20.0, 6).alias("s"), (F.col("n") % 4).cast("double").alias("y"))
    out = lambdarank.gradients(rows, "i", "s", "y", 5)
    return out.select("i", "user_id", (F.round("g", 6) + 0.0).alias("g"), *r6s("h"))
