"""Queries of checks and of the older metrics, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import checks, legacy
from .catalog import _DAYS, days, longs, query, r6s, table


@query("""
WITH r AS (SELECT year(o_orderdate) AS season, CAST(o_orderstatus = 'F' AS INT) AS dnf, CASE o_orderkey % 6 WHEN 0 THEN 'Retired' WHEN 1 THEN NULL WHEN 2 THEN '+1 Lap Lapped' ELSE o_orderpriority END AS status FROM orders)
SELECT CAST(season AS BIGINT) AS season, count(*) AS entries, count(*) FILTER (dnf = 1) AS retirements, round(avg(dnf), 6) AS dnf_rate, count(DISTINCT coalesce(status, '')) FILTER (dnf = 1) AS distinct_causes,
  round(coalesce(avg(CAST(coalesce(status, '') IN ('Retired', 'Did not finish', '') AS INT)) FILTER (dnf = 1), 0), 6) AS generic_cause_share, count(*) FILTER (lower(coalesce(status, '')) LIKE '%lapped%') AS lapped_rows,
  round(avg(CAST(dnf = 1 OR lower(coalesce(status, '')) LIKE '%lapped%' AS INT)), 6) AS dnf_rate_if_lapped_counted
FROM r GROUP BY season
""")
def status_quality(spark, sf_dir):
    key = F.col("o_orderkey") % 6
    status = F.when(key == 0, "Retired").when(key == 2, "+1 Lap Lapped").when(key != 1, F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("season"), (F.col("o_orderstatus") == "F").cast("int").alias("dnf"), status.alias("status"))
    out = checks.status_quality(rows)
    return out.select("season", *longs("entries", "retirements"), *r6s("dnf_rate"), *longs("distinct_causes"), *r6s("generic_cause_share"), *longs("lapped_rows"), *r6s("dnf_rate_if_lapped_counted"))


@query(f"""
WITH {_DAYS}, e AS (SELECT i, user_id, v / 40.0 - 1 AS e, 1.0 / n + 0.05 AS v FROM d WHERE v IS NOT NULL),
p AS (SELECT a.i, pow(a.e - b.e, 2) / (a.v + b.v - 0.02) AS z FROM e a JOIN e b ON a.i = b.i AND a.user_id < b.user_id),
c AS (SELECT i, count(*) AS n_entries FROM e GROUP BY i)
SELECT p.i, any_value(n_entries) AS n_entries, count(*) AS n_pairs, round(avg(z), 6) AS mean_square, round(avg(CAST(z <= pow(1.281551566, 2) AS INT)), 6) AS coverage_80, round(avg(CAST(z <= pow(1.959963985, 2) AS INT)), 6) AS coverage_95 FROM p JOIN c USING (i) GROUP BY p.i
""")
def contrast_coverage(spark, sf_dir):
    d = days(spark, sf_dir).where("v IS NOT NULL")
    rows = d.select("i", "user_id", (F.col("v") / 40.0 - 1).alias("e"), (1.0 / F.col("n") + 0.05).alias("v"))
    return checks.contrast_coverage(rows, ["i"], "user_id", "e", "v", F.lit(0.01)).select("i", "n_entries", "n_pairs", *r6s("mean_square", "coverage_80", "coverage_95"))


@query("""
WITH RECURSIVE s AS (SELECT DISTINCT o_custkey % 40 AS field, o_orderkey % 97 AS session, o_custkey AS entry FROM orders),
p AS (SELECT DISTINCT a.field, a.entry AS a, b.entry AS b FROM s a JOIN s b ON a.field = b.field AND a.session = b.session),
r AS (SELECT field, a AS entry, a AS root FROM p UNION SELECT r.field, p.b, r.root FROM r JOIN p ON p.field = r.field AND p.a = r.entry)
SELECT field, count(*) AS n_entries, count(DISTINCT root) AS n_parts FROM (SELECT field, entry, min(root) AS root FROM r GROUP BY ALL) GROUP BY field
""")
def connected_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("field"), (F.col("o_orderkey") % 97).alias("session"), F.col("o_custkey").alias("entry"))
    return checks.connected_fields(o, "field", "session", "entry")


_LEGACY = f"""
{_DAYS}, rw AS (SELECT i, user_id AS k, round(v / 5) AS s, CASE WHEN n % 9 <> 0 THEN CAST(row_number() OVER (PARTITION BY i ORDER BY s DESC, user_id) AS DOUBLE) END AS f, CAST(n AS DOUBLE) AS y,
  CAST(row_number() OVER (PARTITION BY i ORDER BY s DESC, user_id) <= 1 + CAST(i AS INT) % 5 % 2 AS INT) AS w, v AS s2 FROM d WHERE v IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, k) AS r, row_number() OVER (PARTITION BY i ORDER BY y DESC, k) AS b, avg(y) OVER (PARTITION BY i, s) AS tie FROM rw),
rr AS (SELECT i, k, rank() OVER (PARTITION BY i ORDER BY r) AS pr, rank() OVER (PARTITION BY i ORDER BY f) AS pf FROM rk WHERE f IS NOT NULL),
pe AS (SELECT i, CASE WHEN sum(w) = 1 THEN CAST(min(r) FILTER (w = 1) = 1 AS DOUBLE) END AS top1, CASE WHEN sum(w) = 1 THEN CAST(min(r) FILTER (w = 1) <= 3 AS DOUBLE) END AS winner_top3, avg(abs(r - f)) AS rank_mae,
  sum(CASE WHEN r <= 5 THEN tie / log2(r + 1) ELSE 0 END) / sum(CASE WHEN b <= 5 THEN y / log2(b + 1) ELSE 0 END) AS ndcg5 FROM rk GROUP BY i),
sp AS (SELECT i, corr(pr, pf) AS spearman FROM rr GROUP BY i)
"""


def _scored(spark, sf_dir):
    d = days(spark, sf_dir).where("v IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.col("s").desc(), "user_id"))
    return d.select(
        "i", F.col("user_id").alias("k"), F.round(F.col("v") / 5).alias("score"), F.col("v").alias("other"), F.when(F.col("n") % 9 != 0, place.cast("double")).alias("finish_position"),
        F.col("n").cast("double").alias("relevance"), (place <= 1 + F.col("i").cast("int") % 5 % 2).cast("int").alias("winner"))


@query(f"WITH {_LEGACY} SELECT i, top1, winner_top3, round(spearman, 6) AS spearman, round(rank_mae, 6) AS rank_mae, round(ndcg5, 6) AS ndcg5 FROM pe LEFT JOIN sp USING (i)")
def legacy_race_metrics(spark, sf_dir):
    return legacy.ranking_by_race(_scored(spark, sf_dir), "i", "score", "k").select("i", "top1", "winner_top3", *r6s("spearman", "rank_mae", "ndcg5"))


@query(f"WITH {_LEGACY} SELECT count(*) AS n_races, round(avg(top1), 6) AS top1, round(avg(winner_top3), 6) AS winner_top3, round(avg(spearman), 6) AS spearman, round(avg(rank_mae), 6) AS rank_mae, round(avg(ndcg5), 6) AS ndcg5 FROM pe LEFT JOIN sp USING (i)")
def legacy_metrics(spark, sf_dir):
    return legacy.ranking_metrics(legacy.ranking_by_race(_scored(spark, sf_dir), "i", "score", "k")).select("n_races", *r6s(*legacy.METRICS))


@query(f"""
WITH {_LEGACY}, a AS (SELECT i, arg_max(w, r) AS w FROM (SELECT i, w, -row_number() OVER (PARTITION BY i ORDER BY s DESC, k) AS r FROM rw) GROUP BY i), b AS (SELECT i, arg_max(w, r) AS w FROM (SELECT i, w, -row_number() OVER (PARTITION BY i ORDER BY s2 DESC, k) AS r FROM rw) GROUP BY i)
SELECT i, CAST(b.w AS DOUBLE) - CAST(a.w AS DOUBLE) + 0.0 AS delta FROM a JOIN b USING (i)
""")
def legacy_top1_deltas(spark, sf_dir):
    return legacy.top1_deltas(_scored(spark, sf_dir), "i", "score", "other", "k")
