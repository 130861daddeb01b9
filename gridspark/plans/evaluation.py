"""Queries of ranking metrics, calibration, paired tests, gates and price boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V
from .catalog import _FIELD, _ODDS, _SEED, _board, _u, field, longs, query, r6, r6s, table

_GAIN = "(CASE WHEN {r} <= 5 THEN (pow(2.0, rel) - 1) / log2({r} + 1.0) ELSE 0 END)"


def _metrics(source: str, key: str) -> str:
    """m: the metrics by key of source (key, user_id, pos, classified, sc, pr)."""
    mean_rank = lambda c: f"rank() OVER (PARTITION BY {key}, classified ORDER BY {c}) + (count(*) OVER (PARTITION BY {key}, classified, {c}) - 1) / 2.0"
    return f"""
ma AS (SELECT *, CAST(least(greatest(6 - pos, 0), 5) AS DOUBLE) AS rel, pos = 1 AND classified = 1 AS won, row_number() OVER (PARTITION BY {key} ORDER BY sc DESC, CAST(user_id AS VARCHAR)) AS r FROM {source} WHERE sc IS NOT NULL),
mb AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rel DESC, user_id) AS ir, {mean_rank('pos')} AS ap, {mean_rank('r')} AS ar FROM ma),
mc AS (SELECT {key}, count(*) AS n_entries, min(CASE WHEN won THEN r END) AS wr, avg(abs(r - pos)) AS rank_mae, sum({_GAIN.format(r="r")}) / sum({_GAIN.format(r="ir")}) AS ndcg5,
  CASE WHEN count(CASE WHEN classified = 1 THEN 1 END) > 2 THEN corr(CASE WHEN classified = 1 THEN ar END, CASE WHEN classified = 1 THEN ap END) END AS spearman,
  -ln(greatest(sum(CASE WHEN won THEN pr END), 1e-12)) AS winner_logloss, avg(pow(pr - CAST(won AS DOUBLE), 2)) AS winner_brier FROM mb GROUP BY {key}),
m AS (SELECT * EXCLUDE (wr), CAST(wr = 1 AS DOUBLE) AS top1, CAST(wr <= 3 AS DOUBLE) AS winner_top3, CAST(wr AS DOUBLE) AS winner_rank FROM mc WHERE wr IS NOT NULL)
"""


_ONE = f"{_FIELD}, fx AS (SELECT *, pr AS sc FROM f), {_metrics('fx', 'i')}"


@query(f"WITH {_ONE} SELECT i, n_entries, top1, winner_top3, winner_rank, round(rank_mae, 6) AS rank_mae, round(ndcg5, 6) AS ndcg5, round(spearman, 6) AS spearman, round(winner_logloss, 6) AS winner_logloss, round(winner_brier, 6) AS winner_brier FROM m")
def race_metrics(spark, sf_dir):
    out = V.race_metrics(field(spark, sf_dir), ["i"], "user_id", "pr", "pos", "pr", "classified")
    return out.select("i", "n_entries", "top1", "winner_top3", "winner_rank", *r6s("rank_mae", "ndcg5", "spearman", "winner_logloss", "winner_brier"))


# Three ways to predict a day: by mean value, by number of events, by a fixed order of users.
_MODELS = f"""
{_FIELD}, md AS (SELECT CAST(i AS BIGINT) AS i, user_id, pos, classified, model, CASE model WHEN 'mean' THEN v / 20.0 WHEN 'count' THEN n / 1.0 ELSE (user_id * 37 % 101) / 20.0 END AS sc FROM f, (VALUES ('mean'), ('count'), ('fixed')) t(model)),
pm AS (SELECT *, round(exp(sc - max(sc) OVER (PARTITION BY model, i)) / sum(exp(sc)) OVER (PARTITION BY model, i) * exp(max(sc) OVER (PARTITION BY model, i)), 12) AS pr FROM md), {_metrics('pm', 'model, i')},
ps AS (SELECT *, 2022 + i // 8 AS season FROM m)
"""


def _models(spark, sf_dir):
    """(model, i, user_id, pos, classified, sc, pr) of three models, and their metrics with a season."""
    d = field(spark, sf_dir).select(F.col("i").cast("long").alias("i"), "user_id", "pos", "classified", "v", "n")
    fixed = (F.col("user_id") * 37 % 101) / 20.0
    scores = F.array(*[F.struct(F.lit(m).alias("model"), x.alias("sc")) for m, x in (("mean", F.col("v") / 20.0), ("count", F.col("n") / 1.0), ("fixed", fixed))])
    rows = V.softmax(d.select("*", F.inline(scores)), "sc", ["model", "i"]).withColumn("pr", F.round("probability", 12))
    per = V.race_metrics(rows, ["model", "i"], "user_id", "sc", "pos", "pr", "classified").withColumn("season", 2022 + F.floor(F.col("i") / 8))
    return rows, per


_TESTED = ("top1", "ndcg5", "spearman", "rank_mae", "winner_logloss")


def _tests(metrics: tuple[str, ...], draws: int, block: int = 1, prefix: str = "") -> str:
    """<prefix>tt: paired tests of every model against 'mean', by hashed draws of circular blocks within seasons."""
    sn = "season" if block > 1 else "0"
    start = f"CAST(floor({_u(str(_SEED), 'metric', 'b', 'sn', 'CAST(floor(j / w) AS BIGINT)')} * n) AS BIGINT)"
    flat = " UNION ALL ".join(f"SELECT model, i, {sn} AS sn, '{x}' AS metric, {x} AS x FROM ps WHERE {x} IS NOT NULL" for x in metrics)
    p = prefix
    return f"""
{p}fl AS ({flat}), {p}de AS (SELECT a.model, a.metric, a.i, a.sn, a.x - b.x AS delta FROM {p}fl a JOIN {p}fl b ON a.i = b.i AND a.metric = b.metric AND b.model = 'mean' WHERE a.model <> 'mean'),
{p}ro AS (SELECT *, row_number() OVER (PARTITION BY model, metric, sn ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY model, metric, sn) AS n FROM {p}de),
{p}dr AS (SELECT unnest(range({draws})) AS b), {p}pl AS (SELECT model, metric, b, sn, n, k AS j, least({block}, n) AS w FROM {p}ro, {p}dr),
{p}pk AS (SELECT model, metric, b, sn, ({start} + j % w) % n AS k FROM {p}pl), {p}mn AS (SELECT model, metric, b, avg(delta) AS mean FROM {p}pk JOIN {p}ro USING (model, metric, sn, k) GROUP BY ALL),
{p}ci AS (SELECT model, metric, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high, avg(CAST(CASE WHEN metric IN ('rank_mae', 'winner_logloss', 'winner_brier', 'ece') THEN mean < 0 ELSE mean > 0 END AS INT)) AS p_better FROM {p}mn GROUP BY ALL),
{p}tt AS (SELECT model, metric, delta, n_races, ci_low, ci_high, p_better FROM (SELECT model, metric, avg(delta) AS delta, count(*) AS n_races FROM {p}de GROUP BY ALL) JOIN {p}ci USING (model, metric))
"""


_CLEAR = "p_better >= 0.975 AND CASE WHEN metric = 'winner_logloss' THEN ci_high < 0 ELSE ci_low > 0 END"


def _shown(tests):
    return tests.select("model", "incumbent", "metric", *r6s("delta", "ci_low", "ci_high", "p_better"), "n_races")


_SHOWN = "model, 'mean' AS incumbent, metric, round(delta, 6) AS delta, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_better, 6) AS p_better, n_races"


@query(f"WITH {_MODELS}, {_tests(_TESTED, 10_000)} SELECT {_SHOWN} FROM tt")
def paired_table(spark, sf_dir):
    return _shown(V.paired_table(_models(spark, sf_dir)[1], "mean", "i", _TESTED))


@query(f"WITH {_MODELS}, {_tests(('ndcg5',), 10_000)} SELECT {_SHOWN} FROM tt")
def paired_bootstrap(spark, sf_dir):
    return _shown(V.paired_table(_models(spark, sf_dir)[1], "mean", "i", ("ndcg5",)))


@query(f"WITH {_MODELS}, {_tests(('ndcg5',), 10_000, 4)} SELECT {_SHOWN} FROM tt")
def block_bootstrap(spark, sf_dir):
    return _shown(V.paired_table(_models(spark, sf_dir)[1], "mean", "i", ("ndcg5",), block=4, season="season"))


_ECE = """
eb AS (SELECT model, greatest(ceil(round(pr * 10, 9)), 1) AS bin, count(*) AS n, abs(avg(CAST(pos = 1 AND classified = 1 AS INT)) - avg(pr)) AS gap FROM pm WHERE pr BETWEEN 0 AND 1 GROUP BY ALL),
ec AS (SELECT model, sum(gap * n) / sum(n) AS ece FROM eb GROUP BY model)
"""
_GATES = """
ga AS (SELECT ec.model, nr AS n_races, ec.ece AS win_ece, o.ece AS incumbent_win_ece, true AS tests_passed, true AS tuning_only, nr >= 30 AS enough_paired_races, model_.ts AS timestamped_snapshots,
  ec.ece <= o.ece + 1e-12 AS calibration_not_degraded, br.b <= ob.b + 1e-12 AS brier_not_degraded, coalesce(im.ok, false) AS primary_improved
  FROM ec JOIN (SELECT ece FROM ec WHERE model = 'mean') o ON true JOIN (SELECT model, count(DISTINCT i) AS nr, bool_and(model = 'count') AS ts FROM pm GROUP BY model) model_ USING (model)
  JOIN (SELECT model, avg(winner_brier) AS b FROM m GROUP BY model) br USING (model) JOIN (SELECT avg(winner_brier) AS b FROM m WHERE model = 'mean') ob ON true LEFT JOIN im USING (model) WHERE ec.model <> 'mean')
"""
_IMPROVED = f"im AS (SELECT model, bool_or({_CLEAR}) AS ok FROM tt GROUP BY model)"
_NAMES = ("tests_passed", "tuning_only", "enough_paired_races", "timestamped_snapshots", "calibration_not_degraded", "brier_not_degraded", "primary_improved")


def _accepted(spark, sf_dir, blocks: tuple[int, ...]):
    rows, per = _models(spark, sf_dir)
    rows = rows.withColumn("season", 2022 + F.floor(F.col("i") / 8)).withColumn("winner", (F.col("pos") == 1) & (F.col("classified") == 1))
    rows = rows.withColumn("evaluation_scope", F.when(F.col("model") == "count", "timestamped_snapshot").otherwise("retrospective"))
    out = V.acceptance(rows, per, "mean", "i", True, probability="pr", blocks=blocks)
    return out.select("model", "incumbent", "n_races", *r6s("win_ece", "incumbent_win_ece"), *out.columns[5:])


@query(f"WITH {_MODELS}, {_tests(V.PRIMARY, 10_000)}, {_IMPROVED}, {_ECE}, {_GATES} SELECT model, 'mean' AS incumbent, n_races, round(win_ece, 6) AS win_ece, round(incumbent_win_ece, 6) AS incumbent_win_ece, {', '.join(_NAMES)}, {' AND '.join(_NAMES)} AS adopt FROM ga")
def acceptance_gates(spark, sf_dir):
    return _accepted(spark, sf_dir, ())


@query(f"""
WITH {_MODELS}, {_tests(V.PRIMARY, 10_000)}, {_IMPROVED}, {_ECE}, {_GATES}, {_tests(V.PRIMARY, 10_000, 4, 'x')}, {_tests(V.PRIMARY, 10_000, 8, 'y')},
bs AS (SELECT model, bool_or(ok) AS blocks_support FROM (SELECT model, metric, bool_and({_CLEAR}) AS ok FROM (SELECT * FROM xtt UNION ALL SELECT * FROM ytt) GROUP BY ALL) GROUP BY model)
SELECT model, 'mean' AS incumbent, n_races, round(win_ece, 6) AS win_ece, round(incumbent_win_ece, 6) AS incumbent_win_ece, {', '.join(_NAMES)}, blocks_support, {' AND '.join(_NAMES)} AND blocks_support AS adopt FROM ga JOIN bs USING (model)
""")
def chronology_gates(spark, sf_dir):
    return _accepted(spark, sf_dir, (4, 8))


@query(f"""
WITH {_MODELS}, g AS (SELECT model, count(*) AS n, avg(top1) AS p, avg(ndcg5) AS ndcg5, avg(winner_logloss) AS ll FROM m GROUP BY model)
SELECT model, n AS n_races, round(p, 6) AS top1, round(ndcg5, 6) AS ndcg5, round(ll, 6) AS winner_logloss,
  round((p + 3.841458820 / (2 * n)) / (1 + 3.841458820 / n) - 1.959963985 * sqrt(p * (1 - p) / n + 3.841458820 / (4.0 * n * n)) / (1 + 3.841458820 / n), 6) AS top1_low,
  round((p + 3.841458820 / (2 * n)) / (1 + 3.841458820 / n) + 1.959963985 * sqrt(p * (1 - p) / n + 3.841458820 / (4.0 * n * n)) / (1 + 3.841458820 / n), 6) AS top1_high FROM g
""")
def leaderboard(spark, sf_dir):
    per = _models(spark, sf_dir)[1]
    return V.leaderboard(per, "model", ["top1", "ndcg5", "winner_logloss"]).select("model", "n_races", *r6s("top1", "ndcg5", "winner_logloss", "top1_low", "top1_high"))


_GRID = ", ".join(map(repr, V.geometric_grid(0.3, 4.0, 80)))
_LOSSES = f"""
{_FIELD}, g AS (SELECT unnest([{_GRID}]) AS temperature UNION ALL SELECT 1.0),
p AS (SELECT i, temperature, sum(pow(greatest(pr, 1e-12), 1 / temperature)) AS zz, sum(CAST(pos = 1 AS INT)) AS n, max(CASE WHEN pos = 1 THEN greatest(pr, 1e-12) END) AS pw FROM f, g GROUP BY ALL),
lo AS (SELECT CAST(temperature AS DOUBLE) AS temperature, avg(-ln(greatest(pow(pw, 1 / temperature) / zz, 1e-12))) AS loss, count(*) AS n_races FROM p WHERE n = 1 GROUP BY temperature)
"""


@query(f"WITH {_LOSSES} SELECT round(temperature, 6) AS temperature, round(loss, 6) AS loss, n_races FROM lo")
def temperature_grid(spark, sf_dir):
    rows = field(spark, sf_dir).withColumn("won", F.col("pos") == 1)
    return V.fit_temperature(rows, "pr", ["i"], "won", [*V.geometric_grid(0.3, 4.0, 80), 1.0]).select(*r6s("temperature", "loss"), "n_races")


@query(f"""
WITH {_LOSSES}, b AS (SELECT min(loss) AS after, arg_min(temperature, loss) AS t, max(CASE WHEN temperature = 1 THEN loss END) AS before, max(n_races) AS n_races FROM lo)
SELECT round(CASE WHEN after < before THEN t ELSE 1 END, 6) AS temperature, round(before, 6) AS loss_before, round(after, 6) AS loss_after, n_races, after < before AS improved FROM b
""")
def best_temperature(spark, sf_dir):
    rows = field(spark, sf_dir).withColumn("won", F.col("pos") == 1)
    return V.best_temperature(rows, "pr", ["i"], "won").select(*r6s("temperature", "loss_before", "loss_after"), "n_races", "improved")


@query("SELECT bin, n, round(p, 6) AS predicted, round(y, 6) AS observed, round(y - p, 6) AS gap, round(n / sum(n) OVER (), 6) AS weight FROM (SELECT CAST(greatest(ceil(round(l_discount * 100, 9)), 1) AS BIGINT) AS bin, count(*) AS n, avg(l_discount * 10) AS p, avg(CAST(l_returnflag = 'R' AS INT)) AS y FROM lineitem GROUP BY 1)")
def calibration_table(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").alias("y"))
    return V.calibration_table(rows.withColumn("p", F.round("p", 6)), "p", "y").select("bin", "n", *r6s("predicted", "observed", "gap", "weight"))


@query("""
WITH b AS (SELECT CASE WHEN p <= 0.02 THEN 1 WHEN p <= 0.05 THEN 2 WHEN p <= 0.1 THEN 3 WHEN p <= 0.2 THEN 4 WHEN p <= 0.35 THEN 5 WHEN p <= 0.55 THEN 6 ELSE 7 END AS bin, p, y FROM (SELECT round(l_discount * 10, 6) AS p, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)),
t AS (SELECT bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM b GROUP BY bin) SELECT round(sum(gap * n) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM t
""")
def reliability_ece(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") * 10, 6).alias("p"), (F.col("l_returnflag") == "R").alias("y"))
    return V.expected_calibration_error(V.calibration_table(rows, "p", "y", bins=None)).select(*r6s("ece"), "n")


@query(f"""
WITH {_ODDS}, a AS (SELECT i, user_id, round(pr, 9) AS pr, round(mp, 9) AS mp, abs(round(100 * (pr - mp), 9)) AS edge, ov FROM j),
b AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY pr) + (count(*) OVER (PARTITION BY i, pr) - 1) / 2.0 AS x, rank() OVER (PARTITION BY i ORDER BY mp) + (count(*) OVER (PARTITION BY i, mp) - 1) / 2.0 AS y FROM a),
fv AS (SELECT i, user_id, row_number() OVER (PARTITION BY i ORDER BY pr DESC, user_id) AS k, row_number() OVER (PARTITION BY i ORDER BY mp DESC, user_id) AS l FROM a)
SELECT b.i, round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END, 6) AS spearman_vs_market, round(avg(edge), 6) AS mean_abs_edge_pp, round(max(edge), 6) AS max_abs_edge_pp,
  bool_or(k = 1 AND l = 1) AS same_favourite, round(max(ov), 6) AS overround FROM b JOIN fv USING (i, user_id) GROUP BY b.i
""")
def market_agreement(spark, sf_dir):
    b = _board(spark, sf_dir)
    b = b.withColumns({"win_probability": F.round("win_probability", 9), "market_probability": F.round("market_probability", 9), "edge_vs_market_pp": F.round("edge_vs_market_pp", 9)})
    out = V.agreement(b, "user_id", ["i"])
    return out.select("i", *r6s("spearman_vs_market", "mean_abs_edge_pp", "max_abs_edge_pp"), "same_favourite", *r6s("overround"))


@query(f"""
WITH {_ODDS} SELECT i, round(max(ov), 6) AS overround, round(100.0 * (1.0 - 1.0 / max(ov)), 6) AS house_margin_pct, round(avg(abs(100 * (pr - mp))), 6) AS mean_abs_disagreement_pp, round(max(abs(100 * (pr - mp))), 6) AS max_abs_disagreement_pp,
  count(CASE WHEN xv > 0 THEN 1 END) AS selections_with_positive_ev, count(*) AS selections, round(max(xv), 6) AS best_expected_value FROM j GROUP BY i
""")
def market_efficiency(spark, sf_dir):
    out = V.market_efficiency(_board(spark, sf_dir), ["i"])
    return out.select("i", *r6s("overround", "house_margin_pct", "mean_abs_disagreement_pp", "max_abs_disagreement_pp"), *longs("selections_with_positive_ev", "selections"), *r6s("best_expected_value"))
