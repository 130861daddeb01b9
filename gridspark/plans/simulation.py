"""Queries of the simulator: races of twenty suppliers, at the reference's numbers of simulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import simulation
from .catalog import _SEED, _probit, longs, query, r6s, table

_P = simulation.PRIME
_PAIRS = ("start", "strategy", "race", "quali")
_ENTRIES = """
en AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY entry) AS c, count(*) OVER (PARTITION BY race) AS field FROM (
  SELECT CAST(floor(s_suppkey / 20) AS BIGINT) AS race, s_suppkey AS entry, s_acctbal / 5000.0 AS strength, s_acctbal / 6000.0 + s_nationkey / 50.0 AS lap, 0.3 AS sd,
    0.05 + 0.01 * (s_suppkey % 20) AS p, 0.4 AS difficulty, s_nationkey % 4 AS slot_, s_nationkey = 3 AS rookie FROM supplier)),
calm AS (SELECT *, p / (1 + 0.22 * (2.1 - 1)) AS o FROM en), cc AS (SELECT *, CASE WHEN o * 2.1 > 1 THEN (p - 0.22) / (1 - 0.22) ELSE o END AS pc FROM calm)
"""


def _streams(names: list[str], n_sims: int) -> str:
    """si: race, sim, wild and four coefficients <stream>_0 to _3 for each stream."""
    text = lambda name: f"md5('{_SEED}|{name}|' || CAST(race AS VARCHAR) || '|' || CAST(sim AS VARCHAR))"
    part = lambda name, k: f"CAST('0x' || substr({name}_t, {1 + 8 * k}, 8) AS BIGINT)"
    return (
        f"sm AS (SELECT race, unnest(range({n_sims})) AS sim FROM (SELECT DISTINCT race FROM en)), tx AS (SELECT race, sim, {text('chaos')} AS chaos_t, "
        + ", ".join(f"{text(n)} AS {n}_t" for n in names) + f" FROM sm), si AS (SELECT race, sim, ({part('chaos', 0)} + 0.5) / 4294967296.0 < 0.22 AS wild, "
        + ", ".join(f"{part(n, k)} % {_P} AS {n}_{k}" for n in names for k in range(4)) + " FROM tx)"
    )


def _uniform(name: str) -> str:
    h = f"{name}_0"
    for k in (1, 2, 3):
        h = f"(({h} * c + {name}_{k}) % {_P})"
    return f"(({h} + 0.5) / {_P}.0)"


def _normal(name: str) -> str:
    return f"(sqrt(-2.0 * ln({_uniform(name + '1')})) * cos(6.283185307179586 * {_uniform(name + '2')}))"


def _score(p: str) -> str:
    return f"(-{_probit(f'least(greatest({p}, 1e-4), 1 - 1e-4)')})"


_FAILED = f"{_uniform('fail1')} < CASE WHEN wild THEN least(pc * 2.1, 1.0) ELSE pc END AS retired"


def _summary(n: int, pole: bool) -> str:
    return f"""
, c AS (SELECT race, entry, any_value(field) AS field, sum(CAST(finish = 1 AS INT)) / {n}.0 AS win_probability, sum(CAST(finish <= 3 AS INT)) / {n}.0 AS podium_probability, sum(CAST(finish <= least(10, field) AS INT)) / {n}.0 AS top10_probability,
  sum(CAST(retired AS INT)) / {n}.0 AS failure_probability, sum(CAST(grid = 1 AS INT)) / {n}.0 AS pole_probability, sum(finish) / {n}.0 AS expected_finish,
  coalesce(avg(CASE WHEN NOT retired THEN finish END), any_value(field)) AS expected_finish_if_classified, CAST(quantile_disc(finish, 0.1) AS BIGINT) AS finish_p10,
  CAST(quantile_disc(finish, 0.5) AS BIGINT) AS finish_p50, CAST(quantile_disc(finish, 0.9) AS BIGINT) AS finish_p90 FROM r GROUP BY race, entry),
k AS (SELECT race, entry, finish, count(*) AS n FROM r GROUP BY ALL), g AS (SELECT race, entry, unnest(range(1, field + 1)) AS finish FROM c),
h AS (SELECT race, entry, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY finish) AS finish_counts FROM g LEFT JOIN k USING (race, entry, finish) GROUP BY ALL)
SELECT race, entry, round(win_probability, 6) AS win_probability, round(podium_probability, 6) AS podium_probability, round(top10_probability, 6) AS top10_probability, round(failure_probability, 6) AS failure_probability,
  {"round(pole_probability, 6) AS pole_probability," if pole else ""} round(expected_finish, 6) AS expected_finish, round(expected_finish_if_classified, 6) AS expected_finish_if_classified, finish_p10, finish_p50, finish_p90,
  row_number() OVER (PARTITION BY race ORDER BY win_probability DESC, expected_finish_if_classified, entry) AS win_rank, row_number() OVER (PARTITION BY race ORDER BY expected_finish_if_classified, entry) AS predicted_rank, finish_counts
FROM c JOIN h USING (race, entry)
"""


def _race(grid: bool, n: int) -> str:
    names = [f"{p}{k}" for p in _PAIRS if p != "quali" or not grid for k in (1, 2)] + ["fail1"]
    order = "slot_ = 0, slot_, entry" if grid else f"lap + sqrt(0.55 * 0.55 + sd2) * {_normal('quali')} DESC, entry"
    by = "race" if grid else "race, sim"
    return f"""
WITH {_ENTRIES}, {_streams(names, n)}, fa AS (SELECT *, sd * sd + CASE WHEN rookie THEN 0.45 * 0.45 ELSE 0 END AS sd2 FROM cc),
{"fb AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY " + order + ") AS grid FROM fa), q AS (SELECT * FROM fb JOIN si USING (race))" if grid else
 "fb AS (SELECT * FROM fa JOIN si USING (race)), q AS (SELECT *, row_number() OVER (PARTITION BY " + by + " ORDER BY " + order + ") AS grid FROM fb)"},
s AS (SELECT *, {_FAILED}, (0.18 + 0.70 * difficulty) AS g, CASE WHEN field > 1 THEN ({_score("0.5 / field")} - {_score("(field - 0.5) / field")}) / (field - 1) ELSE 0 END AS slot FROM q),
x AS (SELECT race, sim, entry, field, retired, grid, g * ({_score("(grid - 0.5) / field")} + slot * (1.6 * {_normal("start")} + 2.0 * {_normal("strategy")})) + (1 - g) * (strength + sqrt(0.6 * 0.6 + sd2) * {_normal("race")}) AS sc FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY race, sim ORDER BY retired, sc DESC, entry) AS finish FROM x) {_summary(n, not grid)}
"""


def _entries(spark, sf_dir):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        F.floor(key / 20).cast("long").alias("race"), key.alias("entry"), (F.col("s_acctbal") / 5000.0).alias("strength"), (F.col("s_acctbal") / 6000.0 + nation / 50.0).alias("lap"), F.lit(0.3).alias("sd"),
        (0.05 + 0.01 * (key % 20)).alias("p"), F.lit(0.4).alias("difficulty"), (nation % 4).alias("slot_"), (nation == 3).alias("rookie"))


def _shown(out):
    p = [c for c in ("win_probability", "podium_probability", "top10_probability", "failure_probability", "pole_probability", "expected_finish", "expected_finish_if_classified") if c in out.columns]
    return out.select("race", "entry", *r6s(*p), "finish_p10", "finish_p50", "finish_p90", *longs("win_rank", "predicted_rank"), F.array_join(F.transform("finish_counts", lambda x: x.cast("string")), ",").alias("finish_counts"))


@query(_race(False, 20_000))
def monte_carlo_race(spark, sf_dir):
    out = simulation.simulate_race(_entries(spark, sf_dir), "race", "entry", "strength", "sd", "p", "difficulty", one_lap="lap", rookie="rookie")
    return _shown(out)


@query(_race(True, 20_000))
def known_grid_race(spark, sf_dir):
    out = simulation.simulate_race(_entries(spark, sf_dir), "race", "entry", "strength", "sd", "p", "difficulty", grid="slot_", rookie="rookie")
    return _shown(out)


@query(f"""
WITH {_ENTRIES}, {_streams(["gumbel1", "fail1"], 10_000)}, fb AS (SELECT * FROM cc JOIN si USING (race)),
x AS (SELECT race, sim, entry, field, 0 AS grid, {_FAILED}, strength / 1.0 - ln(-ln({_uniform("gumbel1")})) AS sc FROM fb),
r AS (SELECT *, row_number() OVER (PARTITION BY race, sim ORDER BY retired, sc DESC, entry) AS finish FROM x) {_summary(10_000, False)}
""")
def plackett_luce(spark, sf_dir):
    return _shown(simulation.simulate_plackett_luce(_entries(spark, sf_dir), "race", "entry", "strength", "p"))


_SIMPLE = _streams(["pace1", "pace2", "fail1"], 10_000).replace(f"'{_SEED}|", "'42|")


@query(f"""
WITH {_ENTRIES}, {_SIMPLE}, fb AS (SELECT * FROM cc JOIN si USING (race)),
x AS (SELECT race, sim, entry, field, 0 AS grid, {_uniform("fail1")} < least(greatest(p, 0), 0.95) AS retired, strength + sd * {_normal("pace")} AS sc FROM fb),
r AS (SELECT *, row_number() OVER (PARTITION BY race, sim ORDER BY retired, sc DESC, entry) AS finish FROM x) {_summary(10_000, False)}
""")
def simple_race(spark, sf_dir):
    return _shown(simulation.simulate_simple(_entries(spark, sf_dir), "race", "entry", "strength", "p", "sd"))
