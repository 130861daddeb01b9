"""Team and driver pace as random walks seen through timed sessions: forecasts before every event, variances, rankings.

A league (one championship) is one sequence, whose state is as large as its teams and drivers; leagues, and candidate
variances in a fit, run side by side.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .guards import ContractError


@dataclass(frozen=True)
class Variances:
    """In squares of a hundredth of the log of a lap time."""

    team_prior: float = 1.0
    driver_prior: float = 0.4
    team_step: float = 0.05
    driver_step: float = 0.002
    qualifying: float = 0.2
    race: float = 0.3

    def __post_init__(self):
        if not all(math.isfinite(v) and v > 0 for v in astuple(self)):
            raise ValueError("variances must be finite and positive")


#: Numerical bounds of a fitted variance.
BOUNDS = (1e-6, 1e3)


def session_values(results: DataFrame, qualifying: DataFrame) -> DataFrame:
    """(race_id, event_index, season, kind, team, driver, value): every entry of a race for both kinds of session, with
    -100 ln of the lap time where it was timed: first-segment time, or time a lap of those on the lead lap.

    Sessions with fewer than three times have none; a driver with two teams at one event is refused.
    """
    entry = ["race_id", "driver", "team"]
    roster = results.select(*entry).unionByName(qualifying.select(*entry)).distinct()
    if not roster.groupBy("race_id", "driver").count().where("count > 1").isEmpty():
        raise ContractError("a driver has two teams at one event")
    calendar = results.groupBy("race_id").agg(F.first("event_index").alias("event_index"), F.first("season").alias("season"))
    laps = F.col("laps").cast("double")
    lead = (F.col("classified") == 1) & (laps == F.max(laps).over(Window.partitionBy("race_id"))) & (laps > 0)
    timed = qualifying.select("race_id", "driver", F.lit("qualifying").alias("kind"), F.col("q1_s").cast("double").alias("t"))
    timed = timed.unionByName(results.select("race_id", "driver", F.lit("race").alias("kind"), F.when(lead, F.col("total_ms") / (1000 * laps)).alias("t"))).where("t > 0")
    timed = timed.withColumn("n", F.count("*").over(Window.partitionBy("race_id", "kind"))).where("n >= 3")
    kinds = roster.join(F.broadcast(calendar), "race_id").withColumn("kind", F.explode(F.array(F.lit("qualifying"), F.lit("race"))))
    return kinds.join(timed.select("race_id", "driver", "kind", (-100 * F.ln("t")).alias("value")), ["race_id", "driver", "kind"], "left").select("race_id", "event_index", "season", "kind", "team", "driver", "value")


def centred(cov: np.ndarray) -> np.ndarray:
    """Covariance of deviations from the field's mean."""
    if cov.ndim != 2 or cov.shape[0] != cov.shape[1] or not np.isfinite(cov).all() or not np.allclose(cov, cov.T, atol=1e-9):
        raise ValueError("a finite symmetric matrix is required")
    p = np.eye(len(cov)) - 1.0 / len(cov)
    return p @ cov @ p


def contrasts(n: int) -> np.ndarray:
    """An orthonormal basis of differences: n - 1 rows, each of sum 0."""
    return np.linalg.qr(np.column_stack([np.ones(n), np.eye(n)[:, : n - 1]]))[0][:, 1:].T


class League:
    """Mean and covariance of all teams and drivers of a sequence; only those that were seen drift."""

    def __init__(self, rows: pd.DataFrame, v: Variances):
        names = [*(("team", t) for t in sorted(set(rows["team"]))), *(("driver", d) for d in sorted(set(rows["driver"])))]
        self.place, self.v = {n: i for i, n in enumerate(names)}, v
        self.is_team = np.array([kind == "team" for kind, _ in names])
        self.prior = np.where(self.is_team, v.team_prior, v.driver_prior)
        self.step = np.where(self.is_team, v.team_step, v.driver_step)
        self.mean, self.cov = np.zeros(len(names)), np.diag(self.prior)
        self.seen, self.at, self.regime = np.zeros(len(names), bool), None, None

    def advance(self, index: float, regime: str) -> None:
        """Drift to an event; at a change of regime the teams seen so far start anew."""
        if not math.isfinite(index) or self.at is not None and index < self.at:
            raise ValueError("events must come in order")
        self.cov[np.diag_indices_from(self.cov)] += np.where(self.seen, self.step, 0) * (0 if self.at is None else index - self.at)
        if self.regime is not None and regime != self.regime:
            t = self.seen & self.is_team
            self.mean[t] = 0
            self.cov[t] = 0
            self.cov[:, t] = 0
            self.cov[t, t] = self.prior[t]
        self.at, self.regime = index, regime

    def design(self, roster: pd.DataFrame) -> np.ndarray:
        """A row per entry: its team, and its driver less the mean of the team's drivers."""
        teams, drivers = roster["team"].to_numpy(), roster["driver"].to_numpy()
        h = np.zeros((len(roster), len(self.mean)))
        rows, at = np.arange(len(roster)), np.array([self.place["driver", d] for d in drivers])
        h[rows, [self.place["team", t] for t in teams]] = 1
        h[rows, at] = 1
        same = teams[:, None] == teams[None, :]
        h[:, at] -= same / same.sum(axis=1, keepdims=True)
        self.seen |= (h != 0).any(axis=0)
        self.seen[at] = True
        return h

    def observe(self, h: np.ndarray, values: np.ndarray, noise: float) -> float:
        """Update on a session's differences; the negative log-likelihood of what was new in them."""
        c = contrasts(len(values))
        h, y = c @ h, c @ values
        cross = self.cov @ h.T
        s, new = h @ cross + noise * np.eye(len(y)), y - h @ self.mean
        gain = np.linalg.solve(s, cross.T).T
        self.mean = self.mean + gain @ new
        cov = self.cov - gain @ cross.T
        self.cov = (cov + cov.T) / 2
        return 0.5 * float(len(y) * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + new @ np.linalg.solve(s, new))

    def predict(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of the entries' race values, as deviations from the field's mean."""
        m = h @ self.mean
        return m - m.mean(), centred(h @ self.cov @ h.T + self.v.race * np.eye(len(h)))


def _events(rows: pd.DataFrame, v: Variances) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, float]]:
    """Each event's roster, its forecast before any of its sessions, and the sessions' negative log-likelihood."""
    league = League(rows, v)
    for index, event in rows.groupby("event_index", sort=True):
        league.advance(float(index), event["regime"].iloc[0])
        roster = event.drop_duplicates("driver").sort_values("driver")
        mean, cov = league.predict(league.design(roster))
        loss = 0.0
        for kind in ("qualifying", "race"):
            timed = event[(event["kind"] == kind) & event["value"].notna()].sort_values("driver")
            if len(timed) >= 3:
                h = league.design(roster)[roster["driver"].isin(timed["driver"]).to_numpy()]
                loss += league.observe(h, timed["value"].to_numpy(float), getattr(v, kind))
        yield roster, mean, cov, loss


def pace_forecasts(sessions: DataFrame, league: str, variances: Variances) -> DataFrame:
    """(league, event_index, team, driver, strength, covariance, loss) of every event's entries, from earlier events only.

    sessions has (league, event_index, regime, kind, team, driver, value); covariance is the entry's row, in order of
    drivers; loss is the event's negative log-likelihood, the same in all its rows.
    """
    ship_package(sessions.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for roster, mean, cov, loss in _events(rows, variances):
            out.append(pd.DataFrame({league: rows[league].iloc[0], "event_index": roster["event_index"], "team": roster["team"], "driver": roster["driver"], "strength": mean, "covariance": list(cov), "loss": loss}))
        return pd.concat(out, ignore_index=True)

    kind = sessions.schema[league].dataType.simpleString()
    slim = sessions.select(league, F.col("event_index").cast("double").alias("event_index"), "regime", "kind", "team", "driver", F.col("value").cast("double").alias("value"))
    return slim.groupBy(league).applyInPandas(run, f"`{league}` {kind}, event_index double, team string, driver string, strength double, covariance array<double>, loss double")


def losses(sessions: DataFrame, league: str, candidates: list[Variances]) -> DataFrame:
    """(candidate, loss): each candidate's negative log-likelihood over all leagues; a task takes one of one league."""
    ship_package(sessions.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["candidate"].iloc[0])
        return pd.DataFrame({"candidate": [k], "loss": [sum(loss for *_, loss in _events(rows, candidates[k]))]})

    each = sessions.select(league, F.col("event_index").cast("double").alias("event_index"), "regime", "kind", "team", "driver", F.col("value").cast("double").alias("value"), F.explode(F.array(*map(F.lit, range(len(candidates))))).alias("candidate"))
    return each.groupBy(league, "candidate").applyInPandas(run, "candidate int, loss double").groupBy("candidate").agg(F.sum("loss").alias("loss"))


@dataclass(frozen=True)
class VarianceFit:
    variances: Variances
    as_of: float
    n_events: int
    loss: float
    converged: bool
    at_boundary: tuple[str, ...]


def fit_variances(sessions: DataFrame, league: str, as_of: float, rounds: int = 12, factor: float = 4.0) -> VarianceFit:
    """Six variances by a pattern search on earlier events: a round tries each one up and down by a factor, all trials
    in parallel, takes the best move, and halves the factor (of the log) when none is better."""
    past = sessions.where(F.col("event_index") < as_of)
    stats = past.where("value IS NOT NULL").agg(F.countDistinct("event_index"), F.collect_set("kind")).first()
    if stats[0] < 10 or set(stats[1]) != {"qualifying", "race"}:
        raise ContractError("at least ten earlier events and both kinds of sessions are required")
    per = past.where("value IS NOT NULL").groupBy(league, "event_index", "kind").agg(F.var_pop("value").alias("v"))
    scale = max(float(per.agg(F.median("v")).first()[0]), 0.01)
    clip = lambda x: min(max(x, BOUNDS[0]), BOUNDS[1])
    best, loss, size = tuple(clip(scale * x) for x in (1, 0.2, 0.05, 0.005, 1, 0.5)), math.inf, factor
    for _ in range(rounds):
        moves = [best] + [tuple(clip(x * f) if i == k else x for i, x in enumerate(best)) for k in range(6) for f in (size, 1 / size)]
        found = {r["candidate"]: r["loss"] for r in losses(past, league, [Variances(*m) for m in moves]).collect()}
        k = min(found, key=lambda c: (found[c], c))
        moved = found[k] < loss - 1e-9 and k != 0
        best, loss = moves[k], found[k]
        size = size if moved else math.sqrt(size)
        if size < 1.05:
            break
    edge = tuple(f.name for f, x in zip(fields(Variances), best) if x <= 1.01 * BOUNDS[0] or x >= 0.999 * BOUNDS[1])
    return VarianceFit(Variances(*best), float(as_of), int(stats[0]), loss, size < 1.05, edge)


def sample_rankings(forecasts: DataFrame, race: list[str], n_sims: int = 20_000, seed: int = 20260913, chunk: int = 2000, rates: tuple[str, str] | None = None) -> DataFrame:
    """Shares of correlated Gaussian rankings by race and driver: win, podium, top ten, expected finish, finish among
    finishers, quantiles by inverted distribution, retirements and the predicted rank.

    forecasts has (race, team, driver, strength, covariance) and with rates the columns of each team's beta posterior:
    a team's entries share a drawn rate, and draws in which nobody finishes are drawn again.  Retired entries follow
    the others by pace.
    """
    ship_package(forecasts.sparkSession)
    if isinstance(n_sims, bool) or not isinstance(n_sims, int) or n_sims < 1:
        raise ValueError("the number of simulations must be a positive integer")
    extra = {f"__{k}": F.col(c).cast("double") for k, c in zip("ab", rates)} if rates else {}
    entry = F.struct(F.col("driver"), F.col("team"), "strength", "covariance", *[c.alias(k) for k, c in extra.items()])
    fields_ = F.sort_array(F.collect_list(entry)).alias("e")
    chunks = F.explode(F.sequence(F.lit(0), F.lit((n_sims - 1) // chunk))).alias("chunk")
    rows = forecasts.groupBy(*race).agg(fields_).select(*race, "e", chunks)
    rows = rows.repartition(int(forecasts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *race, "chunk")

    def run(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                e = pd.DataFrame(list(r["e"]))
                n, sims = len(e), min(chunk, n_sims - int(r["chunk"]) * chunk)
                rng = np.random.Generator(np.random.PCG64([seed, zlib.crc32(repr([r[c] for c in race]).encode()), int(r["chunk"])]))
                values, vectors = np.linalg.eigh(centred(np.array(e["covariance"].tolist(), float)))
                draws = e["strength"].to_numpy(float) + rng.standard_normal((sims, n)) @ (vectors * np.sqrt(np.maximum(values, 0))).T
                retired = np.zeros((sims, n), bool)
                if rates:
                    teams, first, which = np.unique(e["team"].to_numpy(str), return_index=True, return_inverse=True)
                    a, b = (e[k].to_numpy(float)[first] for k in ("__a", "__b"))
                    again = np.arange(sims)
                    while len(again):
                        retired[again] = rng.random((len(again), n)) < rng.beta(a, b, (len(again), len(teams)))[:, which]
                        again = again[retired[again].all(axis=1)]
                order = np.lexsort((-draws, retired), axis=1)
                place = np.argsort(order, axis=1) + 1
                cell = np.arange(n)[None, :] * n + place - 1
                hits, out = np.bincount(cell.ravel(), minlength=n * n), np.bincount(cell[retired], minlength=n * n)
                at = np.flatnonzero(hits)
                yield pd.DataFrame({**{c: [r[c]] * len(at) for c in race}, "driver": e["driver"].to_numpy()[at // n], "finish": at % n + 1, "field": n, "n": hits[at], "out": out[at]})

    kinds = ", ".join(f"`{c}` {forecasts.schema[c].dataType.simpleString()}" for c in [*race, "driver"])
    cells = rows.mapInPandas(run, kinds + ", finish int, field int, n long, out long").groupBy(*race, "driver", "finish").agg(F.first("field").alias("field"), F.sum("n").alias("n"), F.sum("out").alias("out"))
    run_ = F.col("n") - F.col("out")
    cells = cells.withColumn("cum", F.sum("n").over(Window.partitionBy(*race, "driver").orderBy("finish")))
    share = lambda c, x: F.sum(F.when(c, x).otherwise(0)) / float(n_sims)
    quantile = lambda q: F.min(F.when(F.col("cum") >= q * n_sims, F.col("finish"))).cast("long")
    out = cells.groupBy(*race, "driver").agg(
        share(F.col("finish") == 1, F.col("n")).alias("win_probability"), share(F.col("finish") <= 3, run_).alias("podium_probability"), share(F.col("finish") <= F.least(F.lit(10), F.col("field")), run_).alias("top10_probability"),
        (F.sum(F.col("finish") * F.col("n")) / float(n_sims)).alias("expected_finish"), F.coalesce(F.try_divide(F.sum(F.col("finish") * run_), F.sum(run_)), F.first("field").cast("double")).alias("expected_finish_if_classified"),
        *[quantile(q).alias(f"finish_p{round(100 * q)}") for q in (0.1, 0.5, 0.9)], (F.sum("out") / float(n_sims)).alias("dnf_probability"))
    w = Window.partitionBy(*race)
    return out.withColumn("predicted_rank", F.row_number().over(w.orderBy("expected_finish_if_classified", "driver"))).withColumn("win_rank", F.rank().over(w.orderBy(F.col("win_probability").desc())))
