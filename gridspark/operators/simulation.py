"""Monte Carlo rankings as relations: chunks of simulations of a race's entries, ranked in each simulation and counted.

Chunks are dealt to tasks, each with its race's entries as arrays (a race has a bounded field), and only counts by
(race, entry, place) leave a task.  Random numbers are 4-wise independent between the entries of a simulation: a cubic
polynomial over a prime field, whose coefficients are hashed from seed, stream, race and simulation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, normal_score, overtaking_blend, split_rate
from ..session import ship_package

#: Order of the field that draws are made in.
PRIME = 2147483647
#: Simulations of a race that one task makes together, and how many such chunks are counted before rows leave it.
CHUNK = 500
TOGETHER = 5


@dataclass(frozen=True)
class SimulationSettings:
    n_sims: int = 20_000
    seed: int = 20260913
    qualifying_noise: float = 0.55
    race_noise: float = 0.60
    rookie_noise: float = 0.45
    start_swing: float = 1.6
    strategy_swing: float = 2.0
    chaos_probability: float = 0.22
    chaos_multiplier: float = 2.1

    def __post_init__(self):
        if isinstance(self.n_sims, bool) or not isinstance(self.n_sims, int) or self.n_sims < 1:
            raise ValueError("the number of simulations must be a positive integer")
        noise = (self.qualifying_noise, self.race_noise, self.rookie_noise, self.start_swing, self.strategy_swing)
        if not all(math.isfinite(x) and x >= 0 for x in noise):
            raise ValueError("noise must be finite and not negative")
        if not 0 <= self.chaos_probability <= 1 or not (math.isfinite(self.chaos_multiplier) and self.chaos_multiplier > 0):
            raise ValueError("chaos settings out of range")


#: MD5's constants (RFC 1321): sines, rotations and the word that each of the 64 steps takes.
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_WORDS = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]


def hashed(heads: list[str], tails: range) -> np.ndarray:
    """The MD5 of each head followed by each number, as four 32-bit numbers: heads x tails x 4.

    Texts of one block are hashed together, step by step; longer ones singly.
    """
    heads_, tails_ = [h.encode() for h in heads], [b"%d" % t for t in tails]
    longest = max(map(len, heads_)) + max(map(len, tails_))
    if longest > 55:
        digests = b"".join(hashlib.md5(h + t).digest() for h in heads_ for t in tails_)
        return np.frombuffer(digests, ">u4").astype(np.int64).reshape(len(heads_), len(tails_), 4)
    block = np.zeros((len(heads_), len(tails_), 64), np.uint8)
    sizes = np.array([len(t) for t in tails_])
    for k, h in enumerate(heads_):
        room = 64 - len(h)
        block[k, :, : len(h)] = np.frombuffer(h, np.uint8)
        block[k, :, len(h) :] = np.frombuffer(b"".join([(t + b"\x80").ljust(room, b"\0") for t in tails_]), np.uint8).reshape(-1, room)
        bits = 8 * (len(h) + sizes)
        block[k, :, 56], block[k, :, 57] = bits & 255, bits >> 8
    words = np.ascontiguousarray(block.reshape(-1, 64).view("<u4").astype(np.uint32).T)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += np.uint32(_SINES[i])
        f += words[_WORDS[i]]
        turned = f << np.uint32(_TURNS[i])
        turned |= f >> np.uint32(32 - _TURNS[i])
        turned += b
        a, d, c, b = d, c, b, turned
    out = np.stack([x + y for x, y in zip((a, b, c, d), start)], axis=1)
    return out.byteswap().astype(np.int64).reshape(len(heads_), len(tails_), 4)


class Draws:
    """Random matrices, simulations by entries, of one race; the streams named at first are hashed together."""

    def __init__(self, seed: int, race: object, sims: range, n: int, streams: tuple[str, ...] = ()):
        self.seed, self.race, self.sims = seed, race, sims
        self.c = np.arange(1, n + 1, dtype=np.int64)[None, :]
        self.held = dict(zip(streams, hashed([self._head(s) for s in streams], sims))) if streams else {}

    def _head(self, stream: str) -> str:
        return f"{self.seed}|{stream}|{self.race}|"

    def _hashed(self, stream: str) -> np.ndarray:
        """Four 32-bit numbers for each simulation."""
        return self.held[stream] if stream in self.held else hashed([self._head(stream)], self.sims)[0]

    def uniform(self, stream: str) -> np.ndarray:
        k = self._hashed(stream) % PRIME
        h = k[:, :1]
        for i in (1, 2, 3):
            # The remainder by 2^31 - 1: the bits above the 31st are added to those below.
            h = h * self.c + k[:, i : i + 1]
            h = (h & PRIME) + (h >> 31)
            h = (h & PRIME) + (h >> 31)
            h[h == PRIME] = 0
        return (h + 0.5) / float(PRIME)

    def normal(self, stream: str) -> np.ndarray:
        return np.sqrt(-2.0 * np.log(self.uniform(stream + "1"))) * np.cos(2 * math.pi * self.uniform(stream + "2"))

    def wild(self, probability: float) -> np.ndarray:
        """Whether a simulation is a chaotic one."""
        return (self._hashed("chaos")[:, :1] + 0.5) / 4294967296.0 < probability


#: From a race's arrays and draws: scores, who retires, and starting places (0 where there are none).
Kind = Callable[[pd.Series, Draws], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _cells(entries: DataFrame, race: str, entry: str, fields: dict[str, Column], s: SimulationSettings, kind: Kind, streams: tuple[str, ...]) -> DataFrame:
    """race, entry, finish, field (size), n, out and poles: counts of places, of retirements and of first starts."""
    spark = entries.sparkSession
    ship_package(spark)
    names = list(fields)
    rows = entries.select(race, F.struct(F.col(entry).alias("id"), *[x.alias(k) for k, x in fields.items()]).alias("x"))
    per = rows.groupBy(race).agg(F.sort_array(F.collect_list("x")).alias("e"))
    n = F.size("e").cast("double")
    slot = F.when(n > 1, (normal_score(F.lit(1.0), n) - normal_score(n, n)) / (n - 1)).otherwise(0.0)
    places = F.transform(F.sequence(F.lit(1), F.size("e")), lambda k: normal_score(k.cast("double"), n))
    lists = [F.col(f"e.{f}").alias(f) for f in ("id", *fields)]
    chunks = F.explode(F.sequence(F.lit(0), F.lit((s.n_sims - 1) // (CHUNK * TOGETHER)))).alias("chunk")
    per = per.select(race, slot.alias("slot"), places.alias("places"), *lists, chunks)
    per = per.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), race, "chunk")

    def run(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                size = len(r["id"])
                hits, out, poles = np.zeros((3, size * size))
                first, end = int(r["chunk"]) * CHUNK * TOGETHER, min((int(r["chunk"]) + 1) * CHUNK * TOGETHER, s.n_sims)
                for start in range(first, end, CHUNK):
                    score, retired, grid = kind(r, Draws(s.seed, r[race], range(start, min(start + CHUNK, end)), size, streams))
                    order = np.argsort(-score, axis=1, kind="stable")
                    # Those who retire keep their order behind those who don't.
                    gone = np.take_along_axis(retired, order, 1)
                    behind = np.cumsum(gone, axis=1)
                    place = np.where(gone, size - behind[:, -1:] + behind, np.arange(1, size + 1) - behind) - 1
                    cell = (order * size + place).ravel()
                    hits += np.bincount(cell, minlength=size * size)
                    out += np.bincount(cell[gone.ravel()], minlength=size * size)
                    poles += np.bincount(cell[np.take_along_axis(grid == 1, order, 1).ravel()], minlength=size * size)
                at = np.flatnonzero(hits)
                yield pd.DataFrame({race: [r[race]] * len(at), entry: np.asarray(r["id"])[at // size], "finish": at % size + 1, "field": size, "n": hits[at].astype(np.int64), "out": out[at].astype(np.int64), "poles": poles[at].astype(np.int64)})

    kinds = [f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in (race, entry)]
    cells = per.mapInPandas(run, ", ".join(kinds) + ", finish int, field int, n long, out long, poles long")
    return cells.groupBy(race, entry, "finish").agg(*[F.sum(c).alias(c) for c in ("n", "out", "poles")], F.first("field").alias("field"))


def _failure(failure: str, s: SimulationSettings) -> dict[str, Column]:
    calm, chaos = split_rate(F.col(failure), F.lit(s.chaos_probability), F.lit(s.chaos_multiplier))
    return {"calm": F.coalesce(calm, F.lit(0.0)), "chaos": F.coalesce(chaos, F.lit(0.0))}


def _counts(cells: DataFrame, race: str, entry: str, n_sims: int, pole: bool) -> DataFrame:
    """Probabilities, quantiles by inverted distribution, the histogram of finishes and both rankings."""
    share = lambda x: F.sum(x) / float(n_sims)
    upto = lambda k: share(F.when(F.col("finish") <= k, F.col("n")).otherwise(0))
    below = F.sum("n").over(Window.partitionBy(race, entry).orderBy("finish"))
    cells = cells.withColumn("cum", below)
    quantile = lambda q: F.min(F.when(F.col("cum") >= q * n_sims, F.col("finish"))).cast("long")
    place = F.struct(F.col("finish").alias("finish"), F.col("n").alias("n"))
    held = F.map_from_entries(F.collect_list(place))
    run = F.sum(F.col("n") - F.col("out"))
    out = cells.groupBy(race, entry).agg(
        upto(F.lit(1)).alias("win_probability"), upto(F.lit(3)).alias("podium_probability"), upto(F.least(F.lit(10), F.col("field"))).alias("top10_probability"),
        share(F.col("out")).alias("failure_probability"), share(F.col("poles")).alias("pole_probability"), share(F.col("finish") * F.col("n")).alias("expected_finish"),
        F.when(run > 0, F.sum(F.col("finish") * (F.col("n") - F.col("out"))) / run).otherwise(F.first("field").cast("double")).alias("expected_finish_if_classified"),
        *[quantile(q).alias(f"finish_p{round(100 * q)}") for q in (0.1, 0.5, 0.9)], held.alias("__held"), F.first("field").alias("__field"),
    )
    counts = F.transform(F.sequence(F.lit(1), F.col("__field")), lambda k: F.coalesce(F.element_at("__held", k), F.lit(0).cast("long")))
    w = Window.partitionBy(race)
    out = out.withColumn("finish_counts", counts).drop("__held", "__field")
    out = out if pole else out.drop("pole_probability")
    return out.withColumn("win_rank", F.row_number().over(w.orderBy(F.col("win_probability").desc(), "expected_finish_if_classified", entry))).withColumn(
        "predicted_rank", F.row_number().over(w.orderBy("expected_finish_if_classified", entry)))


def known_grid(entries: DataFrame, race: str, entry: str, grid: str) -> DataFrame:
    """entries with __grid, a dense starting order: 0 and NULL start behind all others, ties by id."""
    g = F.col(grid).try_cast("double")
    return entries.withColumn("__grid", F.row_number().over(Window.partitionBy(race).orderBy(F.when(g > 0, g).asc_nulls_last(), entry)))


def simulate_race(entries: DataFrame, race: str, entry: str, strength: str, spread: str, failure: str, difficulty: str, settings: SimulationSettings = SimulationSettings(), grid: str | None = None, one_lap: str | None = None, rookie: str | None = None) -> DataFrame:
    """Starting order (known, or drawn from the one-lap strength), race pace blended by difficulty, correlated
    retirements and finish counts.  With a known grid there is no pole_probability.

    NULL strengths and spreads count as 0; an entry may be marked as a rookie, whose spread is wider.
    """
    s, zero = settings, F.lit(0.0)
    wide = F.when(F.col(rookie).cast("boolean"), s.rookie_noise**2).otherwise(zero) if rookie else zero
    base = F.coalesce(F.col(strength).cast("double"), zero)
    fields = {
        "strength": base, "lap": F.coalesce(F.col(one_lap).cast("double"), zero) if one_lap else base, "sd2": F.pow(F.coalesce(F.col(spread).cast("double"), zero), 2) + wide,
        **_failure(failure, s), "g": overtaking_blend(F.col(difficulty)),
    }
    if grid:
        entries, fields["fixed"] = known_grid(entries, race, entry, grid), F.col("__grid").cast("double")

    names = list(fields)

    def kind(r: pd.Series, draws: Draws):
        e = {k: np.asarray(r[k], float)[None, :] for k in names}
        if grid:
            place = np.broadcast_to(e["fixed"].astype(np.int64), (len(draws.sims), len(r["id"])))
        else:
            lap = e["lap"] + np.sqrt(s.qualifying_noise**2 + e["sd2"]) * draws.normal("quali")
            place = np.empty(lap.shape, np.int64)
            np.put_along_axis(place, np.argsort(-lap, axis=1, kind="stable"), np.arange(1, lap.shape[1] + 1)[None, :], 1)
        swing = r["slot"] * (s.start_swing * draws.normal("start") + s.strategy_swing * draws.normal("strategy"))
        pace = e["strength"] + np.sqrt(s.race_noise**2 + e["sd2"]) * draws.normal("race")
        score = e["g"] * (np.asarray(r["places"], float)[place - 1] + swing) + (1 - e["g"]) * pace
        return score, draws.uniform("fail1") < np.where(draws.wild(s.chaos_probability), e["chaos"], e["calm"]), place

    streams = ("chaos", "fail1", *(f"{p}{k}" for p in ("start", "strategy", "race", *(() if grid else ("quali",))) for k in (1, 2)))
    return _counts(_cells(entries, race, entry, fields, s, kind, streams), race, entry, s.n_sims, pole=not grid)


def simulate_plackett_luce(entries: DataFrame, race: str, entry: str, strength: str, failure: str, temperature: float = 1.0, settings: SimulationSettings = SimulationSettings(n_sims=10_000)) -> DataFrame:
    """Rankings by strength / temperature plus Gumbel noise, with the same retirements."""
    fields = {"strength": F.coalesce(F.col(strength).cast("double"), F.lit(0.0)), **_failure(failure, settings)}

    names = list(fields)

    def kind(r: pd.Series, draws: Draws):
        e = {k: np.asarray(r[k], float)[None, :] for k in names}
        score = e["strength"] / temperature - np.log(-np.log(draws.uniform("gumbel1")))
        out = draws.uniform("fail1") < np.where(draws.wild(settings.chaos_probability), e["chaos"], e["calm"])
        return score, out, np.zeros(score.shape, np.int64)

    return _counts(_cells(entries, race, entry, fields, settings, kind, ("chaos", "fail1", "gumbel1")), race, entry, settings.n_sims, pole=False)


def simulate_simple(entries: DataFrame, race: str, entry: str, pace: str, failure: str, spread: str, settings: SimulationSettings = SimulationSettings(n_sims=10_000, seed=42)) -> DataFrame:
    """The plain simulator: pace plus normal noise of each entry's spread, and independent retirements."""
    calm = clip(F.coalesce(F.col(failure).cast("double"), F.lit(0.05)), 0.0, 0.95)
    sd = F.greatest(F.coalesce(F.col(spread).cast("double"), F.lit(0.15)), F.lit(0.0))
    fields = {"strength": F.coalesce(F.col(pace).cast("double"), F.lit(0.0)), "sd": sd, "calm": calm}

    names = list(fields)

    def kind(r: pd.Series, draws: Draws):
        e = {k: np.asarray(r[k], float)[None, :] for k in names}
        score = e["strength"] + e["sd"] * draws.normal("pace")
        return score, draws.uniform("fail1") < e["calm"], np.zeros(score.shape, np.int64)

    return _counts(_cells(entries, race, entry, fields, settings, kind, ("pace1", "pace2", "fail1")), race, entry, settings.n_sims, pole=False)


def winner_logloss(simulated: DataFrame, winners: DataFrame, race: str, entry: str) -> DataFrame:
    """logloss and n_races: mean winner log-loss of simulated races."""
    p = F.greatest(F.col("win_probability"), F.lit(1e-12))
    return simulated.join(winners.select(race, entry), [race, entry]).agg(F.avg(-F.ln(p)).alias("logloss"), F.count("*").alias("n_races"))
